import random
import re

import numpy as np
import pytest
from llm_texts import prose

from cloakwork.llm import neardup
from cloakwork.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k):
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = [(d, sets(t, k)) for d, t in rows if d is not None]
    for i, (d, a) in enumerate(s):
        for e, b in s[:i]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def chain(n, seed=0):
    """Texts each of which differs from the one before by a few words."""
    r = random.Random(seed)
    words = prose(seed, 150).split()
    out = []
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.random()}"
        out.append(" ".join(words))
    return out


def family(seed, n, least, most, words=120):
    """n texts, each with its own part of one text's words replaced, between two shares."""
    r = random.Random(seed)
    base = [f"{w}{r.randrange(40)}" for w in prose(seed, words).split()]
    out = []
    for _ in range(n):
        w = list(base)
        for i in r.sample(range(words), round(words * r.uniform(least, most))):
            w[i] = f"x{r.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tile", [7, 512])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "BLOCK", tile)
    texts = chain(60, 1) + chain(40, 2) + [prose(s, 90) for s in range(50)] * 2 + ["short one", "Short  ONE", "", None]
    for k in range(6):  # near copies, texts about as alike as a link needs, and texts that only share keys
        texts += family(10 + k, 25, 0, 0.03) + family(10 + k, 12, 0.02, 0.06) + family(20 + k, 20, 0.08, 0.2)
    random.Random(tile).shuffle(texts)
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    want = brute(rows, 4)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got)
    assert all(r["n_shingles"] == len(sets(rows[r["doc_id"]][1], 4)) for r in got)


def test_recall_of_pairs_that_are_barely_linked(spark):
    """400 pairs at 0.80 to 0.95, each of texts of its own: nearly all must be found, and none below 0.8."""
    r = random.Random(9)
    rows, linked = [], 0
    for k in range(400):
        base = [f"a{k}.{i}" for i in range(r.randint(150, 400))]
        n = len(base) - 4  # shingles of five words; a new word at the end of the text changes one, then one more each
        cut = round(n * (1 - r.uniform(0.8, 0.95) * 2 / (1 + r.uniform(0.8, 0.95))) / 1)
        other = base[: len(base) - max(1, cut)] + [f"b{k}.{i}" for i in range(max(1, cut))]
        a, b = sets(" ".join(base), 5), sets(" ".join(other), 5)
        linked += 100 * len(a & b) >= 80 * len(a | b)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    found = [k for k in range(400) if got[2 * k] == got[2 * k + 1]]
    assert linked > 100 and len(found) >= 0.995 * linked
    assert all(100 * len(sets(text[2 * k], 5) & sets(text[2 * k + 1], 5)) >= 80 * len(sets(text[2 * k], 5) | sets(text[2 * k + 1], 5)) for k in found)


def test_comparisons_grow_with_the_group(spark, monkeypatch):
    """Near copies about as alike as a link needs, and a long chain of texts each of which is somewhat like the one before."""
    r = random.Random(4)
    words = [f"c{i}" for i in range(200)]
    drift = []
    for k in range(300):
        at = r.randrange(170)
        words[at : at + 30] = [f"d{k}.{i}" for i in range(30)]
        drift.append(" ".join(words))
    made = []
    whole = neardup.compare
    monkeypatch.setattr(neardup, "compare", lambda pairs, *rest: made.append(pairs.count()) or whole(pairs, *rest))
    for texts, groups in ((family(5, 500, 0, 0.012), 1), (drift, 250)):
        made.clear()
        found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        kept = found.where("kept").count()
        assert (kept == 1 if groups == 1 else kept >= groups) and sum(made) < 6 * len(texts), (kept, made)


def test_texts_that_share_a_doc_id(spark):
    """A document of several texts has the links of all of them, whichever text its rows come with."""
    a, b, c = (family(30 + k, 4, 0, 0.01) for k in range(3))
    rows = [(1, a[0]), (1, b[0]), (2, b[1]), (3, a[1]), (4, c[0]), (9, c[1]), (9, b[2]), (7, prose(70, 90)), (7, prose(71, 90)), (8, prose(71, 90))]
    for order in (rows, rows[::-1]):
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(5)).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 1, 7: 7, 8: 7}
    assert {r["doc_id"] for r in neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 7}


def test_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[7]["component_id"] == 1 and not by[7]["kept"]
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0 and by[2]["component_id"] == 2
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert neardup.near_duplicates(none).collect() == []
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "1", "2", "3", "4", "5", "6", "8", "None", "None"])


def test_collision_probability():
    assert (1 - (1 - 0.8**neardup.ROWS) ** neardup.BANDS) ** 2 > 0.999
    a = neardup.band_values(np.arange(1, 400, dtype=np.uint64))
    assert len(a) == 2 * neardup.BANDS and (a[: neardup.BANDS] % 2 == 0).all() and (a[neardup.BANDS :] % 2 != 0).all()


def test_components_equal_union_find(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(r.randrange(300, 900), r.randrange(300, 900)) for _ in range(350)] + [(1000, k) for k in range(1001, 1200)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(a != b for a, b in edges if x in (a, b))}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_of_single_short_chains(spark):
    chains = [[1, 4, 3, 5, 2]]
    for seed in range(4):
        nodes = list(range(1, 7))
        random.Random(seed).shuffle(nodes)
        chains.append(nodes)
    for nodes in chains:
        got = components(spark.createDataFrame(list(zip(nodes, nodes[1:])), "u long, v long")).collect()
        assert sorted((r["id"], r["component"]) for r in got) == [(n, 1) for n in sorted(nodes)], nodes
