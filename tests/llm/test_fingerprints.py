import hashlib
from collections import Counter

import numpy as np
import xxhash
from llm_texts import prose

from cloakwork.llm import fingerprints as fp


def test_difference_recovers_both_sides():
    r = np.random.default_rng(1)
    a, b = [], []
    for n, d in ((0, 0), (5, 0), (50, 3), (400, 100), (3000, 2000), (0, 700)):
        shared = r.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
        a.append(np.concatenate([shared, r.integers(1, 2**63, d, dtype=np.uint64) | np.uint64(1)]))
        b.append(np.concatenate([shared, r.integers(1, 2**63, d // 2, dtype=np.uint64) | np.uint64(1)]))
    for x, y, (p, q) in zip(a, b, fp.difference(a, b)):
        assert set(p.tolist()) == set(x.tolist()) - set(y.tolist())
        assert set(q.tolist()) == set(y.tolist()) - set(x.tolist())


def test_likeness_is_that_of_multisets():
    texts = ["a b.\nc d.\na b.\n", "a b.\na b.\n", "", "zz", prose(4, 500), prose(4, 500) + "\nmore."]
    keys = [fp.digests(t) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            s, t = set(keys[i].tolist()), set(keys[j].tolist())
            want = len(s & t) / len(s | t) if s | t else 1.0
            assert abs(fp.likeness([keys[i]], [keys[j]])[0] - want) < 1e-12
    assert fp.fingerprints(texts[:1], keys[:1]) == fp.fingerprints(texts[:1], keys[:1])
    n, cells = fp.parse(fp.fingerprints(texts[:1], keys[:1])[0])
    assert n == 3 and len(cells) == fp.CELLS and cells["count"].sum() == 9


def test_digests_are_distinct():
    text = " ".join(f"{w}!!" for i in range(300) for w in ("A", "ES", "THE", "OF", "TO"))
    keys = fp.digests(text)
    assert len(set(keys.tolist())) == len(keys) == len(fp.paragraphs(text)) == 1500
    assert fp.likeness([keys], [fp.digests(text + " A!!")])[0] == 1500 / 1501


def hashed(text):
    """Spark's xxhash64."""
    n = xxhash.xxh64_intdigest(text.encode(), 42)
    return n - (1 << 64) if n >> 63 else n


def likeness(a, b):
    """Of multisets of paragraphs."""
    x, y = (Counter(fp.paragraphs(t)) for t in (a, b))
    return (x & y).total() / (x | y).total() if x or y else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hashed(r[1])))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), round(likeness(t, new), 9), round(likeness(t, nxt), 9)))
    return sorted(out, key=str)


def rows_of(got):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=str)


def test_edits_equal_brute_force(odd, none, spark):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    got = fp.edits(odd).collect()
    assert rows_of(got) == brute(rows)
    same = {r["fingerprint"] for r in got if r["doc_id"] in (1, 7)}
    assert len(same) == 1
    assert fp.edits(none).collect() == []
    one = fp.edits(odd.where("doc_id = 8")).collect()
    assert one[0]["near_next"] == 1.0
    ids = "if(id % 3 = 0, null, if(id % 3 = 1, 7, id))"  # two ids that have a third of all rows each
    for doc_id in ("id * 3", ids):
        many = spark.range(500).selectExpr(f"{doc_id} AS doc_id", "concat('line ', id, '.\\nsecond ', id % 7, '.\\n', repeat('same. ', 3)) AS text")
        assert rows_of(fp.edits(many).collect()) == brute([(r["doc_id"], r["text"]) for r in many.collect()])


def test_paragraphs_have_no_more_than_16_words():
    for text in ("a " * 40, " ".join(f"{i:09}" for i in range(40)), "x\n\n y. z", "one two"):
        parts = fp.paragraphs(text)
        assert max(len(p.split()) for p in parts) <= fp.SENTENCE and " ".join(parts).split() == text.split()
