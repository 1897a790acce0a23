import random
import re
from fractions import Fraction
from itertools import permutations

from llm_texts import prose
from pyspark.sql import functions as F

from cloakwork.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    w = WORD.findall(text)
    return {
        "A": len(w) < 200,
        "B": 100 * len(set(w)) < 50 * len(w),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def brute(rows, labels):
    """Every order is run, filter after filter, over rows (doc_id, text, source)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    judged = []
    for d, text, source in rows:
        text = text or ""
        bad = {k for k, v in fails(text).items() if v}
        if d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in rows):
            bad.add("E")
        judged.append((source or "", d, bad))
    out = {}
    for part in {p for p, _, _ in judged}:
        mine = [(d, bad) for p, d, bad in judged if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                removed = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                total[x] += len(removed)
                ids = [d for d, _ in removed]
                redundant = sum(x in bad for _, bad in mine) - len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(bad == {x} for _, bad in mine), sum(d in good for d in ids), sum(d in toxic for d in ids)]
        for key, row in out.items():
            if key[0] == part:
                row.append(total[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def collected(df):
    rows = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}
    return rows


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = prose(r.randrange(n // 2), r.choice([20, 250, 400]))
        if r.random() < 0.3:
            t = t.upper() if r.random() < 0.5 else t + " #$"
        if r.random() < 0.4:
            t = " ".join(t.split() + [f"w{r.random()}" for _ in range(r.choice([5, 300]))])
        out.append(t)
        if r.random() < 0.3:
            out.append(t)
    return out


def test_equals_every_order_run(spark):
    r = random.Random(3)
    rows = [(i, t, r.choice(["a", "a", "a", "b", None, ""])) for i, t in enumerate(texts(1, 80))]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 0, 1, None])) for i in range(0, 90) if r.random() < 0.7] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    got = audit.audit(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, LABELS))
    want = brute(rows, labels)
    assert got.count() == len(want) == len({s or "" for _, _, s in rows}) * 600
    assert collected(got) == want


def test_odd_rows(spark, odd, none):
    labels = [(1, 1, 0), (2, None, 1), (4, 0, 1), (None, 1, 1)]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.select("doc_id", "text", "source").collect()]
    known = spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("x"))
    assert collected(audit.audit(odd, known)) == brute(rows, labels)
    assert audit.audit(none, known).count() == 0
    assert collected(audit.audit(odd, known.limit(0))) == brute(rows, [])


def test_values_are_those_of_the_game(spark):
    """Shapley values by their definition over subsets, for counts of any masks and three filters."""
    k, r = 3, random.Random(5)
    n = {m: r.randrange(1000) for m in range(1 << k)}
    counts = spark.createDataFrame([("p", m, c, c // 2, c // 3) for m, c in n.items()], "part string, mask int, n long, good long, toxic long")
    rows = audit.interactions(counts, "XYZ").collect()
    value = lambda s: sum(c for m, c in n.items() if m & s)
    assert len(rows) == 6 * 3
    for x in rows:
        i = "XYZ".index(x["filter_order"][x["step"] - 1])
        others = [s for s in range(1 << k) if not s >> i & 1]
        weight = {0: Fraction(1, 3), 1: Fraction(1, 6), 2: Fraction(1, 3)}
        assert x["shapley"] == 6 * sum(weight[s.bit_count()] * (value(s | 1 << i) - value(s)) for s in others)
    for order in {x["filter_order"] for x in rows}:  # all that is removed is shared out
        assert sum(x["shapley"] for x in rows if x["filter_order"] == order) == 6 * value(7)


def test_one_filter_and_none_of_copies(spark):
    rows = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s"), (3, prose(1, 300), "s")], "doc_id long, text string, source string")
    got = audit.audit(rows, spark.createDataFrame([], LABELS), {"A": audit.FILTERS["A"]}, copies=None).collect()
    assert [(r["filter_order"], r["kept"], r["removed"], r["shapley"]) for r in got] == [("A", 1, 2, 2)]


def test_texts_are_read_once_and_rows_are_narrow(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = audit.labelled(audit.failed(docs), spark.createDataFrame([], LABELS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange[^\n]*text", plan) and "Python" not in plan
