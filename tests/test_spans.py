"""Span algebra against loops written from its description."""

import random

from pyspark.sql import functions as F

from cloakwork.operators import spans as sp
from cloakwork.schema import SPANS

TYPES = ["A", "B"]


def frames(spark, n=150, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        spans = []
        for _ in range(r.randint(0, 12)):
            a = r.randint(0, 40)
            spans.append((r.choice(TYPES), a, a + r.randint(1, 9), r.choice([0.0, 0.5, 0.7, 0.9]), "r", "p"))
        rows.append((i, spans))
    return rows, spark.createDataFrame(rows, f"id long, spans {SPANS}")


def tup(s):
    return (s["entity_type"], s["start"], s["end"], s["score"])


def order(spans):
    return sorted(spans, key=lambda s: (s[1], -s[2], -s[3], s[0]))


def once(spans, by_type):
    kept = {}
    for s in order(spans):
        kept.setdefault((s[1], s[2], s[0] if by_type else None), s)
    return order(kept.values())


def longest(spans):
    kept = []
    for x in spans:
        hit = [k for k in kept if k[1] < x[2] and x[1] < k[2]]
        if not hit:
            kept.append(x)
        elif all(x[2] - x[1] > k[2] - k[1] for k in hit):
            kept = [k for k in kept if k not in hit] + [x]
    return kept


def got(df, column):
    return {r["id"]: [tup(s) for s in r["x"]] for r in df.select("id", column.alias("x")).collect()}


def test_longest_wins(spark):
    rows, df = frames(spark)
    out = got(df, sp.resolve_results(F.col("spans")))
    for i, spans in rows:
        assert out[i] == longest(once([s[:4] for s in spans if s[3] > 0], True))
        assert all(a[2] <= b[1] or b[2] <= a[1] for a in out[i] for b in out[i] if a is not b)
    again = got(df.withColumn("spans", sp.resolve_results(F.col("spans"))), sp.resolve_results(F.col("spans")))
    assert {i: sorted(x) for i, x in again.items()} == {i: sorted(x) for i, x in out.items()}


def test_conflicts_ignore_types(spark):
    rows, df = frames(spark, seed=2)
    out = got(df, sp.resolve_conflicts(F.col("spans")))
    for i, spans in rows:
        assert out[i] == longest(once([s[:4] for s in spans], False))


def test_contained_both_forms(spark):
    rows, df = frames(spark, seed=3)
    df = df.withColumn("spans", sp.dedupe(F.col("spans"), True))
    out = got(df, sp.merge_contained(sp.by_position(F.col("spans"))))
    long = {}
    for r in sp.merge_contained_long(sp.explode_spans(df), "id").collect():
        long.setdefault(r["id"], []).append(tup(r))
    for i, _ in rows:
        assert order(long.get(i, [])) == out[i]


def test_suppress(spark):
    rows, df = frames(spark, seed=4)
    out = got(df, sp.suppress(F.col("spans"), 0.5))
    for i, spans in rows:
        kept = []
        for k in sorted(range(len(spans)), key=lambda k: (-spans[k][3], spans[k][1], spans[k][2], spans[k][0], k)):
            x = spans[k]
            if not any(y[1] < x[2] and x[1] < y[2] and (min(x[2], y[2]) - max(x[1], y[1])) / (max(x[2], y[2]) - min(x[1], y[1])) >= 0.5 for y in (spans[j] for j in kept)):
                kept.append(k)
        assert out[i] == [spans[k][:4] for k in sorted(kept)]


def test_adjacent_and_continuous(spark):
    text = "John  Smith, Anna-Lee x Bob"
    spans = [("P", 0, 4, 0.5, "r", "p"), ("P", 6, 11, 0.9, "r", "p"), ("P", 13, 17, 0.8, "r", "p"), ("P", 18, 21, 0.8, "r", "p"), ("Q", 24, 27, 0.8, "r", "p")]
    df = spark.createDataFrame([(1, text, spans)], f"id long, text string, spans {SPANS}")
    out = got(df, sp.merge_adjacent(F.col("spans"), F.col("text"), ["P"], 2))[1]
    assert out == [("Q", 24, 27, 0.8), ("P", 0, 11, 0.9), ("P", 13, 17, 0.8), ("P", 18, 21, 0.8)]
    out = got(df, sp.merge_continuous(F.col("spans"), F.col("text"), 2))[1]
    assert out == [("P", 0, 21, 0.9), ("Q", 24, 27, 0.8)]


def test_overlap_and_hull(spark):
    df = spark.range(1)
    pair = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    r = df.select(sp.hull_iou(pair(0, 10), pair(5, 15)).alias("h"), sp.span_overlap((F.lit(0), F.lit(10)), (F.lit(5), F.lit(15))).alias("o"), sp.span_overlap((F.lit(3), F.lit(3)), (F.lit(0), F.lit(9))).alias("e")).first()
    assert abs(r["h"] - 1 / 3) < 1e-12 and r["o"] == 0.5 and r["e"] == 0.0
