"""Character scores by a sweep: against labels of each character, and notes of very many spans."""

import random
import time
from collections import Counter

from cloakwork.operators import evaluate

ROWS = "note_id string, span_start int, span_end int, span_tag string, ordinal int"


def _random(seed, notes=12, most=25):
    r = random.Random(seed)
    return [(f"n{n}", a, a + r.randint(-1, 9), r.choice("ABC"), r.randint(0, 4)) for n in range(notes) for a in (r.randint(-2, 40) for _ in range(r.randint(0, most)))]


def _labels(rows):
    best = {}
    for n, a, b, t, o in rows:
        for pos in range(a, b):
            best[n, pos] = max(best.get((n, pos), (-1, "")), (o, t))
    return {k: t for k, (_, t) in best.items()}


def _brute(gold, predicted):
    g, p = _labels(gold), _labels(predicted)
    tp, fp, fn = Counter(), Counter(), Counter()
    for k in g.keys() | p.keys():
        a, b = g.get(k, "O"), p.get(k, "O")
        if a == b:
            tp[a] += 1
        else:
            fn[a] += 1
            fp[b] += 1
    return {t: (tp[t], fp[t], fn[t]) for t in tp.keys() | fp.keys() | fn.keys() if t != "O"}


def test_equals_labels_of_characters(spark):
    for seed in range(3):
        gold, predicted = _random(seed), _random(seed + 50)
        got = evaluate.char_metrics(spark.createDataFrame(gold, ROWS), spark.createDataFrame(predicted, ROWS)).collect()
        assert {r["tag"]: (r["tp"], r["fp"], r["fn"]) for r in got} == _brute(gold, predicted)


def test_empty_sides(spark):
    rows, none = spark.createDataFrame([("n", 0, 3, "A", 0), ("n", 2, 2, "B", 1)], ROWS), spark.createDataFrame([], ROWS)
    counts = lambda g, p: [(r["tag"], r["tp"], r["fp"], r["fn"]) for r in evaluate.char_metrics(g, p).collect()]
    assert counts(rows, none) == [("A", 0, 0, 3)] and counts(none, rows) == [("A", 0, 3, 0)] and counts(none, none) == []


def test_a_note_of_many_spans(spark):
    """20,000 spans a side in one note; a pass over all spans at each border would take minutes."""
    gold = spark.createDataFrame([("n", 5 * k, 5 * k + 4, "A", k) for k in range(20_000)], ROWS)
    predicted = spark.createDataFrame([("n", 5 * k + 1, 5 * k + 6, "A", k) for k in range(20_000)], ROWS)
    start = time.time()
    r = evaluate.char_metrics(gold, predicted).first()
    # of the 4 characters of a gold span one begins beyond the prediction of the span before
    assert (r["tp"], r["fn"]) == (79_999, 1) and time.time() - start < 30
