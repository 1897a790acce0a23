"""Combinations of models, resolved where a note's spans meet: against each combination by itself."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from cloakwork.operators import evaluate
from cloakwork.operators.spans import resolve_frame

ROWS = "note_id int, span_start int, span_end int, span_tag string, score double, model_name string"


def test_equals_each_combination_by_itself(spark):
    r = random.Random(1)
    rows = [(n, a, a + r.randint(1, 8), r.choice("AB"), r.choice((0.5, 0.9)), r.choice(["m1", "m0", "m2", "other", None])) for n in range(6) for a in (r.randint(0, 30) for _ in range(20))]
    df = spark.createDataFrame(rows, ROWS)
    got = evaluate.power_set(df, ["m1", "m0", "m2"])
    assert got.columns == ["model_name", "note_id", "span_start", "span_end", "span_tag", "score"]
    want = []
    for k in (1, 2, 3):
        for c in combinations(["m0", "m1", "m2"], k):
            want += [("+".join(c), *x) for x in resolve_frame(df.where(F.col("model_name").isin(*c)).drop("model_name")).select(*got.columns[1:]).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_one_exchange_and_no_rows_before_it(spark):
    df = spark.createDataFrame([(1, 0, 2, "A", 0.5, "m0")], ROWS)
    plan = evaluate.power_set(df, ["m0", "m1"])._jdf.queryExecution().executedPlan().toString()
    tail = plan[plan.rindex("Exchange") :]
    assert plan.count("Exchange") == 1 and "Generate" not in tail
    assert evaluate.power_set(df.limit(0), ["m0"]).collect() == []
