"""Pattern dictionaries: native spans against the loop over rules, required literals, what runs where."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cloakwork.operators.dictionary import Dictionary, dictionary, java_pattern, required_literals
from cloakwork.plans.dictionary_queries import CLINIC, FORMS, WORDS


def _native(spark, config, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    rows = df.select("i", dictionary(F.col("t"), config).alias("s")).collect()
    return [[s.asDict() for s in r["s"]] for r in sorted(rows)]


def test_required_literals():
    assert required_literals(r"\bHarbor\s+Clinic\b") == ({"Harbor"}, False)
    assert required_literals(r"(?:ICU|NICU)-\d") == ({"ICU", "NICU"}, False)
    assert required_literals(r"a?(?:bc)+d*") == ({"bc"}, False)
    assert required_literals(r"(?i:ab)\d")[1] and required_literals(r"(?i)ab")[1]
    assert required_literals(r"\d{4}|abc")[0] is None and required_literals(r"(?!abc)\w")[0] is None
    assert java_pattern(r"(?P<a>x)\\Z(?P=a)\Z") == r"(?dU)(?<a>x)\\Z\k<a>\z"


def test_every_match_holds_a_required_literal():
    for rule in Dictionary(CLINIC).rules + Dictionary(WORDS).rules:
        for text, _ in FORMS:
            for m in rule.compiled.finditer(text or ""):
                assert any(w.lower() in m[0].lower() if rule.any_case else w in m[0] for w in rule.literals)


def test_forms_by_hand(spark):
    got = _native(spark, CLINIC, [t for t, _ in FORMS])
    assert [[(s["start"], s["end"], s["entity_type"], s["pattern"]) for s in spans] for spans in got] == [list(spans) for _, spans in FORMS]


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_loop_over_rules(spark, seed):
    """Random rules and texts of few letters, so that hits often hold, equal and overlap one another."""
    pick = random.Random(seed)
    parts = ["a", "b", "ab", "b+", "(?:a|c)", "[ab]{1,3}", r"\b", "c.", ",", "a*b", "(?P<x>a|b)(?P=x)", r"(b)\1", "c$", r"a\Z", "^a"]
    rules = []
    while len(rules) < 12:
        p = "".join(x for x in pick.sample(parts, pick.randint(1, 3)))
        try:
            Dictionary({"institution": "R", "rules": [{"pattern": p, "score": 0.5}]})
        except ValueError:
            continue
        rules.append({"pattern": p, "score": 0.5, "label": f"{len(rules)}:{p}", "flags": pick.sample(["IGNORECASE", "MULTILINE", "DOTALL"], pick.randint(0, 3)), "category": pick.choice(["url", "location", "x"])})
    config = {"institution": "R", "rules": rules}
    texts = ["".join(pick.choices("aabbcABC,. \nä", k=pick.randint(0, 30))) for _ in range(300)]
    loop = Dictionary(config)
    assert _native(spark, config, texts) == [loop.spans(t) for t in texts]


def test_null_empty_and_no_rules(spark):
    assert _native(spark, WORDS, [None, "", "the"])[:2] == [[], []]
    assert _native(spark, {"institution": "N", "rules": []}, ["the"]) == [[]]


def test_faulty_rules():
    for bad in ({"pattern": "a*"}, {"pattern": r"\b"}, {"pattern": "(?a)x"}, {"flags": ["A"]}, {"score": True}):
        with pytest.raises(ValueError):
            Dictionary({"institution": "X", "rules": [{"pattern": "a", "score": 0.5, **bad}]})


def test_native_and_long(spark):
    df = spark.createDataFrame([("of the x " * 4000,)], "t string").select(F.size(dictionary(F.col("t"), WORDS)).alias("n"))
    assert "Python" not in df._jdf.queryExecution().toString()
    start = time.time()
    assert df.first()["n"] == 4000
    assert time.time() - start < 30
