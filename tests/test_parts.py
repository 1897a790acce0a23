"""Parts of names and addresses: forms written by hand."""

from pyspark.sql import functions as F

from cloakwork.operators import address_parts as addresses
from cloakwork.operators.name_parts import name_parts
from cloakwork.plans.parts_queries import ADDRESS_FORMS, NAME_FORMS


def test_name_forms(spark):
    forms = [tuple(None if x is None else x.replace("@", "Smith") for x in f) for f in NAME_FORMS]
    df = spark.createDataFrame([(f[0],) for f in forms], "n string")
    assert {r["n"]: tuple(r["p"]) for r in df.select("n", name_parts(F.col("n")).alias("p")).collect()} == {f[0]: f[1:] for f in forms}


def test_every_token_of_a_name_is_in_one_part(spark):
    texts = ["MD", ",", " , ,", "Jr. Jr. Jr.", "van de la", "Smith, , Dr. Dr.", "A B C, MD, D E", "X, MD van Y, PhD Z", "a " * 500]
    df = spark.createDataFrame([(t,) for t in texts], "n string")
    for r in df.select("n", name_parts(F.col("n")).alias("p")).collect():
        assert sorted(" ".join(p for p in r["p"] if p).split()) == sorted(r["n"].replace(",", " ").split()), r


def test_address_forms(spark):
    forms = [tuple(None if x is None else x.replace("@", "123") for x in f) for f in ADDRESS_FORMS]
    df = spark.createDataFrame([(f[0],) for f in forms], "a string")
    found = {r["a"]: tuple(r["p"]) for r in df.select("a", addresses.address_parts(F.col("a")).alias("p")).collect()}
    assert found == {f[0]: (*f[1:], bool(f[0])) for f in forms}


def _viterbi(classes):
    """Brute force: the best of all ways, by the same scores."""
    emitted, to, ends = addresses._model()
    best = {(): 0}
    for c in classes:
        best = {(*way, j): s + to[j][way[-1] if way else len(to)] + emitted[c][j] for way, s in best.items() for j in range(len(to))}
    return max(s + ends[way[-1]] for way, s in best.items()), emitted, to, ends


def test_tags_are_a_best_way(spark):
    texts = ["12 Oak St", "Reno, NV 89501", "N N N", "PO Box 7 Rd", "5 St St CT"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    for r in df.select("a", addresses.tags(F.col("a")).alias("t")).collect():
        classes = [addresses._class_of(x["token"]) for x in r["t"]]
        way = [addresses.LABELS.index(x["label"]) for x in r["t"]]
        most, emitted, to, ends = _viterbi(classes)
        score = sum(to[j][i] + emitted[c][j] for i, j, c in zip([len(to), *way], way, classes)) + ends[way[-1]]
        assert score == most, r


def test_made_addresses_are_told(spark):
    made = [m for i, m in enumerate(addresses.made_addresses()) if i % 20 == 7]
    df = spark.createDataFrame([(i, " ".join(t for t, _ in m)) for i, m in enumerate(made)], "i int, a string")
    rows = df.select("i", addresses.tags(F.col("a")).alias("t")).collect()
    right = [x["label"] == label for r in rows for x, (_, label) in zip(r["t"], made[r["i"]])]
    assert sum(right) > 0.9 * len(right)
    odd = spark.createDataFrame([(" ",), (",,",), ("x " * 300,)], "a string").select("a", addresses.tags(F.col("a")).alias("t")).collect()
    assert [len(r["t"]) for r in odd] == [0, 2, 300]
