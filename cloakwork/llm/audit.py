"""Filter interaction audit: what each filter removes in every order, and its Shapley value, from one pass over the texts.

A document's mask says which of the k filters it fails. For a part of the table (a source) the removal polynomial

    P(x) = sum over masks m of n(m) * (1 - product over i in m of (1 - x_i))

is the multilinear extension of "documents removed by a set of filters": at a corner, where x is 1 for the filters of a
set and 0 for others, it is the number that this set removes. In powers of x its coefficient at a set T of filters is
(-1)^(|T| + 1) times the number of documents that fail all of T. From these 2^k coefficients follow

* kept, removed, redundant, unique_fails: differences of corner values; no order is run over documents;
* shapley: the integral of the partial derivative along the diagonal, an exact sum of fractions coefficient / |T|,
  times k!, which is a whole number: the filter's removals summed over all orders;
* good_lost, toxic_lost: differences of the corners of the same polynomial of good or toxic documents.

Texts are read once. What meets by exchange are narrow rows: by doc_id with the labels, then by the text's SHA-256 for
the filter of copies, counted before each exchange. A part has 2^k counts, whatever its size.

Defined cases: a null text is empty; a null source and an empty one are the part ""; a null doc_id has no label, is
never a copy of another row, and no row is a copy of it; rows that repeat a doc_id are documents of their own, neither
of which is a copy of the other; a document is good or toxic if any of its labels says so; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping
from fractions import Fraction
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.quality import words
from cloakwork.llm.shared import cut, hot_join

COUNTS = ("n", "good", "toxic")
#: k filters have k! orders and 2^k masks.
MAX_FILTERS = 6


def _shouting(text: Column, words: Column) -> Column:
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text)


#: When a text fails, from it and its words.
FILTERS: Mapping[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": _shouting,
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: The filter of texts that a smaller doc_id has, too.
COPIES = "E"


def failed(docs: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS) -> DataFrame:
    """doc_id, part, key (SHA-256 of the text) and mask (bit i: fails filter i) of docs(doc_id, text, source)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("words", words(F.col("text")))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("key"), sum(bits[1:], bits[0]).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic (0 or 1) by labels(doc_id, quality, toxic)."""
    any_of = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("of")).agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic")).withColumn("real", F.lit(True))
    # rows without doc_id are dealt out by their text, and meet no label
    dealt = rows.withColumns({"of": F.coalesce("doc_id", F.xxhash64("key")), "real": F.col("doc_id").isNotNull()})
    return dealt.join(known, ["of", "real"], "left").select(*rows.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def mask_counts(rows: DataFrame, copies: int | None) -> DataFrame:
    """part, mask, n, good, toxic of rows(doc_id, part, key, mask, good, toxic); copies: the bit of the filter of copies."""
    cell = ["part", "mask", "good", "toxic"]
    if copies is not None:
        # of one text in one part: its rows, and those that fail nothing if this is the text's smallest doc_id
        of_id = rows.groupBy("doc_id", "key", *cell).agg(F.count("*").alias("n"))
        unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
        cells = cut(of_id.groupBy("key", *cell).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("first"), unnamed), "cells")
        least = cells.groupBy("key").agg(F.min("least").alias("of_all"))
        first = F.col("unnamed") + F.when(F.col("least") == F.col("of_all"), F.col("first")).otherwise(0)
        both = F.array(F.struct("mask", first.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << copies)).alias("mask"), (F.col("n") - first).alias("n")))
        rows = hot_join(cells, least, "key").select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    else:
        rows = rows.withColumn("n", F.lit(1))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")))


def polynomials(counts: DataFrame, k: int) -> DataFrame:
    """part, total, and for each of n, good and toxic the removal polynomial: an array whose element T is the
    coefficient of the product of x_i over the bits i of T."""

    def coefficients(c: str) -> Column:
        def failing(t: int) -> Column:
            return F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(t)) == t, F.col(c))), F.lit(0)).cast("long")

        return F.array(F.lit(0).cast("long"), *(failing(t) if t.bit_count() % 2 else -failing(t) for t in range(1, 1 << k)))

    return counts.groupBy("part").agg(F.sum("n").cast("long").alias("total"), *(coefficients(c).alias(c) for c in COUNTS))


def corners(polynomial: Column, k: int) -> Column:
    """The polynomial's values at all 2^k corners: element S is what the filters of S remove."""
    sets = F.array(*(F.lit(s) for s in range(1 << k)))
    within = lambda t, s: t.bitwiseAND(s) == t
    return F.transform(sets, lambda s: F.aggregate(F.arrays_zip(sets.alias("t"), polynomial.alias("c")), F.lit(0).cast("long"), lambda a, x: a + F.when(within(x["t"], s), x["c"]).otherwise(0)))


def shapley(polynomial: Column, k: int) -> Column:
    """k! times each filter's Shapley value.

    Where all x_i are t, the derivative by x_i is the sum of coefficient * t^(|T| - 1) over the sets T with i, whose
    integral from 0 to 1 is the sum of coefficient / |T|.
    """

    def of(i: int) -> Column:
        parts = {t: Fraction(1, t.bit_count()) for t in range(1 << k) if t >> i & 1}
        common = math.lcm(*(p.denominator for p in parts.values()))
        numerator = sum((F.get(polynomial, F.lit(t)) * int(p * common) for t, p in parts.items()), F.lit(0).cast("long"))
        scale = Fraction(math.factorial(k), common)  # whole, for common divides k!
        return numerator * int(scale)

    return F.array(*(of(i) for i in range(k)))


def _steps(letters: str) -> list[dict]:
    """Of every order and step: its filter's bit i, and before: the set of those that came earlier."""
    out = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order, 1):
            out.append({"o": "".join(letters[j] for j in order), "step": step, "i": i, "before": before})
            before |= 1 << i
    return out


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """The audit's rows from part, mask, n, good and toxic; letters name the filters by bit."""
    k = len(letters)
    if not 1 <= k <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters")
    parts = polynomials(counts, k)
    parts = parts.select("part", "total", *(corners(F.col(c), k).alias(c) for c in COUNTS), shapley(F.col("n"), k).alias("values"))
    given = F.from_json(F.lit(json.dumps(_steps(letters))), "array<struct<o: string, step: int, i: int, before: int>>")
    rows = parts.select("*", F.explode(given).alias("s"))
    bit = F.element_at(F.array(*(F.lit(1 << i) for i in range(k))), F.col("s.i") + 1)
    before, after = F.col("s.before"), F.col("s.before") + bit
    lost = lambda c: F.get(c, after) - F.get(c, before)
    every = F.lit((1 << k) - 1)
    return rows.select(
        "part",
        F.col("s.o").alias("filter_order"),
        F.col("s.step").alias("step"),
        (F.col("total") - F.get("n", after)).alias("kept"),
        lost("n").alias("removed"),
        (F.get("n", bit) - lost("n")).alias("redundant"),
        (F.get("n", every) - F.get("n", every - bit)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("values", F.col("s.i")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS, copies: str | None = COPIES) -> DataFrame:
    """One row for each part, order of the filters and step of docs(doc_id, text, source) and labels(doc_id, quality,
    toxic). copies: the letter of the filter of copies, if there is one."""
    letters = "".join(filters) + (copies or "")
    rows = labelled(failed(docs, filters), labels)
    return interactions(mask_counts(rows, len(filters) if copies else None), letters)
