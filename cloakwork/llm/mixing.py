"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks. Block k of a source with weight w is released at slot floor(k / w) and due at
slot ceil((k + 1) / w); in each slot the released block with the earliest deadline goes, so that after t slots a
source that still has blocks has had more than t*w - 1 and fewer than t*w + 1 of them. Weights are exact fractions, so
that the bound holds against the weights themselves: brought to one denominator they are whole shares, and the
schedule repeats after as many slots as there are shares. A table with a row for each slot of that period turns the
number of a block into its slot. All else are DataFrame operations.

Weights are whole numbers, fractions, decimals, or floats, which count as the decimals they are written as. Without
given weights a source's target is the whole part of the square root of its documents (see tempered), so the period
grows with the root of the data. A long period is computed in a task, which holds one number for each source, and
written to the shared folder. More than MAX_PERIOD slots (weights with very many digits) are an error; rounded() shortens
such weights.

Within a source the order is that of md5(doc_id). Ranks come from windows over (source, first digits of the md5)
and from the counts of those groups; there are as many digits as it takes for groups of about GROUP documents, so a
source with any part of all rows is split over many tasks. Whole rows move once for their rank, and once more if they
are put in order.

No row is dropped: once a source has no more blocks its slots stay empty, and the others go on in theirs.
Defined cases: a null source is a source of its own; a null doc_id comes first in its source; equal rows each take a
place; an empty table gives no rows; a source without a weight above 0 is an error; other columns are kept by mix() and
names never clash with its own.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator, Mapping
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.shared import cut, free_name

Weight = int | float | Decimal | Fraction

#: Sources and slots of a period at most, and documents of a group with the same first digits, about.
MAX_SOURCES, MAX_PERIOD, GROUP = 20_000, 1 << 28, 500
#: A schedule of so many slots at most is a literal and broadcast; a longer one is a table and joined by exchange.
LITERAL_SLOTS = 100_000
#: Rows that the task of a long period gives at a time.
BATCH = 1 << 16


def shares(weights: Mapping[str | None, Weight]) -> dict[str | None, int]:
    """Whole shares in exactly the proportion of the weights."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if bad := [s for s, w in exact.items() if w <= 0]:
        raise ValueError(f"weights must be above 0, unlike those of {bad[:5]}")
    whole = math.lcm(*(w.denominator for w in exact.values()))
    out = {s: w.numerator * (whole // w.denominator) for s, w in exact.items()}
    common = math.gcd(*out.values())
    if sum(out.values()) // max(1, common) > MAX_PERIOD:
        raise ValueError(f"the weights' period has more than {MAX_PERIOD} slots; shorten them with rounded()")
    return {s: n // max(1, common) for s, n in out.items()}


def rounded(weights: Mapping[str | None, Weight], digits: int = 6) -> dict[str | None, Decimal]:
    """Weights as shares of 1 with so many digits, one unit of the last at least."""
    total, unit = sum(Fraction(str(w)) for w in weights.values()), 10**digits
    return {s: Decimal(max(1, round(Fraction(str(w)) / total * unit))) / unit for s, w in weights.items()}


def _picks(share: Mapping[str | None, int], order: list[str | None]) -> Iterator[tuple[int, int]]:
    """(number of the source in order, its block in the period) of each slot."""
    period = sum(share.values())
    waiting = [(0, i, 0) for i in range(len(order))]  # (release, source, block)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, block)
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // share[order[i]]), i, k))
        _, i, k = heapq.heappop(ready)
        yield i, k
        if k + 1 < share[order[i]]:
            heapq.heappush(waiting, ((k + 1) * period // share[order[i]], i, k + 1))


def _order(share: Mapping[str | None, int]) -> list[str | None]:
    return sorted(share, key=lambda s: (s is not None, s or ""))


def schedule(share: Mapping[str | None, int]) -> list[tuple[str | None, int, int]]:
    """(source, its block in the period, slot) of one period, by earliest deadline among released blocks."""
    order = _order(share)
    return [(order[i], k, slot) for slot, (i, k) in enumerate(_picks(share, order))]


def _key(source: str | None) -> str:
    return "-" if source is None else f"+{source}"


def _table(spark: SparkSession, share: Mapping[str | None, int]) -> DataFrame:
    """s (a source's key), i, at, n: the schedule of one period, and each source's share."""
    if sum(share.values()) > LITERAL_SLOTS:
        return _long_table(spark, share)
    slots: dict[str | None, list[int]] = {s: [] for s in share}
    for s, _, slot in schedule(share):
        slots[s].append(slot)
    given = F.lit(json.dumps([{"s": _key(s), "n": share[s], "slots": at} for s, at in slots.items()]))
    table = spark.range(1).select(F.inline(F.from_json(given, "array<struct<s: string, n: long, slots: array<long>>>")))
    return table.select("s", "n", F.posexplode("slots").alias("i", "at"))


def _long_table(spark: SparkSession, share: Mapping[str | None, int]) -> DataFrame:
    """The same as a table in the shared folder, made by one task in one pass over the slots."""
    order = _order(share)
    keys, n = [_key(s) for s in order], [share[s] for s in order]

    def run(_):
        import pyarrow as pa

        rows: list[tuple[int, int]] = []

        def batch(first: int) -> pa.RecordBatch:
            of = [i for i, _ in rows]
            names = pa.DictionaryArray.from_arrays(pa.array(of, pa.int32()), pa.array(keys)).cast(pa.string())
            at = pa.array(range(first, first + len(rows)), pa.int64())
            return pa.RecordBatch.from_arrays([names, pa.array([n[i] for i in of], pa.int64()), pa.array([k for _, k in rows], pa.int32()), at], ["s", "n", "i", "at"])

        first = 0
        for pick in _picks(share, order):
            rows.append(pick)
            if len(rows) == BATCH:
                yield batch(first)
                first += len(rows)
                rows.clear()
        yield batch(first)

    return cut(spark.range(0, 1, 1, 1).mapInArrow(run, "s string, n long, i int, at long"), "schedule")


def sizes(docs: DataFrame) -> dict[str | None, int]:
    """Rows of the sources, whose number is bounded by MAX_SOURCES."""
    rows = docs.groupBy("source").count().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; pass weights by a coarser column")
    return {r["source"]: r["count"] for r in rows}


def tempered(rows: Mapping[str | None, int]) -> dict[str | None, int]:
    """The whole part of the square root of each source's rows, exactly; shares() refuses more than MAX_PERIOD slots, which
    takes more than 3.6e12 rows in 20,000 sources."""
    return {s: math.isqrt(n) for s, n in rows.items()}


def mix(docs: DataFrame, weights: Mapping[str | None, Weight] | None = None, block: int = 8) -> DataFrame:
    """docs with source_rank, block, slot and place (slot * block size + rank in the block), which replace columns of
    these names."""
    spark = docs.sparkSession
    docs = docs.drop("source_rank", "block", "slot", "place")
    rows = sizes(docs)
    if not rows:
        return docs.select("*", *(F.lit(None).cast("long").alias(c) for c in ("source_rank", "block", "slot", "place")))
    if weights is not None and (lost := [s for s in rows if s not in weights]):
        raise ValueError(f"sources without a weight: {lost[:5]}")
    share = shares(tempered(rows) if weights is None else weights)
    period = sum(share.values())
    digits = min(8, max(0, math.ceil(math.log(max(1, max(rows.values()) / GROUP), 16))))
    s, g, h, before, rank, i, at, n = (free_name(docs.columns, f"__{x}") for x in ("s", "g", "h", "before", "rank", "i", "at", "n"))
    # a key that is never null, so that the window, the counts and the slots meet by one exchange of the rows
    source = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-"))
    keyed = docs.withColumns({s: source, h: F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))}).withColumn(g, F.substring(h, 1, digits))
    groups = keyed.groupBy(s, g).count()
    ahead = Window.partitionBy(s).orderBy(g).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(s, g, F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias(before))
    ranked = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(s, g).orderBy(h, "doc_id")) - 1)
    ranked = ranked.join(groups, [s, g]).withColumn(rank, F.col(rank) + F.col(before))
    plan = _table(spark, share)
    own = F.broadcast(plan.where("i = 0").select(F.col("s").alias(s), F.col("n").alias(n)))
    slots = plan.select(F.col("s").alias(s), F.col("i").alias(i), F.col("at").alias(at))
    number = F.floor(F.col(rank) / block)
    placed = ranked.join(own, s).withColumn(i, number % F.col(n)).join(F.broadcast(slots) if period <= LITERAL_SLOTS else slots, [s, i])
    slot = F.floor(number / F.col(n)) * period + F.col(at)
    return placed.select(
        *docs.columns,
        F.col(rank).cast("long").alias("source_rank"),
        number.cast("long").alias("block"),
        slot.cast("long").alias("slot"),
        (slot * block + F.col(rank) % block).cast("long").alias("place"),
    )


def mixed(docs: DataFrame, weights: Mapping[str | None, Weight] | None = None, block: int = 8) -> DataFrame:
    """docs, all rows and the same columns, in the order of the schedule."""
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "source")
    return mix(whole, weights, block).orderBy("place").select("row.*")
