"""Span operators for notes with very many spans: joins of intervals, islands, suppression in rounds.

Rows are (key, start, end, ...) with one row a span. Nothing here gathers a note's spans in one value: an interval join
is dealt out by note and bucket of offsets, longest-wins folds one island of overlapping spans at a time, and suppression
takes all local maxima of a round at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.operators.spans import packed, rows_resolved
from cloakwork.sources.shared import cut, free_name

#: Width of the narrowest buckets, and how much wider those of the next level are.
WIDTH, STEP = 64, 16
MAX_LEVEL = 6
MAX_ROUNDS = 1000


def _level(start: str, end: str) -> Column:
    """The narrowest level whose buckets are as long as the span, which so touches two of them at most."""
    length = F.col(end) - F.col(start)
    out = F.lit(MAX_LEVEL)
    for k in reversed(range(MAX_LEVEL)):
        out = F.when(length <= WIDTH * STEP**k, F.lit(k)).otherwise(out)
    return out


def _bucketed(df: DataFrame, start: str, end: str, levels: list[int], level: str, bucket: str, own: str, first: str) -> DataFrame:
    """A row for every bucket that a span touches, at its own level (own) and each wider one of the given levels;
    first: the first bucket it touches there."""

    def at(k: int) -> Column:
        width = WIDTH * STEP**k
        a = F.floor(F.col(start) / width)
        b = F.greatest(a, F.floor((F.col(end) - 1) / width))
        return F.when(F.col(own) <= k, F.transform(F.sequence(a, b), lambda x: F.struct(F.lit(k).alias("level"), x.alias("bucket"), a.alias("first"))))

    kept = df.withColumn(own, _level(start, end))
    none = F.array().cast("array<struct<level: int, bucket: bigint, first: bigint>>")
    touched = F.flatten(F.array(*(F.coalesce(at(k), none) for k in levels)))
    x = free_name(kept.columns, "__x")
    return kept.withColumn(x, F.explode(touched)).select(*kept.columns, F.col(f"{x}.level").alias(level), F.col(f"{x}.bucket").alias(bucket), F.col(f"{x}.first").alias(first))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Every pair of rows of one key whose ranges overlap, with the columns of both; names other than key differ.

    Each span stands in every bucket of offsets that it touches; a pair meets in the shared buckets and is kept in the
    first. Long spans stand in wider buckets, where shorter ones of the other side stand, too, so that no span is in more
    than two buckets of a level. The exchange is by key, level and bucket, so a note of any number of spans is dealt out
    over tasks, and adaptive execution may split what a common bucket has.

    Defined cases: a span without length overlaps one that holds it inside; a null key or offset joins with nothing; an
    end before the start overlaps as its offsets say.
    """
    names = [c for c in left.columns if c != key]
    if clash := set(names) & set(right.columns) - {key}:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    (a, b), (c, d) = left_range, right_range
    every = [*left.columns, *right.columns]
    level, bucket, lo, ro, lf, rf, rk = (free_name(every, f"__{n}") for n in ("level", "bucket", "lo", "ro", "lf", "rf", "rk"))
    left = left.where(F.col(key).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    right = right.where(F.col(key).isNotNull() & F.col(c).isNotNull() & F.col(d).isNotNull())
    # the levels that spans have: a handful of numbers
    levels = sorted({r[0] for side, x, y in ((left, a, b), (right, c, d)) for r in side.select(_level(x, y).alias("k")).distinct().collect()})
    if not levels:
        return left.join(right.limit(0), key)
    l_ = _bucketed(left, a, b, levels, level, bucket, lo, lf)
    r_ = _bucketed(right, c, d, levels, level, bucket, ro, rf).withColumnRenamed(key, rk)
    r_ = r_.withColumnRenamed(level, f"{level}r").withColumnRenamed(bucket, f"{bucket}r")
    met = l_.join(r_, (F.col(key) == F.col(rk)) & (F.col(level) == F.col(f"{level}r")) & (F.col(bucket) == F.col(f"{bucket}r")))
    first = (F.col(level) == F.greatest(lo, ro)) & (F.col(bucket) == F.greatest(lf, rf))
    return met.where(first & (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))).select(*left.columns, *(x for x in right.columns if x != key))


def _ordered() -> list[Column]:
    return [F.col("start"), F.desc("end"), F.desc("score"), F.col("entity_type")]


def dedupe_long(df: DataFrame, key: str, by_type: bool = True) -> DataFrame:
    """One row for each range (and type) of a note: that of the highest score, then the first type."""
    same = [key, "start", "end", *(["entity_type"] if by_type else [])]
    rank = free_name(df.columns, "__rank")
    w = Window.partitionBy(*same).orderBy(F.desc("score"), "entity_type")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def overlap_islands(df: DataFrame, key: str) -> DataFrame:
    """df with island: numbers that grow where a span starts at or after the furthest end before it."""
    reach = free_name(df.columns, "__reach")
    w = Window.partitionBy(key).orderBy(*_ordered())
    reached = df.withColumn(reach, F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("start") < F.col(reach), 0).otherwise(1)
    return reached.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(reach)


def longest_wins_long(df: DataFrame, key: str) -> DataFrame:
    """longest_wins over rows: spans of one island can only meet each other, so each island is folded for itself."""
    rest = ["entity_type", *(c for c in df.columns if c not in (key, "entity_type"))]  # ties go by type
    marked = overlap_islands(df, key)
    rows = marked.groupBy(key, "island").agg(packed(F.col("start"), F.col("end"), F.col("score"), [F.col(c) for c in rest]).alias("rows"))
    kept = rows_resolved(F.col("rows"), dict(rows.dtypes)["rows"], once=False)
    return rows.select(key, F.explode(kept).alias("r")).select(key, "r.row.*").select(*df.columns)


def suppress_long(df: DataFrame, key: str, iou: float = 0.5) -> DataFrame:
    """Greedy suppression by descending score (then start, end, type) over rows, one for each range and type of a note.

    The spans that would suppress each other form a graph. In each round the spans that are left and have no better
    neighbour left are kept, and their neighbours go; that is what the greedy order keeps. A round's spans are written to
    the shared folder.
    """
    better = lambda p: F.struct(*((-F.col(f"{p}score")).alias("a"), F.col(f"{p}start").alias("b"), F.col(f"{p}end").alias("c"), F.col(f"{p}entity_type").alias("d")))
    name = lambda p: F.struct(*(F.col(f"{p}{c}").alias(c) for c in ("start", "end", "entity_type")))
    spans = cut(df, "spans")
    side = lambda p: spans.select(key, *(F.col(c).alias(f"{p}{c}") for c in ("start", "end", "entity_type", "score")))
    met = interval_join(side("u_"), side("v_"), key, ("u_start", "u_end"), ("v_start", "v_end"))
    both = F.least("u_end", "v_end") - F.greatest("u_start", "v_start")
    hull = F.greatest("u_end", "v_end") - F.least("u_start", "v_start")
    enough = F.when(hull > 0, F.greatest(F.lit(0), both) / hull).otherwise(0.0) >= iou
    # u is better than v
    edges = cut(met.where(enough & (better("u_") < better("v_"))).select(key, name("u_").alias("u"), name("v_").alias("v")), "edges")
    kept = None
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        # of the nodes that edges have left, those that nobody suppresses
        free = edges.select(key, F.col("u").alias("n")).distinct().join(edges.select(key, F.col("v").alias("n")).distinct(), [key, "n"], "left_anti")
        gone = edges.join(free.withColumnRenamed("n", "u"), [key, "u"], "left_semi").select(key, F.col("v").alias("n")).distinct()
        gone = cut(gone, "gone")
        kept = gone if kept is None else kept.unionByName(gone)
        left = edges.join(gone.withColumnRenamed("n", "u"), [key, "u"], "left_anti").join(gone.withColumnRenamed("n", "v"), [key, "v"], "left_anti")
        # what a free span had suppressed is gone, so edges from free spans are, too
        edges = cut(left, "edges")
    else:
        raise RuntimeError("suppression did not settle")
    if kept is None:
        return spans
    n = free_name(spans.columns, "__n")
    return spans.withColumn(n, name("")).join(kept.withColumnRenamed("n", n), [key, n], "left_anti").select(*df.columns)
