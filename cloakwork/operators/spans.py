"""Span algebra: overlap, conflict resolution, merging, suppression.

Each operator has an array form, which needs no shuffle and works on one document's spans, and, where semantics
allow, a long form over one row per span, for documents with very many. Order-dependent folds sort first, so that
results don't depend on how spans came together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.schema import SPAN, SPANS, no_spans


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def length(s: Column) -> Column:
    return s["end"] - s["start"]


def span_overlap(s1: tuple[Column, Column], s2: tuple[Column, Column], exact: bool = False) -> Column:
    """The part of s1 that s2 covers; 0 for an empty s1. exact: 1 or 0."""
    (a, b), (c, d) = s1, s2
    if exact:
        return F.when((a == c) & (b == d), 1.0).otherwise(0.0)
    both = F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))
    return F.when(b > a, both / (b - a)).otherwise(0.0)


def hull_iou(a: Column, b: Column) -> Column:
    """Intersection divided by the hull (not the union) of two spans."""
    both = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    hull = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return F.when(hull > 0, both / hull).otherwise(0.0)


def by_position(spans: Column) -> Column:
    """Sorted by start, longer first, then by higher score and type, so that ties have one order."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-s["score"]).alias("c"), s.alias("s")))
    return F.transform(F.sort_array(keyed), lambda k: k["s"])


def fold(xs: Column, kind: str, pending: str, start: Column, step: Callable[[Column, Column, Column], tuple[Column, Column]], close: Callable[[Column], Column]) -> Column:
    """A fold that keeps elements of an array: step gets what is kept, what is pending (of the type pending) and the next
    element, and returns both anew; close turns what is pending at last into an array. step may append to what is kept,
    but not look at it.

    Each step copies what has been kept so far, so that n of them would cost n squared. The elements are taken in pieces
    of about the root of n, each of which has a short array of its own.
    """
    state = f"struct<kept: array<{kind}>, pending: {pending}>"
    none = F.array().cast(f"array<{kind}>")

    def one(s: Column, x: Column) -> Column:
        kept, now = step(s["kept"], s["pending"], x)
        return F.struct(kept.alias("kept"), now.alias("pending"))  # a cast here would copy the array

    def piece(all_: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(none.alias("kept"), all_["pending"].alias("pending")).cast(state), one)
        # one value as a lambda's variable, or the piece would be folded twice
        return F.transform(F.array(done), lambda d: F.struct(F.array_append(all_["parts"], d["kept"]).alias("parts"), d["pending"].alias("pending")))[0]

    def whole(ys: Column) -> Column:
        n = F.size(ys)
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), size), lambda i: F.slice(ys, i, size))
        begin = F.struct(F.array().cast(f"array<array<{kind}>>").alias("parts"), start.cast(pending).alias("pending"))
        return F.aggregate(pieces, begin, piece, lambda a: F.concat(F.flatten(a["parts"]), close(a["pending"])))

    return F.transform(F.array(xs), whole)[0]


def _pending(x: Column, kind: str = SPANS) -> Column:
    return F.when(x.isNull(), F.array().cast(kind)).otherwise(F.array(x).cast(kind))


def dedupe(spans: Column, by_type: bool) -> Column:
    """One span for each (start, end), or (start, end, type): that of the highest score, the first on ties. Equal ones
    are made neighbours, so that each span is compared with one other."""
    if by_type:
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["entity_type"].alias("t"), (-s["score"]).alias("c"), s.alias("s")))
        ordered = F.transform(F.sort_array(keyed), lambda k: k["s"])
    else:
        ordered = by_position(spans)
    same = lambda x, y: F.coalesce((x["start"] == y["start"]) & (x["end"] == y["end"]) & ((x["entity_type"] == y["entity_type"]) if by_type else F.lit(True)), F.lit(False))
    # sorted once, as a lambda's variable
    return F.transform(F.array(ordered), lambda xs: F.filter(xs, lambda x, i: (i == 0) | ~same(x, F.get(xs, i - 1))))[0]


def _longest_step(start: Callable[[Column], Column], end: Callable[[Column], Column]) -> Callable[[Column, Column, Column], tuple[Column, Column]]:
    def step(kept: Column, last: Column, x: Column) -> tuple[Column, Column]:
        apart = ~((start(last) < end(x)) & (start(x) < end(last)))
        before = end(x) < end(last)  # of spans without length, one may end before the last one does
        longer = end(x) - start(x) > end(last) - start(last)
        return (
            F.when(last.isNull() | ~apart, kept).when(before, F.array_append(kept, x)).otherwise(F.array_append(kept, last)),
            F.when(last.isNull(), x).when(apart, F.when(before, last).otherwise(x)).when(longer, x).otherwise(last),
        )

    return step


def longest_wins(spans: Column) -> Column:
    """Left to right: a span without overlap is kept; one that is longer than every kept span it overlaps evicts
    them; any other is dropped. Spans must come sorted.

    Kept spans are disjoint, so the one that ends last is the only one that a later span can overlap; it is pending.
    """
    step = _longest_step(lambda s: s["start"], lambda s: s["end"])
    return fold(spans.cast(SPANS), SPAN, SPAN, F.lit(None), step, _pending)


def merge_contained(spans: Column) -> Column:
    """Drop spans within an earlier kept one; partial overlaps survive. Spans must come sorted, so a span lies within
    an earlier one if the furthest end so far is not before its own."""

    def step(kept: Column, reach: Column, x: Column) -> tuple[Column, Column]:
        within = F.coalesce(reach >= x["end"], F.lit(False))
        return F.when(within, kept).otherwise(F.array_append(kept, x)), F.when(within, reach).otherwise(x["end"])

    return fold(spans.cast(SPANS), SPAN, "int", F.lit(None), step, lambda _: no_spans())


def drop_overlapping_earlier(spans: Column) -> Column:
    """In the given order of priority, keep what overlaps nothing kept before."""
    return F.aggregate(spans.cast(SPANS), no_spans(), lambda kept, x: F.when(F.exists(kept, lambda k: overlaps(k, x)), kept).otherwise(F.array_append(kept, x)))


STRATEGIES = {"longest_wins": longest_wins, "merge_contained": merge_contained}


def resolve_conflicts(spans: Column, strategy: str = "longest_wins") -> Column:
    """Of span tables: equal ranges collapse whatever their type."""
    return STRATEGIES[strategy](by_position(dedupe(spans, by_type=False)))


def resolve_results(spans: Column, strategy: str = "longest_wins", merge_types: Sequence[str] = (), text: Column | None = None, max_gap: int = 2) -> Column:
    """Of detectors' results: zero scores go, equal ranges of one type collapse, conflicts are resolved, and adjacent
    spans of merge_types are joined."""
    out = STRATEGIES[strategy](by_position(dedupe(F.filter(spans, lambda s: s["score"] > 0), by_type=True)))
    return merge_adjacent(out, text, merge_types, max_gap) if merge_types else out


def merge_adjacent(spans: Column, text: Column, types: Sequence[str], max_gap: int = 2) -> Column:
    """Join neighbours of one eligible type with a gap of white space of at most max_gap; others come first."""
    eligible = F.filter(by_position(spans), lambda s: s["entity_type"].isin(list(types)))
    others = F.filter(by_position(spans), lambda s: ~s["entity_type"].isin(list(types)))

    def step(kept: Column, prev: Column, x: Column) -> tuple[Column, Column]:
        gap = x["start"] - prev["end"]
        joins = (prev["entity_type"] == x["entity_type"]) & (gap >= 0) & (gap <= max_gap) & F.substring(text, prev["end"] + 1, gap).rlike(r"^\s*$")
        joined = F.struct(prev["entity_type"], prev["start"], x["end"].alias("end"), F.greatest(prev["score"], x["score"]).alias("score"), prev["recognizer"], prev["pattern"]).cast(SPAN)
        return _joined(kept, prev, x, joins, joined)

    return F.concat(others, fold(eligible, SPAN, SPAN, F.lit(None), step, _pending))


def _joined(kept: Column, prev: Column, x: Column, joins: Column, joined: Column) -> tuple[Column, Column]:
    joins = F.coalesce(joins, F.lit(False))
    return F.when(prev.isNull() | joins, kept).otherwise(F.array_append(kept, prev)), F.when(joins, joined).otherwise(x)


def suppress(spans: Column, iou: float = 0.5) -> Column:
    """Greedy suppression by descending score, across types; the rest in input order."""
    numbered = F.transform(spans, lambda s, i: F.struct((-s["score"]).alias("a"), s["start"].alias("b"), s["end"].alias("c"), s["entity_type"].alias("d"), i.alias("i"), s.alias("s")))
    kept_type = f"array<struct<a: double, b: int, c: int, d: string, i: int, s: {SPAN}>>"
    step = lambda kept, x: F.when(F.exists(kept, lambda k: overlaps(k["s"], x["s"]) & (hull_iou(k["s"], x["s"]) >= iou)), kept).otherwise(F.array_append(kept, x))
    kept = F.aggregate(F.sort_array(numbered).cast(kept_type), F.array().cast(kept_type), step)
    return F.transform(F.array_sort(F.transform(kept, lambda k: F.struct(k["i"].alias("i"), k["s"].alias("s")))), lambda k: k["s"])


def shift(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["entity_type"], (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["score"], s["recognizer"], s["pattern"]).cast(SPAN))


# Long forms: one row a span.


def collect_spans(df: DataFrame, key: str) -> DataFrame:
    """key and spans from rows (key, entity_type, start, end, score, recognizer, pattern)."""
    return df.groupBy(key).agg(F.collect_list(F.struct("entity_type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("score").cast("double").alias("score"), "recognizer", "pattern").cast(SPAN)).alias("spans"))


def explode_spans(df: DataFrame, spans: str = "spans") -> DataFrame:
    return df.select("*", F.explode(spans).alias("__s")).select(*[c for c in df.columns if c != spans], "__s.*")


def merge_contained_long(df: DataFrame, key: str) -> DataFrame:
    """merge_contained by a running maximum of ends: a sort instead of a fold."""
    w = Window.partitionBy(key).orderBy("start", F.desc("end"), F.desc("score"), "entity_type").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__m", F.max("end").over(w)).where(F.col("__m").isNull() | (F.col("__m") < F.col("end"))).drop("__m")


def islands(df: DataFrame, key: str, joins: Column, order: Sequence[str | Column]) -> DataFrame:
    """df with a column island: a running number that grows where joins (of this row with the one before, whose
    values are prev_end and prev_type) is not true."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("prev_end", F.lag("end").over(w)).withColumn("prev_type", F.lag("entity_type").over(w))
    marked = marked.withColumn("__new", F.when(joins, 0).otherwise(1))
    return marked.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new", "prev_end", "prev_type")


def merge_adjacent_long(df: DataFrame, key: str, max_gap: int = 2) -> DataFrame:
    """Neighbours of one type with a gap of at most max_gap joined: (key, entity_type, start, end, score)."""
    gap = F.col("start") - F.col("prev_end")
    joined = islands(df, key, (F.col("prev_type") == F.col("entity_type")) & (gap >= 0) & (gap <= max_gap), ["start", "end", "entity_type", F.desc("score")])
    return joined.groupBy(key, "island").agg(F.min("entity_type").alias("entity_type"), F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"), F.max("score").alias("score")).drop("island")


def merge_continuous(spans: Column, text: Column, max_gap: int) -> Column:
    """Chain spans of one type that overlap or whose gap of at most max_gap is blanks and joining marks only."""

    def step(kept: Column, prev: Column, x: Column) -> tuple[Column, Column]:
        gap = x["start"] - prev["end"]
        joins = (prev["entity_type"] == x["entity_type"]) & ((gap <= 0) | ((gap <= max_gap) & F.substring(text, prev["end"] + 1, F.greatest(gap, F.lit(0))).rlike(r"^[\s,.\-']*$")))
        joined = F.struct(prev["entity_type"], prev["start"], F.greatest(prev["end"], x["end"]).alias("end"), F.greatest(prev["score"], x["score"]).alias("score"), prev["recognizer"], prev["pattern"]).cast(SPAN)
        return _joined(kept, prev, x, joins, joined)

    return fold(by_position(spans), SPAN, SPAN, F.lit(None), step, _pending)


def rows_resolved(rows: Column, kind: str, once: bool = True) -> Column:
    """Longest wins over an array (of type kind) of struct(start, minus: -end, less: -score, row). once: equal ranges
    collapse first."""
    of = kind[len("array<") : -1]
    same = lambda a, b: F.coalesce((a["start"] == b["start"]) & (a["minus"] == b["minus"]), F.lit(False))
    step = _longest_step(lambda s: s["start"], lambda s: -s["minus"])

    def resolved(xs: Column) -> Column:
        ys = F.filter(xs, lambda x, i: (i == 0) | ~same(x, F.get(xs, i - 1))) if once else xs
        return fold(ys, of, of, F.lit(None), step, lambda p: _pending(p, kind))

    # sorted once, as a lambda's variable
    return F.transform(F.array(F.sort_array(rows)), resolved)[0]


def packed(start: Column, end: Column, score: Column, rest: Sequence[str | Column]) -> Column:
    """An aggregate that collects rows in the form of rows_resolved()."""
    return F.collect_list(F.struct(start.alias("start"), (-end).alias("minus"), (-score).alias("less"), F.struct(*rest).alias("row")))


def resolved_rows(rows: Column, kind: str) -> Column:
    return rows_resolved(rows, kind)


def packed_rows(df: DataFrame, rest: Sequence[str]) -> Column:
    score = F.col("score") if "score" in df.columns else F.lit(0.0)
    return packed(F.col("span_start"), F.col("span_end"), score, rest)


def resolve_frame(df: DataFrame, model_name: str | None = None, by: Sequence[str] = ("note_id",)) -> DataFrame:
    """Per note (or the columns by), longest-wins over rows (note_id, span_start, span_end, span_tag, ...); other
    columns stay."""
    packed = df.groupBy(*by).agg(packed_rows(df, [c for c in df.columns if c not in by]).alias("rows"))
    kept = resolved_rows(F.col("rows"), dict(packed.dtypes)["rows"])
    out = packed.select(*by, F.explode(kept).alias("r")).select(*by, "r.row.*")
    return out.withColumn("model_name", F.lit(model_name)) if model_name is not None else out
