"""Span and token evaluation as joins and aggregates.

Span tables are long: note_id, span_start, span_end, span_tag[, score, recognizer_name, model_name, category].
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.operators.long_spans import interval_join
from cloakwork.operators.spans import fold, packed_rows, resolve_frame, resolved_rows

KEY = ["note_id", "span_tag", "span_start", "span_end"]


def map_labels(spans: DataFrame, labels: Mapping[str, str], column: str = "span_tag", drop_unmapped: bool = False) -> DataFrame:
    """Labels replaced by a map; others stay or go. An empty map changes nothing."""
    if not labels:
        return spans
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    new = table[F.col(column)]
    out = spans.withColumn(column, new if drop_unmapped else F.coalesce(new, F.col(column)))
    return out.where(F.col(column).isNotNull()) if drop_unmapped else out


def explode_labels(spans: DataFrame, labels: Mapping[str, Sequence[str]], column: str = "span_tag") -> DataFrame:
    """labels: target -> sources. A source of several targets gives several rows; unmapped rows go."""
    inverse: dict[str, list[str]] = {}
    for target, sources in labels.items():
        for s in sources:
            inverse.setdefault(s, []).append(target)
    if not inverse:
        return spans.limit(0)
    table = F.create_map(*[x for s, t in inverse.items() for x in (F.lit(s), F.array(*(F.lit(v) for v in t)))])
    return spans.withColumn(column, F.explode(table[F.col(column)]))


def _enough(p: Column, g: Column, threshold: float, exact: bool, denominator: str) -> Column:
    """Whether prediction p covers gold span g enough; both have start and end."""
    if exact:
        return (p["start"] == g["start"]) & (p["end"] == g["end"])
    if threshold <= 0:
        return F.lit(True)
    both = F.greatest(F.lit(0), F.least(p["end"], g["end"]) - F.greatest(p["start"], g["start"]))
    size = p["end"] - p["start"] if denominator == "prediction" else g["end"] - g["start"]
    return F.when(size > 0, both / size).otherwise(0.0) >= threshold


KINDS = ("tp", "fp", "fn")


def _matched(golds: Column, preds: Column, threshold: float = 0.5, exact: bool = False, denominator: str = "prediction") -> Column:
    """array of struct(kind, tag, start, end) of one note's gold and predicted spans, arrays of struct(tag, start, end,
    ...); golds come in the order of their ordinals."""

    def of(kind: str, x: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), x["tag"].alias("tag"), x["start"].alias("start"), x["end"].alias("end"))

    def judged(z: Column) -> Column:
        """Of each prediction what it found (a gold key), else itself."""
        first = lambda p: F.get(F.filter(z["g"], lambda g: (g["tag"] == p["tag"]) & _enough(p, g, threshold, exact, denominator)), F.lit(0))
        pairs = F.transform(z["p"], lambda p: F.struct(p.alias("p"), first(p).alias("g")))
        return F.transform(pairs, lambda x: F.when(x["g"].isNull(), of("fp", x["p"])).otherwise(of("tp", x["g"])))

    def whole(z: Column) -> Column:
        missed = F.transform(F.filter(z["g"], lambda g: ~F.array_contains(z["found"], of("tp", g))), lambda g: of("fn", g))
        return F.concat(z["found"], F.filter(z["judged"], lambda x: x["kind"] == "fp"), missed)

    # one value after another as a lambda's variable: what is only named within a lambda would be made for each element
    step = F.transform(F.array(F.struct(golds.alias("g"), preds.alias("p"))), lambda z: F.struct(z["g"], judged(z).alias("judged")))
    step = F.transform(step, lambda z: F.struct(z["g"], z["judged"], F.array_distinct(F.filter(z["judged"], lambda x: x["kind"] == "tp")).alias("found")))
    return F.transform(step, whole)[0]


def _by_note(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """note_id, golds and preds of every note in gold: one exchange a side."""
    span = [F.col("span_tag").alias("tag"), F.col("span_start").alias("start"), F.col("span_end").alias("end")]
    g = gold.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ordinal"), F.struct(*span).alias("s")))).alias("g"))
    p = predicted.groupBy("note_id").agg(F.collect_list(F.struct(*span)).alias("preds"))
    return g.join(p, "note_id", "left").select("note_id", F.col("g.s").alias("golds"), F.coalesce("preds", F.slice("g.s", 1, 0)).alias("preds"))


def matched_rows(gold: DataFrame, predicted: DataFrame, **how) -> DataFrame:
    """note_id, span_tag, span_start, span_end and kind of all true positives (gold keys), false positives
    (predictions) and false negatives (gold rows).

    A prediction counts if its note is in gold and its tag anywhere in gold. Its candidate is the first gold row, by
    ordinal, of its note and tag with enough overlap; a gold key is found if it is somebody's candidate. The overlap
    is relative to the prediction's length, or to the gold span's (denominator). gold needs an ordinal.
    """
    rows = _by_note(gold, predicted).select("note_id", F.explode(_matched(F.col("golds"), F.col("preds"), **how)).alias("m"))
    rows = rows.select("note_id", F.col("m.tag").alias("span_tag"), F.col("m.start").alias("span_start"), F.col("m.end").alias("span_end"), F.col("m.kind").alias("kind"))
    return rows.join(gold.select("span_tag").distinct(), "span_tag", "left_semi").select(*KEY, "kind")


def find_matches(gold: DataFrame, predicted: DataFrame, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """matched_rows() as three tables: true positives, false positives, false negatives."""
    rows = matched_rows(gold, predicted, **how)
    return tuple(rows.where(F.col("kind") == k).drop("kind") for k in KINDS)


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1; 0 where there is nothing to divide by."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def _counts() -> list[Column]:
    return [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]


def counts(gold: DataFrame, predicted: DataFrame, by: Sequence[str], **how) -> DataFrame:
    """tp, fp and fn for each value of the columns by, which are of note_id, span_tag, span_start and span_end."""
    return matched_rows(gold, predicted, **how).groupBy(*by).agg(*_counts())


def compute_metrics(gold: DataFrame, predicted: DataFrame, by: Sequence[str] = ("span_tag",), **how) -> DataFrame:
    """Counts with precision, recall, f1 and total_spans = tp + fn."""
    for df, name in ((gold, "gold"), (predicted, "predicted")):
        missing = {"note_id", "span_start", "span_end", "span_tag"} - set(df.columns)
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
    out = counts(gold, predicted, by, **how)
    scores = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.withColumns(scores).withColumn("total_spans", F.col("tp") + F.col("fn"))


def macro(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


def micro(metrics: DataFrame) -> DataFrame:
    sums = metrics.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return sums.withColumns({f"micro_{k}": v for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()})


def format_results(metrics: DataFrame) -> DataFrame:
    """Scores as text of four decimals."""
    return metrics.withColumns({c: F.format_string("%.4f", F.col(c)) for c in ("precision", "recall", "f1")})


def ablation(gold: DataFrame, predicted: DataFrame, configs: Mapping[str, Sequence[str]], **how) -> DataFrame:
    """Micro and macro scores of each configuration: predictions of its categories, resolved per note, matched.

    A note's gold spans and predictions meet once; all configurations are resolved and matched there.
    """
    rest = ["span_tag", "span_start", "span_end", "category"]
    packed = predicted.groupBy("note_id").agg(packed_rows(predicted, rest).alias("rows"))
    kind = dict(packed.dtypes)["rows"]
    g = gold.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.struct(F.col("span_tag").alias("tag"), F.col("span_start").alias("start"), F.col("span_end").alias("end")).alias("s")))).alias("g"))
    notes = g.join(packed, "note_id", "left").select(F.col("g.s").alias("golds"), F.coalesce("rows", F.array().cast(kind)).alias("rows"))

    def of(categories: Sequence[str]) -> Column:
        kept = resolved_rows(F.filter("rows", lambda r: r["row"]["category"].isin(list(categories))), kind)
        preds = F.transform(kept, lambda r: F.struct(r["row"]["span_tag"].alias("tag"), r["start"], (-r["minus"]).alias("end")))
        return _matched(F.col("golds"), preds, **how)

    each = F.array(*(F.struct(F.lit(name).alias("config"), of(categories).alias("m")) for name, categories in configs.items()))
    rows = notes.select(F.explode(each).alias("c")).select("c.config", F.explode("c.m").alias("m")).select("config", F.col("m.tag").alias("span_tag"), F.col("m.kind").alias("kind"))
    by_tag = rows.groupBy("config", "span_tag").agg(*_counts()).join(gold.select("span_tag").distinct(), "span_tag", "left_semi")
    by_tag = by_tag.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))
    out = by_tag.groupBy("config").agg(*(F.sum(n).alias(n) for n in KINDS), *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    return out.withColumns({f"micro_{k}": v for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()})


def power_set(spans: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every combination of models, named by their sorted names joined with "+", resolved per note. Other models' spans
    are left out.

    A note's spans meet once, and all combinations are resolved there; a span is not repeated before the exchange.
    """
    rest = [c for c in spans.columns if c not in ("note_id", "model_name")]
    packed = spans.where(F.col("model_name").isin(list(models))).groupBy("note_id").agg(packed_rows(spans, [*rest, "model_name"]).alias("rows"))
    kind = dict(packed.dtypes)["rows"]
    combos = [c for k in range(1, len(models) + 1) for c in combinations(sorted(models), k)]
    every = F.array(*(F.struct(F.lit("+".join(c)).alias("name"), F.array(*map(F.lit, c)).alias("models")) for c in combos))

    def of(c: Column) -> Column:
        own = F.filter("rows", lambda r: F.array_contains(c["models"], r["row"]["model_name"]))
        return F.struct(c["name"].alias("model_name"), resolved_rows(own, kind).alias("rows"))

    each = packed.select("note_id", F.explode(F.transform(every, of)).alias("c")).select("note_id", "c.model_name", F.explode("c.rows").alias("r"))
    return each.select("model_name", "note_id", *(F.col("r.row")[c].alias(c) for c in rest))


#: Spans of a note, both sides together, up to which char_metrics() looks at all of them at each border.
FEW = 32


def char_labels(spans: DataFrame) -> DataFrame:
    """note_id, pos, tag of every character in a span; of several spans the last, by ordinal, tells."""
    chars = spans.where("span_end > span_start").select("note_id", "span_tag", "ordinal", F.explode(F.sequence(F.col("span_start"), F.col("span_end") - 1)).alias("pos"))
    return chars.groupBy("note_id", "pos").agg(F.max_by("span_tag", F.struct("ordinal", "span_tag")).alias("tag"))


def char_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """token_metrics() of the characters' labels, without a row a character: a sweep over the borders of a note's spans
    with those that are open there. Between two borders all characters have one label, that of the last open span, by
    ordinal and tag. The cost is that of the borders times the spans open at one."""

    def packed(spans: DataFrame, name: str) -> DataFrame:
        row = F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.col("span_tag").alias("tag"), F.col("span_end").cast("int").alias("end"), F.col("span_start").cast("int").alias("start"))
        return spans.where("span_end > span_start").groupBy("note_id").agg(F.collect_list(row).alias(name))

    open_ = "array<struct<ordinal: bigint, tag: string, end: int>>"
    notes = packed(gold, "g").join(packed(predicted, "p"), "note_id", "full_outer")

    def events(name: str, side: int) -> Column:
        at = lambda s, pos, kind: F.struct(pos.alias("pos"), F.lit(kind).alias("side"), F.struct(s["ordinal"], s["tag"], s["end"]).alias("s"))
        return F.concat(F.transform(name, lambda s: at(s, s["start"], side)), F.transform(name, lambda s: at(s, s["end"], 0)))

    def step(kept: Column, now: Column, x: Column) -> tuple[Column, Column]:
        label = lambda xs: F.coalesce(F.array_max(xs)["tag"], F.lit("O"))
        still = lambda xs, side: F.concat(F.filter(xs, lambda s: s["end"] > x["pos"]), F.when(x["side"] == side, F.array(x["s"])).otherwise(F.array().cast(open_)))
        passed = (x["pos"] > now["pos"]) & (F.size(now["g"]) + F.size(now["p"]) > 0)
        part = F.struct(label(now["g"]).alias("g"), label(now["p"]).alias("p"), (x["pos"] - now["pos"]).alias("n"))
        return F.when(passed, F.array_append(kept, part)).otherwise(kept), F.struct(x["pos"].alias("pos"), still(now["g"], 1).alias("g"), still(now["p"], 2).alias("p"))

    part, pending = "struct<g: string, p: string, n: int>", f"struct<pos: int, g: {open_}, p: {open_}>"
    def at_borders(xs: Column) -> Column:
        """Of a struct of both sides, the parts between neighbouring borders."""
        borders = F.array_sort(F.array_distinct(F.flatten(F.array(xs["g"]["start"], xs["g"]["end"], xs["p"]["start"], xs["p"]["end"]))))

        def between(bs: Column) -> Column:
            label = lambda side, a: F.coalesce(F.array_max(F.filter(xs[side], lambda s: (s["start"] <= a) & (a < s["end"])))["tag"], F.lit("O"))
            ends = F.slice(bs, F.lit(2), F.greatest(F.size(bs) - 1, F.lit(0)))
            return F.transform(ends, lambda e, i: F.transform(F.array(F.get(bs, i)), lambda a: F.struct(label("g", a).alias("g"), label("p", a).alias("p"), (e - a).alias("n")))[0])

        return F.transform(F.array(borders), between)[0]

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(open_).alias("g"), F.array().cast(open_).alias("p"))
    none = F.array().cast(dict(notes.dtypes)["g"])
    notes = notes.select(F.coalesce("g", none).alias("g"), F.coalesce("p", none).alias("p"))
    swept = fold(F.sort_array(F.concat(events("g", 1), events("p", 2))), part, pending, start, step, lambda _: F.array().cast(f"array<{part}>"))
    looked_up = F.transform(F.array(F.struct("g", "p")), at_borders)[0]
    parts = F.when(F.size("g") + F.size("p") <= FEW, looked_up).otherwise(swept)
    rows = notes.select(F.explode(parts).alias("i")).select("i.g", "i.p", F.col("i.n").cast("long").alias("n"))
    return _confusion_scores(rows.groupBy("g", "p").agg(F.sum("n").alias("count")))


def token_labels(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """note_id, tok_start, tok_end, tag: that of the first span, by ordinal, that overlaps the token; else O."""
    hit = interval_join(tokens.select("note_id", "tok_start", "tok_end"), spans.select("note_id", "span_start", "span_end", "span_tag", "ordinal"), "note_id", ("tok_start", "tok_end"), ("span_start", "span_end"))
    first = hit.groupBy("note_id", "tok_start", "tok_end").agg(F.min_by("span_tag", F.struct("ordinal", "span_tag")).alias("tag"))
    return tokens.join(first, ["note_id", "tok_start", "tok_end"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def token_metrics(gold: DataFrame, predicted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Per label scores of (tag) rows at positions on; positions without a label are O, which isn't scored."""
    g, p = gold.select(*on, F.col("tag").alias("g")), predicted.select(*on, F.col("tag").alias("p"))
    pairs = g.join(p, list(on), "full_outer").select(F.coalesce("g", F.lit("O")).alias("g"), F.coalesce("p", F.lit("O")).alias("p"))
    return _confusion_scores(pairs.groupBy("g", "p").count())


def _confusion_scores(confusion: DataFrame) -> DataFrame:
    """Per label scores of a confusion table (g, p, count)."""
    same = F.col("g") == F.col("p")
    rows = confusion.select(F.col("g").alias("tag"), F.when(same, F.col("count")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(same, 0).otherwise(F.col("count")).alias("fn")).unionByName(
        confusion.where(~same).select(F.col("p").alias("tag"), F.lit(0).cast("long").alias("tp"), F.col("count").alias("fp"), F.lit(0).cast("long").alias("fn"))
    )
    out = rows.where("tag <> 'O'").groupBy("tag").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    return out.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("support", F.col("tp") + F.col("fn"))
