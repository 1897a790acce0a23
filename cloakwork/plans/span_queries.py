"""Queries on spans and tokens made from line items: algebra, tokens to entities, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators import bio, chunk, evaluate, long_spans
from cloakwork.operators import spans as sp
from cloakwork.plans.catalogue import query, table
from cloakwork.schema import SPAN

TAGS = ("A", "N", "R")

GOLD_SQL = """SELECT l_orderkey AS note_id, CAST(l_partkey % 97 AS INTEGER) AS span_start, CAST(l_partkey % 97 + 1 + CAST(l_quantity AS INTEGER) % 13 AS INTEGER) AS span_end,
 l_returnflag AS span_tag, MIN(l_linenumber) AS ordinal FROM lineitem GROUP BY 1, 2, 3, 4"""
PRED_SQL = """SELECT l_orderkey AS note_id, CAST(l_partkey % 97 + l_suppkey % 3 - 1 AS INTEGER) AS span_start, CAST(l_partkey % 97 + l_suppkey % 3 + CAST(l_quantity AS INTEGER) % 13 AS INTEGER) AS span_end,
 l_returnflag AS span_tag, MAX(l_discount + 0.5) AS score, 'm' || CAST(l_suppkey % 3 AS VARCHAR) AS model_name, CASE WHEN l_linestatus = 'F' THEN 'regex' ELSE 'llm' END AS category, MIN(l_linenumber) AS ordinal
 FROM lineitem GROUP BY 1, 2, 3, 4, 6, 7"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 97).cast("int")
    rows = rows.select(F.col("l_orderkey").alias("note_id"), start.alias("span_start"), (start + 1 + F.col("l_quantity").cast("int") % 13).alias("span_end"), F.col("l_returnflag").alias("span_tag"), "l_linenumber")
    return rows.groupBy("note_id", "span_start", "span_end", "span_tag").agg(F.min("l_linenumber").alias("ordinal"))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 97 + F.col("l_suppkey") % 3 - 1).cast("int")
    rows = rows.select(
        F.col("l_orderkey").alias("note_id"),
        start.alias("span_start"),
        (start + 1 + F.col("l_quantity").cast("int") % 13).alias("span_end"),
        F.col("l_returnflag").alias("span_tag"),
        (F.col("l_discount") + 0.5).alias("score"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model_name"),
        F.when(F.col("l_linestatus") == "F", "regex").otherwise("llm").alias("category"),
        "l_linenumber",
    )
    return rows.groupBy("note_id", "span_start", "span_end", "span_tag", "model_name", "category").agg(F.max("score").alias("score"), F.min("l_linenumber").alias("ordinal"))


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id and spans of the predictions."""
    p = predicted(spark, sf_dir).select("note_id", F.col("span_tag").alias("entity_type"), F.col("span_start").alias("start"), F.col("span_end").alias("end"), "score", F.col("model_name").alias("recognizer"), F.col("category").alias("pattern"))
    return sp.collect_spans(p, "note_id")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("note_id", F.explode("spans").alias("s")).select("note_id", F.col("s.entity_type").alias("entity_type"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.round("s.score", 6).alias("score"))


def _fold_sql(step: str, rows: str = "d") -> str:
    """A fold over each note's sorted spans; x is the span, kept those kept so far."""
    return f"""WITH RECURSIVE p AS ({PRED_SQL}),
d AS (SELECT note_id, span_tag AS t, span_start AS a, span_end AS b, MAX(score) AS s FROM p GROUP BY ALL),
o AS (SELECT note_id, list({{'a': a, 'b': b, 's': s, 't': t}} ORDER BY a, b DESC, s DESC, t) AS xs FROM {rows} GROUP BY 1),
f AS (SELECT note_id, xs, CAST(1 AS BIGINT) AS i, xs[1:0] AS kept FROM o
 UNION ALL SELECT note_id, xs, i + 1, {step} FROM (SELECT *, xs[i] AS x FROM f WHERE i <= len(xs)))
SELECT note_id, k.t AS entity_type, k.a AS "start", k.b AS "end", round(k.s, 6) AS score FROM (SELECT note_id, unnest(kept) AS k FROM f WHERE i = len(xs) + 1)"""


_LONGEST = """CASE WHEN len(list_filter(kept, lambda k: k.a < x.b AND x.a < k.b)) = 0 THEN list_append(kept, x)
 WHEN len(list_filter(kept, lambda k: k.a < x.b AND x.a < k.b AND x.b - x.a <= k.b - k.a)) = 0 THEN list_append(list_filter(kept, lambda k: NOT (k.a < x.b AND x.a < k.b)), x) ELSE kept END"""


@query(_fold_sql(_LONGEST))
def resolve_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_arrays(spark, sf_dir).select("note_id", sp.resolve_results(F.col("spans")).alias("spans")))


@query(_fold_sql("CASE WHEN len(list_filter(kept, lambda k: k.a <= x.a AND x.b <= k.b)) > 0 THEN kept ELSE list_append(kept, x) END"))
def resolve_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_arrays(spark, sf_dir).select("note_id", sp.resolve_results(F.col("spans"), "merge_contained").alias("spans")))


@query(f"""WITH p AS ({PRED_SQL}), d AS (SELECT note_id, span_tag AS entity_type, span_start AS "start", span_end AS "end", MAX(score) AS score FROM p GROUP BY ALL),
m AS (SELECT *, MAX("end") OVER (PARTITION BY note_id ORDER BY "start", "end" DESC, score DESC, entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM d)
SELECT note_id, entity_type, "start", "end", round(score, 6) AS score FROM m WHERE e IS NULL OR e < "end\"""")
def resolve_contained_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predicted(spark, sf_dir).groupBy("note_id", F.col("span_tag").alias("entity_type"), F.col("span_start").alias("start"), F.col("span_end").alias("end")).agg(F.max("score").alias("score"))
    return sp.merge_contained_long(p, "note_id").withColumn("score", F.round("score", 6))


_NMS = """CASE WHEN len(list_filter(kept, lambda k: k.a < x.b AND x.a < k.b AND (least(k.b, x.b) - greatest(k.a, x.a)) / (greatest(k.b, x.b) - least(k.a, x.a)) >= 0.5)) > 0 THEN kept ELSE list_append(kept, x) END"""


@query(_fold_sql(_NMS).replace("ORDER BY a, b DESC, s DESC, t", "ORDER BY s DESC, a, b, t"))
def nms_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = F.transform(sp.dedupe(F.col("spans"), by_type=True), lambda s: s)
    return _flat(_arrays(spark, sf_dir).select("note_id", sp.suppress(once, 0.5).alias("spans")))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, entity_type, start, end and score of the predictions, one row a range and type."""
    p = predicted(spark, sf_dir)
    return p.groupBy("note_id", F.col("span_tag").alias("entity_type"), F.col("span_start").alias("start"), F.col("span_end").alias("end")).agg(F.max("score").alias("score"))


@query(_fold_sql(_LONGEST))
def resolve_longest_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest wins by islands of overlapping rows."""
    return long_spans.longest_wins_long(_rows(spark, sf_dir), "note_id").withColumn("score", F.round("score", 6))


@query(_fold_sql(_NMS).replace("ORDER BY a, b DESC, s DESC, t", "ORDER BY s DESC, a, b, t"))
def nms_iou_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression by rounds of local maxima over pairs that an interval join finds."""
    return long_spans.suppress_long(_rows(spark, sf_dir), "note_id", 0.5).withColumn("score", F.round("score", 6))


_MERGE = """SELECT note_id, entity_type, MIN("start") AS "start", arg_max("end", ("start", "end")) AS "end", round(MAX(score), 6) AS score FROM (
 SELECT *, SUM(CASE WHEN pt = entity_type AND "start" - pe BETWEEN 0 AND 2 THEN 0 ELSE 1 END) OVER (PARTITION BY note_id ORDER BY "start", "end", entity_type, score DESC ROWS UNBOUNDED PRECEDING) AS island FROM (
 SELECT *, lag("end") OVER w AS pe, lag(entity_type) OVER w AS pt FROM d WINDOW w AS (PARTITION BY note_id ORDER BY "start", "end", entity_type, score DESC))) GROUP BY note_id, island, entity_type"""


@query(f"""WITH p AS ({PRED_SQL}), d AS (SELECT note_id, span_tag AS entity_type, span_start AS "start", span_end AS "end", MAX(score) AS score FROM p GROUP BY ALL) {_MERGE}""")
def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predicted(spark, sf_dir).groupBy("note_id", F.col("span_tag").alias("entity_type"), F.col("span_start").alias("start"), F.col("span_end").alias("end")).agg(F.max("score").alias("score"))
    return sp.merge_adjacent_long(p, "note_id").withColumn("score", F.round("score", 6))


@query(f"""WITH p AS ({PRED_SQL}), d AS (SELECT note_id, span_start AS a, span_end AS b, MAX(score) AS s FROM p WHERE span_tag = 'A' GROUP BY 1, 2, 3),
m AS (SELECT *, MAX(b) OVER (PARTITION BY note_id ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM d),
i AS (SELECT *, SUM(CASE WHEN a - e <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY note_id ORDER BY a, b DESC ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT note_id, 'A' AS entity_type, MIN(a) AS "start", MAX(b) AS "end", round(MAX(s), 6) AS score FROM i GROUP BY note_id, k""")
def merge_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the text between spans is blanks, so that any gap of one character may close
    rows = _arrays(spark, sf_dir).withColumn("spans", F.filter("spans", lambda s: s["entity_type"] == "A")).where(F.size("spans") > 0)
    return _flat(rows.select("note_id", sp.merge_continuous(F.col("spans"), F.lit(" " * 200), 1).alias("spans")))


@query(_fold_sql(_LONGEST))
def outer_merge_recognizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predicted(spark, sf_dir).groupBy("note_id", "span_tag", "span_start", "span_end").agg(F.max("score").alias("score"))
    rows = p.select(F.col("note_id").cast("string").alias("text_hash"), F.struct(F.col("span_tag").alias("entity_type"), F.col("span_start").alias("start"), F.col("span_end").alias("end"), "score", F.lit("r").alias("recognizer"), F.lit("p").alias("pattern")).cast(SPAN).alias("s"))
    side = F.col("s.start") % 2 == 0
    both = [rows.where(c).groupBy("text_hash").agg(F.collect_list("s").alias("spans")) for c in (side, ~side)]
    return _flat(chunk.merge_outputs(*both).select(F.col("text_hash").cast("long").alias("note_id"), "spans"))


@query(f"SELECT g.note_id, g.ordinal, p.ordinal AS other, CASE WHEN p.span_end > p.span_start THEN greatest(0, least(p.span_end, g.span_end) - greatest(p.span_start, g.span_start)) / (p.span_end - p.span_start) ELSE 0 END AS overlap FROM ({GOLD_SQL}) g JOIN ({PRED_SQL}) p ON g.note_id = p.note_id AND g.span_tag = p.span_tag")
def span_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold(spark, sf_dir).select("note_id", "span_tag", "ordinal", F.col("span_start").alias("a"), F.col("span_end").alias("b"))
    p = predicted(spark, sf_dir).select("note_id", "span_tag", F.col("ordinal").alias("other"), "span_start", "span_end")
    overlap = sp.span_overlap((F.col("span_start"), F.col("span_end")), (F.col("a"), F.col("b")))
    return g.join(p, ["note_id", "span_tag"]).select("note_id", "ordinal", "other", overlap.alias("overlap"))


# Tokens: one a line item, placed by its number, several words an order.
TOKENS_SQL = """SELECT note_id, "start", "start" + 4 AS "end", entity, MAX(score) AS score, '' AS word FROM (
 SELECT l_orderkey AS note_id, CAST(l_linenumber * 6 - l_suppkey % 2 * 2 AS INTEGER) AS "start", CASE l_linestatus WHEN 'F' THEN 'B-' ELSE 'I-' END || l_returnflag AS entity, round(0.5 + l_discount * 4, 4) AS score FROM lineitem) GROUP BY ALL"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("note_id"),
        (F.col("l_linenumber") * 6 - F.col("l_suppkey") % 2 * 2).cast("int").alias("start"),
        F.concat(F.when(F.col("l_linestatus") == "F", "B-").otherwise("I-"), F.col("l_returnflag")).alias("entity"),
        F.round(0.5 + F.col("l_discount") * 4, 4).alias("score"),
    )
    return rows.groupBy("note_id", "start", "entity").agg(F.max("score").alias("score")).select("note_id", "start", (F.col("start") + 4).alias("end"), "entity", "score", F.lit("").alias("word"))


@query(f"""WITH t AS ({TOKENS_SQL}), g AS (SELECT *, entity[3:] AS ty FROM t),
i AS (SELECT *, CASE WHEN lag(ty) OVER w = ty AND "start" - lag("end") OVER w <= 2 THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY note_id ORDER BY "start", "end", entity)),
k AS (SELECT *, SUM(new) OVER (PARTITION BY note_id ORDER BY "start", "end", entity ROWS UNBOUNDED PRECEDING) AS k FROM i)
SELECT note_id, ty AS entity_group, MIN("start") AS "start", MAX("end") AS "end", round(AVG(score), 6) AS score FROM k GROUP BY note_id, k, ty""")
def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bio.aggregate(tokens(spark, sf_dir), "note_id").withColumn("score", F.round("score", 6))


@query(f"""WITH t AS ({TOKENS_SQL}), g AS (SELECT *, entity[3:] AS ty, row_number() OVER w AS n, CASE WHEN "start" - lag("end") OVER w <= 2 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY note_id ORDER BY "start", "end", entity)),
k AS (SELECT *, SUM(new) OVER (PARTITION BY note_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM g),
m AS (SELECT *, round(AVG(score) OVER (PARTITION BY note_id, k, ty), 9) AS mean, MIN(n) OVER (PARTITION BY note_id, k, ty) AS first FROM k),
r AS (SELECT *, arg_max(ty, n) FILTER (score >= 0.8) OVER (PARTITION BY note_id, k) AS sure, first_value(ty) OVER (PARTITION BY note_id, k ORDER BY mean DESC, first) AS best FROM m)
SELECT note_id, "start", "end", entity[1:2] || COALESCE(sure, best) AS entity, score FROM r""")
def bio_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bio.normalise(tokens(spark, sf_dir), "note_id").drop("word")


LABELS = {"A": "PERSON", "N": "PLACE"}


@query(f"SELECT note_id, span_start, span_end, CASE span_tag WHEN 'A' THEN 'PERSON' WHEN 'N' THEN 'PLACE' END AS span_tag FROM ({GOLD_SQL}) WHERE span_tag IN ('A', 'N')")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.map_labels(gold(spark, sf_dir).drop("ordinal"), LABELS, drop_unmapped=True)


@query(f"SELECT g.note_id, g.span_start, g.span_end, m.t AS span_tag FROM ({GOLD_SQL}) g JOIN (VALUES ('A', 'X'), ('A', 'Y'), ('R', 'Y')) AS m(s, t) ON g.span_tag = m.s")
def label_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.explode_labels(gold(spark, sf_dir).drop("ordinal"), {"X": ["A"], "Y": ["A", "R"]})


_MATCH = f"""WITH g AS MATERIALIZED ({GOLD_SQL}), p AS MATERIALIZED (SELECT *, concat_ws('|', note_id, span_start, span_end, span_tag, model_name, category) AS pid FROM ({PRED_SQL})),
q AS MATERIALIZED (SELECT * FROM p WHERE note_id IN (SELECT note_id FROM g) AND span_tag IN (SELECT span_tag FROM g)),
c AS MATERIALIZED (SELECT pid, arg_min({{'n': g.note_id, 't': g.span_tag, 'a': g.span_start, 'b': g.span_end}}, (g.ordinal, g.span_start, g.span_end)) AS c FROM q JOIN g ON q.note_id = g.note_id AND q.span_tag = g.span_tag
 WHERE CASE WHEN q.span_end > q.span_start THEN greatest(0, least(q.span_end, g.span_end) - greatest(q.span_start, g.span_start)) / (q.span_end - q.span_start) ELSE 0 END >= 0.5 GROUP BY pid),
tp AS MATERIALIZED (SELECT DISTINCT c.n AS note_id, c.t AS span_tag, c.a AS span_start, c.b AS span_end FROM c),
fp AS (SELECT note_id, span_tag, span_start, span_end FROM q ANTI JOIN c USING (pid)),
fn AS (SELECT note_id, span_tag, span_start, span_end FROM g ANTI JOIN tp USING (note_id, span_tag, span_start, span_end)),
r AS (SELECT *, 'tp' AS kind FROM tp UNION ALL SELECT *, 'fp' FROM fp UNION ALL SELECT *, 'fn' FROM fn)"""
_PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END AS f1"
_SUMS = "COUNT(*) FILTER (kind = 'tp') AS tp, COUNT(*) FILTER (kind = 'fp') AS fp, COUNT(*) FILTER (kind = 'fn') AS fn"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return gold(spark, sf_dir), predicted(spark, sf_dir)


@query(f"{_MATCH} SELECT note_id, span_tag, span_start, span_end, kind FROM r")
def match_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.matched_rows(*_pair(spark, sf_dir))


_ROUND = "round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"


@query(f"{_MATCH}, s AS (SELECT span_tag, {_SUMS} FROM r GROUP BY 1) SELECT span_tag, tp, fp, fn, {_ROUND}, tp + fn AS total_spans FROM (SELECT *, {_PRF} FROM s)")
def prf_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.compute_metrics(*_pair(spark, sf_dir)), "precision", "recall", "f1")


@query(f"{_MATCH}, s AS (SELECT note_id, {_SUMS} FROM r GROUP BY 1) SELECT note_id, tp, fp, fn, {_ROUND}, tp + fn AS total_spans FROM (SELECT *, {_PRF} FROM s)")
def prf_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.compute_metrics(*_pair(spark, sf_dir), by=("note_id",)), "precision", "recall", "f1")


@query(f"{_MATCH}, s AS (SELECT span_tag, {_SUMS} FROM r GROUP BY 1), q2 AS (SELECT *, {_PRF} FROM s) SELECT round(AVG(precision), 9) AS macro_precision, round(AVG(recall), 9) AS macro_recall, round(AVG(f1), 9) AS macro_f1 FROM q2")
def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.macro(evaluate.compute_metrics(*_pair(spark, sf_dir))), "macro_precision", "macro_recall", "macro_f1")


@query(f"{_MATCH}, s AS (SELECT {_SUMS} FROM r) SELECT tp, fp, fn, round(precision, 9) AS micro_precision, round(recall, 9) AS micro_recall, round(f1, 9) AS micro_f1 FROM (SELECT *, {_PRF} FROM s)")
def micro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.micro(evaluate.compute_metrics(*_pair(spark, sf_dir))), "micro_precision", "micro_recall", "micro_f1")


@query(f"{_MATCH}, s AS (SELECT span_tag, {_SUMS} FROM r GROUP BY 1) SELECT span_tag, printf('%.4f', precision) AS precision, printf('%.4f', recall) AS recall, printf('%.4f', f1) AS f1 FROM (SELECT *, {_PRF} FROM s)")
def formatted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.format_results(evaluate.compute_metrics(*_pair(spark, sf_dir))).select("span_tag", "precision", "recall", "f1")


@query(f"""WITH g AS ({GOLD_SQL}), p AS ({PRED_SQL}),
gc AS (SELECT note_id, pos, arg_max(span_tag, (ordinal, span_tag)) AS tag FROM (SELECT *, unnest(range(span_start, span_end)) AS pos FROM g) GROUP BY 1, 2),
pc AS (SELECT note_id, pos, arg_max(span_tag, (ordinal, span_tag)) AS tag FROM (SELECT *, unnest(range(span_start, span_end)) AS pos FROM p) GROUP BY 1, 2),
j AS (SELECT COALESCE(gc.tag, 'O') AS g, COALESCE(pc.tag, 'O') AS p, COUNT(*) AS n FROM gc FULL JOIN pc ON gc.note_id = pc.note_id AND gc.pos = pc.pos GROUP BY 1, 2),
s AS (SELECT tag, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp, CAST(SUM(fn) AS BIGINT) AS fn FROM (
 SELECT g AS tag, CASE WHEN g = p THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN g = p THEN 0 ELSE n END AS fn FROM j UNION ALL SELECT p, 0, n, 0 FROM j WHERE g <> p) WHERE tag <> 'O' GROUP BY 1)
SELECT tag, tp, fp, fn, {_ROUND}, tp + fn AS support FROM (SELECT *, {_PRF} FROM s)""")
def char_token_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.char_metrics(gold(spark, sf_dir), predicted(spark, sf_dir)), "precision", "recall", "f1")


@query(f"""WITH t AS (SELECT DISTINCT note_id, "start" AS tok_start, "end" AS tok_end FROM ({TOKENS_SQL})), g AS ({GOLD_SQL}),
f AS (SELECT t.note_id, tok_start, tok_end, arg_min(span_tag, (ordinal, span_tag)) AS tag FROM t JOIN g ON t.note_id = g.note_id AND tok_start < span_end AND span_start < tok_end GROUP BY ALL)
SELECT t.note_id, t.tok_start, t.tok_end, COALESCE(f.tag, 'O') AS tag FROM t LEFT JOIN f ON t.note_id = f.note_id AND t.tok_start = f.tok_start AND t.tok_end = f.tok_end""")
def token_offset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir).select("note_id", F.col("start").alias("tok_start"), F.col("end").alias("tok_end")).distinct()
    return evaluate.token_labels(t, gold(spark, sf_dir))


@query(f"""SELECT t.note_id, tok_start, tok_end, span_start, span_end, span_tag, ordinal FROM (SELECT DISTINCT note_id, "start" AS tok_start, "end" AS tok_end FROM ({TOKENS_SQL})) t
JOIN ({GOLD_SQL}) g ON t.note_id = g.note_id AND tok_start < span_end AND span_start < tok_end""")
def span_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tokens and gold spans that overlap, joined by note and bucket of offsets."""
    t = tokens(spark, sf_dir).select("note_id", F.col("start").alias("tok_start"), F.col("end").alias("tok_end")).distinct()
    return long_spans.interval_join(t, gold(spark, sf_dir), "note_id", ("tok_start", "tok_end"), ("span_start", "span_end"))


def _resolved_sql(source: str) -> str:
    """Longest wins per g (a name) and note of rows (g, note_id, a, b, s, t)."""
    return f"""d AS ({source}), e AS (SELECT *, row_number() OVER (PARTITION BY g, note_id, a, b ORDER BY s DESC, t) AS rn FROM d),
o AS (SELECT g, note_id, list({{'a': a, 'b': b, 's': s, 't': t}} ORDER BY a, b DESC) AS xs FROM e WHERE rn = 1 GROUP BY 1, 2),
f AS (SELECT g, note_id, xs, CAST(1 AS BIGINT) AS i, xs[1:0] AS kept FROM o UNION ALL SELECT g, note_id, xs, i + 1, {_LONGEST} FROM (SELECT *, xs[i] AS x FROM f WHERE i <= len(xs))),
k AS (SELECT g, note_id, unnest(kept) AS k FROM f WHERE i = len(xs) + 1)"""


_COMBOS = " UNION ALL ".join(f"SELECT '{'+'.join(c)}' AS g, * FROM p WHERE model_name IN ({', '.join(repr(m) for m in c)})" for c in (("m0",), ("m1",), ("m2",), ("m0", "m1"), ("m0", "m2"), ("m1", "m2"), ("m0", "m1", "m2")))


@query(f"""WITH RECURSIVE p AS ({PRED_SQL}), {_resolved_sql(f"SELECT g, note_id, span_start AS a, span_end AS b, MAX(score) AS s, span_tag AS t FROM ({_COMBOS}) GROUP BY g, note_id, span_start, span_end, span_tag")}
SELECT g AS model_name, note_id, k.a AS span_start, k.b AS span_end, k.t AS span_tag FROM k""")
def model_powerset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predicted(spark, sf_dir).select("note_id", "span_start", "span_end", "span_tag", "score", "model_name")
    return evaluate.power_set(p, ["m0", "m1", "m2"]).select("model_name", "note_id", "span_start", "span_end", "span_tag")


CONFIGS = {"all": ["regex", "llm"], "regex": ["regex"], "llm": ["llm"]}
_CONFIG_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS g, * FROM p WHERE category IN ({', '.join(repr(c) for c in cs)})" for n, cs in CONFIGS.items())


@query(f"""WITH RECURSIVE p AS ({PRED_SQL}), gold AS ({GOLD_SQL}), {_resolved_sql(f"SELECT g, note_id, span_start AS a, span_end AS b, MAX(score) AS s, span_tag AS t FROM ({_CONFIG_ROWS}) GROUP BY g, note_id, span_start, span_end, span_tag")},
q AS (SELECT g AS config, note_id, k.t AS span_tag, k.a AS span_start, k.b AS span_end, row_number() OVER () AS pid FROM k WHERE note_id IN (SELECT note_id FROM gold) AND k.t IN (SELECT span_tag FROM gold)),
c AS (SELECT pid, any_value(config) AS config, arg_min({{'n': gold.note_id, 't': gold.span_tag, 'a': gold.span_start, 'b': gold.span_end}}, (gold.ordinal, gold.span_start, gold.span_end)) AS c FROM q JOIN gold ON q.note_id = gold.note_id AND q.span_tag = gold.span_tag
 WHERE greatest(0, least(q.span_end, gold.span_end) - greatest(q.span_start, gold.span_start)) / (q.span_end - q.span_start) >= 0.5 GROUP BY pid),
tp AS (SELECT config, c.t AS span_tag, COUNT(DISTINCT c) AS tp FROM c GROUP BY 1, 2),
fp AS (SELECT config, span_tag, COUNT(*) AS fp FROM q WHERE pid NOT IN (SELECT pid FROM c) GROUP BY 1, 2),
n AS (SELECT config, span_tag, n FROM (SELECT span_tag, COUNT(*) AS n FROM gold GROUP BY 1) CROSS JOIN (VALUES ('all'), ('regex'), ('llm')) AS v(config)),
s AS (SELECT n.config, n.span_tag, COALESCE(tp, 0) AS tp, COALESCE(fp, 0) AS fp, n - COALESCE(tp, 0) AS fn FROM n LEFT JOIN tp ON n.config = tp.config AND n.span_tag = tp.span_tag LEFT JOIN fp ON n.config = fp.config AND n.span_tag = fp.span_tag),
m AS (SELECT *, {_PRF} FROM s), a AS (SELECT config, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp, CAST(SUM(fn) AS BIGINT) AS fn, AVG(precision) AS macro_precision, AVG(recall) AS macro_recall, AVG(f1) AS macro_f1 FROM m GROUP BY 1)
SELECT config, tp, fp, fn, round(macro_precision, 9) AS macro_precision, round(macro_recall, 9) AS macro_recall, round(macro_f1, 9) AS macro_f1, round(precision, 9) AS micro_precision, round(recall, 9) AS micro_recall, round(f1, 9) AS micro_f1 FROM (SELECT *, {_PRF} FROM a)""")
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.ablation(gold(spark, sf_dir), predicted(spark, sf_dir), CONFIGS)
    return _rounded(out, *(f"{k}_{c}" for k in ("macro", "micro") for c in ("precision", "recall", "f1")))
