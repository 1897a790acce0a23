"""Incremental blob ledger for secret scans.

Every version of every text is addressed by its content (SHA-256), and every rule by a hash of what it finds (pattern,
group, least length). The ledger's rows name a blob, the rules that it was scanned by, and the findings. scan() looks
for pairs of blob and rule that the ledger lacks, scans one copy of each such blob by just the missing rules, appends
a row, and joins the findings of the rules asked for back to all paths (rows) that hold the blob. A changed rule is
another rule: it is scanned anew, and what its old form found is left out. Reading merges the rows of a blob, so that
a pair that two runs appended, or one run twice, counts once.

All operations are DataFrame functions. A blob's copies, however many, are scanned once: the copy with the smallest
doc_id. The joins on the blob are dealt out by exchanges that adaptive execution may split.

Defined cases: a null text is an empty one; equal rows get equal results; a null doc_id is kept; an empty table gives
no rows and an empty ledger; other columns are ignored by scan().
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.shared import cut, free_name, shared_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to find, the group whose length counts, its least length, and a text that any match
    contains, if there is one (a cheap test before the pattern)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    has: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


#: A whole private key: its BEGIN line, lines about its encryption, and base64 through the END line, or, if that is
#: missing, the base64 words that follow (60 at most: those of a key of 4096 bits) and a last, shorter one alone in its
#: line. Ends of lines may be written as \\n.
PEM = (
    r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[\t\n\r ]*(?:Proc-Type|DEK-Info):[^\n]*){0,4}"
    r"(?:[A-Za-z0-9+/=\\\t\n\r ]*-----END (?:[A-Z]+ )?PRIVATE KEY-----"
    r"|(?:(?:(?:[\t\n\r ]|\\[nr])+[A-Za-z0-9+/=]{16,}){1,60}(?:[\t ]*\r?\n[A-Za-z0-9+/=]{1,15}[\t ]*\r?(?:\n|$))?)?)"
)
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("=", ":")),
    Rule("access", r"AKIA[A-Z0-9]{12,}", has=("AKIA",)),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", PEM, has=("PRIVATE KEY-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", has=("eyJ",)),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", has=("gh",)),
)
BASE = 3
FOUND = "array<struct<rule: string, start: long, end: long>>"
LEDGER = f"blob string, rules array<string>, found {FOUND}"


def _pieces(text: Column, rule: Rule, number: int) -> Column:
    """(rule, i, characters before the i-th match since the last one, its length, length of the group)."""
    parts = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    found = F.transform(
        F.arrays_zip(whole.alias("m"), group.alias("g"), F.slice(parts, 1, F.size(whole)).alias("p")),
        lambda x, i: F.struct(F.lit(number).alias("rule"), i.alias("i"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("n"), F.length(x["g"]).alias("g")),
    )
    may = text.rlike(rule.pattern)
    if rule.has:
        any_of = F.contains(text, F.lit(rule.has[0]))
        for h in rule.has[1:]:
            any_of |= F.contains(text, F.lit(h))
        may = any_of & may
    return F.when(may, found).otherwise(F.array().cast("array<struct<rule: int, i: int, gap: int, n: int, g: int>>"))


def _versions(rules: tuple[Rule, ...]) -> Column:
    return F.array(*(F.lit(r.version) for r in rules))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and found of blobs(blob, text, rules: the versions to scan by), each blob once or more; blobs without
    findings have no row."""
    none = F.array().cast("array<struct<rule: int, i: int, gap: int, n: int, g: int>>")
    pieces = (F.when(F.array_contains("rules", r.version), _pieces(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules))
    hits = blobs.select("blob", F.explode(F.concat(*pieces)).alias("h")).select("blob", "h.*").distinct()
    so_far = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(so_far)
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("rule") + 1)
    kept = hits.withColumn("end", end).where(F.col("g") >= least)
    one = F.struct(F.element_at(_versions(rules), F.col("rule") + 1).alias("rule"), (F.col("end") - F.col("n")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return kept.groupBy("blob").agg(F.sort_array(F.collect_list(one)).cast(FOUND).alias("found"))


def _read(spark: SparkSession, ledger: str) -> DataFrame | None:
    """blob, rules and found of the ledger, one row a blob; None if there is none yet."""
    try:
        rows = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # as many rows a blob as runs wrote it
    merged = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("rules", "found")]
    return rows.groupBy("blob").agg(*merged)


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and spans (null if none) of docs(doc_id, text). ledger: a folder kept between runs; without one
    the run makes its own in the shared folder."""
    if len({r.version for r in rules}) < len(rules):
        raise ValueError("two rules are the same")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    versions = docs.select("doc_id", text.alias("text"), F.sha2(F.encode(text, "UTF-8"), 256).alias("blob"))
    paths = versions.select("doc_id", "blob")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    first = versions.groupBy("blob").agg(F.min(key).alias("first"))
    known = _read(spark, ledger) if ledger is not None else None
    if known is None:
        first = first.withColumn("rules", _versions(rules))
    else:
        seen = known.select(F.col("blob").alias("b"), F.col("rules").alias("done"))
        missing = F.array_except(_versions(rules), F.coalesce("done", F.array().cast("array<string>")))
        first = first.join(seen, F.col("blob") == F.col("b"), "left").select("blob", "first", missing.alias("rules")).where(F.size("rules") > 0)
    chosen = first.select(F.col("blob").alias("b"), "first", "rules")
    unseen = versions.join(chosen, (F.col("blob") == F.col("b")) & (key == F.col("first"))).select("blob", "text", "rules")
    found = scan_blobs(unseen, rules)
    at = ledger or shared_dir(spark, "ledger")
    first.select("blob", "rules").join(found, "blob", "left").select("blob", "rules", F.coalesce("found", F.array().cast(FOUND)).alias("found")).write.mode("append").parquet(at)
    # rules by their place in the given ones; those of other rules in the ledger have none
    spans = F.transform("found", lambda x: F.struct(x["start"], (F.array_position(_versions(rules), x["rule"]).cast("int") - 1).alias("rule"), x["end"]))
    spans = F.sort_array(F.filter(spans, lambda x: x["rule"] >= 0))
    written = _read(spark, at) if ledger is not None else spark.read.schema(LEDGER).parquet(at)
    entries = written.select(F.col("blob").alias("b"), spans.alias("spans")).where(F.size("spans") > 0)
    return paths.join(entries, F.col("blob") == F.col("b"), "left").drop("b")


def names(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.array(*(F.lit(r.kind) for r in rules))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of spans, by start and then kind, comma-joined; an empty string for none."""
    one = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names(rules), s["rule"] + 1), s["start"], s["end"]))
    return F.coalesce(F.array_join(one, ","), F.lit(""))


def marked(text: Column, spans: Column, mark: str) -> Column:
    """text with what sorted spans cover replaced by mark, once for spans that overlap."""

    def step(a: Column, x: Column) -> Column:
        apart = x["start"] >= a["at"]
        piece = F.substring(text, a["at"] + 1, (x["start"] - a["at"]).cast("int"))
        return F.struct(F.greatest(a["at"], x["end"].cast("int")).alias("at"), F.when(apart, F.array_append(a["parts"], piece)).otherwise(a["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(spans, start, step, lambda a: F.array_join(F.array_append(a["parts"], F.substring(text, a["at"] + 1, F.length(text))), mark))


def redact(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, all rows and the same columns, with every found secret in text replaced by mark and n_chars recounted.

    The spans are those of scan(); only texts with a finding change. What a text looks like without its secrets may
    match again (parts on both sides of one); so a mark should hold nothing that a rule could match.
    """
    found = scan(docs, rules=rules).where("spans is not null").select(F.col("blob").alias("b"), "spans").dropDuplicates(["b"])
    found = cut(found, "blobs")
    b, blob, spans = (free_name(docs.columns, n) for n in ("__hit", "__blob", "__spans"))
    text = F.col("text")
    found = found.select(F.col("b").alias(b), F.col("spans").alias(spans))
    out = docs.withColumn(blob, F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)).join(found, F.col(blob) == F.col(b), "left")
    changed = F.when(F.col(b).isNotNull(), marked(text, F.col(spans), mark)).otherwise(text)
    out = out.withColumn("text", changed)
    return out.select(*(F.when(F.col(b).isNotNull(), F.length("text")).otherwise(F.col(c)).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))
