"""Quality rules: base counts of a text, and its divergence from language references.

The references are learned from all rows with a text and a language: the character-class histogram, and the shares of
the COMMON most frequent words and of all others. A text's histograms are compared with each language's by the Jensen-Shannon distance (base 2, 0 to 1). A text is kept if, for
some language, both distances are small enough; a histogram that too few characters or words made is not judged. All
operations are DataFrame functions; what is collected from the corpus is COMMON + 7 numbers a language, for every
language, and the counts of rows a language.

Defined cases: a null text has no words and fails the base rule; null languages give no reference; without any
reference the base rule alone decides; equal rows get equal results, and each row is kept or rejected for itself; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm.shared import cut

SPACE, WHITE = r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Bins of a word histogram besides that of all other words.
COMMON = 40
#: Only of the SQL, which learns a language from about as many of its rows; up to them, from all.
TRAIN_ROWS = 4000
#: Distances above which a histogram differs, and how much a text needs to be judged by it.
CHAR_DISTANCE, WORD_DISTANCE, MIN_CHARS, MIN_WORDS = 0.3, 0.47, 200, 50
CLASSES = ("letters", "capitals", "digits", "spaces", "symbols", "others")


def words(text: Column) -> Column:
    """Only an untrimmed text's first and last part could be empty."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def _counted(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with t (text), its words, and counts of characters by class."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.withColumn("t", t).withColumns({"n": F.length("t"), "words": words(F.col("t"))})
    # what is left without lower-case letters and white space is short, so that counting in it is cheap
    rest = F.regexp_replace("t", r"[a-z\x20\x09-\x0D\p{L}&&[^\p{Lu}]]+", "")
    count = lambda p: F.regexp_count("rest", F.lit(p))
    base = base.withColumns({"n_words": F.size("words"), "word_chars": F.length(F.array_join("words", "")), "rest": rest})
    base = base.withColumns({"symbols": count(f"[{SYMBOLS}]"), "digits": count("[0-9]"), "capitals": count(r"\p{Lu}")}).withColumn("marks", F.length("rest") - F.col("capitals"))
    base = base.withColumns({"letters": F.col("word_chars") - F.col("marks") - F.col("capitals"), "spaces": F.col("n") - F.col("word_chars"), "others": F.col("marks") - F.col("digits") - F.col("symbols")})
    return base.withColumn("classes", F.array(*(F.col(c).cast("double") for c in CLASSES))).drop("rest", "marks")


def references(docs: DataFrame) -> list[dict]:
    """[{lang, classes: shares, words: {word: share}}] learned from all rows of docs(text, lang) with both."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col("text").cast("string").alias("text"))
    # written, for it is read twice; one row for each different word, so that classes are counted once a word
    counts = cut(known.select("lang", F.explode(words(F.col("text"))).alias("w")).groupBy("lang", "w").count(), "words")
    lower = counts.groupBy("lang", F.lower("w").alias("w")).agg(F.sum("count").alias("count"))
    best = lower.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "w"))).where(F.col("r") <= COMMON).select("lang", "w", "count")
    each = _counted(counts.select("lang", "count", F.col("w").alias("text")))
    totals = [r.asDict() for r in each.groupBy("lang").agg(F.sum("count").alias("n"), *(F.sum(F.col(c) * F.col("count")).alias(c) for c in CLASSES)).collect()]
    # words have no white space: it is what else the texts have
    chars_of = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    for r in totals:
        r["spaces"] = chars_of[r["lang"]] - sum(r[c] for c in CLASSES)
    by = {r["lang"]: r for r in totals if r["n"]}
    found: dict[str, dict[str, int]] = {}
    for r in best.collect():
        found.setdefault(r["lang"], {})[r["w"]] = r["count"]
    out = []
    for lang, r in sorted(by.items()):
        chars = sum(r[c] for c in CLASSES)
        out.append({"lang": lang, "classes": [r[c] / chars for c in CLASSES], "words": {w: c / r["n"] for w, c in sorted(found.get(lang, {}).items())}})
    return out


def _half(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence."""
    m = (p + q) / 2
    return (F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)) / 2


def judge(docs: DataFrame, char_distance: float = CHAR_DISTANCE, word_distance: float = WORD_DISTANCE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance and
    word_distance (those of the closest language; null without a reference) of docs(doc_id, text, lang)."""
    return _judged(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), ["doc_id"], char_distance, word_distance)


def _judged(docs: DataFrame, carried: list[str], char_distance: float, word_distance: float) -> DataFrame:
    refs = references(docs)
    rows = _counted(docs)
    common = sorted({w for r in refs for w in r["words"]})
    rows = rows.select("*", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("lines"))
    hits = F.filter(F.split(F.lower("t"), SPACE), lambda w: w.isin(common))
    # hashes of three words; only a text in which one comes twice needs their places, sorted by hash
    windows = F.transform("words", lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), hits.alias("hits"), F.slice(windows, 1, F.greatest(F.col("n_words") - 2, F.lit(0))).alias("h3")).drop("words", "lines", "t", "text")
    placed = F.sort_array(F.transform("h3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct("h3")) < F.size("h3")
    rows = rows.select("*", F.array_distinct("hits").alias("seen"), F.when(twice, placed).otherwise(F.array().cast("array<struct<h: bigint, i: int>>")).alias("w3")).drop("h3")
    pairs = F.zip_with("w3", F.slice("w3", F.lit(2), F.greatest(F.size("w3"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))
    covered = F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
    share = F.transform("seen", lambda w: F.struct(F.array_position(F.array(*(F.lit(w) for w in common)).cast("array<string>"), w).cast("int").alias("i"), ((F.size("hits") - F.size(F.array_remove("hits", w))) / F.col("n_words")).alias("p")))
    rows = rows.select("*", covered.alias("n_repeat_words"), share.alias("p")).drop("w3", "hits", "seen")
    rows = rows.withColumn("p", F.transform("p", lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"), _entropy(x["p"]).alias("e"))))
    if refs:
        given = F.from_json(F.lit(json.dumps([_by_place(r, common) for r in refs])), REFERENCE)

        def ranked(z: Column) -> Column:
            """One candidate for each language: how far it is beyond the two limits, then the distances."""
            divergence = F.transform(given, lambda r: F.struct(_distance_words(z["p"], r).alias("word"), _distance_classes(z["classes"], r).alias("char")))
            return F.transform(divergence, lambda d: F.struct(F.greatest(d["word"] / word_distance, d["char"] / char_distance).alias("far"), d["word"].alias("word"), d["char"].alias("char")))

        # a lambda's variable: columns that are only named within one would be computed for each language again
        once = F.array(F.struct("p", F.transform("classes", lambda c: c / F.greatest("n", F.lit(1))).alias("classes")))
        best = F.transform(once, lambda z: F.array_min(ranked(z)))[0]
        rows = rows.withColumn("best", best)
        rows = rows.withColumns({"word_distance": F.col("best.word"), "char_distance": F.col("best.char")})
        short_words, short_text = F.col("n_words") < MIN_WORDS, F.col("n") < MIN_CHARS
        fits = (short_words | (F.col("best.word") <= word_distance)) & (short_text | (F.col("best.char") <= char_distance))
    else:
        rows = rows.withColumns({"word_distance": F.lit(None).cast("double"), "char_distance": F.lit(None).cast("double")})
        fits = F.lit(True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("n_symbols", F.col("symbols"))
    whole = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(*carried, *(F.col(c).cast("long").alias(c) for c in whole), failed.alias("base_failed"), (~failed & F.coalesce(fits, F.lit(False))).alias("kept"), "char_distance", "word_distance")


REFERENCE = "array<struct<classes: array<double>, total: double, q: array<double>, e: array<double>>>"


def _by_place(reference: dict, common: list[str]) -> dict:
    """A reference with its words' shares (q) and their p log p (e) by place in common, 0 for other words."""
    q = [reference["words"].get(w, 0.0) for w in common]
    return {"classes": reference["classes"], "total": sum(q), "q": q, "e": [x and x * math.log2(x) for x in q]}


def _entropy(p: Column) -> Column:
    return p * F.log2(p)


def _distance_words(p: Column, r: Column) -> Column:
    """Bins: the language's words, and all other words. Bins that the text lacks have half their share."""

    def add(a: Column, x: Column) -> Column:
        q = F.get(r["q"], x["i"] - 1)
        return F.when(q > 0, F.struct((a["d"] + x["e"] + F.get(r["e"], x["i"] - 1) - _entropy(x["p"] + q)).alias("d"), (a["p"] + x["p"]).alias("p"), (a["q"] + q).alias("q"))).otherwise(a)

    # with p + q = s, a bin's part of the divergence is (p log p + q log q - s log s + s) / 2
    sums = F.aggregate(p, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q")), add, lambda a: F.struct(((a["d"] + a["p"] + a["q"]) / 2).alias("d"), a["p"].alias("p"), a["q"].alias("q")))
    # aggregate once: the sums of the seen bins, then the unseen ones and the rest
    return F.element_at(F.transform(F.array(sums), lambda z: F.sqrt(F.greatest(F.lit(0.0), z["d"] + (r["total"] - z["q"]) / 2 + _half(F.greatest(F.lit(0.0), 1 - z["p"]), F.greatest(F.lit(0.0), 1 - r["total"]))))), 1)


def _distance_classes(p: Column, r: Column) -> Column:
    parts = F.zip_with(p, r["classes"], _half)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the same columns; no row moves."""
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.col("lang").cast("string").alias("lang"))
    # a filter on the verdict alone would be pushed down with all expressions it depends on, and each computed again;
    # not past a column that is made while rows pass
    judged = _judged(whole, ["row"], CHAR_DISTANCE, WORD_DISTANCE).select("row", "kept", F.monotonically_increasing_id().alias("passed"))
    return judged.where(F.col("kept") & (F.col("passed") >= 0)).select("row.*")
