"""Languages of a text as a mixture: expectation-maximisation over n-gram likelihoods.

Features are the two- and three-character sequences of the lower-cased letters (all else counts as one space),
hashed to BUCKETS. Each learned language has a smoothed distribution over the buckets. A text's language
proportions maximise the likelihood of its features as draws from a mixture of these distributions (EM). Then the set of
its languages grows from the likeliest by the next likeliest, with proportions of its own, for as long as that raises
the likelihood less PENALTY * ln(features) for each language; any number of languages may be in it.

The distributions are learned from a sample of labelled rows, TRAIN_ROWS a language in expectation, chosen by a hash
of doc_id; counts are summed on the executors, and the driver gets BUCKETS numbers a language, for every language.

Defined cases: a text that is null or has no letter is "und" with score 0; without a learned language all are "und"; of
languages with one proportion the first by name counts as likelier; a null doc_id has the checksum of an empty text; equal rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.neardup import mix64
from cloakwork.llm.tokens import batches

BUCKETS, TRAIN_ROWS = 1 << 15, 4000
STEPS, PENALTY, SMOOTH = 12, 4.0, 0.5
#: Characters at a time, for four languages; fewer for more.
SLICE = 400_000
PREDICTED = "doc_id long, lang_pred string, score double, mixture string"
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.string())])
_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0][points]


def features(text: str) -> np.ndarray:
    """Buckets of the text's n-grams; empty if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter(c)
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter | np.append(True, letter[:-1])  # the first of other characters in a row
    c = np.concatenate([[32], np.where(letter, c, 32)[keep], [32]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        two = c[:-1] * np.uint64(0x1F123BB5) + c[1:]
        three = (two[:-1] * np.uint64(0x1F123BB5) + c[2:]) ^ np.uint64(0x5555)
    return (mix64(np.concatenate([two, three])) >> np.uint64(49)).astype(np.int64)


def _count_part(parts):
    """Rows of (lang, text) to counts of (lang, bucket) of this partition."""
    counts: dict[str, np.ndarray] = {}
    for batch in parts:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            f = features(text)
            if len(f):
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts[lang] += np.bincount(f, minlength=BUCKETS)
    for lang, c in counts.items():
        i = np.flatnonzero(c)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(i), pa.string()), "bucket": i, "n": c[i]})


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and their distributions as an array (BUCKETS, languages), from labelled docs(doc_id, text, lang)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").count()
    sized = known.join(F.broadcast(sizes.select(F.col("lang").alias("l"), "count")), F.col("lang") == F.col("l"))
    part = (F.least(F.lit(1.0), F.lit(rows) / F.col("count")) * (1 << 30)).cast("long")
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part
    counted = sized.where(chosen).select("lang", "text").mapInArrow(_count_part, "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    p = np.full((BUCKETS, len(langs)), SMOOTH)
    at = {lang: i for i, lang in enumerate(langs)}
    p[table["bucket"].to_numpy(int), table["lang"].map(at).to_numpy(int) if len(table) else np.empty(0, int)] += table["n"].to_numpy(float)
    return langs, (p / p.sum(0, keepdims=True)).astype(np.float32)


def _em(likely: np.ndarray, n: np.ndarray, starts: np.ndarray, doc: np.ndarray, total: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages, and the log-likelihood, of each document."""
    p = allowed / allowed.sum(1, keepdims=True)
    for _ in range(steps):
        w = likely * p[doc]
        w *= (n / w.sum(1))[:, None]
        p = np.add.reduceat(w, starts) / total[:, None]
    return p, np.add.reduceat(n * np.log((likely * p[doc]).sum(1)), starts)


def mixtures(texts: list[str], model: np.ndarray) -> list[np.ndarray | None]:
    """Language proportions of each text; None if it has no letter."""
    counts = [np.bincount(f, minlength=BUCKETS) if len(f := features(t)) else None for t in texts]
    which = [i for i, c in enumerate(counts) if c is not None]
    out: list[np.ndarray | None] = [None] * len(texts)
    if not which or not model.shape[1]:
        return out
    buckets = [np.flatnonzero(counts[i]) for i in which]
    n = np.concatenate([counts[i][b] for i, b in zip(which, buckets)]).astype(np.float32)
    size = np.array([len(b) for b in buckets])
    starts, doc = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    likely = model[np.concatenate(buckets)]
    total = np.add.reduceat(n, starts)
    p, _ = _em(likely, n, starts, doc, total, np.ones((len(size), model.shape[1]), np.float32), STEPS)
    order = np.argsort(-p, axis=1, kind="stable")
    best_p, best = np.zeros_like(p), np.full(len(size), -np.inf)
    growing = np.arange(len(size))  # documents whose set the last language has improved
    for k in range(1, model.shape[1] + 1):
        allowed = np.zeros((len(growing), model.shape[1]), np.float32)
        np.put_along_axis(allowed, order[growing, :k], 1, axis=1)
        own = slice(None) if len(growing) == len(size) else np.isin(doc, growing)
        size_k = size[growing]
        q, fit = _em(likely[own], n[own], np.cumsum(size_k) - size_k, np.repeat(np.arange(len(size_k)), size_k), total[growing], allowed, 0 if k == 1 else STEPS)
        fit = fit - k * PENALTY * np.log(np.maximum(total[growing], 2))
        better = fit > best[growing]
        growing = growing[better]
        best_p[growing], best[growing] = q[better], fit[better]
        if not len(growing):
            break
    for i, q in zip(which, best_p):
        out[i] = q
    return out


def predict(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (the proportion of lang_pred) and mixture of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    def run(parts):
        langs, model = shared.value
        for batch in parts:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in batches(texts, [len(t or "") + 1000 for t in texts], SLICE * 4 // max(4, len(langs))):
                rows = []
                for p in mixtures([t or "" for t in texts[a:b]], model):
                    if p is None:
                        rows.append(("und", 0.0, ""))
                    else:
                        at = np.argsort(-p, kind="stable")
                        rows.append((langs[at[0]], min(1.0, float(p[at[0]])), ",".join(f"{langs[i]}:{p[i]:.3f}" for i in at if p[i] >= 0.0005)))
                yield pa.RecordBatch.from_arrays([ids[a:b], *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(_PREDICTED)[1:]))], schema=_PREDICTED)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PREDICTED)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score, mixture."""
    langs, model = learn(docs.where(~held_out()).select("doc_id", "text", F.col("lang").cast("string").alias("lang")))
    return predict(docs, langs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "mixture")
