"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is a multiset of paragraphs: its lines, cut further after sentence ends, and sentences after every SENTENCE
words, so that a text of one line has several. The digest of a paragraph is a 64-bit hash of its text and
of how many times it came before. A sketch has three rows of cells; a digest is added to one cell of each. A cell
holds a count, the sum of digests and the sum of their check hashes. The difference of two texts' sketches holds
only the digests that one of them lacks; cells with one digest are peeled until none is left. If cells remain, both
are sketched anew with four times the cells. The recovered digests give the likeness: shared paragraphs divided by
all paragraphs (1 for two empty texts).

All documents of a slice are sketched and peeled together with numpy.

A fingerprint is the text "ib1:paragraphs:cells:hash of the text:cells in base64", equal for equal texts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.neardup import mix64
from cloakwork.llm.shared import partitions
from cloakwork.llm.tokens import batches

#: Cells of a fingerprint (a multiple of 3), growth after a failure, words of a long sentence's part.
CELLS, GROWTH, SENTENCE = 48, 4, 16
#: Characters sketched at a time.
SLICE = 400_000
_END = re.compile(r"\n\s*|(?<=[.!?])\s+")
_PART = re.compile(rf"(?:\S+\s*){{1,{SENTENCE}}}")
_CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def paragraphs(text: str) -> list[str]:
    out: list[str] = []
    for p in _END.split(text):
        if len(p) > 2 * SENTENCE and len(p.split()) > SENTENCE:
            out += _PART.findall(p)
        elif p:
            out.append(p)
    return out


def digests(text: str) -> np.ndarray:
    """64-bit digests of the text's paragraphs, none twice: a repeated one would never peel."""
    parts = paragraphs(text)
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    if len(set(parts)) < len(parts):
        seen: Counter[str] = Counter()
        before = np.empty(len(parts), np.uint64)
        for i, p in enumerate(parts):
            before[i] = seen[p]
            seen[p] += 1
        with np.errstate(over="ignore"):
            keys = np.where(before > 0, mix64(keys + before * np.uint64(0x9E3779B97F4A7C15)), keys)
    while len(first := np.unique(keys, return_index=True)[1]) < len(keys):  # two hashes met by chance
        again = np.ones(len(keys), bool)
        again[first] = False
        keys[again] = mix64(keys[again] + np.uint64(1))
    return keys


def _check(keys: np.ndarray) -> np.ndarray:
    return mix64(keys ^ np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFFFFFF)


def _at(keys: np.ndarray, row: int, cells: np.ndarray) -> np.ndarray:
    """The key's cell in this row of a sketch with so many cells."""
    third = cells // 3
    with np.errstate(over="ignore"):
        return row * third + ((mix64(keys * _SALTS[row]) >> np.uint64(33)).astype(np.int64) % third)


class Sketches:
    """Sketches of many documents, one after another; cells: of each document."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.base = np.cumsum(cells) - cells
        n = int(cells.sum())
        self.count, self.key, self.check = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add(self, doc: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        weight = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        with np.errstate(over="ignore"):
            k, c = keys * weight.astype(np.uint64), _check(keys) * weight.astype(np.uint64)
            for row in range(3):
                i = self.base[doc] + _at(keys, row, self.cells[doc])
                np.add.at(self.count, i, weight)
                np.add.at(self.key, i, k)
                np.add.at(self.check, i, c)

    def packed(self, doc: int) -> bytes:
        a = self.base[doc]
        b = a + self.cells[doc]
        out = np.empty(b - a, _CELL)
        out["count"], out["key"], out["check"] = self.count[a:b], self.key[a:b], self.check[a:b]
        return out.tobytes()

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the difference of two sketches: documents, keys and signs recovered, and which documents failed."""
        owner = np.repeat(np.arange(len(self.cells)), self.cells)
        docs, keys, signs = [], [], []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            with np.errstate(over="ignore"):
                k = np.where(sign > 0, self.key[look], -self.key[look])
                pure = np.where(sign > 0, self.check[look], -self.check[look]) == _check(k)
            look, k, sign = look[pure], k[pure], sign[pure]
            doc = owner[look]
            with np.errstate(over="ignore"):  # a digest may stand alone in several cells
                _, first = np.unique(k + doc.astype(np.uint64) * _SALTS[0], return_index=True)
            doc, k, sign = doc[first], k[first], sign[first]
            if not len(k):
                break
            docs.append(doc)
            keys.append(k)
            signs.append(sign)
            self.add(doc, k, -sign)
            touched = np.unique(np.concatenate([self.base[doc] + _at(k, row, self.cells[doc]) for row in range(3)]))
            look = touched[np.abs(self.count[touched]) == 1]
        bad = np.zeros(len(self.cells), bool)
        bad[owner[(self.count != 0) | (self.key != 0) | (self.check != 0)]] = True
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        return join(docs, np.int64), join(keys, np.uint64), join(signs, np.int64), bad


def difference(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest arrays, the digests that only the first and only the second has, by peeling."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64),) * 2] * len(a)
    todo = np.arange(len(a))
    while len(todo):
        # a table much smaller than the difference in size can't be peeled
        least = np.array([abs(len(a[i]) - len(b[i])) for i in todo])
        size = np.full(len(todo), cells, np.int64)
        while (small := size < 1.3 * least).any():
            size[small] *= GROWTH
        s = Sketches(size)
        for side, sign in ((a, 1), (b, -1)):
            n = np.array([len(side[i]) for i in todo])
            s.add(np.repeat(np.arange(len(todo)), n), np.concatenate([side[i] for i in todo]), sign)
        doc, key, sign, bad = s.peel()
        order = np.argsort(doc, kind="stable")
        doc, key, sign = doc[order], key[order], sign[order]
        ends = np.searchsorted(doc, np.arange(len(todo) + 1))
        for j in np.flatnonzero(~bad).tolist():
            k, g = key[ends[j] : ends[j + 1]], sign[ends[j] : ends[j + 1]]
            out[todo[j]] = (k[g > 0], k[g < 0])
        todo, cells = todo[bad], cells * GROWTH
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    out = []
    for x, y, (p, q) in zip(a, b, difference(a, b)):
        every = (len(x) + len(y) + len(p) + len(q)) / 2
        out.append((every - len(p) - len(q)) / every if every else 1.0)
    return out


def fingerprints(texts: list[str], keys: list[np.ndarray]) -> list[str]:
    s = Sketches(np.full(len(texts), CELLS, np.int64))
    s.add(np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate([*keys, np.empty(0, np.uint64)]), 1)
    return [f"ib1:{len(k)}:{CELLS}:{xxhash.xxh3_64_hexdigest(t)}:{base64.b64encode(s.packed(i)).decode()}" for i, (t, k) in enumerate(zip(texts, keys))]


def parse(fingerprint: str) -> tuple[int, np.ndarray]:
    """(paragraphs, cells) of a fingerprint."""
    _, n, _, _, data = fingerprint.split(":")
    return int(n), np.frombuffer(base64.b64decode(data), _CELL)


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as much, or all, of the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDITS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, text), the last one only follows."""
    texts = [t for _, t in rows]
    new = [edited(a, b) for a, b in zip(texts, texts[1:])]
    keys = [digests(t) for t in texts]
    new_keys = [digests(t) for t in new]
    old, after = keys[:-1], keys[1:]
    columns = [
        [d for d, _ in rows[:-1]],
        [len(t) for t in texts[:-1]],
        [hashlib.sha256(t.encode()).hexdigest() for t in new],
        fingerprints(texts[:-1], old),
        fingerprints(new, new_keys),
        likeness(old, new_keys),
        likeness(old, after),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDITS)], schema=_EDITS)


def _edit_part(parts):
    """Rows (bucket, extra, doc_id, text) in order; a bucket's extra row is the one that follows its last."""
    bucket, held, closed = None, [], False
    for batch in parts:
        where, extra = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ids, texts = batch.column(2).to_pylist(), [t or "" for t in batch.column(3).to_pylist()]
        for a, b in batches(texts, [len(t) + 50 for t in texts], SLICE):
            for k in range(a, b):
                if where[k] != bucket:
                    if len(held) > 1:
                        yield _compare(held)
                    bucket, held, closed = where[k], [], False
                if not closed:
                    held.append((ids[k], texts[k]))
                    closed = extra[k]
            if len(held) > 1:
                yield _compare(held)
                held = held[-1:] if not closed else []
    if len(held) > 1:
        yield _compare(held)


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of docs(doc_id, text) and of its edited version (its last half replaced by the
    start of the next document's text), and how alike its fingerprint is to that and to the next document's.

    The next document is the one with the next smaller doc_id, after the last the first; a single document follows
    itself. One exchange brings neighbours together, a range a task: ranges are found from ids and hashes alone, and the
    first document of each range is dealt to the range before it, too. What the driver gets is one id and hash a range
    (and the sample of ids by which Spark finds ranges, at most a million).

    Defined cases: a null text is an empty one; rows of equal doc_id come in descending order of their texts' hash, by
    which any number of them are split over ranges; rows without doc_id come last; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"k": F.coalesce(F.col("doc_id"), F.lit(-(2**63))), "h": F.xxhash64("text")})
    ranges = docs.select("k", "h").repartitionByRange(partitions(spark), "k", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("k", "h")).alias("top")).collect()
    tops = sorted((r["top"]["k"], r["top"]["h"]) for r in ranges)  # ascending; a document of range i is at most tops[i]
    if not tops:
        return spark.createDataFrame([], EDITS)
    top_k, top_h = (np.array(x, np.int64) for x in zip(*tops))

    # range, and whether the document is the highest of it; ids and hashes alone go to Python
    @F.pandas_udf("struct<b: int, head: boolean>")
    def place(k: pd.Series, h: pd.Series) -> pd.DataFrame:
        k, h = k.to_numpy(), h.to_numpy()
        b, end = np.searchsorted(top_k, k), np.searchsorted(top_k, k, "right")
        for i in np.flatnonzero(end > b).tolist():  # ids that are tops
            b[i] += np.searchsorted(top_h[b[i] : end[i]], h[i])
        return pd.DataFrame({"b": b.astype(np.int32), "head": (top_k[b] == k) & (top_h[b] == h)})

    n = len(tops)
    dealt = docs.withColumn("at", place("k", "h")).select("doc_id", "h", "text", "at.b", "at.head")
    is_head = F.col("head")
    # descending order: range b + 1 comes before b, and the highest follows range 0
    copies = F.when(is_head, F.array(F.struct(F.col("b").alias("b"), F.lit(False).alias("extra")), F.struct(((F.col("b") + 1) % n).alias("b"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct(F.col("b").alias("b"), F.lit(False).alias("extra"))))
    rows = dealt.select(F.explode(copies).alias("c"), "doc_id", "text", "h").select("c.b", "c.extra", "doc_id", "text", "h")
    order = ["extra", F.desc_nulls_last("doc_id"), F.desc("h"), "text"]
    return rows.repartitionById(n, F.col("b")).sortWithinPartitions(*order).mapInArrow(_edit_part, EDITS)
