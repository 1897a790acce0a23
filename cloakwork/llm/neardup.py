"""MinHash near-duplicate groups by tensored banding.

A document is the set of its distinct word shingles. Two small collections of BANDS band values each (a band value
combines ROWS minhashes) stand for BANDS * BANDS tables: the key of table (i, j) is the pair of the i-th value of the
first and the j-th of the second. So 2 * BANDS * ROWS minhashes are computed instead of 2 * ROWS * BANDS ** 2. A pair
of similarity s shares some key with probability (1 - (1 - s**ROWS) ** BANDS) ** 2: 0.9997 at 0.8, 7e-12 at 0.02.

1. Signatures: one pass over the texts; equal sets become one class, known by its smallest doc_id.
2. Values that only one class has are dropped before pairs of values form keys. The classes of a key are its bucket;
   of buckets with the same classes one stays.
3. Rounds that link: in every bucket whose classes are not connected yet, each class may be compared with the smallest
   one; a class is compared with one such class a round, on the full shingle sets. Links connect classes, and buckets
   that are connected are done. A group of near copies is connected by about one comparison a class, whatever its size.
4. The buckets that are left hold classes that share keys but are not linked, mostly. Their components are groups whose
   full sets meet in one task, which confirms what links there are. Groups above BLOCK * 2 classes are dealt in tiles, a
   task for each pair of blocks, so that no pair is missed and no task grows with the group. A task compares no classes
   that are connected already, and gives no more links than it needs to connect.
5. The components of the confirmed links, and one join back to all documents.

A center is compared with TILE classes a task, whose sets pass one by one. The stored links are between classes;
copies are never expanded.

Defined cases: a null or empty text, and one without words, has an empty set, links with nothing and is kept; a text
of fewer words than a shingle is one shingle; rows with one doc_id count as one document, whose texts, if they differ, are
linked with each other; a row without doc_id takes
no part in any group (component_id null) and is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.components import components
from cloakwork.llm.shared import cut, free_name, hot_join

BANDS, ROWS = 17, 4
#: Classes that a task compares with a center.
TILE = 512
#: Rounds that compare each class with one other, and classes of a block; a task confirms links within two blocks.
LINKING, BLOCK = 2, 256
FEATURES = "doc_id long, text_hash long, n_shingles long, class string, vals array<long>"
_FEATURES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.string()), ("vals", pa.list_(pa.int64()))])
_M = np.random.default_rng(20_240_229).integers(1, 2**63, 2 * BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_A = np.random.default_rng(7).integers(0, 2**63, 2 * BANDS * ROWS, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of A-Z-lower-cased text."""
    w = (text or "").encode().lower().split()  # of bytes: ASCII letters, ASCII white space
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    if len(w) < size:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), 1)], np.uint64)
    with np.errstate(over="ignore"):
        s = np.zeros(len(w) - size + 1, np.uint64)
        for i in range(size):
            s = mix64(s * np.uint64(3) + h[i : len(w) - size + 1 + i])
    return np.unique(s)


def band_values(s: np.ndarray) -> np.ndarray:
    """2 * BANDS band values of a set; the last bit tells the collection."""
    with np.errstate(over="ignore"):
        low = np.full(len(_M), np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(s), 1024):
            x = s[a : a + 1024, None] * _M + _A
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9E3779B97F4A7C15)
            low = np.minimum(low, x.min(0))
        v = np.arange(2 * BANDS, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        for r in range(ROWS):
            v = mix64(v * np.uint64(31) + low.reshape(2 * BANDS, ROWS)[:, r])
    side = np.repeat(np.array([0, 1], np.uint64), BANDS)
    return ((v << np.uint64(1)) | side).view(np.int64)


def _features(size: int):
    def run(parts):
        for batch in parts:
            n, names, vals = [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), size)
                n.append(len(s))
                names.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                vals.append(band_values(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(vals, pa.list_(pa.int64()))], schema=_FEATURES)

    return run


COMPARED = "id long, center long, both long, total long"
_COMPARED = pa.schema([(n, pa.int64()) for n in ("id", "center", "both", "total")])


def _compare(size: int):
    """Sizes of intersection and union of sorted rows (center, tile, place, id, text); place 0 is the center itself."""

    def run(parts):
        mark = np.empty(0, np.uint64)
        for batch in parts:
            out = []
            for center, place, i, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), batch.column(4)):
                s = shingles(text.as_py(), size)
                if place == 0:
                    mark = s
                else:
                    both = int(np.isin(s, mark, assume_unique=True).sum())
                    out.append((i, center, both, len(s) + len(mark) - both))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], schema=_COMPARED)

    return run


def compare(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """pairs(id, center) with the sizes both and total of their sets' intersection and union; texts(rid, text)."""
    members = hot_join(pairs, pairs.groupBy("center").agg(F.count("*").alias("n")), "center")
    dealt = members.select("id", "center", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / TILE)).alias("tile"))
    own = dealt.groupBy("center", "tile").agg(F.lit(0).alias("place")).withColumn("id", F.col("center"))
    rows = dealt.withColumn("place", F.lit(1)).unionByName(own)
    # never by broadcast: candidates grow with the documents
    rows = texts.hint("merge").join(rows, texts["rid"] == rows["id"]).select("center", "tile", "place", "id", "text")
    return rows.repartition(F.xxhash64("center", "tile")).sortWithinPartitions("center", "tile", "place", "id").mapInArrow(_compare(size), COMPARED)


def buckets(classes: DataFrame) -> DataFrame:
    """key, id of the classes(id, vals) that share a key with another; no two buckets are alike."""
    values = classes.select("id", F.explode("vals").alias("v"))
    shared = values.groupBy("v").count().where("count > 1").select("v")
    kept = hot_join(values, shared, "v").groupBy("id").agg(F.collect_set("v").alias("v"))
    first, second = F.filter("v", lambda x: x % 2 == 0), F.filter("v", lambda x: x % 2 != 0)
    keys = kept.select("id", F.explode(first).alias("a"), second.alias("b")).select("id", F.explode(F.transform("b", lambda y: F.xxhash64(F.col("a"), y))).alias("key"))
    keys = cut(keys, "keys")
    content = [F.count("*").alias("n"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    one = keys.groupBy("key").agg(*content).where("n > 1").groupBy("n", "least", "x", "y").agg(F.min("key").alias("key"))
    return hot_join(keys, one.select("key"), "key")


def _merged(components_: DataFrame | None, links: DataFrame) -> DataFrame:
    """components_(id, component) after links(u, v): the links between components alone are followed."""
    if components_ is None:
        return cut(components(links), "components")
    of = lambda c: components_.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    mapped = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select("u", "v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv"))
    moved = components(mapped.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).select(F.col("id").alias("component"), F.col("component").alias("to"))
    nodes = mapped.select(F.col("u").alias("id"), F.col("cu").alias("component")).unionByName(mapped.select(F.col("v").alias("id"), F.col("cv").alias("component")))
    every = components_.unionByName(nodes).distinct()
    return cut(hot_join(every, moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "components")


def _open(now: DataFrame, components_: DataFrame | None) -> DataFrame:
    """now(key, id) without connected buckets; c: a class's component, least and least_c: the bucket's smallest class."""
    labelled = now.withColumn("c", F.col("id")) if components_ is None else now.join(components_, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    spread = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("id").alias("least"), F.min_by("c", "id").alias("least_c")).where("low <> high")
    return hot_join(labelled, spread.select("key", "least", "least_c"), "key")


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "center").alias("lo"), F.greatest("id", "center").alias("hi"), "center")


def _new(pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """pairs(id, center), each pair once, either way, and none of those compared."""
    once = _unordered(pairs).groupBy("lo", "hi").agg(F.min("center").alias("center"))
    once = once.join(_unordered(compared).select("lo", "hi"), ["lo", "hi"], "left_anti")
    return once.select((F.col("lo") + F.col("hi") - F.col("center")).alias("id"), "center")


def links(sets: list[np.ndarray], known: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs with den * intersection >= num * union, enough to connect all sets that such pairs connect; known: names of
    what the sets are connected by already.

    One set is compared with all others at a time, by marking its shingles. Sets that the first comparison has joined
    needn't be compared with each other; only the rest are compared with all.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    count = np.bincount(flat)
    mark = np.zeros(len(count), bool)
    label = np.unique(np.array(known), return_inverse=True)[1]
    left = np.ones(len(sets), bool)  # not yet compared with all that were left
    out: list[tuple[int, int]] = []
    # first the set whose shingles are the most common: it likely joins the most
    u = int(np.argmax(np.add.reduceat(count[flat], starts) / size))
    while True:
        tokens = flat[starts[u] : starts[u] + size[u]]
        mark[tokens] = True
        both = np.add.reduceat(mark[flat].astype(np.int64), starts)
        mark[tokens] = False
        left[u] = False
        for v in np.flatnonzero((den * both >= num * (size + size[u] - both)) & left).tolist():
            if label[u] != label[v]:
                label[label == label[v]] = label[u]
                out.append((u, v))
        names, first, members = np.unique(label[left], return_index=True, return_counts=True)
        if len(names) < 2:  # pairs that are left to compare are joined already
            return out
        u = int(np.flatnonzero(left)[first[np.argmin(members)]])


def _confirm(size: int, num: int, den: int):
    def run(parts):
        group, ids, known, sets = None, [], [], []

        def ended():
            rows = [(ids[a], ids[b]) for a, b in links(sets, known, num, den)] if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in parts:
            for g, i, c, t in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if g != group:
                    yield ended()
                    group, ids, known, sets = g, [], [], []
                ids.append(i)
                known.append(c)
                sets.append(shingles(t.as_py(), size))
        yield ended()

    return run


def connected(classes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """id and component of classes(id, doc_id, text_hash, vals) that are linked with another; docs(doc_id, text_hash,
    text) has the text of each class under its doc_id and text_hash."""
    now = cut(buckets(classes), "buckets")
    members = classes.select("id", F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).join(now.select("id").distinct(), "id")
    # the texts of all candidates, once; never by broadcast, for they grow with the documents
    of_class = docs.hint("merge").join(members, (docs["doc_id"] == members["d"]) & (docs["text_hash"] == members["h"]))
    texts = cut(of_class.select(F.col("id").alias("rid"), "text").dropDuplicates(["rid"]), "texts")
    compared = cut(now.where("key is null").selectExpr("id", "id AS center", "id AS both", "id AS total"), "compared")
    found = None

    def judge(pairs: DataFrame) -> None:
        nonlocal compared, found
        new = cut(compare(cut(pairs, "pairs"), texts, size), "compared")
        compared = compared.unionByName(new)
        found = _merged(found, new.where(den * F.col("both") >= num * F.col("total")).select(F.col("id").alias("u"), F.col("center").alias("v")))

    for _ in range(LINKING):
        now = cut(_open(now, found), "buckets")
        judge(_new(now.where("c <> least_c").select("id", F.col("least").alias("center")), compared).groupBy("id").agg(F.min("center").alias("center")))
    # what is not connected yet: whole groups meet in tasks, which leave out pairs that are connected
    rest = cut(_open(now.select("key", "id"), found), "buckets")
    groups = components(rest.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")))
    groups = cut(groups.join(rest.select("id", "c").distinct(), "id"), "groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    # blocks of a large group: a class belongs to one block and goes to every pair of blocks that has it
    blocks = F.when(F.col("n") <= 2 * BLOCK, F.lit(1)).otherwise(F.ceil(F.col("n") / BLOCK))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("a"), F.greatest(b, F.col("own")).alias("b")))
    # a block meets itself in any tile it is in, so the tile (b, b) is only needed when there is one block
    tiles = F.filter(tiles, lambda t: (t["a"] != t["b"]) | (F.col("blocks") == 1))
    dealt = hot_join(groups, sizes, "component").withColumn("blocks", blocks).withColumn("own", own).select("component", "id", "c", F.explode(tiles).alias("t")).select("id", "c", F.xxhash64("component", "t.a", "t.b").alias("tile"))
    tasks = texts.hint("merge").join(dealt, texts["rid"] == dealt["id"]).select("tile", "rid", "c", "text")
    links_ = tasks.repartition("tile").sortWithinPartitions("tile", "rid").mapInArrow(_confirm(size, num, den), "u long, v long")
    return _merged(found, cut(links_, "links"))


def _numbered(named: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The classes of named(doc_id, text_hash, class, vals), each with an id of its own and the doc_id and text_hash of a
    row, and links(u, v) between the classes of one doc_id, if there are any.

    A class's id is its smallest doc_id. Where different texts have one doc_id, classes may share it; all but the first of
    those have negative ids, from a hash of the class.
    """
    first = F.min(F.struct("doc_id", "text_hash")).alias("row")
    classes = cut(named.groupBy("class").agg(first, F.first("vals").alias("vals")).select("class", "row.doc_id", "row.text_hash", "vals"), "classes")
    several = cut(named.groupBy("doc_id").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("doc_id", "least"), "several")
    if several.isEmpty():
        return classes.withColumn("id", F.col("doc_id")), None
    shared = classes.select("doc_id", "class").join(several.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("class").alias("holder"))
    own = F.col("holder").isNull() | (F.col("holder") == F.col("class"))
    other = -F.shiftrightunsigned(F.xxhash64("class"), 1) - 1
    classes = cut(classes.join(shared, "doc_id", "left").select("class", "doc_id", "text_hash", "vals", F.when(own, F.col("doc_id")).otherwise(other).alias("id")), "classes")
    ids = classes.select("class", "id")
    of_doc = named.select("doc_id", "class").join(several, "doc_id").where("class <> least").select("class", "least").distinct()
    same = of_doc.join(ids.withColumnRenamed("id", "u"), "class").join(ids.select(F.col("class").alias("least"), F.col("id").alias("v")), "least")
    return classes, cut(same.select("u", "v"), "same")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of docs(doc_id, text); linked: den * intersection >= num * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    features = cut(docs.mapInArrow(_features(shingle), FEATURES), "features")
    named = features.where("doc_id is not null and class is not null")
    classes, same = _numbered(named)
    found = connected(classes, docs, shingle, num, den)
    if same is not None:  # a component is known by the smallest doc_id of its classes, not by their ids
        found = _merged(found, same)
        least = found.join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("least"))
        found = hot_join(found, least, "component").select("id", F.col("least").alias("component"))
    named_classes = classes.select("class", "id", "doc_id").join(found, "id", "left").select("class", F.coalesce("component", "doc_id").alias("component"))
    out = hot_join(features, cut(named_classes, "components"), "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of docs that represent their group, with the same columns."""
    dropped = near_duplicates(docs, shingle).where("not kept").select("doc_id").distinct()
    k = free_name(docs.columns, "__dropped")
    dropped = dropped.withColumnRenamed("doc_id", k)
    return docs.join(dropped, F.col("doc_id") == dropped[k], "left_anti").select(*docs.columns)
