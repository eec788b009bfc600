"""Near-duplicate detection with DartMinHash signatures.

A document is the set of its SHINGLE-word shingles (or, weighted, the multiset). Darts are thrown by hash
at the plane element x weight x rank; those under an element's weight and of rank up to R hit it, with R
chosen so that the document is hit about k ln k + 2k times, however long it is. Each dart belongs to one
of k coordinates; the earliest on each is the document's signature, and two documents agree on a
coordinate with the probability of their (weighted) Jaccard similarity.

Classes are found in rounds, each of links that are checked exactly on the whole shingle sets, and each joins
classes of the round before, so that later rounds handle few rows:
1. Equal texts are one text, by digest; signatures, sets and links are those of texts, and doc_ids come in
   at the end.
2. Signatures are banded. Texts that share a band are linked to the least of it - first to the least
   over all their bands, then, where that left them in another class, to the least of each band.
3. In bands that still hold several classes, every text outside the largest class is compared exactly with
   all texts of the band, in blocks of bounded size; a block returns only the links that join classes.
So a band of thousands of copies makes one link a copy, no band is cut short or skipped, and every pair that
shares a band is linked if its sets reach the threshold, or else by other links.

A band's least text comes from a partial aggregate that is joined back. Memory of a task: an Arrow batch,
two blocks of BLOCK sets, or the two shingle sets of a pair.

Texts of under SHINGLE words are one shingle of all their words; very long texts have all their shingles.
Null and wordless texts link to nothing but, if not null, to equal texts. near_duplicates() takes rows that
share a doc_id as one document, which joins the classes of all its texts, so repeated rows are one; a null
doc_id is kept there, in a class of its own. text_classes() tells the texts apart, whatever their doc_ids.
A class is named by its least doc_id, so there are no ties. An empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import shared_table, small_batches
from inkspan.llm.components import components, jump
from inkspan.llm.rolling import BASES, mix, window_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
BLOCK = 512


def shingles(raw: bytes | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct shingles, sorted, and how often each occurs."""
    words = word_hashes(raw or b"")
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(window_hashes(words, min(size, len(words))), return_counts=True)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def throw(elements: np.ndarray, weights: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(rank, id) of the darts of rank up to ``reach`` that hit the weighted elements.

    The weight axis is cut into unit cells. In a cell, darts arrive along the rank axis as a Poisson
    process of rate 1 with gaps drawn by hash; in the last, broken cell a dart's height must be under
    the weight. So a dart depends on its element, cell and number alone: documents share darts.
    """
    cells = np.ceil(weights).astype(np.int64)
    cell = np.repeat(elements, cells)
    level = np.arange(len(cell)) - np.repeat(np.cumsum(cells) - cells, cells)
    height = np.repeat(weights, cells) - level
    seed = mix(cell + level.astype(np.uint64) * BASES[2])
    # The first few arrivals of all cells at once, then cell by cell what is still in reach.
    most = int(reach + 6 * np.sqrt(reach) + 4)
    ranks, ids = [], []
    rank, number = np.zeros(len(cell)), 0
    while len(seed):
        numbers = np.arange(number, number + most, dtype=np.uint64)
        dart = mix(seed[:, None] + (numbers * np.uint64(2) + np.uint64(1))[None, :] * BASES[0])
        gaps = -np.log(_uniform(dart))
        gaps[:, 0] += rank
        at = np.cumsum(gaps, 1)
        hit = at <= reach
        broken = height < 1
        if broken.any():
            hit[broken] &= _uniform(mix(dart[broken] ^ BASES[1])) <= height[broken, None]
        ranks.append(at[hit])
        ids.append(dart[hit])
        on = at[:, -1] <= reach
        seed, rank, height = seed[on], at[on, -1], height[on]
        number, most = number + most, max(1, most // 2)
    return np.concatenate(ranks), np.concatenate(ids)


def signature(elements: np.ndarray, weights: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The id of the earliest dart on each of k coordinates."""
    reach = (k * np.log(k) + 2 * k) / weights.sum()
    while True:
        rank, ids = throw(elements, weights, reach)
        last_first = np.argsort(-rank, kind="stable")
        at = (mix(ids + BASES[2]) % np.uint64(k)).astype(np.int64)[last_first]
        out = np.zeros(k, np.uint64)
        out[at] = ids[last_first]  # the earliest is written last
        if len(np.unique(at)) == k:
            return out
        reach *= 2


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(_k, text) -> _k, _bands array<long>; texts without words are left out."""
    kind = docs.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            keys, keyed = [], []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                elements, counts = shingles(raw)
                if not len(elements):
                    continue
                sig = signature(elements, counts.astype(float) if weighted else np.ones(len(elements)), bands * rows)
                band = salt.copy()
                for column in sig.reshape(bands, rows).T:
                    band = mix(band * BASES[0] + column)
                keys.append(k)
                keyed.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(keyed, pa.list_(pa.int64()))], ["_k", "_bands"])

    small_batches(docs.sparkSession)
    return docs.select("_k", F.col("text").cast("binary")).mapInArrow(run, f"_k {kind}, _bands array<long>")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(_k, text) -> _k, _set binary: the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(raw)[0].tobytes() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["_k", "_set"])

    return docs.select("_k", F.col("text").cast("binary")).mapInArrow(run, "_k long, _set binary")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold, with their other columns (longs)."""
    names = pairs.columns
    of_a, of_b = (sets.select(F.col("_k").alias(c), F.col("_set").alias("_" + c)) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("_a").to_pylist(), batch.column("_b").to_pylist()
            on = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold for x, y in zip(a, b)]
            yield batch.select(names).filter(pa.array(on, pa.bool_()))

    return pairs.join(of_a, "a").join(of_b, "b").select(*names, "_a", "_b").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """_k, _class after the classes that links (a, b) name have become one; the links are few, as classes meet, not texts."""
    links = shared_table(links, "class_links")
    if links.isEmpty():
        return classes
    joined = classes.join(components(links).withColumnRenamed("id", "_class"), "_class", "left")
    return shared_table(joined.select("_k", F.coalesce("root", "_class").alias("_class")), "classes")


class Block:
    """Shingle sets, posted by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def similarities(self, s: np.ndarray) -> np.ndarray:
        """Jaccard similarities of a set with all of the block."""
        lo, hi = np.searchsorted(self.values, s), np.searchsorted(self.values, s, "right")
        n = hi - lo
        common = np.bincount(self.owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(self.sizes))
        return common / np.maximum(self.sizes + len(s) - common, 1)


def stragglers(bands: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between classes that texts in one band make.

    Bands of one class drop out by an aggregate. In the others, members outside the largest class meet
    all members, BLOCK against BLOCK, by their shingle sets.
    """
    placed = bands.join(classes, "_k")
    sizes = placed.groupBy("_band", "_class").agg(F.count(F.lit(1)).alias("_n"))
    mixed = sizes.groupBy("_band").agg(
        F.max(F.struct("_n", "_class"))["_class"].alias("_major"), F.sum("_n").alias("_all"),
        (F.sum("_n") - F.max("_n")).alias("_others"), F.count(F.lit(1)).alias("_kinds"),
    ).where("_kinds > 1")
    mixed = shared_table(mixed, "mixed")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    members = placed.join(mixed, "_band").withColumns({"_left": blocks("_others"), "_right": blocks("_all"), "_outside": F.col("_class") != F.col("_major")})
    members = members.join(sets, "_k")
    spot = lambda n: F.pmod(F.xxhash64("_k"), F.col(n)).cast("int")
    side = lambda df, out, i, j: df.select("_band", i.alias("_i"), j.alias("_j"), "_class", "_set", F.lit(out).alias("_out"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = side(members.where("_outside"), True, spot("_left"), every("_right"))
    right = side(members, False, every("_left"), spot("_right"))

    def compare(block: pa.Table) -> pa.Table:
        """Links between classes, as a forest: classes that one link has joined are not compared again."""
        classes = block.column("_class").to_numpy()
        out = block.column("_out").to_numpy()
        mine, theirs = np.flatnonzero(out), np.flatnonzero(~out)
        found: list[tuple[int, int]] = []
        if len(mine) and len(theirs):
            sets = [np.frombuffer(x, np.uint64) for x in block.column("_set").to_pylist()]
            root = np.unique(classes, return_inverse=True)[1]
            posted = Block([sets[y] for y in theirs])
            for x in mine:
                if (root[theirs] == root[x]).all():
                    continue
                for y in theirs[posted.similarities(sets[x]) >= threshold]:
                    if root[x] != root[y]:
                        found.append((max(classes[x], classes[y]), min(classes[x], classes[y])))
                        root[root == root[y]] = root[x]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return left.unionByName(right).groupBy("_band", "_i", "_j").applyInArrow(compare, "a long, b long").distinct()


def digest(text: str = "text") -> Column:
    """What tells texts apart; null for null."""
    return F.when(F.col(text).isNotNull(), F.concat_ws(":", F.md5(F.col(text).cast("binary")), F.octet_length(text)))


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(doc_id, text) -> _d, _id, _root: a row for each distinct text, by digest; null texts are left out.

    _id is the least doc_id that holds the text (null if only null ids do), _root names the class.
    """
    known = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("_d"), "text")
    least = known.groupBy("_d").agg(F.min("doc_id").alias("_id"))
    # Numbered by digest, so that hubs do not change between runs.
    texts = shared_table(least.sortWithinPartitions("_d").withColumn("_k", F.monotonically_increasing_id()), "texts")
    signed = sign(known.select(F.col("_d").alias("_k"), "text"), bands, rows, weighted).withColumnRenamed("_k", "_d").dropDuplicates(["_d"])
    signatures = shared_table(signed.join(texts.select("_d", "_k"), "_d").select("_k", "_bands"), "signatures")
    banded = signatures.select("_k", F.explode("_bands").alias("_band"))
    shared = banded.groupBy("_band").agg(F.min("_k").alias("_hub"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    banded = shared_table(banded.join(shared.select("_band", "_hub"), "_band"), "bands")
    # Each text that shares a band, with the least texts of its bands, itself left out: at most one a band.
    hubs = banded.groupBy("_k").agg(F.collect_set("_hub").alias("_h"))
    hubs = shared_table(hubs.select("_k", F.array_sort(F.array_remove("_h", F.col("_k"))).alias("_hubs")), "hubs")
    # One row a text, whatever ids hold it; copies are folded before they move.
    once = known.groupBy("_d").agg(F.first("text").alias("text")).join(texts.select("_d", "_k").join(hubs, "_k", "left_semi"), "_d")
    sets = shared_table(shingle_sets(once), "sets")

    # Each text has one link to a smaller one, so the links are a forest already.
    first = hubs.where(F.size("_hubs") > 0).select(F.col("_k").alias("a"), F.element_at("_hubs", 1).alias("b"))
    parents = shared_table(verify(first, sets, threshold).select(F.col("a").alias("id"), F.col("b").alias("root")), "first_links")
    roots = jump(parents).withColumnRenamed("id", "_k")
    classes = shared_table(hubs.select("_k").join(roots, "_k", "left").select("_k", F.coalesce("root", "_k").alias("_class")), "classes")
    others = hubs.where(F.size("_hubs") > 1).select(F.col("_k").alias("a"), F.explode(F.slice("_hubs", F.lit(2), F.size("_hubs") - 1)).alias("b"))
    ca, cb = (classes.select(F.col("_k").alias(c), F.col("_class").alias("_c" + c)) for c in "ab")
    apart = shared_table(others.join(ca, "a").join(cb, "b").where("_ca <> _cb"), "apart")
    classes = _merged(classes, verify(apart, sets, threshold).select(F.col("_ca").alias("a"), F.col("_cb").alias("b")).distinct())
    classes = _merged(classes, stragglers(banded.select("_k", "_band"), classes, sets, threshold))
    return texts.join(classes, "_k", "left").select("_d", "_id", F.coalesce("_class", "_k").alias("_root"))


def least_texts(classes: DataFrame) -> DataFrame:
    """_root, _id, _d: of each class the text with the least doc_id, null last, then the least digest."""
    order = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_d")
    return classes.groupBy("_root").agg(F.min(order).alias("_b")).select("_root", "_b._id", "_b._d")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, class_id: the least doc_id of each document's class."""
    known = docs.where("doc_id is not null")
    classes = shared_table(text_classes(known, threshold, bands, rows, weighted), "text_classes")
    # By another key than the aggregate's, so that Spark deals both sides out anew and can split a hot class.
    hubs = least_texts(classes).select((-F.col("_root")).alias("_key"), F.col("_id").alias("_hub"))
    hubs = shared_table(classes.withColumn("_key", -F.col("_root")).join(hubs, "_key").where("_hub <> _id").select("_d", "_hub"), "text_hubs")
    # Copies share a digest: by another key than the joins before, both sides are dealt out anew for this one.
    texts = classes.select("_d", "_id").join(hubs, "_d", "left").select(F.reverse("_d").alias("_turned"), F.coalesce("_hub", "_id").alias("_hub"))
    held = known.where("text is not null").select(F.col("doc_id").cast("long").alias("a"), F.reverse(digest()).alias("_turned"))
    pairs = held.join(texts, "_turned").select("a", F.col("_hub").alias("b"))
    spans = shared_table(pairs.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("_last")), "spans")
    # A document with several texts joins the classes of all of them; where no id is in two, nothing is left to join.
    final = spans.select(F.col("a").alias("id"), F.col("b").alias("root")) if spans.where("b <> _last").isEmpty() else components(pairs)
    ids = docs.select("doc_id").distinct()
    return ids.join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))
