"""Approximate nearest neighbours with a permutation index.

A vector is represented by its NEAR nearest pivots in order. The index posts it under each of them: per
block of vectors there is an inverted file, pivot -> (vector, position). For vectors whose lists differ
little the footrule distance - the sum of position differences, a missing pivot counting as position
NEAR - is small; by inverted file it is a constant minus 2 * sum of (NEAR - max(position, position))
over the pivots that both lists hold, so only postings of the query's own pivots are read: with PIVOTS many,
NEAR * NEAR / PIVOTS additions a vector (4), where its distance takes a multiplication a component. The
CANDIDATES best of a block by footrule are reranked by Euclidean distance in double precision on the original
vectors, and the best of all blocks are merged.

Pivots come from a bounded sample (SAMPLE vectors, the first by a hash of vec_id), every vector is indexed.
The index is dealt out once, in blocks of about BLOCK vectors. Queries come in blocks of about QUERY_BLOCK;
one after the other these are broadcast and meet every block of the index where it lies, so neither side is
copied for the other and what is broadcast is bounded. Equal vectors of a block are candidates as one and are
spelled out at the end, smallest vec_id first, so a group of copies takes one candidate's place.

Vectors that are null, empty, zero, or hold a null or non-finite component, or whose number of components
is not the commonest one (ties: the smaller), take no part; neither do null vec_ids. Of rows that repeat a
vec_id the one with the least vector takes part. Ties go to the smaller vec_id. Extra columns are ignored,
whatever their names. Empty input, no queries: an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import shared_dir, shared_table, small_batches

PIVOTS, NEAR, SAMPLE = 1024, 64, 8192
CANDIDATES, BLOCK, QUERY_BLOCK = 512, 8192, 4096


def usable(vector: str) -> Column:
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def choose_pivots(vectors: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """n pivots of a sample, each the farthest of a few draws from those chosen before."""
    distinct = np.unique(vectors, axis=0)
    if len(distinct) <= n:
        return distinct
    rng = np.random.default_rng(3)
    order = rng.permutation(len(distinct))
    chosen = [order[0]]
    least = ((distinct - distinct[order[0]]) ** 2).sum(1)
    for _ in range(n - 1):
        draw = rng.choice(len(distinct), 8, replace=False)
        best = draw[least[draw].argmax()]
        chosen.append(best)
        least = np.minimum(least, ((distinct - distinct[best]) ** 2).sum(1))
    return distinct[chosen]


def permutations(vectors: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    d = (pivots**2).sum(1)[None, :] - 2.0 * vectors @ pivots.T
    near = min(near, len(pivots))
    if near == len(pivots):
        return np.argsort(d, 1, kind="stable")
    part = np.argpartition(d, near - 1, 1)[:, :near]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), 1, kind="stable"), 1)


def inverted_file(perm: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each pivot's postings, and the vectors and positions posted."""
    near = perm.shape[1]
    flat = perm.ravel()
    order = np.argsort(flat, kind="stable")
    bounds = np.searchsorted(flat[order], np.arange(pivots + 1))
    return bounds, order // near, (order % near).astype(np.int32)


#: A block: its ids, which distinct vector each has, which are queries, the distinct vectors and their inverted file.
ARRAYS = {"ids": np.int64, "copies": np.int64, "asked": np.bool_, "vectors": np.float64, "bounds": np.int64, "posted": np.int64, "positions": np.int32}
INDEX = "block int, " + ", ".join(f"{a} binary" for a in ARRAYS)


def build_index(vectors: DataFrame, pivots: np.ndarray, blocks: int, near: int = NEAR) -> DataFrame:
    """(_id, _v, _query) -> a row a block."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        every = frame["_id"].to_numpy(np.int64)
        v = np.array(frame["_v"].tolist(), np.float64)
        order = np.lexsort((*v.T[::-1], every))  # of a repeated id the least vector comes first
        ids, first = np.unique(every[order], return_index=True)
        first = order[first]
        distinct, of = np.unique(v[first], axis=0, return_inverse=True)
        bounds, posted, positions = inverted_file(permutations(distinct, pivots, near), len(pivots))
        arrays = (ids, of.ravel(), frame["_query"].to_numpy(bool)[first], distinct, bounds, posted, positions)
        packed = [np.ascontiguousarray(a, kind).tobytes() for a, kind in zip(arrays, ARRAYS.values())]
        return pd.DataFrame([[int(frame["_block"].iloc[0]), *packed]], columns=["block", *ARRAYS])

    spread = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(blocks)).cast("int")
    return vectors.withColumn("_block", spread).groupBy("_block").applyInPandas(build, INDEX)


class Block:
    """A row of the index."""

    def __init__(self, row: dict, dim: int):
        for name, kind in ARRAYS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.vectors = self.vectors.reshape(-1, dim)
        self.by_copy = np.lexsort((self.ids, self.copies))  # copies of a vector together, smallest id first
        self.start = np.searchsorted(self.copies[self.by_copy], np.arange(len(self.vectors) + 1))

    def search(self, query: np.ndarray, own: int, perm: np.ndarray, k: int, candidates: int) -> list[tuple[float, int]]:
        """A query's k nearest among its ``candidates`` best by footrule: (distance, id)."""
        v, near = self.vectors, len(perm)
        shared = np.zeros(len(v), np.int32)
        for at, p in enumerate(perm):
            lo, hi = self.bounds[p], self.bounds[p + 1]
            shared[self.posted[lo:hi]] += near - np.maximum(self.positions[lo:hi], at)
        best = np.argpartition(-shared, candidates - 1)[:candidates] if len(v) > candidates else np.arange(len(v))
        distance = np.sqrt(((v[best] - query) ** 2).sum(1))
        found: list[tuple[float, int]] = []
        for j in np.argsort(distance, kind="stable"):
            if len(found) >= k and distance[j] > found[-1][0]:
                break
            ids = self.ids[self.by_copy[self.start[best[j]] : self.start[best[j] + 1]]][: k + 1]
            found += [(float(distance[j]), int(i)) for i in ids if i != own]
        return sorted(found)[:k]


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = PIVOTS, near: int = NEAR,
    candidates: int = CANDIDATES, block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: the k nearest found of each query row."""
    spark = vectors.sparkSession
    small_batches(spark)
    good = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(
        F.col("vec_id").cast("long").alias("_id"), F.col("embedding").cast("array<double>").alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_query")
    )
    sizes = good.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes
    good = good.where(F.size("_v") == dim)
    sample = good.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("_v").collect()
    chosen = choose_pivots(np.array([r["_v"] for r in sample]), pivots)
    index = shared_table(build_index(good, chosen, max(1, -(-n // block)), near), "vectors")

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, copies, asked, v in zip(*(batch.column(c).to_pylist() for c in range(4))):
                on = np.frombuffer(asked, bool)
                own = np.frombuffer(v, np.float64).reshape(-1, dim)[np.frombuffer(copies, np.int64)[on]]
                rows = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), dim).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)[on]), rows], ["_id", "_v"])

    asked = shared_table(index.select("ids", "copies", "asked", "vectors").mapInArrow(queries, "_id long, _v array<double>"), "queries")
    parts = max(1, -(-asked.count() // query_block))
    path = f"{shared_dir(spark).rstrip('/')}/inkspan/near-{uuid.uuid4().hex}"
    hit = "query_id long, vec_id long, score double"
    spark.createDataFrame([], hit).write.parquet(path)
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(parts)) == part).collect()  # about query_block rows
        if not rows:
            continue
        v = np.array([r["_v"] for r in rows])
        shared = spark.sparkContext.broadcast((np.array([r["_id"] for r in rows]), v, permutations(v, chosen, near).astype(np.int32)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    held = Block({a: batch.column(a)[i].as_buffer() for a in ARRAYS}, dim)
                    found = [(int(q), i, d) for q, x, perm in zip(*shared.value) for d, i in held.search(x, q, perm, k, candidates)]
                    columns = list(zip(*found)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        index.select(*ARRAYS).mapInArrow(run, hit).write.mode("append").parquet(path)
        shared.destroy()
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = spark.read.schema(hit).parquet(path).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
