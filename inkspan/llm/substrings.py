"""Removal of repeated word passages, found by level-wise doubling.

A passage is ``window`` consecutive words. Level by level (``start`` words, twice that, ..., ``window``)
only windows that still may repeat are looked at. At a level of length l, a window is represented by its
anchor: of the l-word runs inside it, the one with the least hash. Equal windows have equal anchors, so a
window whose anchor is in no other document cannot repeat, and one row an anchor (about 2 in window - l
words) settles all windows around it. Windows that survive are extended to the next length; at the last
one the window is its own anchor, and its words are compared by a 64-bit hash.

A word goes if a window that covers it also starts in a document with a smaller doc_id. All levels look
at the input, not at what is left.

Texts that are equal as a whole are settled first, by digest: all but the least doc_id go, and only that
one looks for windows. Shuffled are anchors and surviving windows, never all pairs: an anchor's or window's documents meet in a
partial aggregate (least doc_id), which is joined back, so a passage that a third of the documents hold
is summed before it moves. Memory: an Arrow batch of texts.

Null and wordless texts have no words and keep none. Documents under ``window`` words lose nothing; very
long ones are searched whole. Rows that share a doc_id do not count as others, and each loses what its own
text repeats, so there are no ties. A null doc_id sorts after all others. An empty table gives an empty
result. Extra columns are dropped by ``find_repeats`` and kept by ``drop_repeats``; its outputs replace
columns of the same names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, shared_table, small_batches
from inkspan.llm.rolling import lowest, window_hashes, word_hashes

WINDOW = 50
START = 25
LAST = (1 << 63) - 1


def levels(window: int = WINDOW, start: int = START) -> list[int]:
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _anchors(words: np.ndarray, length: int, window: int) -> np.ndarray:
    """The anchor's hash of each window."""
    h = window_hashes(words, length)
    return h[lowest(h, window - length + 1)]


def _alive(words: np.ndarray, held: np.ndarray, length: int, window: int) -> np.ndarray:
    return np.isin(_anchors(words, length, window), held.astype(np.uint64))


def _level(rows: DataFrame, length: int, before: int | None, window: int) -> DataFrame:
    """(_k, _t, _raw [, _held]) -> _k, _t, _h: the anchors of surviving windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            held = batch.column(3) if before else None
            for i, (k, t, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                words = word_hashes(raw or b"")
                if len(words) < window:
                    continue
                anchors = _anchors(words, length, window)
                if before:
                    own = held[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    anchors = anchors[_alive(words, own, before, window)]
                anchors = np.unique(anchors).view(np.int64)
                parts.append((np.full(len(anchors), k), np.full(len(anchors), t), anchors))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["_k", "_t", "_h"])

    return rows.mapInArrow(run, "_k long, _t long, _h long")


def _last(rows: DataFrame, text: int, before: int, window: int) -> DataFrame:
    """(..., _k, _t, _held) with the text at column ``text`` -> _k, _t, _h, _p: surviving windows and where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, parts = batch.column(batch.num_columns - 1), []
            raws = batch.column(text).cast(pa.binary()).to_pylist()
            keys, ties = (batch.column(batch.num_columns - c).to_pylist() for c in (3, 2))
            for i, (k, t, raw) in enumerate(zip(keys, ties, raws)):
                words = word_hashes(raw or b"")
                own = held[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.flatnonzero(_alive(words, own, before, window))
                h = window_hashes(words, window)[at].view(np.int64)
                parts.append((np.full(len(at), k), np.full(len(at), t), h, at.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["_k", "_t", "_h", "_p"])

    return rows.mapInArrow(run, "_k long, _t long, _h long, _p int")


def _back(rows: DataFrame, sums: DataFrame, how: str = "inner") -> DataFrame:
    """Join sums by _h back to the rows they were made of.

    By a key that is not the one of the aggregate, both sides are dealt out for the join alone, and Spark
    splits the rows of a passage that many documents hold over several tasks.
    """
    turned = sums.withColumn("_g", F.bitwise_not("_h")).drop("_h")
    return rows.withColumn("_g", F.bitwise_not("_h")).join(turned, "_g", how).drop("_g")


def _keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """_c0, _c1, ...: the columns, under names that clash with none; _k and _t."""
    return docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)],
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_k"), F.xxhash64("text").alias("_t"),
    )


def find_repeats(docs: DataFrame, window: int = WINDOW, start: int = START, columns: list[str] | None = None) -> DataFrame:
    """_k, _t, _copy, _starts: what repeats a document with a smaller doc_id.

    _k is doc_id, or the largest long for null, and _t a hash of the text, which tells rows apart that
    share a doc_id. _copy: the whole text does. _starts: where such windows start. Documents with neither
    have no row. ``columns`` ride along to the last level, so that a caller who joins the same columns by
    (_k, _t) shares its exchange.
    """
    if not 0 < start < window:
        raise ValueError(f"start must lie between 0 and window: {start}, {window}")
    small_batches(docs.sparkSession)
    columns = columns or ["text"]
    rows = _keyed(docs, columns)
    texts = _keyed(docs, ["text"]).select("_k", "_t", F.col("_c0").cast("binary").alias("_raw"))
    known = shared_table(texts.where("_raw is not null").select("_k", "_t", F.unhex(F.md5("_raw")).alias("_d")), "digests")
    # Copies share a digest: not by the key of the aggregate, so that Spark can split those of a hot text.
    turned = F.reverse(F.hex("_d")).alias("_turned")
    least = known.groupBy("_d").agg(F.min("_k").alias("_lo")).select(turned, "_lo")
    roles = cut(known.select("_k", "_t", turned).join(least, "_turned").groupBy("_k", "_t").agg(F.max(F.col("_lo") < F.col("_k")).alias("_copy")))
    alone = roles.where("not _copy").select("_k", "_t")

    held, before = None, None
    steps = levels(window, start)
    for length in steps[:-1]:
        source = texts if held is None else texts.join(held, ["_k", "_t"]).select("_k", "_t", "_raw", "_held")
        anchors = shared_table(_level(source, length, before, window), f"anchors{length}")
        shared = anchors.groupBy("_h").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi")).where("_lo < _hi")
        alive = _back(anchors, shared.select("_h"), "left_semi").join(alone, ["_k", "_t"], "left_semi")
        held = alive.groupBy("_k", "_t").agg(F.collect_list("_h").alias("_held"))
        before = length
    joined = rows.join(held, ["_k", "_t"]).select(*(c for c in rows.columns if c[:2] == "_c"), "_k", "_t", "_held")
    windows = _last(joined, columns.index("text"), before, window)
    first = windows.groupBy("_h").agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi")).where("_lo < _hi")
    repeats = _back(windows, first.select("_h", "_lo")).where("_lo < _k").groupBy("_k", "_t").agg(F.array_sort(F.collect_set("_p")).alias("_starts"))
    copies = roles.where("_copy").select("_k", "_t", "_copy", F.lit(None).cast("array<int>").alias("_starts"))
    return copies.unionByName(repeats.select("_k", "_t", F.lit(False).alias("_copy"), "_starts"))


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words a window at one of the starts covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + window, n), -1)
    return np.cumsum(step[:n]) > 0


def drop_repeats(docs: DataFrame, window: int = WINDOW, start: int = START) -> DataFrame:
    """docs' columns and n_words, n_removed, kept_sha256, kept (the words left, joined by one space)."""
    out = ["n_words", "n_removed", "kept_sha256", "kept"]
    keep = [c for c in docs.columns if c not in out]
    rows = _keyed(docs, keep)
    found = find_repeats(docs, window, start, keep)
    inner = [f"_c{i}" for i in range(len(keep))]
    joined = rows.join(found, ["_k", "_t"], "left").select(*inner, "_copy", "_starts")
    text, n = keep.index("text"), len(keep)
    # The columns that are kept ride through the task as they are.
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, copy, at = batch.column(text).cast(pa.binary()).to_pylist(), batch.column(n), batch.column(n + 1)
            words_n, removed, digests, kept = [], [], [], []
            for i, raw in enumerate(raws):
                words = (raw or b"").split()
                gone, left = 0, words
                if copy[i].as_py():
                    if len(words) >= window:
                        gone, left = len(words), []
                elif at[i].is_valid:
                    cover = covered(len(words), at[i].values.to_numpy(zero_copy_only=False).astype(np.int64), window)
                    gone = int(cover.sum())
                    left = [words[j] for j in np.flatnonzero(~cover)]
                joined_left = b" ".join(left)
                words_n.append(len(words)), removed.append(gone)
                digests.append(hashlib.sha256(joined_left).hexdigest()), kept.append(joined_left)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                [*inner, *out],
            )

    made = joined.mapInArrow(run, f"{types}, n_words long, n_removed long, kept_sha256 string, kept binary")
    return made.select(
        *[F.col(c).alias(k) for c, k in zip(inner, keep)], "n_words", "n_removed", "kept_sha256", F.col("kept").cast("string").alias("kept")
    )
