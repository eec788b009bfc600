"""Exact top-k search by BM25: an inverted index in shards, blocks of queries turned into indexes, an exact merge.

Index. A shard is a run of SHARD documents of one input partition (what is left of it, up to half as many
more, joins the last one), in one row: term -> (document,
term frequency). Documents are numbered by rising length. Document frequencies, the number of documents and their
mean length are summed over all shards, so a shard scores with global statistics and its top k merge exactly.

Search. A block of thousands of queries is an inverted index too: term -> queries. A shard is passed document by
document, longest first: the lists of a document's light terms are gathered and added up, which gives its scores for all
queries of the block at once. The terms that are heavy (in more than HEAVY of all documents, and the DENSE most
frequent of a block at most) are spread by document, with the maxima of their frequencies in BLOCK documents (of one,
these are the scores themselves); bounds of what they add are one product of matrices for BATCH blocks and GROUP
queries, in single precision and rounded up. Only pairs whose bounds reach the query's threshold, the k-th best score
that the task has found so far, are scored to the end; thresholds rise after each RUN documents and are handed on
from shard to shard. Bounds that tie with the threshold are scored. Scores rank by DIGITS decimals, so that equal sums added in
another order are ties.

Work. Lists of light terms grow with the documents and queries do too, so the exact search takes the square of
the input; what is saved is a factor, and no bound of a list lets long queries skip light terms (the tenth best
score of a long text is mostly under a fifth of its own).

BM25: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)),
each distinct term of a query counted once. Terms are lower-cased runs of letters and digits (beyond ASCII,
any character but white space).

Queries are packed into blocks of some ASKED terms, 2 * ASKED at most (or one longer query), and at most 2 * QUERIES
queries, and searched block by block: a block is broadcast, every shard is read where it lies, and nothing but hits moves. So the index is never
shuffled, and what is broadcast is bounded whatever the input. Terms that only the query itself holds are
left out. Hits are lists of k a (query, task), merged in two levels.

Ranks: best score first, ties to the smaller doc_id; a query's own row is no hit; only documents that share
a term are hits. Null and wordless texts are never found and find nothing. Rows without doc_id are left out;
rows that repeat a doc_id are hits of their own, and the least of their texts is the query. Texts of any
length are indexed and asked whole. Columns other than doc_id and text are ignored, whatever their names. An
empty table, or one without a query, gives an empty result.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import shared_dir, shared_table, small_batches
from inkspan.llm.rolling import word_hashes

K1, B = 1.2, 0.75
SHARD, BLOCK, LINE = 6144, 1, 8
#: Share of all documents from which a term is heavy, the most heavy terms of a block of queries, documents between two
#: rises of the thresholds, blocks of documents and queries whose bounds are one product, pairs scored together.
HEAVY, DENSE, WORTH, RUN, BATCH, GROUP, SCORED = 0.02, 1024, 0.02, 32, 256, 512, 8192
#: Scores rank by so many digits; what two orders of adding may differ by; what bounds in single precision may lack.
DIGITS, SLACK, ROUNDED = 9, 2e-9, 1 + 1e-4
#: Terms and queries of a block of queries, some 15 bytes a term are broadcast; shards that a task passes one after another.
ASKED, QUERIES, TOGETHER = 2_500_000, 16384, 16

_ASCII = np.arange(256, dtype=np.uint8)
_ASCII[[c for c in range(128) if not chr(c).isalnum()]] = 0x20
_TABLE = _ASCII.tobytes()


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct terms, sorted, and their frequencies."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_TABLE)
    return np.unique(word_hashes(raw).view(np.int64), return_counts=True)


#: Arrays of a shard and their types; frequencies take as many bytes (``width``) as the greatest needs.
ARRAYS = {
    "ids": np.int64, "lengths": np.int64, "terms": np.int64, "bounds": np.int64, "posted": np.uint16, "freqs": None,
}
INDEX = "shard long, docs int, length long, width int, " + ", ".join(f"{a} binary" for a in ARRAYS)


def pack_shard(number: int, ids: list[int], lists: list[tuple[np.ndarray, np.ndarray]]) -> list:
    """The index row of at most 65536 documents with terms."""
    lengths = np.array([int(f.sum()) for _, f in lists], np.int64)
    order = np.lexsort((np.array(ids, np.int64), lengths))
    sizes = np.array([len(lists[i][0]) for i in order])
    term = np.concatenate([lists[i][0] for i in order])
    freq = np.concatenate([lists[i][1] for i in order]).astype(np.uint32, copy=False)
    lists.clear()
    by = np.argsort(term, kind="stable")
    term, freq = term[by], freq[by]
    posted = np.repeat(np.arange(len(order), dtype=np.uint16), sizes)[by]
    del by
    start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    distinct = term[start]
    bounds = np.append(start, len(term)).astype(np.int64)
    width = np.min_scalar_type(int(freq.max()))
    arrays = [np.array(ids, np.int64)[order], lengths[order], distinct, bounds, posted, freq.astype(width)]
    return [number, len(ids), int(lengths.sum()), width.itemsize, *(a.tobytes() for a in arrays)]


def build_index(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(doc_id, text) -> a row a shard."""
    small_batches(docs.sparkSession)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Small partitions are put together, without a shuffle, so that there are no more shards than needed.
    rows = rows.coalesce(max(1, rows.select("doc_id").count() // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids, lists = [], []

        def out(n: int) -> pa.RecordBatch:
            row = pack_shard(number, ids[:n], lists[:n])
            del ids[:n], lists[:n]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], [c.split()[0] for c in INDEX.split(", ")]).cast(SCHEMA)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, freqs = terms(text)
                if len(found):
                    ids.append(i), lists.append((found, freqs.astype(np.uint32)))
                if len(ids) > shard + shard // 2:
                    yield out(shard)
                    number += 1
        if ids:
            yield out(len(ids))

    return rows.mapInArrow(run, INDEX)


SCHEMA = pa.schema([("shard", pa.int64()), ("docs", pa.int32()), ("length", pa.int64()), ("width", pa.int32()), *((a, pa.binary()) for a in ARRAYS)])


class Asked:
    """A block of at most 65535 queries: their distinct terms by falling df, and an inverted index of the queries.

    The DENSE most frequent of the terms in more than ``heavy`` documents are heavy, the same ones in every shard;
    they come first. A light term has its queries in lines of LINE, which are copied at once; lines are filled up
    with a query beyond the last.
    """

    def __init__(self, ids: list[int], terms: list[np.ndarray], df: list[np.ndarray], n: int, heavy: float):
        # Queries alike in their most frequent terms and in length are neighbours, so that a group has few heavy terms.
        order = sorted(range(len(ids)), key=lambda i: (int(terms[i][-1]), len(terms[i])))
        sizes = np.array([len(terms[i]) for i in order])
        self.ids = np.array([ids[i] for i in order], np.int64)
        distinct, first, places = np.unique(np.concatenate([terms[i] for i in order]), return_index=True, return_inverse=True)
        df = np.concatenate([df[i] for i in order])[first].astype(np.float64)
        order = np.argsort(-df, kind="stable")
        self.terms, df = distinct[order], df[order]
        self.sorted = np.argsort(order).astype(np.int32)  # the numbers of the terms by rising hash
        places = self.sorted[places]
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        asking = np.repeat(np.arange(len(sizes)), sizes)
        group, frequent = asking // GROUP, min(DENSE, int((df > heavy).sum()))
        held = places < frequent
        shares = np.bincount(group[held] * frequent + places[held], minlength=(group[-1] + 1) * frequent).reshape(group[-1] + 1, frequent)
        dense = shares * (df[:frequent] / n) > WORTH * np.bincount(np.arange(len(sizes)) // GROUP)[:, None]
        held[held] = dense[group[held], places[held]]
        self.heavy = np.flatnonzero(dense.any(0))
        # The heavy terms of each query, by their places among the heavy ones.
        self.held = np.searchsorted(self.heavy, places[held]).astype(np.int16)
        self.starts = np.append(0, np.cumsum(np.bincount(asking[held], minlength=len(sizes))))
        places, asking = places[~held], asking[~held]
        n = np.bincount(places, minlength=len(self.terms))
        self.lines = (-(-n // LINE)).astype(np.int32)
        self.first = np.cumsum(self.lines) - self.lines
        self.asking = np.full(int(self.lines.sum()) * LINE, len(sizes), np.uint16)
        self.asking[_runs(self.first * LINE, n)] = asking[np.argsort(places, kind="stable")]
        self.asking = self.asking.reshape(-1, LINE)

    def weights(self) -> np.ndarray:
        """A row a heavy term: its idf at each query that asks for it, in single precision."""
        out = np.zeros((len(self.heavy), len(self.ids)), np.float32)
        out[self.held, np.repeat(np.arange(len(self.ids)), np.diff(self.starts))] = self.idf[self.heavy[self.held]]
        return out


def _runs(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each of ``lo`` on, ``n`` of each."""
    end = np.cumsum(n)
    return np.repeat(lo - (end - n), n) + np.arange(end[-1] if len(end) else 0)


class Best:
    """The k best hits of each query of a block, and the ``floor`` of scores that are worth a look."""

    def __init__(self, asks: Asked, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.ids, self.scores = np.zeros((len(asks.ids), k), np.int64), np.zeros((len(asks.ids), k))
        self.known = self.scores.copy()  # the k best scores, or what they are at least, of hits that are not yet added also
        # What is rounded differently must not be lost.
        self.floor = np.maximum(least - SLACK, 1e-300)

    def _first(self, asked: np.ndarray, queries: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        """The k first rows of each query by ``keys``; each has k at least, as empty places score 0."""
        order = np.lexsort((*keys, queries))
        return order[np.searchsorted(queries, asked, sorter=order)[:, None] + np.arange(self.k)]

    def rise(self, queries: np.ndarray, scores: np.ndarray) -> None:
        """Raise the thresholds by hits that score so much at least, and are added later."""
        asked = np.unique(queries)
        queries = np.concatenate([np.repeat(asked, self.k), queries])
        scores = np.concatenate([self.known[asked].ravel(), scores])
        self.known[asked] = scores[self._first(asked, queries, -scores)]
        self.least[asked] = np.maximum(self.least[asked], self.known[asked, -1])
        self.floor[asked] = np.maximum(self.least[asked] - SLACK, 1e-300)

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        asked = np.unique(queries)
        queries = np.concatenate([np.repeat(asked, self.k), queries])
        ids, scores = np.concatenate([self.ids[asked].ravel(), ids]), np.concatenate([self.scores[asked].ravel(), scores])
        kept = self._first(asked, queries, ids, -np.round(scores, DIGITS))
        self.ids[asked], self.scores[asked] = ids[kept], scores[kept]
        self.known[asked] = np.maximum(self.scores[asked], self.known[asked])
        self.least[asked] = np.maximum(self.least[asked], self.scores[asked, -1])
        self.floor[asked] = np.maximum(self.least[asked] - SLACK, 1e-300)

    def hits(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n, ids, scores in zip((self.scores >= self.floor[:, None]).sum(1).tolist(), self.ids, self.scores):
            yield ids[:n], scores[:n]


class Shard:
    """One row of the index, with impacts by global statistics (but for the idf factor)."""

    def __init__(self, row: dict[str, memoryview], width: int, mean: float):
        for name, kind in ARRAYS.items():
            setattr(self, name, np.frombuffer(row[name], kind or f"u{width}"))
        self.n = len(self.ids)
        self.blocks = -(-self.n // BLOCK)
        self.norm = K1 * (1 - B + B * self.lengths / mean)
        self.floor = self.norm[::BLOCK]  # documents are numbered by length
        self.impact = self.norm[self.posted]
        self.impact += self.freqs
        np.divide(self.freqs * (K1 + 1), self.impact, out=self.impact)

    def bounds_of_all(self, ts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row a document of heavy terms' frequencies, and a row a block of the most that its documents take from each."""
        lo, n = self.bounds[ts], np.diff(self.bounds)[ts]
        at = _runs(lo, n)
        freq = np.zeros((self.blocks * BLOCK, len(ts)), self.freqs.dtype)
        freq[self.posted[at], np.repeat(np.arange(len(ts)), n)] = self.freqs[at]
        most = freq.reshape(self.blocks, BLOCK, len(ts)).max(1).astype(np.float32)
        most *= np.float32(K1 + 1) / (most + self.floor.astype(np.float32)[:, None])
        most *= np.float32(ROUNDED)
        return freq[: self.n], most

    def bounds_of(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        freq, most = self.bounds_of_all(np.array([t]))
        return freq[:, 0], most[:, 0]

    def search(self, query: np.ndarray, idf: np.ndarray, light: int, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best; query: terms by rising document frequency, the first ``light`` of them light."""
        if not len(query):
            return np.empty(0, np.int64), np.empty(0)
        asks = Asked([own], [query], [np.arange(len(query))], 1, light - 1)
        asks.idf = idf[::-1]
        return next(self.search_block(asks, k, np.zeros(1)))

    def by_document(self, asks: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Light terms document by document: where each document's begin, their numbers and scores."""
        place = np.searchsorted(asks.terms[asks.sorted], self.terms)
        place[place == len(asks.terms)] = 0
        number = asks.sorted[place]
        known = np.flatnonzero((asks.terms[number] == self.terms) & (asks.lines[number] > 0))
        lo, n = self.bounds[known], np.diff(self.bounds)[known]
        at, number = _runs(lo, n), np.repeat(number[known], n)
        posted = self.posted[at]
        by = np.argsort(posted, kind="stable")
        number, at = number[by], at[by]
        return np.append(0, np.cumsum(np.bincount(posted, minlength=self.n))), number, self.impact[at] * asks.idf[number]

    def search_block(self, asks: Asked, k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its k best, those below ``least`` left out; ``least`` rises to the k-th."""
        best = Best(asks, k, least)
        self.find(asks, asks.weights(), best)
        return best.hits()

    def find(self, asks: Asked, weights: np.ndarray, best: Best) -> None:
        """Put all documents that may be among the best of a query into ``best``."""
        place = np.searchsorted(self.terms, asks.terms[asks.heavy])
        place[place == len(self.terms)] = 0
        dense = np.flatnonzero(self.terms[place] == asks.terms[asks.heavy])
        freq, most = self.bounds_of_all(place[dense])
        most = np.ascontiguousarray(most.T)
        column = np.full(len(asks.heavy), -1, np.int32)
        column[dense] = np.arange(len(dense))
        groups = [(slice(q, q + GROUP), dense[weights[dense, q : q + GROUP].any(1)]) for q in range(0, len(asks.ids), GROUP)]
        groups = [(group, column[held], weights[held, group]) for group, held in groups]
        starts, numbers, scores = self.by_document(asks)
        lines, first = asks.lines[numbers], asks.first[numbers]
        ends = np.append(0, np.cumsum(lines))[starts]
        begin, added = self.blocks, None
        # Long documents have the best scores, mostly: they come first.
        for end in range(self.n, 0, -RUN):
            found, low = [], max(end - RUN, 0)
            at = _runs(first[starts[low] : starts[end]], lines[starts[low] : starts[end]])
            for d in range(end - 1, low - 1, -1):
                if d // BLOCK < begin:
                    rows = slice(max(begin - BATCH, 0), begin)
                    begin = rows.start
                    added = np.empty((rows.stop - begin, len(asks.ids)), np.float32)
                    for group, held, weight in groups:
                        np.matmul(most[:, rows].take(held, 0).T, weight, out=added[:, group])
                    added *= np.float32(ROUNDED)
                i, j = starts[d], starts[d + 1]
                asking = asks.asking.take(at[ends[d] - ends[low] : ends[d + 1] - ends[low]], 0)
                # bincount adds in order of the lines, so term by term.
                score = np.bincount(asking.ravel(), scores[i:j].repeat(lines[i:j] * LINE), len(asks.ids) + 1)[:-1]
                bound = score + added[d // BLOCK - begin]
                hits = (bound >= best.floor).nonzero()[0]
                if len(hits):
                    hits = hits[asks.ids[hits] != self.ids[d]]
                    found.append((np.full(len(hits), d), hits, score[hits], bound[hits]))
            if not found:
                continue
            docs, hits, score, bound = (np.concatenate(x) for x in zip(*found))
            # What a bound of one document lacks is known, that of several may be of another one.
            best.rise(hits, bound * (2 - ROUNDED**3) if BLOCK == 1 else score)
            good = bound >= best.floor[hits]
            docs, hits, score = docs[good], hits[good], score[good]
            for i in range(0, len(docs), SCORED):
                part = slice(i, i + SCORED)
                best.add(hits[part], self.ids[docs[part]], score[part] + self.heavy_scores(asks, docs[part], hits[part], freq, column))

    def heavy_scores(self, asks: Asked, docs: np.ndarray, queries: np.ndarray, freq: np.ndarray, column: np.ndarray) -> np.ndarray:
        """What heavy terms add to the scores of pairs."""
        n = np.diff(asks.starts)[queries]
        term = asks.held[_runs(asks.starts[queries], n)]
        pair = np.repeat(np.arange(len(docs)), n)
        here = column[term] >= 0
        term, pair = term[here], pair[here]
        f = freq[docs[pair], column[term]].astype(np.float64)
        norm = self.norm[docs]
        return np.bincount(pair, f * (K1 + 1) / (f + norm[pair]) * asks.idf[asks.heavy[term]], len(docs))


def _top(k: int):
    """SQL that keeps the k best of a list of (negative rounded score, doc_id, score)."""
    return lambda hits: F.slice(F.array_sort(F.flatten(F.collect_list(hits))), 1, k)


def query_blocks(docs: DataFrame, is_query: Column, df: DataFrame, n: int, most: int) -> tuple[DataFrame, int]:
    """A row a block of queries: _b and the pickled block; and the number of blocks _b, some of which may be missing.

    Blocks are dealt by hash; while one of several queries is over ``most`` terms, or one over so many queries as
    are meant to be in a block, twice as many are made. A block is packed by an executor.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"]):
                found = terms(text)[0]
                yield pd.DataFrame({"query_id": np.full(len(found), int(i)), "term": found})

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        ids, lists = rows["query_id"].to_pylist(), []
        for name in ("term", "df"):
            lists.append([x.values.to_numpy() for chunk in rows[name].chunks for x in chunk])
        return pa.table({"_b": pa.array([key[0].as_py()]), "asks": pa.array([pickle.dumps(Asked(ids, *lists, n, HEAVY * n))], pa.binary())})

    asked = docs.where(F.col("doc_id").isNotNull() & is_query).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("text").alias("text"))
    # A term of one document is in the query alone.
    known = asked.mapInPandas(ask, "query_id long, term long").join(df.where("df > 1"), "term")
    listed = known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("asked"))
    held = shared_table(listed.select("query_id", "asked.term", "asked.df"), "queries")
    total, rows = held.agg(F.sum(F.size("term")).alias("x"), F.count(F.lit(1))).first()
    blocks = max(1, -(-(total or 0) // most), -(-rows // QUERIES))
    while True:
        out = held.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        over = out.groupBy("_b").agg(F.sum(F.size("term")).alias("_n"), F.count(F.lit(1)).alias("_q"))
        if over.where((F.col("_q") > 1) & (F.col("_n") > 2 * most) | (F.col("_q") > 2 * QUERIES)).isEmpty():
            return shared_table(out.groupBy("_b").applyInArrow(pack, "_b long, asks binary"), "asked"), blocks
        blocks *= 2


def search(docs: DataFrame, is_query: Column, k: int = 10, shard: int = SHARD, asked: int = ASKED) -> DataFrame:
    """(doc_id, text) -> query_id, rank, doc_id, score: the k best of all documents for each query row."""
    spark = docs.sparkSession
    if not 0 < shard <= 32768:
        raise ValueError(f"a shard may be of 1 to 32768 documents: {shard}")
    index = shared_table(build_index(docs, shard), "index")
    stats = index.agg(F.sum("docs").alias("n"), F.sum("length").alias("words"), F.count(F.lit(1)).alias("shards")).first()
    n, mean = int(stats["n"] or 0), float(stats["words"] or 0) / max(1, int(stats["n"] or 0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                df = np.diff(np.frombuffer(b, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), pa.array(df)], ["term", "df"])

    df = index.select("terms", "bounds").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    queries, blocks = query_blocks(docs, is_query, df, n, asked)
    path = f"{shared_dir(spark).rstrip('/')}/inkspan/hits-{uuid.uuid4().hex}"
    HITS = "query_id long, part long, ids array<long>, scores array<double>"
    spark.createDataFrame([], HITS).write.parquet(path)
    # A few shards a task, so that the first ones' hits spare work in the others; all cores stay busy.
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-int(stats["shards"]) // TOGETHER))
    passed = index.drop("docs", "length").coalesce(tasks)
    for b in range(blocks):
        rows = queries.where(F.col("_b") == b).select("asks").collect()  # bounded: see query_blocks
        if not rows:
            continue
        block = spark.sparkContext.broadcast(bytes(rows[0]["asks"]))
        del rows

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            asks, best, part = pickle.loads(block.value), None, 0
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    held = Shard({a: row[a].as_buffer() for a in ARRAYS}, row["width"].as_py(), mean)
                    if best is None:
                        weights, best, part = asks.weights(), Best(asks, k, np.zeros(len(asks.ids))), row["shard"].as_py()
                    held.find(asks, weights, best)  # what one shard found spares work in the next
            if best is not None:
                found = [(q, *hits) for q, hits in zip(asks.ids.tolist(), best.hits()) if len(hits[0])]
                columns = [[f[0] for f in found], [part] * len(found), [f[1] for f in found], [f[2] for f in found]]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "part", "ids", "scores"])

        passed.mapInArrow(run, HITS).write.mode("append").parquet(path)
        block.destroy()
    hits = spark.read.schema(HITS).parquet(path)
    listed = hits.select(
        "query_id", F.pmod(F.xxhash64("part"), F.lit(256)).alias("part"),
        F.zip_with("scores", "ids", lambda s, i: F.struct((-F.round(s, DIGITS)).alias("r"), i.alias("i"), s.alias("s"))).alias("hits"),
    )
    top = _top(k)
    merged = listed.groupBy("query_id", "part").agg(top("hits").alias("hits")).groupBy("query_id").agg(top("hits").alias("hits"))
    return merged.select("query_id", F.posexplode("hits").alias("_p", "_h")).select(
        "query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_h.i").alias("doc_id"), F.col("_h.s").alias("score")
    )
