"""Exact BM25 search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.llm import bm25
from inkspan.llm.bm25 import BLOCK, INDEX, K1, Asked, B, Shard, pack_shard, search


def split(text):
    low = (text or "").lower()
    return re.findall(r"[^\W_]+", low) if low.isascii() else re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", low)


def brute(rows, every, k):
    docs = [(i, Counter(split(t))) for i, t in rows if i is not None]
    docs = [(i, c) for i, c in docs if c]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / max(1, len(docs))
    df = Counter(t for _, c in docs for t in c)
    out = {}
    for q, asked in {i: c for i, c in reversed(docs) if i % every == 0}.items():
        scored = []
        for i, c in docs:
            s = 0.0
            for t in sorted(asked, key=lambda t: (df[t], t)):
                if t in c:
                    norm = K1 * (1 - B + B * sum(c.values()) / mean)
                    s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (K1 + 1) / (c[t] + norm)
            if s > 0 and i != q:
                scored.append((-round(s, 9), i))
        if scored:
            out[q] = sorted(scored)[:k]
    return out


def run(spark, rows, every=5, k=10, schema="doc_id long, text string", **options):
    got = {}
    df = spark.createDataFrame(rows, schema)
    for r in search(df, F.col("doc_id") % every == 0, k=k, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 9), r.doc_id))
    return got


def same(got, expected):
    """Near ties may change places: ids are compared within equal scores to 8 digits."""
    assert got.keys() == expected.keys()
    for q in got:
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in expected[q]], abs=1e-8)
        assert [i for _, i in got[q]] == [i for _, i in expected[q]]


def corpus(n, seed=1, vocabulary=300):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % vocabulary}"
    return [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("shard", [1, 7, 60, 16384])
def test_matches_scoring_all(spark, shard):
    rows = corpus(300)
    same(run(spark, rows, k=5, shard=shard, asked=500), brute(rows, 5, 5))


def test_pruning_on_a_larger_shard(spark):
    rows = corpus(3000, 2, 2000)
    same(run(spark, rows, every=250), brute(rows, 250, 10))


def test_blocks_are_skipped_and_bounds_hold():
    """Every bound holds, and documents between pivots are not scored."""
    rng = np.random.default_rng(4)
    lists = []
    for i in range(2000):
        words = np.unique(rng.zipf(1.3, rng.integers(5, 80)) % 5000).astype(np.int64)
        lists.append((words, rng.integers(1, 400 if i == 7 else 4, len(words)).astype(np.uint32)))
    ids, every = list(range(2000)), [(t, f) for t, f in lists]
    row = dict(zip([c.split()[0] for c in INDEX.split(", ")], pack_shard(0, ids, lists)))
    assert row["width"] == 2
    mean = row["length"] / row["docs"]
    held = Shard(row, 2, mean)
    scored = 0
    for t in range(0, len(held.terms), 37):
        freq, most = held.bounds_of(t)
        assert (freq * (K1 + 1) / (freq + held.norm) <= np.repeat(most, BLOCK)[: held.n] + 1e-12).all()
        lo, hi = held.bounds[t], held.bounds[t + 1]
        assert freq[held.posted[lo:hi]].tolist() == held.freqs[lo:hi].tolist() and (freq > 0).sum() == hi - lo
    df = dict(zip(held.terms.tolist(), np.diff(held.bounds).tolist()))
    plain = held.norm
    held.norm = Counted(plain)
    for q in range(0, 2000, 100):
        asked = np.array(sorted(every[q][0].tolist(), key=lambda t: (df[t], t)), np.int64)
        d = np.array([df[t] for t in asked.tolist()])
        idf = np.log(1 + (2000 - d + 0.5) / (d + 0.5))
        light = int(np.searchsorted(d, 40, "right"))
        held.norm.seen = 0
        found, sums = held.search(asked, idf, light, q, 10)
        scored += held.norm.seen
        score = np.zeros(2000)
        for t, w in zip(asked.tolist(), idf.tolist()):
            at = np.searchsorted(held.terms, t)
            a, b = held.bounds[at], held.bounds[at + 1]
            score[held.posted[a:b]] += held.impact[a:b] * w
        best = sorted((-round(s, 9), i) for s, i in zip(score.tolist(), held.ids.tolist()) if i != q and s > 0)[:10]
        assert [i for _, i in best] == found.tolist()
        assert [-s for s, _ in best] == pytest.approx(sums.tolist(), abs=1e-8)
    assert 0 < scored < 0.8 * 20 * 2000


class Counted:
    """An array that counts how many documents are scored to the end."""

    def __init__(self, values):
        self.values, self.seen = values, 0

    def __getitem__(self, docs):
        self.seen += len(docs)
        return self.values[docs]


def test_a_very_long_text_and_frequent_words(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(60_000)) + " rare" + " often" * 700
    rows = [*corpus(120, 3), (500, long), (501, "rare often"), (502, "often " * 300), (505, long)]
    same(run(spark, rows, shard=50), brute(rows, 5, 10))


def test_equal_texts_tie_by_id(spark):
    rows = [(i, "alpha beta gamma") for i in range(40)] + [(100 + i, "alpha delta") for i in range(5)]
    same(run(spark, rows, every=10, shard=6), brute(rows, 10, 10))


def test_nulls_unicode_and_fewer_hits_than_k(spark):
    rows = [(0, "Zoë geht"), (5, None), (10, ""), (15, "..."), (20, "nothing shared"), (1, "zoë Geht heim"), (2, "geht"), (None, "zoë"), (3, "a_b"), (25, "a b")]
    same(run(spark, rows), brute(rows, 5, 10))


def test_repeated_ids_are_hits_of_their_own(spark):
    rows = [(0, "x y"), (1, "x"), (1, "x")]
    assert [i for _, i in run(spark, rows)[0]] == [1, 1]


def test_empty_table_and_extra_columns(spark):
    schema = "doc_id long, text string, query_id string, term int"
    assert run(spark, [], schema=schema) == {}
    assert run(spark, [(1, "a", "x", 1)], schema=schema) == {}
    assert [i for _, i in run(spark, [(0, "a", "x", 1), (1, "a", "x", 1)], schema=schema)[0]] == [1]


def packed(lists, ids, mean):
    """A shard of (term, frequency) pairs."""
    lists = [(np.array(sorted(d), np.int64), np.array([d[t] for t in sorted(d)], np.uint32)) for d in lists]
    row = dict(zip([c.split()[0] for c in INDEX.split(", ")], pack_shard(0, list(ids), lists)))
    return Shard(row, row["width"], mean)


def random_lists(n, seed):
    rng = np.random.default_rng(seed)
    return [dict(Counter((rng.zipf(1.3, rng.integers(5, 80)) % 900).tolist())) for _ in range(n)]


def asked_of(lists, every, heavy):
    df = Counter(t for d in lists for t in d)
    terms = [np.array(sorted(lists[q], key=lambda t: (df[t], t)), np.int64) for q in range(0, len(lists), every)]
    return Asked(list(range(0, len(lists), every)), terms, [np.array([df[t] for t in x.tolist()]) for x in terms], len(lists), heavy)


@pytest.mark.parametrize(("dense", "batch", "block", "heavy"), [(1024, 128, 2, 40), (3, 7, 2, 40), (1024, 1, 1, 5), (50, 128, 8, 900), (1024, 128, 2, 5000)])
def test_a_block_of_queries_is_searched_as_each_alone(monkeypatch, dense, batch, block, heavy):
    lists = random_lists(1500, 6)
    for name, value in (("DENSE", dense), ("BATCH", batch), ("BLOCK", block)):
        monkeypatch.setattr(bm25, name, value)
    mean = sum(sum(d.values()) for d in lists) / len(lists)
    held, asks = packed(lists, range(len(lists)), mean), asked_of(lists, 30, heavy)
    found = dict(zip(asks.ids.tolist(), held.search_block(asks, 10, np.zeros(len(asks.ids)))))
    df = Counter(t for d in lists for t in d)
    idf = {t: math.log(1 + (len(lists) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    for q, (ids, sums) in found.items():
        scores = []
        for i, d in enumerate(lists):
            norm = K1 * (1 - B + B * sum(d.values()) / mean)
            scores.append((-round(sum(idf[t] * d[t] * (K1 + 1) / (d[t] + norm) for t in lists[q] if t in d), 9), i))
        best = sorted(x for x in scores if x[1] != q and x[0] < 0)[:10]
        assert [i for _, i in best] == ids.tolist()
        assert [-s for s, _ in best] == pytest.approx(sums.tolist(), abs=1e-8)
    assert len(found) == 50


def test_what_a_shard_found_spares_work_in_the_next():
    lists = random_lists(1500, 7)
    asks = asked_of(lists, 30, 40)
    first, again = packed(lists, range(1500), 40.0), packed(lists, range(3000, 4500), 40.0)
    least = np.zeros(len(asks.ids))
    before = [(q, ids.tolist(), sums) for q, (ids, sums) in zip(asks.ids, first.search_block(asks, 10, least))]
    alone, carried = (Counted(again.norm) for _ in range(2))
    again.norm = alone
    fresh = list(again.search_block(asks, 10, np.zeros(len(asks.ids))))
    again.norm = carried
    after = list(again.search_block(asks, 10, least))
    assert carried.seen < 0.8 * alone.seen
    # Scores as good as the k-th are still hits: the merge has the last word on ties.
    for (q, ids, sums), (new, good), (all_, _) in zip(before, after, fresh):
        assert (good >= sums[-1] - 1e-8).all() and new.tolist() == all_[: len(new)].tolist()
        assert q + 3000 in new and len(new) >= len(ids)


@pytest.mark.parametrize("others", [0, 1500])
def test_sums_added_in_another_order_tie_by_id(spark, others):
    """Eight terms of one document frequency, their frequencies dealt in any order: all scores are equal."""
    rng = random.Random(5)
    rows = [(i, " ".join(w for w, n in zip("abcdefgh", rng.sample(range(1, 9), 8)) for _ in range(n))) for i in range(60)]
    rows += [(1000 + i, "other") for i in range(others)]
    got = run(spark, rows, every=5000, shard=25 if not others else 400)
    assert [i for _, i in got[0]] == list(range(1, 11))


def best_of(lists, asks, k=10):
    """The best of every query by scoring every document."""
    df = Counter(t for d in lists for t in d)
    idf = {t: math.log(1 + (len(lists) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    mean, out = sum(sum(d.values()) for d in lists) / len(lists), {}
    for q in asks.ids.tolist():
        scores = []
        for i, d in enumerate(lists):
            norm = K1 * (1 - B + B * sum(d.values()) / mean)
            scores.append((-round(sum(idf[t] * d[t] * (K1 + 1) / (d[t] + norm) for t in lists[q] if t in d), 9), i))
        out[q] = sorted(x for x in scores if x[1] != q and x[0] < 0)[:k]
    return mean, out


@pytest.mark.parametrize(
    "sizes",
    [{}, {"GROUP": 7, "WORTH": 0.0}, {"GROUP": 16, "WORTH": 0.2, "RUN": 5}, {"LINE": 1, "SCORED": 3, "RUN": 1500}, {"LINE": 64, "BATCH": 3}, {"WORTH": 2.0}, {"DENSE": 2, "GROUP": 1}],
)
def test_hits_do_not_depend_on_sizes(monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(bm25, name, value)
    lists = random_lists(1500, 8)
    asks = asked_of(lists, 30, 40)
    mean, best = best_of(lists, asks)
    held = packed(lists, range(len(lists)), mean)
    for q, (ids, sums) in zip(asks.ids.tolist(), held.search_block(asks, 10, np.zeros(len(asks.ids)))):
        assert [i for _, i in best[q]] == ids.tolist()
        assert [-s for s, _ in best[q]] == pytest.approx(sums.tolist(), abs=1e-8)


def test_lists_are_added_up_once_a_document(monkeypatch):
    """A shard of 100 documents is passed once for all 300 queries of a block, not once a query."""
    lists, calls, plain = random_lists(300, 9), [], np.bincount
    asks, held = asked_of(lists, 1, 40), packed(lists[:100], range(100), 40.0)
    monkeypatch.setattr(np, "bincount", lambda *a, **b: calls.append(1) or plain(*a, **b))
    assert len(list(held.search_block(asks, 10, np.zeros(300)))) == 300
    assert 100 <= len(calls) < 150


def test_queries_of_any_number_are_packed_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(bm25, "QUERIES", 20)
    rows = corpus(400, 11)
    same(run(spark, rows, every=2, k=3, shard=100), brute(rows, 2, 3))
