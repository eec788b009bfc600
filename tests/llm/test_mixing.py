"""Mixing: targets against a plain water-filling, and what the draws must fulfil."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkspan.llm.mixing import mix, plan_mix, source_targets, splitting_tree
from inkspan.llm.queries import QUERIES


def filled(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 3, None: 7}, {"z": 10}, {"a": 0, "b": 0},
    {"a": 5, "B": 500, "é": 50, "": 9, "aa": 1, None: 2}, {f"s{i}": i * i for i in range(12)},
])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(table).collect()}
    assert got == {s: pytest.approx(t) for s, t in filled(sizes).items()}


def test_tree_splits_exactly(spark):
    quotas = spark.createDataFrame([("a", 100), ("b", 37), (None, 3)], "source string, quota int")
    got = splitting_tree(quotas, 7, 1).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        by_source[r.source] += r.blocks
        by_shard[r.shard] += r.blocks
    assert by_source == {"a": 100, "b": 37, None: 3}
    assert set(by_shard) == set(range(7)) and max(by_shard.values()) - min(by_shard.values()) <= 3


def test_counts_by_shard_are_hypergeometric(spark):
    """64 shards draw 30 tokens each of 640 a and 1280 b: mean and spread of the counts of a."""
    quotas = spark.createDataFrame([("a", 640), ("b", 1280)], "source string, quota int")
    for seed in (1, 2):
        got = {r.shard: r.blocks for r in splitting_tree(quotas, 64, seed).where("source = 'a'").collect()}
        counts = [got.get(i, 0) for i in range(64)]
        both = splitting_tree(quotas, 64, seed).groupBy("shard").sum("blocks").collect()
        assert {r[1] for r in both} == {30} and sum(counts) == 640
        spread = sum((x - 10) ** 2 for x in counts) / 64
        assert 30 * (1 / 3) * (2 / 3) * (1890 / 1919) == pytest.approx(6.57, abs=0.01)
        assert 3.5 < spread < 10.5  # 6.57, give or take 3.3 standard errors


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def documents():
    rows = []
    for i in range(900):
        source = ["web", "web", "web", "books", None, "news"][i % 6]
        rows.append((i, " ".join(["w"] * (i * 7 % 40)), source))
    return rows + [(None, None, "web"), (None, "a b", "web"), (3, "a b", "web"), (3, "a b", "web"), (2000, "", "empty")]


def test_plan(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = plan_mix(docs).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in out) == Counter((i, s, words(t)) for i, t, s in rows)
    sizes, taken, largest = Counter(), Counter(), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += words(t)
        largest[s] = max(largest[s], words(t))
    for r in out:
        assert len(r.draws) <= 2 and all(0 <= d.shard < 16 for d in r.draws)
        assert len({d["pass"] for d in r.draws}) == len(r.draws)
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(filled(sizes)[r.source])
        taken[r.source] += r["size"] * len(r.draws)
    for s in sizes:
        assert abs(taken[s] - filled(sizes)[s]) <= largest[s] / 2 + 1
    again = plan_mix(docs.repartition(7)).collect()
    key = lambda rs: sorted((str(r.doc_id), r["size"], str(r.draws)) for r in rs)
    assert key(out) == key(again)


def test_one_hot_block(spark):
    """All rows share a null doc_id: their texts tell the rows apart."""
    docs = spark.createDataFrame([(None, " ".join(["w"] * (1 + i % 9)), "s") for i in range(500)], "doc_id long, text string, source string")
    out = plan_mix(docs).collect()
    total = sum(r["size"] for r in out)
    assert abs(sum(r["size"] * len(r.draws) for r in out) - 1.5 * total) <= 5


def test_the_draw_prefers_no_size(spark):
    """Half of a source is read once more: the long documents' share of it is their share of the source."""
    rows = [(i, " ".join(["w"] * (40 if i % 2 else 4)), "s") for i in range(4000)]
    out = plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    twice = [r["size"] for r in out if len(r.draws) == 2]
    assert abs(sum(x == 40 for x in twice) / len(twice) - 0.5) < 0.04  # 4.5 % are three deviations


def test_repeated_rows_may_be_drawn_in_part(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s")] * 30 + [(None, "x y", "t")] * 31, "doc_id long, text string, source string")
    taken = Counter()
    for r in plan_mix(docs).collect():
        taken[r.source] += r["size"] * len(r.draws)
    targets = filled({"s": 120, "t": 62})
    assert all(abs(taken[s] - targets[s]) <= 2 for s in taken) and len(taken) == 2


def test_mix_deals_out_and_shuffles_shards(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    planned = {(r.doc_id, d["pass"]): d for r in plan_mix(docs).collect() for d in r.draws if r.doc_id not in (None, 3)}
    out = mix(docs).withColumn("_at", F.spark_partition_id()).collect()
    assert len(out) == sum(len(r.draws) for r in plan_mix(docs).collect())
    at, parts = defaultdict(set), defaultdict(list)
    for r in out:
        at[r.shard, r.position >> 52].add(r._at)
        parts[r._at].append((r.shard, r.position))
        if r.doc_id not in (None, 3):
            assert planned[r.doc_id, r["pass"]].shard == r.shard
    assert all(len(x) == 1 for x in at.values()) and {shard for shard, _ in at} == set(range(16))
    assert all(x == sorted(x) for x in parts.values())
    for shard in range(16):
        ids = [r.doc_id for r in sorted(out, key=lambda r: r.position) if r.shard == shard and r.doc_id is not None]
        assert len(ids) < 5 or ids != sorted(ids)


def test_kept_and_clashing_columns(spark):
    rows = [(i, "a b c", "s", i, "x", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, size string, _block int")
    out = plan_mix(docs, keep=["doc_id", "source", "text", "n"])
    assert out.columns == ["doc_id", "source", "text", "n", "size", "source_size", "target", "draws"]
    assert {(r.doc_id, r.n, r["size"]) for r in out.collect()} == {(i, i, 3) for i in range(40)}


def test_empty_table(spark):
    assert plan_mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_query(spark, small):
    out = QUERIES["op2_source_mixing"](spark, small).collect()
    near, largest = defaultdict(int), defaultdict(int)
    for r in out:
        of = r.source_size, r.target
        assert r.taken <= 2 * r["size"]
        near[of] += r.taken
        largest[of] = max(largest[of], r["size"])
    for of, taken in near.items():
        assert abs(taken - of[1]) <= largest[of] / 2 + 1
