"""Rendezvous sharding against the same rule in plain Python."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from inkspan.llm.queries import QUERIES
from inkspan.llm.sharding import assign_shards, number_within_shards, rendezvous, unit_hash


def unit(*parts):
    return (int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) + 0.5) / 16**13


def home(key, weights):
    return min((-math.log(unit(key, str(i))) / w, i) for i, w in enumerate(weights))[1]


def test_matches_the_rule(spark):
    weights = [1.0, 2.0, 0.5, 4.0, 1.0]
    rows = [(str(i),) for i in range(3000)] + [(None,), ("",), ("é",), ("7",), ("7",)]
    out = assign_shards(spark.createDataFrame(rows, "key string"), "key", weights, grown=1.5).collect()
    for r in out:
        assert r.shard == home(r.key or "", weights)
        assert r.grown_shard == home(r.key or "", [*weights, 1.5])
    share = Counter(r.shard for r in out)
    for i, w in enumerate(weights):
        assert share[i] / len(out) == pytest.approx(w / sum(weights), abs=0.03)


def test_growth_takes_rows_into_the_new_shard_only(spark):
    keys = spark.range(2000).withColumnRenamed("id", "key")
    out = assign_shards(keys, "key", [1.0] * 10, grown=1.0).collect()
    moved = [r for r in out if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {10} and 100 < len(moved) < 260


def test_without_growth_and_empty_table(spark):
    keys = spark.createDataFrame([(1, "x", 2)], "key long, shard string, grown_shard int")
    assert [tuple(r) for r in assign_shards(keys, "key", [1.0]).collect()] == [(1, 0, None)]
    assert assign_shards(keys.limit(0), "key", [1.0, 1.0], grown=1.0).collect() == []
    for bad in ([], [0.0], [1.0, -1.0], [float("inf")], [float("nan")]):
        with pytest.raises(ValueError):
            rendezvous(keys["key"], bad)


def test_slots_are_gapless_and_reruns_agree(spark):
    rows = [(i % 700, f"t{i % 3}") for i in range(2000)] + [(None, None)] * 20
    df = spark.createDataFrame(rows, "key long, text string")
    placed = assign_shards(df, "key", [1.0] * 3).withColumn("_at", unit_hash(df["key"].cast("string"), df["text"]))
    out = number_within_shards(placed, ["key", "text"], "_at", 3)
    slots = defaultdict(list)
    for r in out.collect():
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    key = lambda d: sorted((str(r.key), str(r.text), r.shard, r.slot) for r in d.collect())
    assert key(out) == key(number_within_shards(placed.repartition(5), ["key", "text"], "_at", 3))


def test_query(spark, small):
    out = QUERIES["op3_rendezvous_sharding"](spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    slots = defaultdict(list)
    assert len(out) == len(texts)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "key"
        assert r.shard == home(str(r.doc_id), [1.0] * 40) and r.grown_shard == home(str(r.doc_id), [1.0] * 41)
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_inner_names_clash_with_none(spark):
    rows = [(i, 0.01 * i, i % 2, "a", "b", 7) for i in range(50)]
    df = spark.createDataFrame(rows, "key long, at double, shard int, _slice string, _base string, _count int")
    for shards in (2, 10**6):  # broadcast, or joined
        out = number_within_shards(df, ["key"], "at", shards).collect()
        assert {(r.key, r._slice, r._base, r._count, r.slot) for r in out} == {(i, "a", "b", 7, i // 2) for i in range(50)}
