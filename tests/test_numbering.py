"""Numbers, running sums and medians of groups in slices, against plain Python."""

import random
import statistics
from itertools import groupby

from pyspark.sql import functions as F

from inkspan.operators import assets, sheet
from inkspan.operators.numbering import medians, running


def skewed(n=600):
    """(key, i, w): one key holds half of the rows, another is null."""
    rng = random.Random(5)
    return [(rng.choice(["a", "a", "a", "b", None, "c"]), i, rng.randint(0, 9)) for i in range(n)]


def test_running_sums_and_totals(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "key string, i long, w long").repartition(7)
    for weight in (None, "w"):
        got = {r.i: (r.upto, r.whole) for r in running(df, ["key"], ["i"], "upto", "whole", weight).collect()}
        expected, sums = {}, {}
        size = lambda w: w if weight else 1
        for k, i, w in rows:
            sums[k] = sums.get(k, 0) + size(w)
            expected[i] = sums[k]
        assert got == {i: (expected[i], sums[k]) for k, i, _ in rows}


def test_a_large_group_lies_in_many_slices(spark):
    df = spark.range(20_000).select(F.lit(1).alias("key"), "id")
    plan = running(df, ["key"], [F.col("id").desc()], "n")
    assert {r.id: r.n for r in plan.collect()} == {i: 20_000 - i for i in range(20_000)}
    slices = df.repartitionByRange(8, "key", "id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in slices) < 6_000


def test_no_rows_and_no_keys(spark):
    empty = spark.createDataFrame([], "key string, i long, w long")
    assert running(empty, ["key"], ["i"], "n").collect() == []
    assert medians(empty, ["key"], {"m": F.col("w")}).collect() == []
    assert {r.i: (r.n, r.t) for r in running(spark.createDataFrame([(3,), (1,)], "i long"), [], ["i"], "n", "t").collect()} == {1: (1, 2), 3: (2, 2)}


def test_head_and_tail(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "key string, i long, w long").repartition(5)
    for most, tail in ((10, 3), (11, 100), (1000, 10), (1, 1)):
        expected = set()
        for k, group in groupby(sorted(rows, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
            numbered = list(enumerate((i for _, i, _ in group), 1))
            last = min(tail, most // 2)
            kept = numbered if len(numbered) <= most else numbered[: most - last] + numbered[len(numbered) - last :]
            expected |= {(k, i, at, no) for no, (at, i) in enumerate(kept, 1)}
        got = {(r.key, r.i, r.actual_row, r.sample_row) for r in sheet.head_tail(df, ["key"], ["i"], most, tail).collect()}
        assert got == expected


def test_windows_of_rows(spark):
    df = spark.createDataFrame(skewed(), "key string, i long, w long")
    counts = {(r.key, r.window): r["count"] for r in sheet.cap_windows(df, ["key"], ["i"], 40).groupBy("key", "window").count().collect()}
    sizes = {k: sum(x[0] == k for x in skewed()) for k in "abc"}
    for k, n in sizes.items():
        assert [counts[k, w] for w in range(-(-n // 40))] == [40] * (n // 40) + [n % 40] * (n % 40 > 0)
    assert {r.window for r in sheet.cap_windows(df, ["key"], ["i"], 0).collect()} == {0}


def test_medians_of_positive_finite_values(spark):
    values = [("a", float(x)) for x in [5, 1, 1, 9, -3, 0, 7, 7]] + [("a", float("nan")), ("a", float("inf")), ("a", None), ("b", None), ("b", -1.0), (None, 4.0), (None, 5.0), ("c", 2.5)]
    df = spark.createDataFrame(values, "key string, v double").repartition(6)
    got = {r.key: (r.m, r.large) for r in medians(df, ["key"], {"m": F.col("v"), "large": F.when(F.col("v") > 4, F.col("v"))}).collect()}
    assert got == {"a": (6.0, 7.0), "b": (12.0, 12.0), None: (4.5, 5.0), "c": (2.5, 12.0)}
    rng = random.Random(3)
    many = [(k, float(rng.randint(1, 30))) for k in "xy" for _ in range(rng.randint(200, 300))]
    got = {r.key: r.m for r in medians(spark.createDataFrame(many, "key string, v double"), ["key"], {"m": F.col("v")}).collect()}
    assert got == {k: statistics.median(v for x, v in many if x == k) for k in "xy"}


def test_names_of_images(spark):
    rows = [(k, i, f, "image/png", f"sha256:{i:064x}") for k in ("d", None) for i, f in enumerate(["x.png", "", "x.png", "y.png", "x.png", None])]
    df = spark.createDataFrame(rows, "key string, i long, filename string, content_type string, image_id string").repartition(3)
    named = {(r.key, r.i): r.asset_name for r in assets.asset_names(df, ["key"], ["i"]).collect()}
    for k in ("d", None):
        assert [named[k, i] for i in range(6)] == ["x.png", "image_0002_000000000000.png", "0003_x.png", "y.png", "0005_x.png", "image_0006_000000000000.png"]
