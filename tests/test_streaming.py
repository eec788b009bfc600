"""Streams that end, grow and start again."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from inkspan.streaming import incremental


def run(df, out):
    df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def test_files_are_read_once_and_errors_land(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    read = lambda: incremental.land_blocks(incremental.stream_files(spark, f"file://{folder}", files_per_trigger=10), out, ["csv", "json"]).awaitTermination()
    (folder / "a.csv").write_text("name,n\nx,1\ny,2\n")
    (folder / "broken.json").write_text('{"a": ')
    read()
    first = incremental.landed(spark, out).collect()
    assert {r.doc_id.rsplit("/")[-1] for r in first} == {"a.csv"}
    read()
    assert sorted(map(str, incremental.landed(spark, out).collect())) == sorted(map(str, first))
    (folder / "b.json").write_text('{"k": "v"}')
    (folder / "c.exe").write_text("?")
    read()
    got = incremental.landed(spark, out)
    assert {r.doc_id.rsplit("/")[-1] for r in got.collect()} == {"a.csv", "b.json"}
    assert got.where("doc_id like '%a.csv'").count() == len(first)
    told = {(r.doc_id.rsplit("/")[-1], r.error_class) for r in incremental.landed(spark, out, "errors").collect()}
    assert told == {("broken.json", "Malformed"), ("c.exe", "UnsupportedFormat")}


def test_an_image_is_kept_once_across_runs(spark, tmp_path):
    source, out = f"file://{tmp_path}/images", f"file://{tmp_path}/out"
    noon = datetime(2024, 5, 1, 12)
    schema = "image_id string, doc_id long, at timestamp"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    images = lambda: incremental.distinct_images(spark.readStream.schema(schema).parquet(source), "at")
    add([("i", 1, noon), ("i", 2, noon), ("j", 3, noon)])
    run(images(), out)
    add([("i", 4, noon + timedelta(hours=1)), ("k", 5, noon + timedelta(hours=2))])
    run(images(), out)
    assert {r.image_id: r["count"] for r in spark.read.parquet(f"{out}/rows").groupBy("image_id").count().collect()} == {"i": 1, "j": 1, "k": 1}


def test_counts_of_closed_windows(spark, tmp_path):
    source, out = f"file://{tmp_path}/events", f"file://{tmp_path}/out"
    noon = datetime(2024, 5, 1, 12)
    schema = "at timestamp, kind string"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    counts = lambda: incremental.windowed_counts(spark.readStream.schema(schema).parquet(source), "at", "10 minutes", "kind", "1 hour")
    add([(noon + timedelta(minutes=m), k) for m, k in [(0, "a"), (9, "a"), (9, "b"), (10, "a")]])
    run(counts(), out)
    # A row older than the newest one but inside the delay still counts; then the windows close.
    add([(noon + timedelta(minutes=5), "a")])
    run(counts(), out)
    add([(noon + timedelta(hours=5), "c")])
    run(counts(), out)
    got = {(r.start, r.kind): r.n for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == {(noon, "a"): 3, (noon, "b"): 1, (noon + timedelta(minutes=10), "a"): 1}


def test_paragraphs_of_a_stream(spark, tmp_path):
    source, out = f"file://{tmp_path}/texts", f"file://{tmp_path}/out"
    for i, text in enumerate(["one\n\ntwo", "three"]):
        spark.createDataFrame([(i, text)], "doc_id long, text string").write.mode("append").parquet(source)
        run(incremental.stream_paragraphs(spark.readStream.schema("doc_id long, text string").parquet(source)).withColumn("doc_id", F.col("doc_id").cast("string")), out)
    assert sorted(r.md for r in spark.read.parquet(f"{out}/rows").collect()) == ["one\n\n", "three\n\n", "two\n\n"]
