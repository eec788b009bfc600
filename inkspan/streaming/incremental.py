"""The same readers over a growing folder: files are turned into rows once, with exactly-once sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkspan.operators.render import block_markdown
from inkspan.plans.document_text import paragraph_blocks
from inkspan.session import stored
from inkspan.sources import reader
from inkspan.sources.files import FILE_SCHEMA, with_format


def stream_files(spark: SparkSession, path: str, glob: str = "*", files_per_trigger: int = 100, doc_format: str | None = None) -> DataFrame:
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return with_format(stream.option("maxFilesPerTrigger", files_per_trigger).load(path), doc_format)


def land_blocks(files: DataFrame, out: str, formats=reader.SUPPORTED, **sheet_options) -> StreamingQuery:
    """A stream of files -> blocks and errors as Parquet below ``out``: one run over what is new, then it ends.

    The checkpoint below ``out`` remembers which files were taken, so a later run takes the others alone. A batch has
    a folder of its own in both tables and replaces it, so one that is run again after a failure leaves one copy.
    """

    def land(batch: DataFrame, number: int) -> None:
        blocks, errors = reader.parse(stored(batch, "files"), formats, **sheet_options)
        blocks.write.mode("overwrite").parquet(f"{out}/blocks/batch={number}")
        errors.write.mode("overwrite").parquet(f"{out}/errors/batch={number}")

    return files.writeStream.foreachBatch(land).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def landed(spark: SparkSession, out: str, table: str = "blocks") -> DataFrame:
    return spark.read.parquet(f"{out}/{table}").drop("batch")


def stream_paragraphs(texts: DataFrame) -> DataFrame:
    """(doc_id, text) of a stream -> rendered paragraphs; stateless, append mode."""
    return paragraph_blocks(texts).withColumn("md", block_markdown()).select("doc_id", "block_index", "md")


def distinct_images(images: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """Each image once within the watermark's delay, across files."""
    return images.withWatermark(time, delay).dropDuplicatesWithinWatermark(["image_id"])


def windowed_counts(events: DataFrame, time: str, width: str, by: str, delay: str = "1 hour") -> DataFrame:
    counted = events.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), by, "n")
