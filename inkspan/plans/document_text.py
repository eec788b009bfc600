"""Documents that are already text: lines and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import list_item, looks_like_heading, trim_ws


def lines(docs: DataFrame, keys=("doc_id",)) -> DataFrame:
    """keys, line_no (from 0), line."""
    return docs.select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def paragraph_blocks(docs: DataFrame, prefix: str | None = None) -> DataFrame:
    """Every line that is not blank as a paragraph; doc_id as text, after ``prefix`` and a slash if given.

    Blocks are numbered inside the document's own array, so nothing is shuffled.
    """
    texts = F.filter(F.transform(F.split("text", "\n"), trim_ws), lambda x: x != "")
    key = F.col("doc_id").cast("string")
    key = F.concat_ws("/", prefix, key) if prefix else F.col("doc_id")
    rows = docs.select(key.alias("doc_id"), F.posexplode(texts).alias("block_index", "text"))
    return rows.select(
        "doc_id", F.col("block_index").cast("long").alias("block_index"), F.lit("paragraph").alias("block_type"), "text", *[F.lit(None).cast(t).alias(c) for c, t in EMPTY.items()]
    )


EMPTY = {
    "level": "smallint", "ordered": "boolean", "items": "array<struct<level:smallint,text:string>>",
    "rows": "array<array<struct<text:string,colspan:int,rowspan:int>>>", "image_id": "string", "filename": "string",
    "content_type": "string", "alt": "string", "url": "string", "link_text": "string",
}


def classified(docs: DataFrame) -> DataFrame:
    """Lines as headings, list items gathered to lists, and paragraphs."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines(docs).withColumn("text", trim_ws("line")).where("text <> ''")
    kind = F.when(list_item("text").isNotNull(), "list").when(looks_like_heading("text"), "heading").otherwise("paragraph")
    marked = rows.withColumn("block_type", kind)
    new = (F.col("block_type") != "list") | (F.coalesce(F.lag("block_type").over(w), F.lit("")) != "list")
    numbered = marked.withColumn("_new", new.cast("int")).withColumn("block_index", F.sum("_new").over(w) - 1)
    item = F.struct("line_no", F.struct(F.lit(0).cast("smallint").alias("level"), list_item("text").alias("text")).alias("i"))
    return numbered.groupBy("doc_id", "block_index", "block_type").agg(
        F.min("text").alias("text"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"]).alias("items")
    )
