"""Blocks to Markdown, spans, chunks and JSON.

A block is a row: doc_id, block_index, block_type and the columns of its type (see BLOCK_SCHEMA).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import link_kind, markdown_cell, trim_ws

BLOCK_SCHEMA = (
    "doc_id string, block_index bigint, block_type string, level smallint, text string, ordered boolean, "
    "items array<struct<level:smallint,text:string>>, rows array<array<struct<text:string,colspan:int,rowspan:int>>>, "
    "image_id string, filename string, content_type string, alt string, url string, link_text string"
)


def table_width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def table_line(row: Column, width: Column) -> Column:
    cell = lambda i: F.coalesce(markdown_cell(F.get(row, i - 1)["text"]), F.lit(""))
    return F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), width), cell), " | "), F.lit(" |\n"))


def table_header(rows: Column) -> Column:
    width = table_width(rows)
    return F.concat(table_line(F.element_at(rows, 1), width), F.lit("|"), F.repeat(F.lit("---|"), width), F.lit("\n"))


def table_markdown(rows: Column) -> Column:
    width = table_width(rows)
    body = F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: table_line(r, width)), "")
    empty = F.coalesce(F.size(rows), F.lit(0)) == 0
    return F.when(empty | (width == 0), F.lit("| |\n|---|\n\n")).otherwise(F.concat(table_header(rows), body, F.lit("\n")))


def list_markdown(items: Column, ordered: Column) -> Column:
    mark = F.when(F.coalesce(ordered, F.lit(False)), "1. ").otherwise("- ")
    line = lambda x: F.concat(F.repeat(F.lit("  "), F.coalesce(x["level"], F.lit(0)).cast("int")), mark, trim_ws(x["text"]), F.lit("\n"))
    return F.concat(F.array_join(F.transform(items, line), ""), F.lit("\n"))


def block_markdown() -> Column:
    """The Markdown of a block row, its closing blank line included."""
    t = F.col("block_type")
    text = F.coalesce(trim_ws("text"), F.lit(""))
    level = F.least(F.greatest(F.coalesce(F.col("level").cast("int"), F.lit(1)), F.lit(1)), F.lit(6))
    attr = lambda n, c: F.concat(F.lit(f' {n}="'), F.coalesce(c, F.lit("")), F.lit('"'))
    link = trim_ws(F.coalesce("link_text", F.lit("")))
    return (
        F.when(t == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text, F.lit("\n\n")))
        .when(t == "paragraph", F.concat(text, F.lit("\n\n")))
        .when(t == "list", list_markdown(F.col("items"), F.col("ordered")))
        .when(t == "table", table_markdown(F.col("rows")))
        .when(t == "image", F.concat(F.lit("[image:"), "image_id", attr("filename", F.col("filename")), attr("content_type", F.col("content_type")), attr("alt", F.col("alt")), F.lit("]\n\n")))
        .when(t == "link", F.concat(F.when(link == "", F.col("url")).otherwise(F.concat(F.lit("["), link, F.lit("]("), "url", F.lit(")"))), F.lit("\n\n")))
        .otherwise("")
    )


def text_length(rows: Column | None = None) -> Column:
    """Characters of a block's own text: cells of tables, items of lists, names of images, links."""
    n = lambda x: F.coalesce(F.length(x), F.lit(0))
    t = F.col("block_type")
    return (
        F.when(t == "table", F.aggregate(F.flatten("rows"), F.lit(0), lambda a, x: a + n(x["text"])))
        .when(t == "list", F.aggregate("items", F.lit(0), lambda a, x: a + n(x["text"])))
        .when(t == "image", n(F.col("image_id")) + n(F.col("filename")) + n(F.col("alt")))
        .when(t == "link", n(F.col("url")) + n(F.col("link_text")))
        .otherwise(n(F.col("text")))
    )


def with_spans(blocks: DataFrame) -> DataFrame:
    """Adds md, span_start and span_end (bytes of the rendered document, end exclusive) and link_kind."""
    before = Window.partitionBy("doc_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    sized = blocks.withColumn("md", block_markdown()).withColumn("_n", F.octet_length("md").cast("bigint"))
    start = F.coalesce(F.sum("_n").over(before), F.lit(0))
    return sized.withColumns({"span_start": start, "span_end": start + F.col("_n"), "link_kind": F.when(F.col("block_type") == "link", link_kind("url"))}).drop("_n")


def to_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown."""
    parts = blocks.select("doc_id", F.struct("block_index", block_markdown().alias("md")).alias("_b"))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_b")), lambda b: b["md"]), "").alias("markdown"))


def table_pieces(rows: Column, most: int) -> Column:
    """A table's Markdown in pieces of at most ``most`` characters, the header repeated in each."""
    whole, header, width = table_markdown(rows), table_header(rows), table_width(rows)
    lines = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: table_line(r, width))
    start = F.struct(F.array().cast("array<string>").alias("out"), header.alias("cur"))

    def step(acc, line):
        over = (F.length(acc["cur"]) + F.length(line) + 1 > most) & (acc["cur"] != header)
        return F.struct(
            F.when(over, F.array_append(acc["out"], F.concat(acc["cur"], F.lit("\n")))).otherwise(acc["out"]).alias("out"),
            F.when(over, F.concat(header, line)).otherwise(F.concat(acc["cur"], line)).alias("cur"),
        )

    folded = F.aggregate(lines, start, step, lambda acc: F.array_append(acc["out"], F.concat(acc["cur"], F.lit("\n"))))
    one = (F.coalesce(F.size(rows), F.lit(0)) <= 1) | (F.length(whole) <= most) | (F.length(header) >= most)
    return F.when(one, F.array(whole)).otherwise(folded)


def block_pieces(most: int) -> Column:
    return F.when(F.col("block_type") == "table", table_pieces(F.col("rows"), most)).otherwise(F.array(block_markdown()))


def pack(pieces: Column, most: int) -> Column:
    """Greedy packing of array<struct<pos, text>>, no text empty, into array<struct<content, block_first, block_last>>.

    Only lengths are folded, to the places (from 1) where chunks begin; every chunk is then one slice, joined once.
    """
    most = max(most, 1)
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("cur"), F.lit(0).alias("i"))

    def step(acc, n):
        i = acc["i"] + 1
        opens = (acc["cur"] == 0) | (acc["cur"] + n > most)
        cur = F.when(opens, n).otherwise(acc["cur"] + n)
        # A full chunk is closed: the next piece opens one.
        return F.struct(F.when(opens, F.array_append(acc["at"], i)).otherwise(acc["at"]).alias("at"), F.when(cur >= most, 0).otherwise(cur).alias("cur"), i.alias("i"))

    begins = F.aggregate(F.transform(pieces, lambda p: F.length(p["text"])), start, step, lambda acc: F.array_append(acc["at"], acc["i"] + 1))
    runs = F.transform(F.slice(begins, 1, F.size(begins) - 1), lambda a, j: F.slice(pieces, a, F.get(begins, j + 1) - a))
    return F.transform(
        runs, lambda run: F.struct(
            F.array_join(F.transform(run, lambda p: p["text"]), "").alias("content"),
            F.element_at(run, 1)["pos"].cast("bigint").alias("block_first"), F.element_at(run, -1)["pos"].cast("bigint").alias("block_last"),
        ),
    )


def to_chunks(blocks: DataFrame, most: int) -> DataFrame:
    """doc_id, chunk_no (from 0), content, block_first, block_last: one shuffle, by document."""
    listed = blocks.select("doc_id", "block_index", F.posexplode(block_pieces(most)).alias("_i", "text"))
    item = F.struct("block_index", "_i", "text")
    ordered = listed.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("_p"))
    filled = F.filter("_p", lambda p: p["text"] != "")
    pieces = F.transform(filled, lambda p: F.struct(p["block_index"].alias("pos"), p["text"].alias("text")))
    ordered = ordered.select("doc_id", pieces.alias("_p"))
    pieces = F.col("_p")
    return ordered.select("doc_id", F.posexplode(pack(pieces, most)).alias("chunk_no", "_c")).select("doc_id", "chunk_no", "_c.*")


def to_json_rows(blocks: DataFrame) -> DataFrame:
    """doc_id, json: schema_version 1 and the blocks in order, nulls included."""
    t = F.col("block_type")
    keep = {"ignoreNullFields": "false"}
    body = (
        F.when(t == "heading", F.to_json(F.struct(F.lit("heading").alias("type"), "level", "text"), keep))
        .when(t == "paragraph", F.to_json(F.struct(F.lit("paragraph").alias("type"), "text"), keep))
        .when(t == "list", F.to_json(F.struct(F.lit("list").alias("type"), "ordered", "items"), keep))
        .when(t == "table", F.to_json(F.struct(F.lit("table").alias("type"), "rows"), keep))
        .when(t == "image", F.to_json(F.struct(F.lit("image").alias("type"), F.col("image_id").alias("id"), "content_type", "alt"), keep))
        .when(t == "link", F.to_json(F.struct(F.lit("link").alias("type"), "url", F.col("link_text").alias("text")), keep))
    )
    listed = blocks.select("doc_id", F.struct("block_index", body.alias("j")).alias("_b")).groupBy("doc_id").agg(F.array_sort(F.collect_list("_b")).alias("_b"))
    joined = F.array_join(F.transform("_b", lambda b: b["j"]), ",")
    return listed.select("doc_id", F.concat(F.lit('{"schema_version":1,"blocks":['), joined, F.lit("]}")).alias("json"))
