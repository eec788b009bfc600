"""CSV and TSV files as cells. Records may span lines, so a file is decoded whole; rows number the records."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import cell_text
from inkspan.operators import graph, sheet
from inkspan.session import stored
from inkspan.sources.files import ERROR_SCHEMA

DELIMITERS = {"csv": ",", "tsv": "\t"}


#: Cells that leave a task together.
SLICE = 50_000


def cells(files: DataFrame) -> DataFrame:
    """doc_id, doc_format, content -> doc_id, sheet, r, c, text, error_class, message; blank records are skipped.

    A file that is no UTF-8, whose quotes do not close or whose records differ in width is one row with error_class.
    """

    def records_of(kind: str, content: bytes) -> tuple[list[list[str]], str | None, str | None]:
        try:
            records = [r for r in csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), delimiter=DELIMITERS[kind], strict=True) if r]
        except UnicodeDecodeError as error:
            return [], "NoUtf8", str(error)
        except csv.Error as error:
            return [], "Malformed", str(error)
        widths = sorted({len(r) for r in records})
        return ([], "UnequalLengths", f"records of {widths[0]} to {widths[-1]} fields") if len(widths) > 1 else (records, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(doc: str, flat: list[tuple], error: str | None = None, message: str | None = None) -> pa.RecordBatch:
            n = len(flat)
            return pa.RecordBatch.from_arrays(
                [pa.array([doc] * n, pa.string()), pa.array(["Sheet1"] * n), pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.string()), pa.array([error] * n, pa.string()), pa.array([message] * n, pa.string())],
                ["doc_id", "sheet", "r", "c", "text", "error_class", "message"],
            )

        for batch in batches:
            for doc, kind, content in zip(*batch.columns):
                records, error, message = records_of(kind.as_py(), content.as_py() or b"")
                flat = [(None, None, None)] if error else []
                for r, record in enumerate(records):
                    flat += [(r, c, x) for c, x in enumerate(record)]
                    if len(flat) >= SLICE:
                        yield batch_of(doc.as_py(), flat)
                        flat = []
                yield batch_of(doc.as_py(), flat, error, message)

    return files.where(F.col("doc_format").isin(*DELIMITERS)).select("doc_id", "doc_format", "content").mapInArrow(
        run, f"doc_id string, sheet string, r bigint, c int, text string, {ERROR_SCHEMA}"
    )


def sheet_blocks(
    grid: DataFrame, max_sheets: int = 32, max_rows: int = 20000, max_cols: int = 100, max_cell_chars: int = 2000, tail_rows: int = 2000,
    empty_row_run: int = 1, drop_empty_cols: bool = True, table_rows: int = 500, group_by: str | None = None, named: DataFrame | None = None,
) -> DataFrame:
    """Cells of sheets (doc_id, sheet, [sheet_no], r, c, text, [formula, is_error]) -> blocks.

    A sheet heading; its named tables (doc_id, sheet, table_no, name, r0, r1, c0, c1, header_rows; ends
    exclusive), if given; then the other regions, which ``empty_row_run`` blank rows end, split into tables side
    by side. A table has a heading where a sheet has several, and a heading and a table for each segment. Long
    sheets keep their head and tail; row numbers in headings are the original ones. The cells and their places
    are stored once each and read from there.
    """
    keys = ["doc_id", "sheet"]
    if "sheet_no" not in grid.columns:
        grid = grid.withColumn("sheet_no", F.lit(1))
    good = stored(grid.where(F.col("r").isNotNull() & (F.col("sheet_no") <= max_sheets)), "cells")
    last = min(tail_rows, max_rows // 2)
    head_n = max_rows - last
    size = good.groupBy(*keys).agg((F.max("r") + 1).alias("_n"))
    short = F.col("_n") <= max_rows
    to_sample = lambda r: F.when(short | (r < head_n), r).when(r >= F.col("_n") - last, r - (F.col("_n") - last) + head_n)
    to_actual = lambda r: F.when(short | (r < head_n), r + 1).otherwise(r - head_n + (F.col("_n") - last) + 1)
    sampled = good.where(F.col("c") < max_cols).withColumn("filled", ~sheet.is_empty(good)).join(size, keys).withColumn("r", to_sample(F.col("r"))).where("r is not null")
    cells_ = stored(sampled.select(*keys, "r", "c", F.when(F.col("filled"), cell_text("text", max_cell_chars)).otherwise("").alias("text")), "sample")

    # Units: named tables (kind 0), then regions that none of them touches (kind 1); a row for each of their rows.
    unit = [*keys, "kind", "region"]
    whole = {"c0": F.lit(0), "c1": F.lit(max_cols), "name": F.lit(None).cast("string"), "given": F.lit(None).cast("boolean")}
    bounds = sheet.region_bounds(cells_.where("text <> ''"), keys, gap=empty_row_run).withColumn("kind", F.lit(1))
    several = bounds.groupBy(*keys).agg(F.count(F.lit(1)).alias("_regions"))
    if named is not None:
        tables = named.join(size, keys).withColumns({"c1": F.least("c1", F.lit(max_cols)), "kind": F.lit(0), "region": F.col("table_no").cast("long")})
        taken = cells_.select(*keys, "r").distinct().join(size, keys).withColumn("_a", to_actual(F.col("r")) - 1)
        inside = taken.join(tables.drop("_n"), keys).where((F.col("_a") >= F.col("r0")) & (F.col("_a") < F.col("r1")) & (F.col("c0") < F.col("c1")))
        spans = inside.groupBy(*unit, "name", "c0", "c1").agg(
            F.min("r").alias("first_row"), (F.max("r") + 1).alias("end_row"), F.max((F.col("header_rows") > 0) & (F.col("_a") == F.col("r0"))).alias("given")
        )
        boxes = spans.select(*keys, F.col("first_row").alias("r0"), (F.col("end_row") - 1).alias("r1"), "c0", (F.col("c1") - 1).alias("c1"))
        extent = cells_.where("text <> ''").join(bounds, keys).where(F.col("r").between(F.col("first_row"), F.col("end_row") - 1))
        extent = extent.groupBy(*unit, "first_row", "end_row").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).withColumns({"r0": F.col("first_row"), "r1": F.col("end_row") - 1})
        bounds = graph.rectangles_free_of(extent, boxes, keys).select(*unit, "first_row", "end_row")
        bounds = bounds.withColumns(whole).unionByName(spans.select(*unit, "first_row", "end_row", "c0", "c1", "name", "given"))
    else:
        bounds = bounds.withColumns(whole)
    bounds = stored(bounds.select(*unit, "first_row", "end_row", "c0", "c1", "name", "given"), "regions")
    rows = bounds.select(*unit, "first_row", "c0", "c1", F.explode(F.sequence("first_row", F.col("end_row") - 1)).alias("r"))
    placed = cells_.join(rows, [*keys, "r"]).where((F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1"))).select(*unit, "r", "c", "text")
    placed = stored(placed, "placed")
    head = sheet.has_header(placed.where("kind = 1"), unit).unionByName(bounds.where("kind = 0").select(*unit, F.col("given").alias("has_header")))
    head = bounds.select(*unit, "first_row", "name").join(head, unit)
    parts = sheet.region_tables(placed.where("kind = 1"), unit).unionByName(bounds.where("kind = 0").select(*unit, F.lit(1).cast("long").alias("block"), F.col("c0").alias("first_column"), F.col("c1").alias("end_column")))

    flags = rows.select(*unit, "r").join(head, unit).where((F.col("r") > F.col("first_row")) | ~F.col("has_header"))
    flags = flags.join(sheet.total_rows(placed, unit), [*unit, "r"], "left").join(sheet.repeated_headers(placed, unit), [*unit, "r"], "left")
    flags = flags.select(*unit, "r", "is_total", (F.col("has_header") & F.coalesce("repeats_header", F.lit(False))).alias("repeats_header"))
    ranges = sheet.row_segments(flags, unit, 0 if group_by else table_rows)
    lines = ranges.select(*unit, F.col("segment").alias("_p"), F.explode(F.sequence("first_row", F.col("end_row") - 1)).alias("r"))
    table = [*unit, "block"]
    lines = lines.join(parts, unit).withColumns({"segment": F.col("_p").cast("long"), "segment_key": F.lit(None).cast("string"), "label": F.lit("")})
    in_table = (F.col("c") >= F.col("first_column")) & (F.col("c") < F.col("end_column"))
    names = placed.join(head.where("has_header"), unit).where("r = first_row").join(parts, unit).where(in_table).select(*table, "c", "text")
    if group_by:
        # By letter any column inside the table, else by the header's text.
        letters = parts.select(*table, F.explode(F.sequence("first_column", F.col("end_column") - 1)).alias("c")).join(names, [*table, "c"], "left")
        column = sheet.group_column(letters.withColumn("text", F.coalesce("text", F.lit(""))), table, group_by).withColumnRenamed("c", "_gc")
        by = placed.join(column, unit).where("c = _gc").select(*table, "r", F.col("text").alias("_key"), F.col("label").alias("_label"))
        runs = sheet.key_segments(lines.drop("segment", "segment_key", "label").join(by, [*table, "r"], "left"), [*table, "_p"], "r", "_key")
        # A table has no more rows than a sheet's limit, so a window holds it.
        in_run = F.row_number().over(Window.partitionBy(*table, "_p", "segment").orderBy("r"))
        capped = runs.withColumn("window", sheet.cap_window(in_run, table_rows))
        number = F.dense_rank().over(Window.partitionBy(*table).orderBy("_p", "segment", "window"))
        lines = capped.withColumn("segment", number.cast("long")).withColumn("label", F.coalesce("_label", F.lit("")))
    lines = stored(lines.join(size, keys).select(*table, "first_column", "end_column", "r", to_actual(F.col("r")).alias("actual_row"), "segment", "segment_key", "label"), "lines")
    spans = lines.groupBy(*table, "segment").agg(F.min("actual_row").alias("a"), F.max("actual_row").alias("b"), F.min("segment_key").alias("key"), F.min("label").alias("label"))
    body = placed.join(lines.select(*table, "first_column", "end_column", "r", "segment"), [*unit, "r"]).where(in_table).select(*table, "segment", "r", "c", "text")
    top = names.join(spans.select(*table, "segment"), table).select(*table, "segment", F.lit(-1).cast("bigint").alias("r"), "c", "text")
    keep = body.unionByName(top)
    keep = sheet.drop_empty_columns(keep, [*table, "segment"]) if drop_empty_cols else keep
    keep = keep.withColumn("c", F.dense_rank().over(Window.partitionBy(*table, "segment").orderBy("c")) - 1)
    nameless = keep.join(head.where("not has_header").select(*unit), unit).select(*table, "segment", "c").distinct()
    keep = keep.unionByName(nameless.select(*table, "segment", F.lit(-1).cast("bigint").alias("r"), "c", sheet.column_name("c").alias("text")))
    bodies = sheet.table_rows(keep, [*table, "segment"])

    known = head.select(*unit, "name").join(parts.select(*table), unit).join(spans.groupBy(*table).agg(F.count(F.lit(1)).alias("_segments")), table, "left")
    known = known.join(parts.groupBy(*unit).agg(F.count(F.lit(1)).alias("_blocks")), unit).join(several, keys)
    known = known.withColumn("_no", F.dense_rank().over(Window.partitionBy(*keys, "kind").orderBy("region", "block")))
    known = known.withColumn("_named", F.max((F.col("kind") == 0).cast("int")).over(Window.partitionBy(*keys)))
    z = F.lit(0)
    cell = lambda x: F.struct(x.alias("text"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"))
    block = lambda df, o, kind, **cols: df.select(
        *keys, F.array(*[x.cast("bigint") for x in o]).alias("_o"), F.lit(kind).alias("block_type"), *[v.alias(k) for k, v in cols.items()]
    )
    sheets = good.select(*keys, "sheet_no").distinct()
    at = lambda *x: (F.col("kind") + 1, F.col("region"), F.col("block"), *x)
    out = block(sheets, (z, z, z, z, z), "heading", level=F.lit(2).cast("smallint"), text=F.concat(F.lit("Sheet: "), F.trim("sheet")))
    titled = known.where("kind = 0 or _regions > 1 or _blocks > 1 or _named = 1 or _segments > 1")
    title = F.when(F.col("kind") == 0, F.concat(F.lit("Table: "), F.trim("name"))).otherwise(F.concat(F.lit("Table "), "_no"))
    out = out.unionByName(block(titled, at(z, z), "heading", level=F.lit(3).cast("smallint"), text=title))
    rows_title = sheet.rows_heading(F.col("label"), F.col("key"), F.col("a"), F.col("b"))
    parted = spans.join(known.where("_segments > 1").select(*table), table)
    out = out.unionByName(block(parted, at(F.col("segment"), z), "heading", level=F.lit(4).cast("smallint"), text=rows_title))
    out = out.unionByName(block(bodies, at(F.col("segment"), F.lit(1)), "table", rows=F.transform("rows", lambda r: F.transform(r, cell))), allowMissingColumns=True)
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet_no", "_o")) - 1
    return complete(out.join(sheets, keys).withColumn("block_index", index.cast("bigint")).drop("_o", "sheet", "sheet_no"))


def complete(blocks: DataFrame) -> DataFrame:
    """All block columns, nulls where a block has none."""
    from inkspan.plans.document_text import EMPTY

    columns = {"text": "string", **EMPTY}
    have = [F.col(c) if c in blocks.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
    return blocks.select("doc_id", "block_index", "block_type", *have)
