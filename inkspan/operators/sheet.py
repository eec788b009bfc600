"""Spreadsheet operators over a long table of cells: key columns, r, c (from 0) and text.

All are windows and aggregates within one sheet; sheets are independent, so ``keys`` is what Spark
partitions by. An empty cell is blank text that is no error and has no formula.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.numbers import is_number
from inkspan.functions.text import column_index, column_name, comparable, trim_ws
from inkspan.operators.numbering import running

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def is_empty(cells: DataFrame) -> Column:
    blank = F.coalesce(trim_ws("text"), F.lit("")) == ""
    if "is_error" in cells.columns:
        blank = blank & ~F.coalesce("is_error", F.lit(False))
    if "formula" in cells.columns:
        blank = blank & F.col("formula").isNull()
    return blank


def head_tail(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], most: int, tail: int) -> DataFrame:
    """The first and last rows of each group, ``most`` in all; adds actual_row (from 1) and sample_row."""
    last = min(tail, most // 2)
    row, n = F.col("actual_row"), F.col("_n")
    kept = running(rows, keys, order, "actual_row", "_n").where((row <= most - last) | (row > n - last) | (n <= most))
    # What is left out lies between head and tail, so a row of the tail moves up by that much.
    return kept.withColumn("sample_row", F.when((row <= most - last) | (n <= most), row).otherwise(row - n + most)).drop("_n")


def row_regions(filled: DataFrame, keys: Sequence[str], row: str = "r", gap: int = 1) -> DataFrame:
    """Rows that hold something -> region (from 1): a run of ``gap`` blank rows ends a region."""
    w = Window.partitionBy(*keys).orderBy(row)
    new = F.coalesce((F.col(row) - F.lag(row).over(w) > max(gap, 1)).cast("int"), F.lit(0))
    return filled.withColumn("_new", new).withColumn("region", F.sum("_new").over(w) + 1).drop("_new")


def region_bounds(filled: DataFrame, keys: Sequence[str], row: str = "r", gap: int = 1) -> DataFrame:
    """A row a region: first_row, end_row (exclusive)."""
    regions = row_regions(filled.select(*keys, row).distinct(), keys, row, gap)
    return regions.groupBy(*keys, "region").agg(F.min(row).alias("first_row"), (F.max(row) + 1).alias("end_row"))


def used_extent(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    filled = cells.where(~is_empty(cells))
    return filled.groupBy(*keys).agg(*[f(x).alias(f"{n}_{x}") for x in "rc" for n, f in (("min", F.min), ("max", F.max))])


def dense_columns(cells: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Columns with more cells than max(rows / 50, 1): the others may separate tables."""
    counts = cells.where(~is_empty(cells)).groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("cells"))
    return counts.where(F.col("cells") > max(rows // 50, 1))


def column_blocks(cells: DataFrame, keys: Sequence[str], rows: int, width: int) -> DataFrame:
    """Tables side by side: block, first_column, end_column.

    Runs of sparse columns between dense ones separate; those at the ends stay with their neighbour.
    """
    dense = dense_columns(cells, keys, rows)
    w = Window.partitionBy(*keys).orderBy("c")
    islands = dense.withColumn("_new", F.coalesce((F.col("c") - F.lag("c").over(w) > 1).cast("int"), F.lit(0)))
    islands = islands.withColumn("block", F.sum("_new").over(w) + 1)
    runs = islands.groupBy(*keys, "block").agg(F.min("c").alias("_lo"), (F.max("c") + 1).alias("_hi"))
    all_blocks = Window.partitionBy(*keys)
    return runs.select(
        *keys, "block",
        F.when(F.col("block") == 1, 0).otherwise(F.col("_lo")).cast("int").alias("first_column"),
        F.when(F.col("block") == F.max("block").over(all_blocks), width).otherwise(F.col("_hi")).cast("int").alias("end_column"),
    )


def region_tables(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tables side by side in each region (keys): block (from 1), first_column, end_column.

    As column_blocks, with each region's own rows and columns; a region without dense columns is one table.
    """
    filled = cells.where(~is_empty(cells))
    extents = filled.groupBy(*keys).agg(F.min("c").alias("_cs"), (F.max("c") + 1).alias("_ce"), (F.max("r") - F.min("r") + 1).alias("_n"))
    counts = filled.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("_cells"))
    dense = counts.join(extents, list(keys)).where(F.col("_cells") > F.greatest(F.floor(F.col("_n") / 50), F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("c")
    new = F.coalesce((F.col("c") - F.lag("c").over(w) > 1).cast("int"), F.lit(0))
    islands = dense.withColumn("_new", new).withColumn("block", F.sum("_new").over(w) + 1)
    runs = islands.groupBy(*keys, "block").agg(F.min("c").alias("_lo"), (F.max("c") + 1).alias("_hi"))
    last = F.max("block").over(Window.partitionBy(*keys))
    joined = extents.join(runs, list(keys), "left").withColumn("block", F.coalesce("block", F.lit(1)))
    return joined.select(
        *keys, "block",
        F.when(F.col("block") == 1, F.col("_cs")).otherwise(F.col("_lo")).cast("int").alias("first_column"),
        F.when(F.col("block") == last, F.col("_ce")).otherwise(F.col("_hi")).cast("int").alias("end_column"),
    )


def drop_empty_columns(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of columns that hold something; the others leave by a semi-join."""
    kept = cells.where(~is_empty(cells)).select(*keys, "c").distinct()
    return cells.join(kept, [*keys, "c"], "left_semi")


def row_profile(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, r) -> non_empty, numeric_like, string_like."""
    filled, number = ~is_empty(cells), is_number(trim_ws("text"))
    return cells.groupBy(*keys, "r").agg(
        F.count_if(filled).alias("non_empty"), F.count_if(filled & number).alias("numeric_like"), F.count_if(filled & ~number).alias("string_like")
    )


def has_header(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys -> has_header: the first row is mostly text, and the second has numbers or the first none."""
    w = Window.partitionBy(*keys).orderBy("r")
    two = row_profile(cells, keys).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= 2)
    at = lambda i, x: F.max(F.when(F.col("_i") == i, F.col(x)))
    wide = two.groupBy(*keys).agg(
        *[at(i, x).alias(f"_{x}{i}") for i in (1, 2) for x in ("non_empty", "numeric_like", "string_like")]
    )
    texty = (F.col("_non_empty1") > 0) & (F.col("_string_like1") * 2 >= F.col("_non_empty1"))
    told = F.col("_non_empty2").isNull() | (F.col("_numeric_like2") > 0) | (F.col("_numeric_like1") == 0)
    return wide.select(*keys, (texty & told).alias("has_header"))


def total_rows(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, r) -> is_total: one of the first two filled cells says total, and numbers weigh in."""
    filled = cells.where(~is_empty(cells))
    w = Window.partitionBy(*keys, "r").orderBy("c")
    first = filled.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= 2)
    says = first.groupBy(*keys, "r").agg(F.max(F.contains(comparable("text"), F.lit("total"))).alias("_says"))
    enough = (F.col("non_empty") >= 2) & ((F.col("numeric_like") > 0) | (F.col("string_like") * 2 <= F.col("non_empty")))
    return row_profile(cells, keys).join(says, [*keys, "r"]).select(*keys, "r", (F.col("_says") & enough).alias("is_total"))


def repeated_headers(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, r) -> repeats_header: four fifths of the header's cells recur in place, and text weighs in."""
    filled = cells.where(~is_empty(cells)).select(*keys, "r", "c", comparable("text").alias("_t"))
    top = Window.partitionBy(*keys)
    marked = filled.withColumn("_top", F.min("r").over(top))
    head = marked.where("r = _top").select(*keys, "c", F.col("_t").alias("_h"))
    size = head.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    same = marked.where("r > _top").join(head, [*keys, "c"]).groupBy(*keys, "r").agg(F.count_if(F.col("_t") == F.col("_h")).alias("_same"))
    profile = row_profile(cells, keys)
    return same.join(size, list(keys)).join(profile, [*keys, "r"]).select(
        *keys, "r", ((F.col("_same") * 10 >= F.col("_n") * 8) & (F.col("string_like") >= F.col("numeric_like"))).alias("repeats_header")
    )


def key_segments(rows: DataFrame, keys: Sequence[str], order: str | Sequence[str], key: str) -> DataFrame:
    """Runs of equal keys: adds segment (from 1) and segment_key, the first raw key of the run.

    Blank keys belong to the run before them; leading blanks to the first.
    """
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*keys).orderBy(*order)
    norm = F.when(F.coalesce(comparable(key), F.lit("")) != "", comparable(key))
    filled = rows.withColumn("_k", norm).withColumn(
        "_k", F.coalesce(F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("_k", True).over(w.rowsBetween(*ALL)))
    )
    new = F.coalesce((~F.col("_k").eqNullSafe(F.lag("_k").over(w)) & F.lag(F.lit(1)).over(w).isNotNull()).cast("int"), F.lit(0))
    out = filled.withColumn("_new", new).withColumn("segment", (F.sum("_new").over(w) + 1).cast("long"))
    inside = Window.partitionBy(*keys, "segment").orderBy(*order).rowsBetween(*ALL)
    raw = F.when(norm.isNotNull(), F.col(key))
    return out.withColumn("segment_key", F.first(raw, True).over(inside)).drop("_k", "_new")


def cap_window(number: Column, cap: int) -> Column:
    """The run of ``cap`` rows (from 0) that a row number (from 1) falls in; a cap of 0 puts all in one."""
    return (F.floor((number - 1) / cap) if cap > 0 else F.lit(0)).cast("long")


def cap_windows(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], cap: int) -> DataFrame:
    """Adds window: the cap_window of each row in its group, which may be of any size."""
    return running(rows, keys, order, "_number").withColumn("window", cap_window(F.col("_number"), cap)).drop("_number")


def row_segments(rows: DataFrame, keys: Sequence[str], cap: int = 500) -> DataFrame:
    """(keys, r, is_total, repeats_header; data rows only) -> keys, segment, first_row, end_row.

    A total row closes its segment; a repeated header, more than three rows on, closes it and belongs to
    none. How far on it is depends on where the segment began, so rows are folded in order, one sheet an
    array of small structs. Segments are then cut to ``cap`` rows.
    """
    item = F.struct("r", F.coalesce("is_total", F.lit(False)).alias("t"), F.coalesce("repeats_header", F.lit(False)).alias("h"))
    ordered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    range_type = "array<struct<a:bigint,b:bigint>>"
    start = F.struct(F.array().cast(range_type).alias("done"), F.element_at("_rows", 1)["r"].cast("bigint").alias("cur"))

    def step(acc, x):
        r = x["r"].cast("bigint")
        push = lambda end, go: F.struct(
            F.when(end > acc["cur"], F.array_append(acc["done"], F.struct(acc["cur"].alias("a"), end.alias("b")))).otherwise(acc["done"]).alias("done"), go.alias("cur")
        )
        return F.when(x["h"] & (r > acc["cur"] + 3), push(r, r + 1)).when(x["t"], push(r + 1, r + 1)).otherwise(acc)

    end = (F.element_at("_rows", -1)["r"] + 1).cast("bigint")
    folded = F.aggregate(
        "_rows", start, step,
        lambda acc: F.when(end > acc["cur"], F.array_append(acc["done"], F.struct(acc["cur"].alias("a"), end.alias("b")))).otherwise(acc["done"]),
    )
    parts = ordered.select(*keys, F.posexplode(folded).alias("_i", "_s"))
    size = cap if cap > 0 else 1 << 40
    cut = parts.select(*keys, "_i", F.explode(F.sequence(F.col("_s.a"), F.col("_s.b") - 1, F.lit(size))).alias("first_row"), F.col("_s.b").alias("_b"))
    order = Window.partitionBy(*keys).orderBy("_i", "first_row")
    return cut.select(*keys, F.row_number().over(order).alias("segment"), "first_row", F.least(F.col("_b"), F.col("first_row") + size).alias("end_row"))


def group_column(headers: DataFrame, keys: Sequence[str], spec: str) -> DataFrame:
    """(keys, c, text of the header) -> keys, c, label: a column letter inside the bounds, else the header."""
    letter = column_index(F.lit(spec.strip()))
    width = F.max("c").over(Window.partitionBy(*keys)) + 1
    marked = headers.withColumn("_by_letter", F.coalesce(letter < width, F.lit(False))).withColumn("_letter", letter)
    chosen = marked.where(
        F.when(F.col("_by_letter"), F.col("c") == F.col("_letter")).otherwise(comparable("text") == comparable(F.lit(spec)))
    )
    first = Window.partitionBy(*keys).orderBy("c")
    return chosen.withColumn("_i", F.row_number().over(first)).where("_i = 1").select(
        *keys, "c", F.when(F.col("_by_letter"), column_name("c")).otherwise(trim_ws("text")).alias("label")
    )


def table_rows(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells -> keys, rows: array of rows of cell texts in order, gaps filled with empty text."""
    width = F.max("c").over(Window.partitionBy(*keys)) + 1
    low = F.min("c").over(Window.partitionBy(*keys))
    placed = cells.withColumn("_w", width).withColumn("_lo", low)
    by_row = placed.groupBy(*keys, "r", "_w", "_lo").agg(F.map_from_entries(F.collect_list(F.struct("c", "text"))).alias("_m"))
    line = F.transform(F.sequence(F.col("_lo"), F.col("_w") - 1), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit("")))
    return by_row.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("x")))), lambda s: s["x"]).alias("rows"))


def rows_heading(label: Column | None, key: Column | None, first: Column, last: Column) -> Column:
    """``Rows a–b`` or ``label: key (Rows a–b)``, row numbers from 1."""
    span = F.concat(F.lit("Rows "), first.cast("string"), F.lit("–"), last.cast("string"))
    if key is None:
        return span
    return F.when(key.isNull(), span).otherwise(F.concat(label, F.lit(": "), F.substring(key, 1, 120), F.lit(" ("), span, F.lit(")")))


