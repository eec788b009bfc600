"""Page layout: text atoms with positions -> lines -> paragraphs -> classified blocks.

atoms: doc_id, page, seq, x, y, font_size, text. Everything is per page, so pages are independent; the
one fold (lines hang on their first atom's y) runs over one page's atoms as an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import heading_level, list_item, looks_like_heading

PAGE = ("doc_id", "page")


def positive_median(x: str | Column, default: float = 12.0) -> Column:
    """Median of the positive finite values; the middle two of an even number are averaged."""
    v = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.median(F.when((v > 0) & ~F.isnan(v) & (v < float("inf")), v)), F.lit(default))


def advance(text: str | Column, size: str | Column) -> Column:
    """Estimated width: narrow characters a third of the size, digits and capitals .55, others .5."""
    t, s = (F.col(v) if isinstance(v, str) else v for v in (text, size))
    n = lambda p: F.length(F.regexp_replace(t, p, ""))
    narrow, wide = n(r"[^ .,;:!'|ijl]"), n(r"[^0-9A-Z]")
    return s * (narrow * 0.33 + wide * 0.55 + (F.length(t) - narrow - wide) * 0.5)


def lines(atoms: DataFrame) -> DataFrame:
    """doc_id, page, line (from 0), y, font_size, text.

    Atoms go down the page; one joins the line whose first atom is within half the median font size.
    """
    page = Window.partitionBy(*PAGE)
    eps = F.greatest(positive_median("font_size").over(page) * 0.5, F.lit(0.5))
    a = atoms.withColumn("_eps", eps).withColumn("_neg", -F.col("y"))
    item = F.struct("_neg", "x", (-F.col("font_size")).alias("_f"), "seq", "text", "y", "font_size", "_eps")
    ordered = a.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("_a"))
    start = F.struct(F.array().cast("array<int>").alias("no"), F.lit(-1).alias("cur"), F.lit(None).cast("double").alias("at"))

    def step(acc, x):
        new = acc["at"].isNull() | (F.abs(x["y"] - acc["at"]) > x["_eps"])
        cur = F.when(new, acc["cur"] + 1).otherwise(acc["cur"])
        return F.struct(F.array_append(acc["no"], cur).alias("no"), cur.alias("cur"), F.when(new, x["y"].cast("double")).otherwise(acc["at"]).alias("at"))

    numbered = ordered.select(*PAGE, F.explode(F.arrays_zip(F.aggregate("_a", start, step, lambda z: z["no"]).alias("line"), F.col("_a").alias("a"))).alias("_z"))
    numbered = numbered.select(*PAGE, F.col("_z.line").alias("line"), "_z.a.*")
    w = Window.partitionBy(*PAGE, "line").orderBy("x", "seq")
    before = F.lag("text").over(w)
    gap = F.col("x") - F.lag(F.col("x") + advance("text", "font_size")).over(w)
    letters = F.rlike(before, F.lit(r"[\p{L}\p{N}]$")) & F.rlike("text", F.lit(r"^[\p{L}\p{N}]"))
    space = F.when(before.isNull(), "").when(gap > F.col("font_size") * F.when(letters, 1.4).otherwise(0.65), " ").otherwise("")
    glued = numbered.withColumn("_t", F.concat(space, "text"))
    parts = F.array_sort(F.collect_list(F.struct("x", "seq", "_t")))
    return glued.groupBy(*PAGE, "line").agg(
        F.max("y").alias("y"), F.max("font_size").alias("font_size"), F.array_join(F.transform(parts, lambda p: p["_t"]), "").alias("text")
    )


def gap_groups(rows: DataFrame, keys, order, position: Column, limit: Column, name: str = "paragraph") -> DataFrame:
    """Adds ``name`` (from 1): a new group where the position moves on by more than ``limit``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((F.abs(position - F.lag(position).over(w)) > limit).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w) + 1).drop("_new")


def paragraphs(page_lines: DataFrame) -> DataFrame:
    """Lines -> doc_id, page, paragraph, y_top, font_size, line_count, text."""
    limit = F.greatest(positive_median("font_size").over(Window.partitionBy(*PAGE)) * 1.5, F.lit(6.0))
    limited = page_lines.withColumn("_limit", limit)
    grouped = gap_groups(limited, PAGE, [F.desc("y"), "line"], F.col("y"), F.col("_limit"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("_n"), "line", "text")))
    return grouped.groupBy(*PAGE, "paragraph").agg(
        F.max("y").alias("y_top"), F.max("font_size").alias("font_size"), F.count(F.lit(1)).alias("line_count"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"),
    )


def body_size(blocks: DataFrame) -> DataFrame:
    """Adds body_size: the median size below the top 35 % of the page, else of the page."""
    page = Window.partitionBy(*PAGE)
    top, low = F.max("y_top").over(page), F.min("y_top").over(page)
    below = F.when(F.col("y_top") <= top - (top - low) * 0.35, F.col("font_size"))
    marked = blocks.withColumns({"_below": below, "_top": top, "_span": top - low})
    middle = F.median(F.when(F.col("_below") > 0, F.col("_below"))).over(page)
    return marked.withColumn("body_size", F.coalesce(middle, positive_median("font_size").over(page)))


def prefix_while(rows: DataFrame, keys, order, flag: Column) -> DataFrame:
    """Rows before the first one whose flag does not hold."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_on", F.min(F.coalesce(flag, F.lit(False)).cast("int")).over(w)).where("_on = 1").drop("_on")


def cover_title(blocks: DataFrame) -> DataFrame:
    """First page: the leading large paragraphs of the top 35 %, at most twenty."""
    first = body_size(blocks.where("page = 1"))
    big = F.col("font_size") >= F.greatest(F.max("font_size").over(Window.partitionBy(*PAGE)) * 0.65, F.col("body_size") * 1.35)
    marked = first.withColumn("_big", big & (F.col("y_top") >= F.col("_top") - F.col("_span") * 0.35))
    return prefix_while(marked, PAGE, ["paragraph"], F.col("_big")).where("paragraph <= 20")


def classify(blocks: DataFrame) -> DataFrame:
    """Adds block_type (list, heading, paragraph) and level, by size, place and words."""
    b = body_size(blocks)
    ratio = F.col("font_size") / F.col("body_size")
    near_top = F.col("y_top") >= F.col("_top") - F.col("_span") * 0.55
    sentence = F.rlike("text", F.lit(r"[.!?]\s+\p{Lu}|\.$"))
    heading = ((ratio >= 1.3) & (F.length("text") <= 120)) | (
        near_top & (F.length("text") <= 180) & (F.col("line_count") <= 4) & ~sentence & ((ratio >= 1.12) | ((ratio >= 0.98) & looks_like_heading("text")))
    )
    items = F.transform(F.split("text", "\n"), list_item)
    kind = F.when(F.forall(items, lambda x: x.isNotNull()), "list").when(heading, "heading").otherwise("paragraph")
    level = F.when((F.col("page") == 1) & (ratio < 1.3), 2).otherwise(heading_level(ratio))
    return b.withColumn("block_type", kind).withColumn("level", F.when(F.col("block_type") == "heading", level)).drop("_below", "_top", "_span")


def merge_headings(blocks: DataFrame) -> DataFrame:
    """Adds merged: adjacent headings of one level and of sizes within a fifth share a number."""
    w = Window.partitionBy(*PAGE).orderBy("paragraph")
    same = (
        (F.col("block_type") == "heading") & (F.lag("block_type").over(w) == "heading") & (F.lag("level").over(w) == F.col("level"))
        & (F.abs(F.col("font_size") - F.lag("font_size").over(w)) <= F.col("font_size") * 0.2)
        & (F.length("text") + F.length(F.lag("text").over(w)) <= 160)
    )
    return blocks.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("merged", F.sum("_new").over(w)).drop("_new")
