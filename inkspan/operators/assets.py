"""Images of documents: one copy of equal bytes, and file names that do not collide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import base_name, image_id, safe_file_name, type_extension
from inkspan.operators.numbering import running


def first_copies(images: DataFrame, keys, order, data: str = "bytes") -> DataFrame:
    """The first image of each content; adds image_id. Spark keeps one of each content in a task before it moves."""
    w = Window.partitionBy(*keys, "image_id").orderBy(*order)
    return images.withColumn("image_id", image_id(data)).withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def asset_names(images: DataFrame, keys, order) -> DataFrame:
    """Adds asset_name: the safe base name, else image_<no>_<hash>.<ext>; a name's later uses get a number before it."""
    numbered = running(images, keys, order, "image_no")
    four = lambda n: F.when(n > 9999, n.cast("string")).otherwise(F.lpad(n.cast("string"), 4, "0"))
    own = base_name(F.coalesce("filename", F.lit("")))
    made = F.concat(F.lit("image_"), four(F.col("image_no")), F.lit("_"), F.substring(F.regexp_replace("image_id", "^sha256:", ""), 1, 12), F.lit("."), type_extension("content_type"))
    named = numbered.withColumn("_name", F.when(own == "", made).otherwise(safe_file_name(own)))
    # The first use of a name is its least number, which every task finds among its own rows before they move.
    firsts = named.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_name").alias("_own")).agg(F.min("image_no").alias("_first"))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    used = named.join(firsts, reduce(lambda a, b: a & b, same, F.col("_name") == F.col("_own")))
    name = F.when(F.col("image_no") == F.col("_first"), F.col("_name")).otherwise(F.concat(four(F.col("image_no")), F.lit("_"), "_name"))
    return used.select(*[F.col(f"`{c}`") for c in numbered.columns], name.alias("asset_name"))
