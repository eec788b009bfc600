"""Running sums and row numbers of groups that may hold a third of all rows.

A window by group sorts a whole group in one task. Here rows are dealt out in ranges of (group, order), so a large
group lies in many slices; a window runs inside a slice, and only the slices' sums, at most a row a group and a
row a slice, are added up across slices. The slices are stored, so a lost task finds each row in the slice it had.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.session import stored


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, total: str | None = None, weight: str | Column | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` (a whole number; 1 if none) over the rows of a group up to this one.

    ``total`` names a column for the sum of the whole group. Null keys are a group. Rows that are equal in all of
    ``order`` go in any order, and all of them lie in one slice, so ``order`` should tell rows apart.
    """
    one = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    sized = rows.withColumn("_weight", one.cast("long"))
    slices = stored(sized.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    group = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    sums = slices.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s")).agg(F.sum("_weight").alias("_sum"))
    before = F.sum("_sum").over(group.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumns({"_before": F.coalesce(before, F.lit(0)), "_total": F.sum("_sum").over(group)}).drop("_sum")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = slices.withColumn("_inside", F.sum("_weight").over(inside))
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_slice") == F.col("_s"))
    out = summed.join(sums, same)
    added = {name: F.col("_inside") + F.col("_before")} | ({total: F.col("_total")} if total else {})
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c not in added], *[c.alias(n) for n, c in added.items()])


def medians(rows: DataFrame, keys: Sequence[str], values: dict[str, Column], default: float = 12.0) -> DataFrame:
    """keys, and for each of ``values`` the median of its positive finite values, ``default`` if there are none.

    Equal values are counted before they move. The middle two of an even number are averaged.
    """
    fit = lambda v: F.when((v > 0) & ~F.isnan(v) & (v < float("inf")), v)
    each = F.array(*[F.struct(F.lit(n).alias("_of"), fit(v.cast("double")).alias("_v")) for n, v in values.items()])
    counted = rows.select(*keys, F.explode(each).alias("_e")).groupBy(*keys, "_e._of", "_e._v").agg(F.count("_e._v").alias("_n"))
    run = running(counted, [*keys, "_of"], ["_v"], "_upto", "_all", "_n")
    covers = lambda place: (F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place)
    lower, upper = covers(F.floor((F.col("_all") + 1) / 2)), covers(F.floor(F.col("_all") / 2) + 1)
    middle = lambda n: [F.max(F.when((F.col("_of") == n) & at, F.col("_v"))) for at in (lower, upper)]
    return run.groupBy(*keys).agg(*[F.coalesce((a + b) / 2, F.lit(default)).alias(n) for n in values for a, b in [middle(n)]])
