"""Configuration documents: JSON text to pairs and tables with Catalyst's own JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_COLUMNS = 20


def scalar_pairs(rows: DataFrame, keys, column: str) -> DataFrame:
    """A flat object's members: keys, ord, key, value (text)."""
    names = F.json_object_keys(column)
    values = F.from_json(column, "map<string,string>")
    pair = F.transform(names, lambda k: F.struct(k.alias("key"), F.try_element_at(values, k).alias("value")))
    return rows.select(*keys, F.posexplode(pair).alias("ord", "_p")).select(*keys, "ord", "_p.key", "_p.value")


def objects_to_table(rows: DataFrame, keys, column: str) -> DataFrame:
    """An array of flat objects as table rows: a # column, then the keys in the order first seen.

    Objects with more than MOST_COLUMNS keys between them make no table.
    """
    objects = rows.select(*keys, F.posexplode(F.from_json(column, "array<string>")).alias("i", "_o"))
    pairs = scalar_pairs(objects, [*keys, "i"], "_o")
    first = pairs.groupBy(*keys, "key").agg(F.min(F.struct("i", "ord")).alias("_at"))
    columns = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "key"))), lambda x: x["key"]).alias("columns"))
    columns = columns.where(F.size("columns") <= MOST_COLUMNS)
    maps = pairs.groupBy(*keys, "i").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_m"))
    line = F.concat(F.array((F.col("i") + 1).cast("string")), F.transform("columns", lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(""))))
    body = maps.join(columns, list(keys)).groupBy(*keys, "columns").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))), lambda x: x["l"]).alias("_b"))
    return body.select(*keys, F.concat(F.array(F.concat(F.array(F.lit("#")), "columns")), "_b").alias("rows"))


def one_line(value: str):
    """How a scalar is shown: null, "" for blank, JSON for several lines, else trimmed."""
    v = F.col(value)
    return (
        F.when(v.isNull(), "null").when(F.trim(v) == "", '""')
        .when(F.rlike(v, F.lit(r"[\r\n]")), F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'^\{"v":(.*)\}$', 1)).otherwise(F.trim(v))
    )


def numbered(rows: DataFrame, keys, order) -> DataFrame:
    return rows.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
