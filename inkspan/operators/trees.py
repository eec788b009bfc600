"""Trees as rows: (doc_id, node_id, parent_id, ord, title)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.session import stored


def flatten(nodes: DataFrame, most: int = 255) -> DataFrame:
    """Adds depth (root 0, ``most`` for all that lie deeper) and path, whose order is the tree's pre-order.

    One join a level; each level is stored, so none is computed twice.
    """
    root = nodes.where(F.col("parent_id").isNull()).select("*", F.lit(0).alias("depth"), F.array(F.col("ord").cast("int")).alias("path"))
    found = level = stored(root, "level")
    depth = 0
    while True:
        depth += 1
        up = level.select("doc_id", F.col("node_id").alias("parent_id"), F.col("path").alias("_up"))
        level = nodes.join(up, ["doc_id", "parent_id"]).select(
            *nodes.columns, F.lit(min(depth, most)).alias("depth"), F.array_append("_up", F.col("ord").cast("int")).alias("path")
        )
        level = stored(level, "level")
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def tree_stats(flat: DataFrame) -> DataFrame:
    return flat.groupBy("doc_id").agg(F.count(F.lit(1)).alias("node_count"), F.max("depth").alias("max_depth"))


def nested_json(flat: DataFrame) -> DataFrame:
    """What flatten gives -> doc_id, node_id, json of each root: {"title": ..., "children": [...]}, a null title as null.

    Children's texts are folded into their parents level by level from the deepest; a level is stored, and only
    the one below it is read with it. Children go by ord, then node_id. A node_id stands for one node of its doc_id.
    """
    nodes = stored(flat.select("doc_id", "node_id", "parent_id", "ord", "title", F.size("path").alias("_level")), "nodes")
    title = F.to_json(F.struct("title"), {"ignoreNullFields": "false"})
    below = made = None
    for level in range(nodes.agg(F.coalesce(F.max("_level"), F.lit(1))).first()[0], 0, -1):
        own = nodes.where(F.col("_level") == level)
        own = own.withColumn("_inner", F.lit("")) if below is None else own.join(below, ["doc_id", "node_id"], "left")
        text = F.concat(F.substring(title, F.lit(1), F.length(title) - 1), F.lit(',"children":['), F.coalesce("_inner", F.lit("")), F.lit("]}"))
        made = stored(own.select("doc_id", "node_id", "parent_id", "ord", text.alias("json")), "json")
        listed = F.array_sort(F.collect_list(F.struct("ord", "node_id", "json")))
        below = made.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(listed, lambda x: x["json"]), ",").alias("_inner"))
    return made.select("doc_id", "node_id", "json")


def tree_blocks(flat: DataFrame) -> DataFrame:
    """The root as a heading, the rest as one unordered list."""
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "Untitled").otherwise(F.trim("title"))
    item = F.struct("path", F.struct((F.col("depth") - 1).cast("smallint").alias("level"), title.alias("text")).alias("i"))
    items = flat.where("depth > 0").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"]).alias("items"))
    heads = flat.where("depth = 0").select("doc_id", F.lit(0).cast("bigint").alias("block_index"), F.lit("heading").alias("block_type"), F.lit(1).cast("smallint").alias("level"), title.alias("text"))
    return heads.unionByName(
        items.select("doc_id", F.lit(1).cast("bigint").alias("block_index"), F.lit("list").alias("block_type"), F.lit(False).alias("ordered"), "items"), allowMissingColumns=True
    )
