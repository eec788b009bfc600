"""Connected components of a link table, by hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import shared_table


def jump(parents: DataFrame) -> DataFrame:
    """(id, root): follow parents to their roots; every round doubles the steps."""
    while True:
        up = parents.select(F.col("id").alias("root"), F.col("root").alias("_up"))
        step = parents.join(up, "root", "left").select("id", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved"))
        step = shared_table(step, "jumps")
        parents = step.select("id", "root")
        if step.where("_moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> id, root: the least id of each linked id's component, without the roots' own rows.

    A node hooks to its least neighbour if that is smaller; what remains between roots is contracted and
    hooked again, until no link is left. All state is in the shared folder, as tables whose size Spark knows,
    so that small ones move in no shuffle; the driver only asks whether rows are left.
    """
    links = shared_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not links.isEmpty():
        hooked = jump(shared_table(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")), "hooked"))
        if roots is None:
            roots = hooked
        else:
            new = hooked.select(F.col("id").alias("root"), F.col("root").alias("_new"))
            moved = roots.join(new, "root", "left").select("id", F.coalesce("_new", "root").alias("root"))
            roots = shared_table(moved.unionByName(hooked.join(roots.select("id"), "id", "left_anti")), "roots")
        ra = hooked.select(F.col("id").alias("a"), F.col("root").alias("_ra"))
        rb = hooked.select(F.col("id").alias("b"), F.col("root").alias("_rb"))
        over = links.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("_ra", "a").alias("x"), F.coalesce("_rb", "b").alias("y"))
        links = shared_table(over.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
    return roots if roots is not None else links.select(F.col("a").alias("id"), F.col("b").alias("root"))
