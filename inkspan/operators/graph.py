"""Diagrams: nodes (doc_id, slide, ord, node_id, label, shape, x, y, w, h) and edges between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import mermaid_label
from inkspan.session import stored

RADIUS = 120.0
#: Places that the smallest cells of a search for the nearest node hold at most, and how often a radius is halved for that.
CROWD, MOST_HALVINGS = 32, 24
ARROWS = {"none": "---", "forward": "-->", "backward": "<--", "both": "<-->"}
REASON_WEIGHTS = {"connectors": 0.95, "chart": 0.9, "smartart": 0.9, "groups": 0.8}
OTHER_WEIGHT = 0.7


def _cell(value: str, side: Column) -> Column:
    return F.floor(F.col(value) / side)


def _halvings(places: DataFrame, keys: Sequence[str], radius: float) -> int:
    """How often the radius is halved until no cell of that side holds more than CROWD places."""
    tried = places.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in range(0, MOST_HALVINGS + 1, 2)])))
    side = F.lit(radius) / F.pow(F.lit(2.0), F.col("_level"))
    held = tried.groupBy(*keys, "_level", _cell("cx", side).alias("_gx"), _cell("cy", side).alias("_gy")).agg(F.count(F.lit(1)).alias("_n"))
    most = {r["_level"]: r["_m"] for r in held.groupBy("_level").agg(F.max("_n").alias("_m")).collect()}
    return min((x for x, n in most.items() if n <= CROWD), default=MOST_HALVINGS if most else 0)


def snap(points: DataFrame, nodes: DataFrame, keys: Sequence[str], point: str, radius: float = RADIUS, others: bool = False) -> DataFrame:
    """Each point's nearest node within ``radius`` (inclusive), the first in order on ties.

    points: keys, point id, x, y. nodes: keys, ord, node_id, cx, cy. With ``others``, points are nodes themselves
    and do not snap to their own id.

    Nodes at one place are one row. An equi-join on keys and grid cell lets a point meet the nodes of nine cells,
    which hold all within a cell's side. Crowded nodes have small cells first: what finds a node within the side is
    done, and the others look again in cells twice as wide, up to the radius. A point that is still looking has no
    node within half the side, so it meets few.
    """
    keys = list(keys)
    finite = lambda x, y: (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    ids = nodes.where(finite("cx", "cy"))
    place = [*keys, "cx", "cy"]
    if others:
        # The second at a place is for the point that is the first.
        ids = ids.groupBy(*place, "node_id").agg(F.min("ord").alias("ord"))
        ids = ids.withColumn("_i", F.row_number().over(Window.partitionBy(*place).orderBy("ord", "node_id"))).where("_i <= 2")
        at = lambda i: F.min(F.when(F.col("_i") == i, F.struct("ord", "node_id")))
        places = ids.groupBy(*place).agg(at(1).alias("_first"), at(2).alias("_second"))
        node = F.when(F.col("_first.node_id") == F.col(point), F.col("_second")).otherwise(F.col("_first"))
    else:
        places = ids.groupBy(*place).agg(F.min(F.struct("ord", "node_id")).alias("_first"))
        node = F.col("_first")
    places = stored(places, "places")
    rest = points.where(finite("x", "y") & F.col(point).isNotNull()).select(*keys, point, "x", "y")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    out = None
    for level in range(_halvings(places, keys, float(radius)), -1, -1):
        reach = float(radius) / 2**level
        side = F.lit(reach * (1 + 1e-9))  # so that rounding puts no node within reach beyond the next cell
        p = rest.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
        p = p.withColumns({"_gx": _cell("x", side) + F.col("_dx"), "_gy": _cell("y", side) + F.col("_dy")}).drop("_dx", "_dy")
        met = p.join(places.withColumns({"_gx": _cell("cx", side), "_gy": _cell("cy", side)}), [*keys, "_gx", "_gy"])
        met = met.withColumns({"distance": F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), "_node": node}).where((F.col("distance") <= reach) & F.col("_node").isNotNull())
        best = F.min(F.struct("distance", "_node.ord", "_node.node_id")).alias("_b")
        found = met.groupBy(*keys, point).agg(best).select(*keys, point, "_b.node_id", "_b.distance")
        if level:
            found = stored(found, "snapped")
            rest = stored(rest.join(found.select(*keys, point), [*keys, point], "left_anti"), "unsnapped")
        out = found if out is None else out.unionByName(found)
    return out


def join_ends(edges: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges whose two shape ids are nodes: adds from_label and to_label; self-loops go."""
    a = nodes.select(*keys, F.col("node_id").alias("from_id"), F.col("label").alias("from_label"))
    b = nodes.select(*keys, F.col("node_id").alias("to_id"), F.col("label").alias("to_label"))
    return edges.where("from_id <> to_id").join(a, [*keys, "from_id"]).join(b, [*keys, "to_id"])


def unattached(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes that no edge touches."""
    used = edges.select(*keys, F.col("from_id").alias("node_id")).unionByName(edges.select(*keys, F.col("to_id").alias("node_id")))
    return nodes.join(used, [*keys, "node_id"], "left_anti")


def arrow(direction: Column) -> Column:
    out = F.lit("---")
    for name, text in ARROWS.items():
        out = F.when(direction == name, text).otherwise(out)
    return out


def mermaid(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], most: int | None = 240, head: str = "flowchart TD") -> DataFrame:
    """keys, mermaid: nodes that edges use, by id, then the edges by (from, to, label)."""
    used = edges.select(*keys, F.col("from_id").alias("node_id")).unionByName(edges.select(*keys, F.col("to_id").alias("node_id"))).distinct()
    node = F.concat(F.lit("n"), F.col("node_id").cast("string"), F.lit("@{ shape: "), F.coalesce("shape", F.lit("rect")), F.lit(', label: "'), mermaid_label("label", most), F.lit('" }'))
    node_lines = nodes.join(used, [*keys, "node_id"], "left_semi").select(*keys, F.lit(0).alias("_k"), F.col("node_id").alias("_a"), F.lit(0).cast("bigint").alias("_b"), F.lit("").alias("_c"), node.alias("_line"))
    label = F.coalesce("label", F.lit(""))
    edge = F.concat(F.lit("n"), F.col("from_id").cast("string"), F.lit(" "), arrow(F.col("direction")), F.when(label == "", "").otherwise(F.concat(F.lit("|"), mermaid_label(label, most), F.lit("|"))), F.lit(" n"), F.col("to_id").cast("string"))
    edge_lines = edges.select(*keys, F.lit(1).alias("_k"), F.col("from_id").alias("_a"), F.col("to_id").cast("bigint").alias("_b"), label.alias("_c"), edge.alias("_line"))
    listed = node_lines.unionByName(edge_lines).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", "_a", "_b", "_c", "_line"))).alias("_l"))
    return listed.select(*keys, F.concat(F.lit(f"{head}\n"), F.array_join(F.transform("_l", lambda x: F.concat(F.lit("  "), x["_line"])), "\n")).alias("mermaid"))


def slide_scores(reasons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, reason) -> keys, score (the greatest weight) and reasons (sorted, distinct)."""
    weight = F.lit(OTHER_WEIGHT)
    for name, w in REASON_WEIGHTS.items():
        weight = F.when(F.col("reason") == name, w).otherwise(weight)
    return reasons.groupBy(*keys).agg(F.max(weight).alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def chart_table(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, series_no, series, cat_idx, category, value) -> keys, series_no, series, cells in category order."""
    from inkspan.functions.text import number_text

    cells = F.array_sort(F.collect_list(F.struct("cat_idx", number_text("value").alias("v"))))
    return points.groupBy(*keys, "series_no", "series").agg(F.transform(cells, lambda s: s["v"]).alias("cells"))


def first_match_range(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, low: str, high: str, ident: str, width: int = 64) -> DataFrame:
    """Left join of each point with the least range that holds it; bounds are inclusive.

    Ranges are posted in buckets as wide as they are: of ``width`` times the power of two that reaches their
    length, so each touches at most two, and points look once at each width in use (a few dozen at most, asked
    for first). So this is an equi-join on keys, width and bucket. Equal points stay rows of their own.
    """
    span = F.greatest(F.col(high) - F.col(low) + 1, F.lit(1))
    level = F.greatest(F.ceil(F.log2(span / F.lit(float(width)))), F.lit(0)).cast("int")
    r = ranges.where(F.col(low) <= F.col(high)).select(*keys, low, high, ident).withColumn("_level", level)
    levels = sorted(x["_level"] for x in r.select("_level").distinct().collect()) or [0]
    bucket = lambda v: F.floor(F.col(v) / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))))
    r = r.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(low), bucket(high)))))
    p = points.withColumn("_row", F.monotonically_increasing_id()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels])))
    met = p.withColumn("_bucket", bucket(at)).join(r, [*keys, "_level", "_bucket"], "left")
    met = met.withColumn(ident, F.when(F.col(at).between(F.col(low), F.col(high)), F.col(ident)))
    return met.groupBy("_row", *points.columns).agg(F.min(ident).alias(ident)).drop("_row")


def rectangles_free_of(boxes: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boxes (r0, r1, c0, c1; inclusive) that no taken box of the same keys overlaps."""
    t = taken.select(*[F.col(k).alias(f"_t_{k}") for k in keys], *[F.col(x).alias(f"_t_{x}") for x in ("r0", "r1", "c0", "c1")])
    on = [F.col(k) == F.col(f"_t_{k}") for k in keys]
    on += [F.col("r0") <= F.col("_t_r1"), F.col("_t_r0") <= F.col("r1"), F.col("c0") <= F.col("_t_c1"), F.col("_t_c0") <= F.col("c1")]
    return boxes.join(t, on, "left_anti")


def ranked(rows: DataFrame, keys: Sequence[str], order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
