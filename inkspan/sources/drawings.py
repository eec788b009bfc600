"""Drawings inside documents: shapes, connectors and chart parts as rows, and the diagrams and tables they become.

Shapes lie in groups inside groups, each of which moves and scales what it holds. A shape's box in the drawing is its own
box sent through the transforms of its groups, innermost first. Connectors that name two shapes join on their ids;
loose lines snap to the nearest shape (inkspan.operators.graph).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.numbers import emu_to_pixels, length_to_pixels
from inkspan.functions.text import trim_ws, unit_of_format, with_unit
from inkspan.operators import graph
from inkspan.session import stored
from inkspan.sources.files import ancestor, attr, under

SHAPES, GROUPS = ("sp", "wsp", "cxnSp", "pic"), ("grpSp", "wgp", "wpc")
# Preset geometries and OpenDocument shape types with a Mermaid shape of their own; all others are rect.
PRESETS = {
    "roundRect": "rounded", "flowChartTerminator": "rounded", "ellipse": "circle", "diamond": "diamond", "flowChartDecision": "diamond", "hexagon": "hex", "can": "cyl",
    "parallelogram": "lean-r", "trapezoid": "trap-b", "triangle": "tri", "rtTriangle": "tri", "ltTriangle": "tri", "upTriangle": "tri", "downTriangle": "tri",
    "flowChartPredefinedProcess": "subproc",
}
ODF_TYPES = {
    "round-rectangle": "rounded", "roundrect": "rounded", "ellipse": "circle", "circle": "circle", "diamond": "diamond", "hexagon": "hex", "parallelogram": "lean-r",
    "trapezoid": "trap-b", "triangle": "tri", "isosceles-triangle": "tri", "right-triangle": "tri", "cylinder": "cyl",
}


def mapped(name: Column, values: dict[str, str], other: str = "rect") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), trim_ws(name)), F.lit(other))


def first_of(cond: Column, value: Column) -> Column:
    """The first value in document order among the rows that meet the condition."""
    return F.min(F.when(cond & value.isNotNull(), F.struct("pre", value.alias("v"))))["v"]


def group_transforms(told: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _g, sx, sy, tx, ty: a child's x becomes x * sx + tx outside the group."""
    ratio = lambda a, b: F.when(F.col(a).isNull() | F.col(b).isNull() | (F.col(b) == 0), 1.0).otherwise(F.col(a) / F.col(b))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scaled = told.withColumns({"sx": ratio("w", "inner_w"), "sy": ratio("h", "inner_h")})
    return scaled.select(*keys, F.col("_o").alias("_g"), "sx", "sy", (zero("x") - zero("inner_x") * F.col("sx")).alias("tx"), (zero("y") - zero("inner_y") * F.col("sy")).alias("ty"))


def ooxml_shapes(nodes: DataFrame, keys: Sequence[str], any_end: bool = False) -> DataFrame:
    """keys, pre, tag, node_id, preset, x, y, w, h (pixels in the drawing), from_id, to_id, head, tail, rid, alt, grouped.

    With ``any_end`` a line end counts whatever its type.
    """
    owner = ancestor(*SHAPES, *GROUPS)
    number = lambda n: attr(n).try_cast("double")
    is_ = lambda t: F.col("tag") == t
    marked = lambda t: F.max((is_(t) & (F.lit(any_end) | ~F.lower(trim_ws(F.coalesce(attr("type"), F.lit("")))).isin("", "none"))).cast("int")) == 1
    parts = nodes.where(F.col("tag").isin("cNvPr", "off", "ext", "chOff", "chExt", "prstGeom", "stCxn", "endCxn", "headEnd", "tailEnd", "blip"))
    told = parts.withColumn("_o", owner).where("_o is not null").groupBy(*keys, "_o").agg(
        first_of(is_("cNvPr"), attr("id").try_cast("bigint")).alias("node_id"), first_of(is_("cNvPr"), attr("descr")).alias("alt"), first_of(is_("prstGeom"), attr("prst")).alias("preset"),
        first_of(is_("off"), number("x")).alias("x"), first_of(is_("off"), number("y")).alias("y"), first_of(is_("ext"), number("cx")).alias("w"), first_of(is_("ext"), number("cy")).alias("h"),
        first_of(is_("chOff"), number("x")).alias("inner_x"), first_of(is_("chOff"), number("y")).alias("inner_y"), first_of(is_("chExt"), number("cx")).alias("inner_w"), first_of(is_("chExt"), number("cy")).alias("inner_h"),
        first_of(is_("stCxn"), attr("id").try_cast("bigint")).alias("from_id"), first_of(is_("endCxn"), attr("id").try_cast("bigint")).alias("to_id"),
        marked("headEnd").alias("head"), marked("tailEnd").alias("tail"), first_of(is_("blip"), attr("embed")).alias("rid"),
    )
    groups = F.transform(F.filter("path", lambda p: p["tag"].isin(*GROUPS)), lambda p: p["pre"])
    shapes = nodes.where(F.col("tag").isin(*SHAPES)).select(*keys, "pre", "tag", groups.alias("_groups"))
    shapes = shapes.join(told.withColumnRenamed("_o", "pre"), [*keys, "pre"], "left").withColumn("grouped", F.size("_groups") > 0)
    # Innermost group first.
    inside = shapes.select(*keys, "pre", F.posexplode("_groups").alias("_depth", "_g")).join(group_transforms(told, keys), [*keys, "_g"])
    step = F.struct((-F.col("_depth")).alias("o"), "sx", "sy", "tx", "ty")
    chain = inside.groupBy(*keys, "pre").agg(F.array_sort(F.collect_list(step)).alias("_chain"))
    shapes = shapes.join(chain, [*keys, "pre"], "left")
    box = F.struct("x", "y", "w", "h")
    through = lambda b, g: F.struct((b["x"] * g["sx"] + g["tx"]).alias("x"), (b["y"] * g["sy"] + g["ty"]).alias("y"), (b["w"] * g["sx"]).alias("w"), (b["h"] * g["sy"]).alias("h"))
    shapes = shapes.withColumn("_box", F.aggregate(F.coalesce("_chain", F.array().cast("array<struct<o:int,sx:double,sy:double,tx:double,ty:double>>")), box, through))
    pixels = [emu_to_pixels(F.col(f"_box.{c}")).alias(c) for c in "xywh"]
    return shapes.select(*keys, "pre", "tag", "node_id", "preset", *pixels, "from_id", "to_id", F.coalesce("head", F.lit(False)).alias("head"), F.coalesce("tail", F.lit(False)).alias("tail"), "rid", "alt", "grouped")


def shape_texts(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pre (of the shape), lines (its paragraphs, a line each), words (its runs, between spaces)."""
    shape = ancestor(*SHAPES)
    runs = nodes.where((F.col("tag") == "#text") & under("t") & under(*SHAPES)).select(*keys, shape.alias("_s"), F.coalesce(ancestor("p"), F.lit(-1)).alias("_p"), F.col("pre").alias("_at"), "text")
    joined = lambda value, order, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda z: z["v"]), sep)
    paras = runs.groupBy(*keys, "_s", "_p").agg(trim_ws(joined(F.col("text"), "_at", "")).alias("line"), joined(trim_ws("text"), "_at", " ").alias("words")).where("line <> ''")
    return paras.groupBy(*keys, F.col("_s").alias("pre")).agg(joined(F.col("line"), "_p", "\n").alias("lines"), joined(trim_ws("words"), "_p", " ").alias("words"))


def snapped(lines: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines (keys, pre, x1, y1, x2, y2, ...) with start_id and end_id: the nodes nearest to their ends, or null."""
    centres = nodes.select(*keys, "ord", "node_id", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    end = lambda a, b, name: graph.snap(lines.select(*keys, F.col("pre").alias("_line"), F.col(a).alias("x"), F.col(b).alias("y")), centres, keys, "_line").select(
        *keys, F.col("_line").alias("pre"), F.col("node_id").alias(name)
    )
    return lines.join(end("x1", "y1", "start_id"), [*keys, "pre"], "left").join(end("x2", "y2", "end_id"), [*keys, "pre"], "left")


def ooxml_graph(nodes: DataFrame, keys: Sequence[str], pictures: DataFrame | None = None, word: bool = False) -> dict[str, DataFrame]:
    """The diagrams of slides, or with ``word`` of a text's drawings, by ``keys``.

    nodes: keys, ord, node_id, label, kind, shape, x, y, w, h. edges: keys, from_id, to_id, label, direction; an end may be
    missing. connectors: keys, connectors. pictures: keys' entry, rid -> image_id, filename. On slides a line counts
    if it has an arrow, and edges point forward; in texts only connectors make a diagram, and lines keep their arrow.
    """
    # Shapes, nodes and edges are each used many times over; stored, they keep the plans behind them small.
    shapes = stored(ooxml_shapes(nodes, keys, any_end=word).join(shape_texts(nodes, keys), [*keys, "pre"], "left"), "shapes")
    known = shapes.where("node_id is not null and x is not null and y is not null and w is not null and h is not null")
    texts = known.where(F.col("tag").isin("sp", "wsp") & F.col("lines").isNotNull())
    texts = texts.where(F.coalesce("preset", F.lit("")) != "line") if word else texts
    label = F.col("words") if word else F.col("lines")
    place = ["x", "y", "w", "h"]
    found = texts.select(*keys, F.col("pre").alias("ord"), "node_id", label.alias("label"), F.lit("text").alias("kind"), mapped(F.col("preset"), PRESETS).alias("shape"), *place, F.lit(None).cast("string").alias("image_id"))
    if pictures is not None:
        pics = known.where("tag = 'pic'").join(pictures, ["doc_id", "entry", "rid"])
        name = F.coalesce(F.when(trim_ws("alt") != "", trim_ws("alt")), "filename", F.lit("image"))
        found = found.unionByName(pics.select(*keys, F.col("pre").alias("ord"), "node_id", name.alias("label"), F.lit("image").alias("kind"), F.lit("rect").alias("shape"), *place, "image_id"))
    found = stored(found, "drawn_nodes")
    joins = shapes.where("tag = 'cxnSp'").select(*keys, "pre", "from_id", "to_id", F.col("words").alias("label"), F.lit("forward").alias("direction"))
    arrows = F.when(F.col("head") & F.col("tail"), "both").when(F.col("head"), "forward" if word else "reverse").when(F.col("tail"), "reverse" if word else "forward").otherwise("none")
    drawn = shapes.where("preset = 'line' and tag in ('sp', 'wsp') and x is not null and w is not null").select(
        *keys, "pre", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.col("words").alias("label"), arrows.alias("arrow")
    )
    drawn = drawn if word else drawn.where("arrow <> 'none'")
    loose = snapped(drawn, found, keys).where("start_id is not null and end_id is not null and start_id <> end_id")
    turned = F.col("arrow") == "reverse"
    a, b = F.when(turned, F.col("end_id")).otherwise(F.col("start_id")), F.when(turned, F.col("start_id")).otherwise(F.col("end_id"))
    if word:
        way = F.when(F.col("arrow").isin("none", "both"), F.col("arrow")).otherwise("forward")
        more = loose.select(*keys, a.alias("from_id"), b.alias("to_id"), "label", way.alias("direction"))
    else:
        more = loose.select(*keys, a.alias("from_id"), b.alias("to_id"), "label", F.lit("forward").alias("direction"))
        back = loose.where("arrow = 'both'").select(*keys, F.col("end_id").alias("from_id"), F.col("start_id").alias("to_id"), "label", F.lit("forward").alias("direction"))
        more = more.unionByName(back)
    edges = stored(joins.drop("pre").unionByName(more), "drawn_edges")
    counted = joins.select(*keys) if word else joins.select(*keys).unionByName(drawn.select(*keys))
    return {"nodes": found, "edges": edges, "connectors": counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("connectors")), "shapes": shapes}


def odf_graph(nodes: DataFrame, keys: Sequence[str], styles: DataFrame, pictures: DataFrame) -> dict[str, DataFrame]:
    """As ooxml_graph, for OpenDocument pages: frames and custom shapes with strings as ids, lengths with units.

    styles: doc_id, style, start, end - whether a style draws a marker. Nodes are numbered in document order. An end
    that names no shape takes the one nearest to its place, if the connector has both places.
    """
    shape = ("frame", "custom-shape")
    own = lambda n: length_to_pixels(attr(n))
    titled = F.lower(F.coalesce(attr("class"), F.lit(""))).isin("title", "subtitle")
    frames = nodes.where(F.col("tag").isin(*shape)).select(*keys, "pre", attr("id").alias("odf_id"), own("x").alias("x"), own("y").alias("y"), own("width").alias("w"), own("height").alias("h"), titled.alias("_titled"))
    pieces = nodes.where((F.col("tag") == "#text") & under("p", "h") & (trim_ws("text") != "")).withColumn("_s", ancestor(*shape, "connector", "line")).where("_s is not null")
    spoken = F.array_sort(F.collect_list(F.struct("pre", trim_ws("text").alias("v"))))
    texts = pieces.groupBy(*keys, F.col("_s").alias("pre")).agg(F.array_join(F.transform(spoken, lambda z: z["v"]), " ").alias("label"))
    geometry = nodes.where("tag = 'enhanced-geometry'").groupBy(*keys, ancestor(*shape).alias("pre")).agg(first_of(F.lit(True), attr("type")).alias("_type"))
    held = nodes.where("tag = 'image'").select(*keys, ancestor(*shape).alias("pre"), F.regexp_replace(trim_ws(attr("href")), r"^\./", "").alias("target")).join(pictures.select("doc_id", F.col("entry").alias("target"), "image_id"), ["doc_id", "target"])
    held = held.groupBy(*keys, "pre").agg(F.min("image_id").alias("image_id"))
    full = frames.join(texts, [*keys, "pre"], "left").join(geometry, [*keys, "pre"], "left").join(held, [*keys, "pre"], "left")
    full = full.where("x is not null and y is not null and w is not null and h is not null and (image_id is not null or (label is not null and not _titled))")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("pre")).cast("bigint")
    label = F.when(F.col("image_id").isNotNull(), F.concat(F.lit("office-image:"), "image_id")).otherwise(F.col("label"))
    kind = F.when(F.col("image_id").isNotNull(), "image").otherwise("text")
    found = full.select(*keys, F.col("pre").alias("ord"), number.alias("node_id"), "odf_id", label.alias("label"), kind.alias("kind"), mapped(F.col("_type"), ODF_TYPES).alias("shape"), "x", "y", "w", "h", "image_id")
    found = stored(found, "drawn_nodes")
    there = lambda c: ~F.lower(trim_ws(F.coalesce(attr(c), F.lit("")))).isin("", "none")
    lines = nodes.where(F.col("tag").isin("connector", "line")).select(
        *keys, "pre", attr("start-shape").alias("_from"), attr("end-shape").alias("_to"), *[own(c).alias(c) for c in ("x1", "y1", "x2", "y2")],
        there("marker-start").alias("_start"), there("marker-end").alias("_end"), attr("style-name").alias("style"),
    )
    lines = lines.join(styles, ["doc_id", "style"], "left").join(texts, [*keys, "pre"], "left")
    start, end = F.col("_start") | F.coalesce("start", F.lit(False)), F.col("_end") | F.coalesce("end", F.lit(False))
    way = F.when(start & end, "both").when(end, "forward").when(start, "backward").otherwise("none")
    ids = found.where("odf_id is not null").groupBy(*keys, "odf_id").agg(F.min("node_id").alias("_n"))
    named = lambda c, name: ids.withColumnRenamed("odf_id", c).withColumnRenamed("_n", name)
    lines = lines.withColumn("direction", way).join(named("_from", "from_named"), [*keys, "_from"], "left").join(named("_to", "to_named"), [*keys, "_to"], "left")
    placed = lines.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null and (from_named is null or to_named is null)")
    near = snapped(placed.select(*keys, "pre", "x1", "y1", "x2", "y2"), found, keys).select(*keys, "pre", "start_id", "end_id")
    edges = lines.join(near, [*keys, "pre"], "left").select(*keys, F.coalesce("from_named", "start_id").alias("from_id"), F.coalesce("to_named", "end_id").alias("to_id"), "label", "direction")
    edges = stored(edges.where("from_id is null or to_id is null or from_id <> to_id"), "drawn_edges")
    return {"nodes": found.drop("odf_id"), "edges": edges, "connectors": lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("connectors"))}


def odf_markers(nodes: DataFrame) -> DataFrame:
    """doc_id, style, start, end: styles whose graphic properties draw a marker at an end."""
    there = lambda c: F.max((~F.lower(trim_ws(F.coalesce(attr(c), F.lit("")))).isin("", "none")).cast("int")) == 1
    props = nodes.where("tag = 'graphic-properties'").groupBy("doc_id", "entry", ancestor("style").alias("pre")).agg(there("marker-start").alias("start"), there("marker-end").alias("end"))
    styles = nodes.where("tag = 'style'").select("doc_id", "entry", "pre", attr("name").alias("style")).join(props, ["doc_id", "entry", "pre"])
    return styles.groupBy("doc_id", "style").agg(F.max("start").alias("start"), F.max("end").alias("end"))


def diagrams(found: dict[str, DataFrame], keys: Sequence[str], spelled: bool = True) -> DataFrame:
    """keys, text: a fenced flow chart for each drawing with a connector and an edge between two ends.

    With ``spelled``, ends that are no node of the drawing are named by their id, else they stay bare.
    """
    edges = found["edges"].where("from_id is not null and to_id is not null").join(found["connectors"].select(*keys), list(keys), "left_semi")
    edges = edges.join(found["nodes"].select(*keys).distinct(), list(keys), "left_semi").withColumn("label", trim_ws("label"))
    label = F.when(F.col("kind") == "image", F.concat(F.lit("office-image:"), F.col("image_id"))).otherwise(F.col("label"))
    nodes = found["nodes"].withColumn("label", label).groupBy(*keys, "node_id").agg(F.max(F.struct("ord", "label", "shape")).alias("_n")).select(*keys, "node_id", "_n.label", "_n.shape")
    if spelled:
        used = edges.select(*keys, F.col("from_id").alias("node_id")).unionByName(edges.select(*keys, F.col("to_id").alias("node_id"))).distinct()
        bare = used.join(nodes, [*keys, "node_id"], "left_anti").select(*keys, "node_id", F.concat(F.lit("n"), "node_id").alias("label"), F.lit("rect").alias("shape"))
        nodes = nodes.unionByName(bare)
    made = graph.mermaid(nodes, edges, keys, head="flowchart LR")
    return made.select(*keys, F.concat(F.lit("```mermaid\n"), "mermaid", F.lit("\n```\n")).alias("text"))


def diagram_json(found: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """keys, graph: nodes, edges, nodes that no edge touches and warnings, as JSON."""
    wanted = found["connectors"].select(*keys).join(found["nodes"].select(*keys).distinct(), list(keys), "left_semi")
    edges = found["edges"].join(wanted, list(keys), "left_semi")
    nodes = found["nodes"].join(wanted, list(keys), "left_semi")
    whole = edges.where("from_id is not null and to_id is not null")
    free = graph.unattached(nodes, whole, list(keys)).select(*keys, "ord").withColumn("_free", F.lit(True))
    name = lambda c: F.concat(F.lit("n"), F.col(c))
    node = F.struct("ord", F.struct(name("node_id").alias("id"), F.col("label").alias("text"), "kind", F.struct("x", "y", "w", "h").alias("bbox")).alias("j"))
    listed = nodes.join(free, [*keys, "ord"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(node)).alias("_n"), F.array_sort(F.collect_list(F.when(F.col("_free"), node))).alias("_f"))
    edge = F.when(F.col("from_id").isNotNull() & F.col("to_id").isNotNull(), F.struct("from_id", "to_id", F.coalesce("label", F.lit("")).alias("o"), F.struct(name("from_id").alias("from"), name("to_id").alias("to"), F.lit("connector").alias("kind"), "label").alias("j")))
    missing = F.when(F.col("from_id").isNull() | F.col("to_id").isNull(), F.lit("connector missing endpoint"))
    drawn = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(edge)).alias("_e"), F.collect_list(missing).alias("_w"))
    only = lambda c: F.transform(c, lambda x: x["j"])
    empty = lambda c, like: F.coalesce(only(c), F.filter(only(like), lambda _: F.lit(False)))
    both = listed.join(drawn, list(keys), "left")
    whole = F.struct(only("_n").alias("nodes"), F.coalesce(only("_e"), F.from_json(F.lit("[]"), "array<struct<from:string,to:string,kind:string,label:string>>")).alias("edges"), empty("_f", "_n").alias("unattached_text"), F.coalesce("_w", F.array().cast("array<string>")).alias("warnings"))
    return both.select(*keys, F.to_json(whole, {"ignoreNullFields": "false"}).alias("graph"))


def charts(nodes: DataFrame) -> DataFrame:
    """doc_id, part (the chart's entry), title, chart_type, note, rows (null without categories or series).

    Point caches are sparse: a category or value has an index, and gaps are left out. A chart's columns are all indices in
    use, a row is a series, and what a series does not have is blank. A category is named by the first series
    that names it, a series by its first text outside of categories and values.
    """
    key = ["doc_id", "entry"]
    c = nodes.where(F.rlike("entry", F.lit(r"/charts?/[^/]+\.xml$")))
    parent = F.try_element_at("path", F.lit(-1))["tag"]
    kind = F.regexp_extract("tag", r"^(bar|line|pie|area|scatter|radar|doughnut)Chart$", 1)
    text = F.when((F.col("tag") == "#text") & (trim_ws("text") != ""), trim_ws("text"))
    heads = c.groupBy(*key).agg(
        first_of(kind != "", kind).alias("chart_type"), first_of(under("title") & parent.isin("t", "v"), text).alias("title"), F.max((F.col("tag") == "chartSpace").cast("int")).alias("_chart")
    ).where("_chart = 1")
    order = F.row_number().over(Window.partitionBy(*key).orderBy("pre"))
    series = c.where("tag = 'ser'").select(*key, F.col("pre").alias("_s"), order.alias("series_no"))
    code = F.when((F.col("tag") == "#text") & (parent == "formatCode") & under("val") & under("numCache"), trim_ws("text")).when(F.col("tag") == "numFmt", trim_ws(attr("formatCode")))
    told = c.where(under("ser")).groupBy(*key, ancestor("ser").alias("_s")).agg(
        first_of((parent == "v") & ~under("cat", "val", "title"), text).alias("name"), first_of(code != "", code).alias("code")
    )
    series = series.join(told, [*key, "_s"], "left").withColumn("unit", unit_of_format("code"))
    cache = ancestor("cat", "val")
    points = c.where((F.col("tag") == "pt") & under("ser") & under("cat", "val")).select(*key, ancestor("ser").alias("_s"), under("cat").alias("_cat"), cache.alias("_cache"), F.col("pre").alias("_pt"), attr("idx").try_cast("int").alias("_idx"))
    place = F.row_number().over(Window.partitionBy(*key, "_cache").orderBy("_pt")) - 1
    points = points.withColumn("idx", F.coalesce("_idx", place))
    shown = c.where((F.col("tag") == "#text") & (parent == "v") & under("pt")).groupBy(*key, ancestor("pt").alias("_pt")).agg(first_of(F.lit(True), text).alias("value"))
    series = stored(series, "series")
    points = stored(points.join(shown, [*key, "_pt"]).where("value is not null").join(series.select(*key, "_s", "series_no"), [*key, "_s"]), "points")
    values = points.where(~F.col("_cat")).select(*key, "series_no", "idx", F.col("value").try_cast("double").alias("value")).where("value is not null")
    names = points.where("_cat").groupBy(*key, "idx").agg(F.min_by("value", F.struct("series_no", "_pt")).alias("category"))
    columns = names.select(*key, "idx").unionByName(values.select(*key, "idx")).distinct().join(names.select(*key).distinct(), key, "left_semi")
    cell = lambda x: F.struct(x.alias("text"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"))
    row = lambda first, value: F.concat(F.array(cell(first)), F.transform(F.array_sort(F.collect_list(F.struct("idx", value.alias("v")))), lambda z: cell(z["v"])))
    top = columns.join(names, [*key, "idx"], "left").groupBy(*key).agg(row(F.lit("series"), F.coalesce("category", F.lit(""))).alias("_top"))
    # The grid: each series meets the columns of its own chart.
    grid = series.join(columns, key).join(values, [*key, "series_no", "idx"], "left")
    one = grid.groupBy(*key, "series_no", "name").agg(row(F.coalesce("name", F.lit("series")), F.coalesce(F.when(F.col("value").isNotNull(), with_unit(F.col("value"), F.col("unit"))), F.lit(""))).alias("_row"))
    body = one.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("series_no", "_row"))), lambda z: z["_row"]).alias("_body"))
    pair = F.concat_ws("=", F.coalesce("name", F.concat(F.lit("series"), "series_no")), "unit")
    units = series.where("unit is not null").groupBy(*key).agg(F.array_sort(F.collect_set("unit")).alias("_u"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("series_no", pair.alias("p")))), lambda z: z["p"]), ", ").alias("_pairs"))
    out = heads.join(top, key, "left").join(body, key, "left").join(units, key, "left")
    note = F.concat(F.lit("Note: "), F.coalesce(F.concat("chart_type", F.lit(" chart")), F.lit("chart")), F.when(F.size("_u") == 1, F.concat(F.lit("; units: "), F.element_at("_u", 1))).when(F.size("_u") > 1, F.concat(F.lit("; units: "), "_pairs")).otherwise(""))
    rows = F.when(F.col("_top").isNotNull() & F.col("_body").isNotNull(), F.concat(F.array("_top"), "_body"))
    return stored(out.select("doc_id", F.col("entry").alias("part"), "title", "chart_type", F.coalesce(note, F.lit("Note: chart")).alias("note"), rows.alias("rows")), "charts")


def chart_blocks(places: DataFrame, found: DataFrame) -> DataFrame:
    """Places (doc_id, part, further columns) of charts -> heading, note and table blocks, ordered by _j."""
    at = places.join(found, ["doc_id", "part"])
    keep = [x for x in places.columns if x != "part"]
    head = at.select(*keep, F.lit(0).alias("_j"), F.lit("heading").alias("block_type"), F.lit(3).cast("smallint").alias("level"), F.coalesce("title", F.lit("Chart")).alias("text"))
    note = at.select(*keep, F.lit(1).alias("_j"), F.lit("paragraph").alias("block_type"), F.col("note").alias("text"))
    body = at.where("rows is not null").select(*keep, F.lit(2).alias("_j"), F.lit("table").alias("block_type"), "rows")
    return head.unionByName(note, allowMissingColumns=True).unionByName(body, allowMissingColumns=True)


def diagram_blocks(made: DataFrame, keep: Sequence[str]) -> DataFrame:
    head = made.select(*keep, F.lit(0).alias("_j"), F.lit("heading").alias("block_type"), F.lit(3).cast("smallint").alias("level"), F.lit("Diagram").alias("text"))
    return head.unionByName(made.select(*keep, F.lit(1).alias("_j"), F.lit("paragraph").alias("block_type"), "text"), allowMissingColumns=True)
