"""Office archives as blocks: relational steps over XML nodes (see inkspan.sources.files).

Every function takes the nodes of all XML entries (see parts) and, where the format holds images, those
(see media), and returns block rows or cells. Numbering of nodes within an entry (pre) gives order; joins on
(doc_id, entry, pre) resolve styles, lists, relationships and shared strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.numbers import format_kind, header_kind, is_number, looks_like_serial, serial_to_iso
from inkspan.functions.text import CURRENCIES, a1_range, collapse, column_index, image_id, image_type, trim_ws
from inkspan.session import stored
from inkspan.sources import drawings
from inkspan.sources.delimited import complete, sheet_blocks
from inkspan.sources.files import ancestor, attr, under, xml_nodes, zip_entries

KEY = ["doc_id", "entry"]
#: Entries that are parsed, and entries that are images.
XML_ENTRY = r"(?i:\.(xml|rels|opf|x?html?)$)"
IMAGE_ENTRY = r"(?i:(^|/)(media|Pictures|img|images)/|\.(png|jpe?g|webp|bmp|tiff?)$)"


def entries(files: DataFrame, names: str = f"{XML_ENTRY}|{IMAGE_ENTRY}|^content\\.json$") -> DataFrame:
    """The entries that readers look at, stored: every archive is unzipped once."""
    return stored(zip_entries(files, names), "entries")


def parsed(unzipped: DataFrame) -> DataFrame:
    """The nodes of all XML entries, stored, with the errors of entries that are needed for them."""
    return stored(xml_nodes(unzipped.where(F.col("entry").isNull() | F.rlike("entry", F.lit(XML_ENTRY)))), "nodes")


#: Fixed value: what stands for SmartArt.
SMART_ART = "Note: SmartArt detected on this slide; semantic extraction not implemented; excluded."


def parts(files: DataFrame) -> DataFrame:
    """The nodes of all XML entries: every file is unzipped and parsed once, and the nodes are stored."""
    return parsed(zip_entries(files, XML_ENTRY)).where("error_class is null").drop("error_class", "message")


def media(files: DataFrame) -> DataFrame:
    """The images of the archives."""
    return images(zip_entries(files, IMAGE_ENTRY))


def _ordered_text(rows: DataFrame, keys, order="pre", piece="text", sep="") -> DataFrame:
    """keys -> text: pieces joined in document order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(piece).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), sep).alias("text"))


def relationships(nodes: DataFrame) -> DataFrame:
    """doc_id, part, rid, kind, target (path in the archive); of a repeated id the last counts."""
    nodes = nodes.where(F.endswith("entry", F.lit(".rels")) & (F.col("tag") == "Relationship"))
    folder = F.regexp_replace("entry", r"_rels/[^/]*$", "")
    part = F.concat(folder, F.regexp_extract("entry", r"_rels/([^/]*)\.rels$", 1))
    target = attr("Target")
    joined = F.when(F.startswith(target, F.lit("/")), F.substring(target, 2, 1 << 20)).when(F.contains(target, F.lit("://")), target).otherwise(F.concat(folder, target))
    # a/b/../c is a/c; two rounds cover what packages hold.
    for _ in range(3):
        joined = F.regexp_replace(joined, r"[^/]+/\.\./", "")
    rows = nodes.select("doc_id", part.alias("part"), attr("Id").alias("rid"), F.element_at(F.split(attr("Type"), "/"), -1).alias("kind"), joined.alias("target"), "pre")
    last = rows.groupBy("doc_id", "part", "rid").agg(F.max_by(F.struct("kind", "target"), "pre").alias("_l"))
    return last.select("doc_id", "part", "rid", "_l.kind", "_l.target")


def images(entries: DataFrame) -> DataFrame:
    """doc_id, entry, image_id, content_type, filename, bytes."""
    name = F.element_at(F.split("entry", "/"), -1)
    found = entries.where(F.rlike("entry", F.lit(IMAGE_ENTRY)) & F.col("data").isNotNull())
    return found.select("doc_id", "entry", image_id("data").alias("image_id"), image_type(name).alias("content_type"), name.alias("filename"), F.col("data").alias("bytes"))


def _table_cells(nodes: DataFrame, table: str, row: str, cell: str, para: str, text: tuple[str, ...], pieces: bool = False) -> DataFrame:
    """KEY, table, rows: outermost tables as arrays of rows of cells.

    With ``pieces`` a cell's texts are trimmed and joined by spaces, and repeated cells of OpenDocument are spelled out.
    """
    first = lambda tag: F.try_element_at(F.filter("path", lambda p: p["tag"] == tag), F.lit(1))["pre"]
    cells = nodes.where(F.col("tag") == cell).where(F.size(F.filter("path", lambda p: p["tag"] == table)) == 1)
    cells = cells.select(*KEY, first(table).alias("_t"), ancestor(row).alias("_r"), F.col("pre").alias("_c"))
    inner = nodes.where((F.col("tag") == "#text") & under(*text)).select(*KEY, first(table).alias("_t"), ancestor(cell).alias("_c"), ancestor(para).alias("_p"), "pre", "text")
    lines = _ordered_text(inner, [*KEY, "_t", "_c", "_p"])
    joined = _ordered_text(lines, [*KEY, "_t", "_c"], "_p", "text", "\n")
    if pieces:
        joined = _ordered_text(inner.withColumn("text", trim_ws("text")).where("text <> ''"), [*KEY, "_t", "_c"], sep=" ")
    filled = cells.join(joined, [*KEY, "_t", "_c"], "left")
    if cell == "tc":
        told = nodes.where(F.col("tag").isin("gridSpan", "vMerge")).groupBy(*KEY, ancestor(cell).alias("_c")).agg(
            F.max(F.when(F.col("tag") == "gridSpan", F.greatest(attr("val").try_cast("int"), F.lit(1)))).alias("colspan"),
            F.max(F.when(F.col("tag") == "vMerge", F.when(F.lower(attr("val")) == "restart", "restart").otherwise("continue"))).alias("merge"),
        )
        filled = filled.join(told, [*KEY, "_c"], "left").withColumn("colspan", F.coalesce("colspan", F.lit(1)))
        filled = filled.join(merged_rows(filled, [*KEY, "_t"], "_r", "_c"), [*KEY, "_t", "_c"], "left")
    elif cell == "table-cell":
        told = lambda n: F.greatest(F.coalesce(attr(n).try_cast("int"), F.lit(1)), F.lit(1))
        spans = nodes.where(F.col("tag") == cell).select(*KEY, F.col("pre").alias("_c"), told("number-columns-spanned").alias("colspan"), told("number-rows-spanned").alias("rowspan"), (told("number-columns-repeated") if pieces else F.lit(1)).alias("_n"))
        filled = filled.join(spans, [*KEY, "_c"]).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_i")
    else:
        filled = filled.withColumns({"colspan": F.lit(1), "rowspan": F.lit(1)})
    one = F.struct(F.coalesce(trim_ws("text"), F.lit("")).alias("text"), "colspan", F.coalesce("rowspan", F.lit(1)).alias("rowspan"))
    rows = filled.groupBy(*KEY, "_t", "_r").agg(F.transform(F.array_sort(F.collect_list(F.struct("_c", one.alias("x")))), lambda z: z["x"]).alias("_cells"))
    return rows.groupBy(*KEY, F.col("_t").alias("pre")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_cells"))), lambda z: z["_cells"]).alias("rows"))


def merged_rows(cells: DataFrame, keys, row: str, cell: str) -> DataFrame:
    """keys, cell, rowspan of the cells that merge down; merge is restart, continue or null, colspan how many columns a cell covers.

    A cell's columns come from the running sum of spans before it. Down each column the last cell that does not
    continue decides: if it starts a merge, it owns the continuations up to here, and each of their columns makes
    it one longer; these have 0 rows themselves. Only the columns of tables that merge are spelled out.
    """
    has = cells.where("merge is not null").select(*keys).distinct()
    before = Window.partitionBy(*keys, row).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.join(has, keys, "left_semi").withColumn("_at", F.coalesce(F.sum("colspan").over(before), F.lit(0)))
    columns = placed.select(*keys, row, cell, "merge", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("colspan") - 1)).alias("_column"))
    down = Window.partitionBy(*keys, "_column").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.when(F.coalesce("merge", F.lit("none")) != "continue", F.struct(F.col("merge").alias("m"), F.col(cell).alias("owner")))
    owned = columns.withColumn("_last", F.last(fixed, ignorenulls=True).over(down))
    length = owned.where("merge = 'continue' and _last.m = 'restart'").groupBy(*keys, F.col("_last.owner").alias(cell)).agg(F.count(F.lit(1)).alias("_more"))
    starts = placed.where("merge = 'restart'").select(*keys, cell).join(length, [*keys, cell], "left").select(*keys, cell, (F.coalesce("_more", F.lit(0)) + 1).cast("int").alias("rowspan"))
    return starts.unionByName(placed.where("merge = 'continue'").select(*keys, cell, F.lit(0).alias("rowspan")))


def _numbered(blocks: DataFrame, order) -> DataFrame:
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return complete(blocks.withColumn("block_index", index.cast("bigint")))


def _gather_lists(items: DataFrame, order: str = "pre", same: Column | None = None) -> DataFrame:
    """Adjacent list items (KEY, pre, block_type, level, text, ordered, group) become one list block at the first's place."""
    w = Window.partitionBy(*KEY).orderBy(order)
    is_list = F.col("block_type") == "list"
    joins = is_list & (F.lag("block_type").over(w) == "list") & F.lag("group").over(w).eqNullSafe(F.col("group"))
    marked = items.withColumn("_g", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(w))
    item = F.struct(order, F.struct(F.coalesce("level", F.lit(0)).cast("smallint").alias("level"), "text").alias("i"))
    at = lambda c: F.min_by(c, order).alias(c)
    rest = [c for c in items.columns if c not in (*KEY, order, "group", "text", "level", "ordered", "block_type")]
    out = marked.groupBy(*KEY, "_g").agg(
        F.min(order).alias(order), at("block_type"), at("text"), at("level"), at("ordered"), *[at(c) for c in rest],
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"]).alias("items"),
    )
    one = F.col("block_type") == "list"
    return out.withColumns({"items": F.when(one, F.col("items")), "text": F.when(~one, F.col("text")), "level": F.when(~one, F.col("level"))}).drop("_g")


def docx_blocks(nodes: DataFrame, pictures: DataFrame) -> DataFrame:
    doc = nodes.where("entry = 'word/document.xml'")
    parent = F.try_element_at("path", F.lit(-1))["tag"]
    # Style id -> level: its outline level, else an id or name of the form heading N.
    styles = nodes.where("entry = 'word/styles.xml'")
    style = styles.where("tag = 'style'").select("doc_id", F.col("pre").alias("_s"), attr("styleId").alias("style"))
    inside = styles.where(F.col("tag").isin("outlineLvl", "name")).select("doc_id", ancestor("style").alias("_s"), "tag", attr("val").alias("val"))
    told = inside.groupBy("doc_id", "_s").agg(F.max(F.when(F.col("tag") == "outlineLvl", F.col("val").cast("int") + 1)).alias("_o"), F.max(F.when(F.col("tag") == "name", F.col("val"))).alias("_n"))
    by_name = lambda x: F.regexp_extract(F.lower(x), r"^heading ?([1-9])$", 1).try_cast("int")
    levels = style.join(told, ["doc_id", "_s"], "left").select("doc_id", "style", F.coalesce("_o", by_name(F.col("style")), by_name(F.col("_n"))).alias("_level"))
    # Numbering id -> abstract numbering -> is the level ordered.
    numbering = nodes.where("entry = 'word/numbering.xml'")
    nums = numbering.where("tag = 'num'").select("doc_id", F.col("pre").alias("_n"), attr("numId").alias("num"))
    refs = numbering.where(F.col("tag") == "abstractNumId").select("doc_id", ancestor("num").alias("_n"), attr("val").alias("_abs"))
    abstract = numbering.where("tag = 'abstractNum'").select("doc_id", F.col("pre").alias("_a"), attr("abstractNumId").alias("_abs"))
    lvl = numbering.where("tag = 'lvl'").select("doc_id", ancestor("abstractNum").alias("_a"), F.col("pre").alias("_l"), attr("ilvl").alias("ilvl"))
    fmt = numbering.where("tag = 'numFmt'").select("doc_id", ancestor("lvl").alias("_l"), (attr("val") != "bullet").alias("_ord"))
    kinds = nums.join(refs, ["doc_id", "_n"]).join(abstract, ["doc_id", "_abs"]).join(lvl, ["doc_id", "_a"]).join(fmt, ["doc_id", "_l"]).select("doc_id", "num", "ilvl", "_ord")

    paras = doc.where((F.col("tag") == "p") & (parent == "body")).select(*KEY, "pre")
    of_p = lambda cond, **cols: doc.where(cond).where(~under("tbl")).select(*KEY, ancestor("p").alias("pre"), *[v.alias(k) for k, v in cols.items()])
    props = of_p(F.col("tag").isin("pStyle", "outlineLvl", "numId", "ilvl"), k=F.col("tag"), v=attr("val")).groupBy(*KEY, "pre").pivot("k", ["pStyle", "outlineLvl", "numId", "ilvl"]).agg(F.first("v"))
    piece = F.when(F.col("tag") == "tab", "\t").when(F.col("tag").isin("br", "cr"), "\n").otherwise(F.col("text"))
    bits = doc.where(((F.col("tag") == "#text") & (parent == "t")) | (F.col("tag").isin("tab", "br", "cr") & under("r"))).where(~under("tbl"))
    text = _ordered_text(bits.select(*KEY, ancestor("p").alias("_p"), "pre", piece.alias("text")), [*KEY, "_p"]).withColumnRenamed("_p", "pre")
    p = paras.join(props, [*KEY, "pre"], "left").join(text, [*KEY, "pre"], "left").withColumn("text", trim_ws(F.coalesce("text", F.lit(""))))
    p = p.join(levels.withColumnRenamed("style", "pStyle"), ["doc_id", "pStyle"], "left")
    p = p.join(kinds.withColumnRenamed("num", "numId"), ["doc_id", "numId", "ilvl"], "left")
    level = F.coalesce("_level", F.col("outlineLvl").cast("int") + 1)
    in_list = F.col("numId").isNotNull() & F.col("ilvl").isNotNull()
    flow = p.where("text <> ''").select(
        *KEY, "pre", F.when(in_list, "list").when(level.isNotNull(), "heading").otherwise("paragraph").alias("block_type"),
        F.when(in_list, F.col("ilvl").cast("int")).otherwise(level).cast("smallint").alias("level"), "text", F.coalesce("_ord", F.lit(False)).alias("ordered"), F.col("numId").alias("group"),
    )
    flow = _gather_lists(flow).withColumn("_k", F.lit(0))
    rels = relationships(nodes).where("part = 'word/document.xml'").select("doc_id", "rid", "target")
    links = of_p(F.col("tag") == "hyperlink", rid=F.coalesce(attr("rid"), attr("id")), _at=F.col("pre"))
    linked = _ordered_text(doc.where((F.col("tag") == "#text") & under("hyperlink")).select(*KEY, ancestor("hyperlink").alias("_at"), "pre", "text"), [*KEY, "_at"])
    links = links.join(rels, ["doc_id", "rid"]).join(linked, [*KEY, "_at"], "left").select(*KEY, "pre", F.lit(1).alias("_k"), F.lit("link").alias("block_type"), F.col("target").alias("url"), F.col("text").alias("link_text"))
    blips = of_p(F.col("tag") == "blip", rid=attr("embed"))
    pics = blips.join(rels, ["doc_id", "rid"]).join(pictures.select("doc_id", F.col("entry").alias("target"), "image_id", "content_type", "filename"), ["doc_id", "target"])
    pics = pics.select(*KEY, "pre", F.lit(2).alias("_k"), F.lit("image").alias("block_type"), "image_id", "content_type", "filename")
    tables = _table_cells(doc, "tbl", "tr", "tc", "p", ("t",)).select(*KEY, "pre", F.lit(0).alias("_k"), F.lit("table").alias("block_type"), "rows")
    first = lambda tag: F.try_element_at(F.filter("path", lambda p: p["tag"] == tag), F.lit(1))["pre"]
    drawn = doc.where(under("drawing") & ~under("tbl")).withColumns({"para": first("p"), "drawing": first("drawing")})
    places = drawn.where((F.col("tag") == "chart") & attr("rid").isNotNull()).select(*KEY, F.col("para").alias("pre"), F.col("pre").alias("_i"), attr("rid").alias("rid"))
    places = places.join(rels, ["doc_id", "rid"]).select(*KEY, "pre", F.lit(3).alias("_k"), "_i", F.col("target").alias("part"))
    shown = drawings.chart_blocks(places, drawings.charts(nodes))
    shapes = drawings.diagrams(drawings.ooxml_graph(drawn, [*KEY, "para", "drawing"], word=True), [*KEY, "para", "drawing"], spelled=False)
    shapes = drawings.diagram_blocks(shapes.select(*KEY, F.col("para").alias("pre"), F.lit(4).alias("_k"), F.col("drawing").alias("_i"), "text"), [*KEY, "pre", "_k", "_i"])
    out = flow
    for more in (links, pics, tables, shown, shapes):
        out = out.unionByName(more, allowMissingColumns=True)
    return _numbered(out, ["pre", "_k", "_i", "_j"])


def _sheets(nodes: DataFrame) -> DataFrame:
    """doc_id, entry, sheet, sheet_no: worksheets in the workbook's order."""
    rels = relationships(nodes).where("part = 'xl/workbook.xml'").select("doc_id", "rid", F.col("target").alias("entry"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre"))
    book = nodes.where("entry = 'xl/workbook.xml' and tag = 'sheet'")
    book = book.select("doc_id", attr("name").alias("sheet"), F.coalesce(attr("rid"), attr("id")).alias("rid"), order.alias("sheet_no"))
    return book.join(rels, ["doc_id", "rid"]).select(*KEY, "sheet", "sheet_no")


def named_tables(nodes: DataFrame) -> DataFrame:
    """doc_id, sheet, table_no, name, r0, r1, c0, c1 (ends exclusive), header_rows: tables that worksheets name."""
    parts_ = nodes.where("tag = 'tablePart'").select(*KEY, F.coalesce(attr("rid"), attr("id")).alias("rid"), "pre").join(_sheets(nodes), KEY)
    rels = relationships(nodes).select("doc_id", F.col("part").alias("entry"), "rid", "target")
    told = nodes.where("tag = 'table' and entry like 'xl/tables/%'").select(
        "doc_id", F.col("entry").alias("target"), F.coalesce(attr("displayName"), attr("name")).alias("name"), a1_range(attr("ref")).alias("_at"), F.coalesce(attr("headerRowCount").try_cast("int"), F.lit(1)).alias("header_rows")
    )
    found = parts_.join(rels, [*KEY, "rid"]).join(told.where("_at is not null and name is not null"), ["doc_id", "target"])
    number = F.row_number().over(Window.partitionBy("doc_id", "sheet").orderBy("pre"))
    return found.select("doc_id", "sheet", number.alias("table_no"), "name", "_at.*", "header_rows")


def xlsx_cells(nodes: DataFrame) -> DataFrame:
    """doc_id, sheet, sheet_no, r, c, text, formula, is_error: typed cells as text; dates by their style."""
    sheets = _sheets(nodes)
    si = nodes.where("entry = 'xl/sharedStrings.xml'")
    strings = si.where("tag = 'si'").select("doc_id", F.col("pre").alias("_si"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")) - 1).alias("idx"))
    words = _ordered_text(si.where((F.col("tag") == "#text") & under("t")).select("doc_id", ancestor("si").alias("_si"), "pre", "text"), ["doc_id", "_si"])
    strings = strings.join(words, ["doc_id", "_si"], "left").select("doc_id", "idx", F.coalesce("text", F.lit("")).alias("shared"))
    st = nodes.where("entry = 'xl/styles.xml'")
    codes = st.where("tag = 'numFmt'").select("doc_id", attr("numFmtId").alias("_f"), attr("formatCode").alias("_code"))
    xfs = st.where((F.col("tag") == "xf") & under("cellXfs")).select("doc_id", attr("numFmtId").alias("_f"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")) - 1).alias("style"))
    xfs = xfs.join(codes, ["doc_id", "_f"], "left").select("doc_id", "style", format_kind(F.col("_f").cast("int"), F.coalesce("_code", F.lit(""))).alias("kind"))
    ws = nodes.where(F.startswith("entry", F.lit("xl/worksheets/"))).join(sheets, KEY)
    cells = ws.where("tag = 'c'").select(*KEY, "sheet", "sheet_no", F.col("pre").alias("_c"), attr("r").alias("ref"), F.coalesce(attr("t"), F.lit("n")).alias("t"), F.coalesce(attr("s").cast("int"), F.lit(0)).alias("style"))
    inner = ws.where((F.col("tag") == "#text") & under("v", "t", "f")).select(*KEY, ancestor("c").alias("_c"), F.when(under("f"), "f").otherwise("v").alias("part"), "pre", "text")
    values = _ordered_text(inner, [*KEY, "_c", "part"]).groupBy(*KEY, "_c").pivot("part", ["v", "f"]).agg(F.first("text"))
    c = cells.join(values, [*KEY, "_c"], "left").withColumn("idx", F.when(F.col("t") == "s", F.col("v").try_cast("int")))
    c = c.join(strings, ["doc_id", "idx"], "left")
    c = c.join(xfs, ["doc_id", "style"], "left")
    number = F.col("v").try_cast("double")
    from inkspan.functions.text import number_text

    shown = (
        F.when(F.col("t") == "s", F.col("shared")).when(F.col("t") == "b", F.when(F.col("v") == "1", "true").otherwise("false"))
        .when(F.col("t") == "e", F.concat(F.lit("#ERR:"), "v")).when((F.col("t") == "n") & F.col("kind").isNotNull() & number.isNotNull(), serial_to_iso(number, F.col("kind")))
        .when((F.col("t") == "n") & number.isNotNull(), number_text(number)).otherwise(F.col("v"))
    )
    value = F.when(F.col("f").isNull(), shown).when(shown.isNull(), F.concat(F.lit("="), "f")).otherwise(F.concat(shown, F.lit(" ("), "f", F.lit(")")))
    return dated_by_header(c.select(
        "doc_id", "sheet", "sheet_no", (F.regexp_extract("ref", r"([0-9]+)$", 1).cast("bigint") - 1).alias("r"), column_index(F.regexp_extract("ref", "^([A-Za-z]+)", 1)).cast("int").alias("c"),
        F.coalesce(value, F.lit("")).alias("text"), F.col("f").alias("formula"), (F.col("t") == "e").alias("is_error"),
    ))


def dated_by_header(cells: DataFrame) -> DataFrame:
    """Numbers that may be dates become dates below a header, in a sheet's first row, that names one; styles have had their say."""
    heads = cells.where("r = 0").select("doc_id", "sheet", "c", header_kind(trim_ws("text")).alias("_kind")).where("_kind is not null")
    number = F.when(is_number(trim_ws("text")), trim_ws("text").try_cast("double"))
    dated = F.when((F.col("r") > 0) & F.col("_kind").isNotNull() & looks_like_serial(number), serial_to_iso(number, F.col("_kind")))
    # A sheet has a header for a column once, however long the column is.
    return cells.join(heads.dropDuplicates(["doc_id", "sheet", "c"]), ["doc_id", "sheet", "c"], "left").withColumn("text", F.coalesce(dated, F.col("text"))).select(cells.columns)


def ods_cells(nodes: DataFrame, max_rows: int = 20_000, max_cols: int = 100, tail_rows: int = 2000) -> DataFrame:
    """Cells of an OpenDocument sheet; repeated rows and columns that hold text are expanded, empty ones are not.

    A file may declare a million repeats in a few bytes. Of a repeated row its first ``max_rows`` and last ``tail_rows``
    are spelled out, of a repeated column its first ``max_cols``: more of them no sheet of these limits shows, and
    the last row keeps its number.
    """
    nodes = nodes.where("entry = 'content.xml'")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre"))
    tables = nodes.where("tag = 'table'").select(*KEY, F.col("pre").alias("_t"), attr("name").alias("sheet"), number.alias("sheet_no"))
    rep = lambda n: F.coalesce(attr(n).try_cast("int"), F.lit(1))
    before = lambda keys, n: F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = nodes.where("tag = 'table-row'").select(*KEY, ancestor("table").alias("_t"), "pre", rep("number-rows-repeated").alias("_n"))
    rows = rows.withColumn("r", before([*KEY, "_t"], "_n")).select(*KEY, "_t", F.col("pre").alias("_r"), "r", F.col("_n").alias("_rn"))
    cells = nodes.where(F.col("tag").isin("table-cell", "covered-table-cell")).select(*KEY, ancestor("table-row").alias("_r"), "pre", rep("number-columns-repeated").alias("_n"), attr("formula").alias("formula"))
    cells = cells.withColumn("c", before([*KEY, "_r"], "_n")).withColumnRenamed("pre", "_c")
    text = _ordered_text(_ordered_text(nodes.where((F.col("tag") == "#text") & under("p")).select(*KEY, ancestor("table-cell").alias("_c"), ancestor("p").alias("_p"), "pre", "text"), [*KEY, "_c", "_p"]), [*KEY, "_c"], "_p", "text", "\n")
    full = cells.join(text, [*KEY, "_c"]).join(rows, [*KEY, "_r"]).join(tables, [*KEY, "_t"])
    first = lambda start, n, most: F.sequence(F.col(start), F.col(start) + F.least(F.col(n), F.lit(most)) - 1)
    last = F.sequence(F.col("r") + F.col("_rn") - F.least(F.col("_rn"), F.lit(max(tail_rows, 1))), F.col("r") + F.col("_rn") - 1)
    rows_ = F.explode(F.array_union(first("r", "_rn", max_rows), last))
    told = full.select("doc_id", "sheet", "sheet_no", rows_.alias("r"), "c", "_n", "text", F.regexp_replace("formula", "^of:=?", "").alias("formula"))
    told = told.select("doc_id", "sheet", "sheet_no", "r", F.explode(first("c", "_n", max_cols)).alias("c"), "text", "formula")
    return told.withColumns({"r": F.col("r").cast("bigint"), "c": F.col("c").cast("int"), "is_error": F.lit(False)})


def xlsx_blocks(nodes: DataFrame, **options) -> DataFrame:
    """Each sheet's named tables, then its regions, split into tables side by side."""
    return sheet_blocks(xlsx_cells(nodes), named=named_tables(nodes), **options)


def ods_blocks(nodes: DataFrame, **options) -> DataFrame:
    """Each sheet's regions, split into tables side by side."""
    limits = {k: v for k, v in options.items() if k in ("max_rows", "max_cols", "tail_rows")}
    return sheet_blocks(ods_cells(nodes, **limits), **options)


def pptx_blocks(nodes: DataFrame, pictures: DataFrame) -> DataFrame:
    """Slides in presentation order: title heading, paragraphs and lists, tables, images, charts, the diagram, speaker notes."""
    rels = relationships(nodes)
    pres = nodes.where("entry = 'ppt/presentation.xml' and tag = 'sldId'")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre"))
    slides = pres.select("doc_id", F.coalesce(attr("rid"), attr("id")).alias("rid"), order.alias("slide"))
    slides = slides.join(rels.where("part = 'ppt/presentation.xml'").select("doc_id", "rid", "target"), ["doc_id", "rid"]).select("doc_id", F.col("target").alias("entry"), "slide")
    s = nodes.join(slides, KEY)
    shape = ancestor("sp")
    kind = s.where("tag = 'ph'").select(*KEY, shape.alias("_sp"), F.coalesce(attr("type"), F.lit("body")).alias("ph"))
    bits = s.where(((F.col("tag") == "#text") & under("t")) | (F.col("tag") == "br")).where(~under("tbl") & under("sp"))
    paras = _ordered_text(bits.select(*KEY, "slide", shape.alias("_sp"), ancestor("p").alias("_p"), "pre", F.when(F.col("tag") == "br", "\n").otherwise(F.col("text")).alias("text")), [*KEY, "slide", "_sp", "_p"])
    bullets = s.where(F.col("tag").isin("buChar", "buAutoNum")).groupBy(*KEY, ancestor("p").alias("_p")).agg(F.max((F.col("tag") == "buAutoNum").cast("int")).alias("_auto"))
    lvl = s.where("tag = 'pPr'").select(*KEY, ancestor("p").alias("_p"), attr("lvl").cast("int").alias("_lvl"))
    p = paras.join(kind, [*KEY, "_sp"], "left").join(bullets, [*KEY, "_p"], "left").join(lvl, [*KEY, "_p"], "left")
    p = p.withColumn("text", trim_ws("text")).where("text <> ''").where(~F.coalesce("ph", F.lit("")).isin("dt", "ftr", "sldNum", "hdr"))
    rank = F.when(F.col("ph").isin("title", "ctrTitle"), 0).when(F.col("ph") == "subTitle", 1).otherwise(2)
    titles = slides.join(p.groupBy(*KEY).agg(F.min_by("text", F.struct(rank, "_p")).alias("_title")), KEY, "left")
    heads = titles.select(*KEY, "slide", F.lit(-1).alias("pre"), F.lit(0).alias("_k"), F.lit("heading").alias("block_type"), F.lit(1).cast("smallint").alias("level"), F.coalesce("_title", F.concat(F.lit("Slide "), "slide")).alias("text"))
    flow = _gather_lists(p.select(*KEY, "slide", F.col("_p").alias("pre"), F.when(F.col("_auto").isNotNull(), "list").otherwise("paragraph").alias("block_type"), F.col("_lvl").cast("smallint").alias("level"), "text", (F.col("_auto") == 1).alias("ordered"), F.col("_auto").cast("string").alias("group"))).withColumn("_k", F.lit(1))
    tables = _table_cells(s, "tbl", "tr", "tc", "p", ("t",)).join(slides, KEY).select(*KEY, "slide", "pre", F.lit(1).alias("_k"), F.lit("table").alias("block_type"), "rows")
    alt = s.where("tag = 'cNvPr'").select(*KEY, ancestor("pic").alias("_pic"), attr("descr").alias("alt"))
    pics = s.where("tag = 'blip'").select(*KEY, "slide", "pre", ancestor("pic").alias("_pic"), attr("embed").alias("rid"))
    own_rels = rels.select("doc_id", F.col("part").alias("entry"), "rid", "target")
    linked = own_rels.join(pictures.select("doc_id", F.col("entry").alias("target"), "image_id", "content_type", "filename"), ["doc_id", "target"])
    pics = pics.join(linked, [*KEY, "rid"])
    pics = pics.join(alt.where("_pic is not null"), [*KEY, "_pic"], "left").select(*KEY, "slide", "pre", F.lit(1).alias("_k"), F.lit("image").alias("block_type"), "image_id", "content_type", "filename", "alt")
    places = s.where((F.col("tag") == "chart") & attr("rid").isNotNull() & under("graphicData")).select(*KEY, "slide", "pre", attr("rid").alias("rid"))
    places = places.join(own_rels, [*KEY, "rid"]).select(*KEY, "slide", "pre", F.lit(1).alias("_k"), F.col("target").alias("part"))
    shown = drawings.chart_blocks(places, drawings.charts(nodes))
    art = s.where((F.col("tag") == "graphicData") & F.contains(attr("uri"), F.lit("/diagram"))).select(*KEY, "slide", "pre", F.lit(1).alias("_k"), F.lit("paragraph").alias("block_type"), F.lit(SMART_ART).alias("text"))
    page = [*KEY, "slide"]
    shapes = drawings.diagrams(drawings.ooxml_graph(s, page, linked.select(*KEY, "rid", "image_id", "filename")), page)
    shapes = drawings.diagram_blocks(shapes.select(*page, F.lit(0).alias("pre"), F.lit(2).alias("_k"), "text"), [*page, "pre", "_k"])
    to_notes = rels.where("kind = 'notesSlide'").groupBy("doc_id", F.col("part").alias("_slide")).agg(F.min_by("target", "rid").alias("entry"))
    notes = nodes.join(to_notes, KEY).join(slides.select("doc_id", F.col("entry").alias("_slide"), "slide"), ["doc_id", "_slide"])
    note = _ordered_text(notes.where((F.col("tag") == "#text") & under("t")).select(*KEY, "slide", ancestor("p").alias("_p"), "pre", "text"), [*KEY, "slide", "_p"]).withColumn("text", trim_ws("text")).where("text <> ''")
    said = note.select(*KEY, "slide", F.col("_p").alias("pre"), F.lit(4).alias("_k"), F.lit("paragraph").alias("block_type"), "text")
    note_head = note.select(*KEY, "slide").distinct().select(*KEY, "slide", F.lit(0).alias("pre"), F.lit(3).alias("_k"), F.lit("heading").alias("block_type"), F.lit(3).cast("smallint").alias("level"), F.lit("Speaker notes").alias("text"))
    out = heads
    for more in (flow, tables, pics, shown, art, shapes, note_head, said):
        out = out.unionByName(more, allowMissingColumns=True)
    return _numbered(out, ["slide", "_k", "pre", "_j"])


def odt_blocks(nodes: DataFrame, pictures: DataFrame) -> DataFrame:
    """Headings, paragraphs, lists and tables of the text body; images last."""
    nodes = nodes.where("entry in ('content.xml', 'styles.xml')")
    doc = nodes.where("entry = 'content.xml'")
    parent = F.try_element_at("path", F.lit(-1))["tag"]
    top = doc.where((parent == "text") & F.col("tag").isin("h", "p") & ~under("list", "table"))
    blank = F.repeat(F.lit(" "), F.coalesce(attr("c").try_cast("int"), F.lit(1)))
    piece = F.when(F.col("tag") == "tab", "\t").when(F.col("tag") == "line-break", "\n").when(F.col("tag") == "s", blank).otherwise(F.col("text"))
    bits = doc.where(F.col("tag").isin("#text", "tab", "line-break", "s") & under("h", "p")).where(~under("table"))
    text = _ordered_text(bits.select(*KEY, ancestor("h", "p").alias("_p"), "pre", piece.alias("text")), [*KEY, "_p"]).withColumnRenamed("_p", "pre").withColumn("text", trim_ws("text")).where("text <> ''")
    flow = top.select(*KEY, "pre", F.when(F.col("tag") == "h", "heading").otherwise("paragraph").alias("block_type"), F.when(F.col("tag") == "h", F.coalesce(attr("outline-level").try_cast("int"), F.lit(1))).cast("smallint").alias("level"), F.lit(False).alias("ordered"), F.lit(None).cast("string").alias("group"))
    outer = F.try_element_at(F.filter("path", lambda p: p["tag"] == "list"), F.lit(1))["pre"]
    depth = F.size(F.filter("path", lambda p: p["tag"] == "list")) - 1
    ordered = nodes.where(F.col("tag") == "list-level-style-number").select("doc_id", F.try_element_at("path", F.lit(-1))["pre"].alias("_s"), "entry")
    styles = nodes.where("tag = 'list-style'").select("doc_id", "entry", F.col("pre").alias("_s"), attr("name").alias("_style")).join(ordered, ["doc_id", "entry", "_s"], "left_semi").select("doc_id", "_style").distinct()
    lists = doc.where("tag = 'list'").select(*KEY, F.col("pre").alias("_l"), attr("style-name").alias("_style")).join(styles.withColumn("_ord", F.lit(True)), ["doc_id", "_style"], "left").select(*KEY, "_l", F.coalesce("_ord", F.lit(False)).alias("ordered"))
    items = doc.where((F.col("tag").isin("p", "h")) & under("list") & ~under("table")).select(*KEY, "pre", F.lit("list").alias("block_type"), depth.cast("smallint").alias("level"), outer.alias("_l"), outer.cast("string").alias("group"))
    items = items.join(lists, [*KEY, "_l"], "left").drop("_l")
    gathered = _gather_lists(flow.unionByName(items).join(text, [*KEY, "pre"])).withColumn("_k", F.lit(0))
    tables = _table_cells(doc, "table", "table-row", "table-cell", "p", ("p",)).select(*KEY, "pre", F.lit(0).alias("_k"), F.lit("table").alias("block_type"), "rows")
    pics = doc.where(F.col("tag") == "image").select(*KEY, "pre", attr("href").alias("target")).join(pictures.select("doc_id", F.col("entry").alias("target"), "image_id", "content_type", "filename"), ["doc_id", "target"])
    pics = pics.select(*KEY, "pre", F.lit(1).alias("_k"), F.lit("image").alias("block_type"), "image_id", "content_type", "filename")
    # A diagram is of one child of the text, and stands behind it.
    child = F.when(F.get("path", F.lit(2))["tag"] == "text", F.coalesce(F.get("path", F.lit(3))["pre"], F.col("pre")))
    drawn = doc.withColumn("_top", child).where("_top is not null")
    graph = drawings.odf_graph(drawn, [*KEY, "_top"], drawings.odf_markers(nodes), pictures)
    shapes = drawings.diagrams(graph, [*KEY, "_top"]).select(*KEY, F.col("_top").alias("pre"), F.lit(0).alias("_k"), "text")
    shapes = drawings.diagram_blocks(shapes, [*KEY, "pre", "_k"])
    out = gathered
    for more in (tables, pics, shapes):
        out = out.unionByName(more, allowMissingColumns=True)
    return _numbered(out, ["_k", "pre", "_j"])


def odp_blocks(nodes: DataFrame, pictures: DataFrame) -> DataFrame:
    """Pages in order: title heading, headings, paragraphs and lists, tables, images, and the diagram.

    Texts are trimmed and joined by spaces. Frames of the class title or subtitle make the title and no body.
    """
    doc = nodes.where("entry = 'content.xml'")
    page, frame = [*KEY, "slide"], ancestor("frame")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre"))
    pages = doc.where("tag = 'page'").select(*KEY, F.col("pre").alias("_page"), number.alias("slide"), attr("name").alias("_name"))
    s = doc.withColumn("_page", ancestor("page")).join(pages.drop("_name"), [*KEY, "_page"]).drop("_page")
    titled = s.where((F.col("tag") == "frame") & F.lower(F.coalesce(attr("class"), F.lit(""))).isin("title", "subtitle")).select(*KEY, F.col("pre").alias("_f"), F.lit(True).alias("_titled"))
    bits = s.where((F.col("tag") == "#text") & under("p", "h") & ~under("table", "connector", "line")).withColumn("text", trim_ws("text")).where("text <> ''")
    bits = bits.withColumns({"_p": ancestor("p", "h"), "_f": frame}).join(titled, [*KEY, "_f"], "left").withColumn("_titled", F.coalesce("_titled", F.lit(False)))
    titles = _ordered_text(bits.where("_titled"), page, sep=" ").withColumnRenamed("text", "_title")
    heads = pages.join(titles, page, "left").select(*page, F.lit(-1).alias("pre"), F.lit(0).alias("_k"), F.lit("heading").alias("block_type"), F.lit(1).cast("smallint").alias("level"), F.coalesce("_title", "_name", F.concat(F.lit("Slide "), "slide")).alias("text"))
    told = s.where(F.col("tag").isin("p", "h")).select(
        *KEY, F.col("pre").alias("_p"), (F.col("tag") == "h").alias("_h"), (F.size(F.filter("path", lambda p: p["tag"] == "list")) - 1).alias("_depth"), under("list-item").alias("_item"), attr("outline-level").try_cast("int").alias("_outline"),
    )
    text = _ordered_text(bits, [*page, "_p", "_titled"], sep=" ").join(told, [*KEY, "_p"]).where("_h or not _titled")
    in_list = ~F.col("_h") & F.col("_item") & (F.col("_depth") >= 0)
    level = F.when(F.col("_h"), F.least(F.greatest(F.coalesce("_outline", F.lit(1)) + 1, F.lit(2)), F.lit(6))).when(in_list, F.col("_depth"))
    flow = text.select(*page, F.col("_p").alias("pre"), F.when(F.col("_h"), "heading").when(in_list, "list").otherwise("paragraph").alias("block_type"), level.cast("smallint").alias("level"), "text", F.lit(False).alias("ordered"), F.col("slide").cast("string").alias("group"))
    tables = _table_cells(s, "table", "table-row", "table-cell", "p", ("p",), pieces=True).join(s.where("tag = 'table'").select(*page, "pre"), [*KEY, "pre"]).select(*page, "pre", F.lit("table").alias("block_type"), "rows")
    # A table inside a chart has a note before it.
    kind = F.element_at(F.split(attr("class"), ":"), -1)
    drawn = s.where("tag = 'chart'").select(*KEY, F.col("pre").alias("_chart"), kind.alias("_kind"))
    noted = s.where("tag = 'table'").select(*KEY, "pre", ancestor("chart").alias("_chart")).join(drawn, [*KEY, "_chart"]).join(tables.select(*page, "pre", "rows"), [*KEY, "pre"])
    unit = first_unit(F.col("rows"))
    notes = noted.select(*page, "pre", F.lit(-1).alias("_j"), F.lit("paragraph").alias("block_type"), F.concat(F.lit("Note: "), F.coalesce("_kind", F.lit("chart")), F.lit(" chart"), F.coalesce(F.concat(F.lit("; units: "), unit), F.lit(""))).alias("text"))
    at = s.where("tag = 'image'").select(*page, "pre", F.regexp_replace(trim_ws(attr("href")), r"^\./", "").alias("target"))
    pics = at.join(pictures.select("doc_id", F.col("entry").alias("target"), "image_id", "content_type", "filename"), ["doc_id", "target"]).select(*page, "pre", F.lit("image").alias("block_type"), "image_id", "content_type", "filename")
    # Tables and images between two items part a list.
    body = _gather_lists(flow.unionByName(tables, allowMissingColumns=True).unionByName(pics, allowMissingColumns=True).unionByName(notes, allowMissingColumns=True).withColumn("_j", F.coalesce("_j", F.lit(0))).withColumn("_o", F.struct("slide", "pre", "_j")), "_o").withColumn("_k", F.lit(1))
    graph = drawings.odf_graph(s, page, drawings.odf_markers(nodes), pictures)
    shapes = drawings.diagrams(graph, page).select(*page, F.lit(0).alias("pre"), F.lit(2).alias("_k"), "text")
    out = heads.unionByName(body, allowMissingColumns=True).unionByName(drawings.diagram_blocks(shapes, [*page, "pre", "_k"]), allowMissingColumns=True)
    return _numbered(out, ["slide", "_k", "pre", "_j"])


def first_unit(rows: Column) -> Column:
    """The unit of a table's first cell that shows one: a percent sign before a currency."""
    shown = lambda x: F.coalesce(*[F.when(F.contains(x, F.lit(u)), F.lit(u)) for u in ("%", *CURRENCIES)])
    return F.get(F.filter(F.transform(F.flatten(rows), lambda c: shown(c["text"])), lambda u: u.isNotNull()), F.lit(0))


def epub_blocks(nodes: DataFrame, pictures: DataFrame) -> DataFrame:
    """Chapters in spine order: a heading each, then headings, paragraphs, list items and images of its body."""
    opf = nodes.where(F.endswith("entry", F.lit(".opf")))
    folder = F.regexp_extract("entry", "^(.*/)?[^/]*$", 1)
    manifest = opf.where("tag = 'item'").select("doc_id", attr("id").alias("idref"), F.concat(folder, F.regexp_replace(attr("href"), "[#?].*$", "")).alias("entry"), attr("media-type").alias("media"))
    spine = opf.where("tag = 'itemref'").select("doc_id", attr("idref").alias("idref"), F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).alias("chapter"))
    chapters = spine.join(manifest.where(F.rlike("media", F.lit("html"))), ["doc_id", "idref"]).select(*KEY, "chapter")
    x = nodes.join(chapters, KEY)
    title = _ordered_text(x.where((F.col("tag") == "#text") & under("title")).select(*KEY, "pre", "text"), KEY)
    heads = chapters.join(title, KEY, "left").select(*KEY, "chapter", F.lit(-1).alias("pre"), F.lit("heading").alias("block_type"), F.lit(1).cast("smallint").alias("level"), F.coalesce(F.when(trim_ws("text") != "", trim_ws("text")), F.element_at(F.split("entry", "/"), -1)).alias("text"))
    tags = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote")
    body = x.where((F.col("tag") == "#text") & under("body") & under(*tags))
    owner = F.element_at(F.filter("path", lambda p: p["tag"].isin(*tags)), -1)
    grouped = _ordered_text(body.select(*KEY, "chapter", owner["pre"].alias("_p"), owner["tag"].alias("_tag"), ancestor("ul", "ol").cast("string").alias("group"), under("ol").alias("ordered"), "pre", "text"), [*KEY, "chapter", "_p", "_tag", "group", "ordered"])
    flow = grouped.select(*KEY, "chapter", F.col("_p").alias("pre"), F.when(F.col("_tag") == "li", "list").when(F.startswith("_tag", F.lit("h")), "heading").otherwise("paragraph").alias("block_type"), F.when(F.startswith("_tag", F.lit("h")), F.substring("_tag", 2, 1).try_cast("int")).otherwise(0).cast("smallint").alias("level"), collapse("text").alias("text"), "ordered", "group").where("text <> ''")
    flow = _gather_lists(flow)
    src = F.concat(F.regexp_extract("entry", "^(.*/)?[^/]*$", 1), F.regexp_replace(attr("src"), "[#?].*$", ""))
    pics = x.where("tag = 'img'").select(*KEY, "chapter", "pre", src.alias("target"), attr("alt").alias("alt")).join(pictures.select("doc_id", F.col("entry").alias("target"), "image_id", "content_type", "filename"), ["doc_id", "target"])
    pics = pics.select(*KEY, "chapter", "pre", F.lit("image").alias("block_type"), "image_id", "content_type", "filename", "alt")
    return _numbered(heads.unionByName(flow, allowMissingColumns=True).unionByName(pics, allowMissingColumns=True), ["chapter", "pre"])


#: A topic of content.json with its children as they are, to be read level by level.
TOPIC = "struct<title:string,children:struct<attached:array<string>>>"


def json_topics(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """XMind content.json (doc_id, entry, data): topics as doc_id, node_id, parent_id, ord, title, and failures.

    The first sheet with a rootTopic or a topic counts. One step a level: the children of a level's topics are kept
    as JSON text and read by the next.
    """
    found = entries.where("entry = 'content.json' and data is not null")
    sheets = found.select("doc_id", "entry", F.from_json(F.try_validate_utf8(F.col("data").cast("string")), "array<string>").alias("_sheets"))
    topic = F.from_json(F.col("_s"), "struct<rootTopic:string,topic:string>")
    # get of the reader: a sheet may hold either; the first sheet that holds one is the map.
    tops = sheets.select("doc_id", F.posexplode("_sheets").alias("_n", "_s")).select("doc_id", "_n", F.coalesce(topic["rootTopic"], topic["topic"]).alias("_json")).where("_json is not null")
    top = tops.groupBy("doc_id").agg(F.min_by("_json", "_n").alias("_json"))
    level = stored(top.select("doc_id", F.array(F.lit(0)).alias("_path"), "_json"), "topics")
    error = F.when(F.col("_sheets").isNull(), "Malformed").otherwise("NoTopic")
    failed = sheets.join(level.select("doc_id"), "doc_id", "left_anti").select("doc_id", "entry", error.alias("error_class"), F.lit("no sheet with a topic").alias("message"))
    levels = [level]
    while True:
        below = level.select("doc_id", "_path", F.posexplode(F.from_json("_json", TOPIC)["children"]["attached"]).alias("_i", "_json"))
        level = stored(below.select("doc_id", F.array_append("_path", F.col("_i")).alias("_path"), "_json"), "topics")
        if level.isEmpty():
            break
        levels.append(level)
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    name = lambda p: F.array_join(p, ".")
    topics = found.select(
        "doc_id", name("_path").alias("node_id"), F.when(F.size("_path") > 1, name(F.slice("_path", F.lit(1), F.size("_path") - 1))).alias("parent_id"),
        F.element_at("_path", -1).alias("ord"), F.from_json("_json", TOPIC)["title"].alias("title"),
    )
    return topics, failed


def mind_map_nodes(nodes: DataFrame) -> DataFrame:
    """XMind content.xml and MindManager Document.xml: doc_id, node_id, parent_id, ord, title."""
    nodes = nodes.where("entry in ('content.xml', 'Document.xml')")
    topics = nodes.where(F.col("tag").isin("topic", "Topic"))
    first_sheet = F.coalesce(ancestor("sheet"), F.lit(-1))
    topics = topics.withColumn("_sheet", first_sheet).withColumn("_first", F.min("_sheet").over(Window.partitionBy("doc_id"))).where("_sheet = _first")
    topics = topics.select("doc_id", F.col("pre").alias("node_id"), ancestor("topic", "Topic").alias("parent_id"), F.col("pre").alias("ord"))
    told = nodes.where((F.col("tag") == "#text") & (F.try_element_at("path", F.lit(-1))["tag"] == "title")).select("doc_id", ancestor("topic", "Topic").alias("node_id"), "text")
    plain = nodes.where("tag = 'Text'").select("doc_id", ancestor("Topic").alias("node_id"), attr("PlainText").alias("text"))
    titles = told.unionByName(plain).where("text is not null").groupBy("doc_id", "node_id").agg(F.array_join(F.collect_list("text"), "").alias("title"))
    return topics.join(titles, ["doc_id", "node_id"], "left")


def mind_maps(unzipped: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics (doc_id, node_id, parent_id, ord, title), from content.json where an archive has one, else its XML; and failures."""
    modern, failed = json_topics(unzipped)
    modern = stored(modern, "json")
    held = unzipped.where("entry = 'content.json'").select("doc_id").distinct()
    number = mind_map_nodes(nodes).join(held, "doc_id", "left_anti").withColumns({c: F.col(c).cast("string") for c in ("node_id", "parent_id")})
    return modern.unionByName(number), failed
