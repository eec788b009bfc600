"""Charts, diagrams, merged cells and broken files, read from files that are made from the tables, a file a nation."""

from __future__ import annotations

import io
import zipfile
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators.render import to_markdown
from inkspan.plans.reader_queries import FORMATS, RELS, archive, made_files, nations
from inkspan.sources import reader

QUERIES: dict = {}
ORACLES: dict = {}

#: Suppliers of each nation, numbered from 0 in the order of their keys.
BASE = """
s AS (SELECT n_nationkey, n_name AS name, r_name AS region, s_suppkey AS k, s_name AS supplier, floor(s_acctbal)::BIGINT AS balance,
 row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS i FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey),
n AS (SELECT n_nationkey, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def read_markdown(spark: SparkSession, sf: str, make, doc_format: str) -> DataFrame:
    blocks = reader.blocks_of(made_files(nations(spark, sf), make, doc_format), [doc_format])
    return to_markdown(blocks).select(F.col("doc_id").cast("long").alias("n_nationkey"), F.lit(doc_format).alias("doc_format"), "markdown")


# Charts: caches with gaps. Negative balances and odd keys are left out.


def chart_xml(key: int, name: str, pairs: list[tuple[str, str, int]]) -> str:
    points = lambda values: "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in values)
    cats = f"<c:cat><c:strRef><c:strCache>{points((i, escape(s)) for i, (s, _, _) in enumerate(pairs))}</c:strCache></c:strRef></c:cat>"
    series = lambda title, code, values: f"<c:ser><c:tx><c:v>{title}</c:v></c:tx>{cats}<c:val><c:numRef><c:numCache><c:formatCode>{escape(code)}</c:formatCode>{points(values)}</c:numCache></c:numRef></c:val></c:ser>"
    kind = ("barChart", "pieChart")[key % 2]
    body = series("balance", "$#,##0", [(i, b) for i, (_, b, _) in enumerate(pairs) if int(b) >= 0]) + series("key", '0"kg"', [(i, k) for i, (_, _, k) in enumerate(pairs) if k % 2 == 0])
    title = f"<c:title><c:tx><c:rich><a:p><a:r><a:t>{escape(name)}</a:t></a:r></a:p></c:rich></c:tx></c:title>"
    return f'<c:chartSpace xmlns:c="c" xmlns:a="a"><c:chart>{title}<c:plotArea><c:{kind}>{body}</c:{kind}></c:plotArea></c:chart></c:chartSpace>'


def chart_pptx(key: int, name: str, region: str, pairs: list) -> bytes:
    frame = '<p:graphicFrame><a:graphic><a:graphicData uri="u/chart"><c:chart r:id="rId7"/></a:graphicData></a:graphic></p:graphicFrame>'
    return archive({
        "ppt/presentation.xml": '<p:p xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:p>',
        "ppt/_rels/presentation.xml.rels": RELS.format('<Relationship Id="rId1" Type="t/slide" Target="slides/slide1.xml"/>'),
        "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a" xmlns:c="c" xmlns:r="r">{frame}</p:sld>',
        "ppt/slides/_rels/slide1.xml.rels": RELS.format('<Relationship Id="rId7" Type="t/chart" Target="../charts/chart3.xml"/>'),
        "ppt/charts/chart3.xml": chart_xml(key, name, pairs),
    })


def chart_docx(key: int, name: str, region: str, pairs: list) -> bytes:
    drawing = '<w:drawing><wp:inline><a:graphic><a:graphicData uri="u/chart"><c:chart r:id="rId4"/></a:graphicData></a:graphic></wp:inline></w:drawing>'
    return archive({
        "word/document.xml": f'<w:document xmlns:w="w" xmlns:wp="wp" xmlns:a="a" xmlns:c="c" xmlns:r="r"><w:body><w:p><w:r><w:t>Part of {escape(region)}</w:t></w:r><w:r>{drawing}</w:r></w:p></w:body></w:document>',
        "word/_rels/document.xml.rels": RELS.format('<Relationship Id="rId4" Type="t/chart" Target="charts/chart1.xml"/>'),
        "word/charts/chart1.xml": chart_xml(key, name, pairs),
    })


@query(f"""
WITH {BASE},
t AS (SELECT n_nationkey, '| series | ' || string_agg(supplier, ' | ' ORDER BY i) || ' |~|' || repeat('---|', count(*)::INT + 1) || '~'
 || '| balance | ' || string_agg(CASE WHEN balance >= 0 THEN '$' || balance ELSE '' END, ' | ' ORDER BY i) || ' |~'
 || '| key | ' || string_agg(CASE WHEN k % 2 = 0 THEN k || ' kg' ELSE '' END, ' | ' ORDER BY i) || ' |~~' AS body FROM s GROUP BY 1),
c AS (SELECT n.*, '### ' || name || '~~Note: ' || CASE WHEN n_nationkey % 2 = 0 THEN 'bar' ELSE 'pie' END || ' chart; units: balance=$, key=kg~~' || coalesce(body, '') AS chart FROM n LEFT JOIN t USING (n_nationkey))
SELECT n_nationkey, 'pptx' AS doc_format, replace('# Slide 1~~' || chart, '~', chr(10)) AS markdown FROM c
UNION ALL SELECT n_nationkey, 'docx', replace('Part of ' || region || '~~' || chart, '~', chr(10)) FROM c""")
def read_charts(spark: SparkSession, sf: str) -> DataFrame:
    return read_markdown(spark, sf, chart_pptx, "pptx").unionByName(read_markdown(spark, sf, chart_docx, "docx"))


# Diagrams: boxes in a group in a group, connectors by id, loose arrows by place.

#: Pixels are 9525 EMU; a box is 1,000,000 wide, boxes stand 4,000,000 apart, far beyond the reach of a loose end.
BOX, STEP = 1_000_000, 4_000_000
PRESETS = (("rect", "rect"), ("diamond", "diamond"), ("roundRect", "rounded"))


def _xfrm(x: float, y: float, w: float, h: float, inner: tuple | None = None) -> str:
    child = "" if inner is None else f'<a:chOff x="{inner[0]:.0f}" y="{inner[1]:.0f}"/><a:chExt cx="{inner[2]:.0f}" cy="{inner[3]:.0f}"/>'
    return f'<a:xfrm><a:off x="{x:.0f}" y="{y:.0f}"/><a:ext cx="{w:.0f}" cy="{h:.0f}"/>{child}</a:xfrm>'


def grouped_shapes(pairs: list, shape: str, text) -> tuple[str, list[tuple[float, float]]]:
    """Supplier boxes in two groups, of which one doubles and one halves and both shift, and where their centres really are."""
    boxes, centres = "", []
    for i, (supplier, _, k) in enumerate(pairs):
        # Inside: at (i * STEP, 700,000) from an origin of (500,000, 300,000), half as large; the outer group doubles.
        x, y = 500_000 + i * STEP / 2, 300_000 + 700_000 / 2
        real_x, real_y = 2 * (x - 500_000) + 250_000, 4 * (y - 300_000) + 9_000_000
        centres.append((real_x + BOX / 2, real_y + 2 * BOX / 2))
        inner = (900_000 + (x - 500_000) * 2, 100_000 + (y - 300_000) * 2, BOX, BOX)
        boxes += f'<p:{shape}><p:nv><p:cNvPr id="{k + 10}"/></p:nv><p:spPr>{_xfrm(*inner)}<a:prstGeom prst="{PRESETS[i % 3][0]}"/></p:spPr>{text(supplier)}</p:{shape}>'
    wide = max(1, len(pairs)) * STEP
    low = f'<p:grpSp><p:grpSpPr>{_xfrm(500_000, 300_000, wide / 2, wide / 2, (900_000, 100_000, wide, wide))}</p:grpSpPr>{boxes}</p:grpSp>'
    top = f'<p:grpSp><p:grpSpPr>{_xfrm(250_000, 9_000_000, wide * 2, wide * 4, (500_000, 300_000, wide, wide))}</p:grpSpPr>{low}</p:grpSp>'
    return top, centres


def loose_arrows(centres: list[tuple[float, float]], shape: str) -> str:
    """From each box to the next, off the centres by 20 pixels; every second arrow has two heads."""
    out = ""
    for i, ((x1, y1), (x2, y2)) in enumerate(zip(centres, centres[1:])):
        ends = '<a:headEnd type="triangle"/><a:tailEnd type="arrow"/>' if i % 2 else '<a:headEnd type="none"/><a:tailEnd type="arrow"/>'
        out += f'<p:{shape}><p:nv><p:cNvPr id="{90_000_000 + i}"/></p:nv><p:spPr>{_xfrm(x1 + 20 * 9525, y1, x2 - x1 - 40 * 9525, y2 - y1)}<a:prstGeom prst="line"/><a:ln>{ends}</a:ln></p:spPr></p:{shape}>'
    return out


def connectors(pairs: list) -> str:
    label = lambda b: "" if int(b) >= 0 else "<p:txBody><a:p><a:r><a:t>owes</a:t></a:r></a:p></p:txBody>"
    return "".join(f'<p:cxnSp><p:nv><p:cNvPr id="{80_000_000 + i}"/><p:c><a:stCxn id="1"/><a:endCxn id="{k + 10}"/></p:c></p:nv>{label(b)}</p:cxnSp>' for i, (_, b, k) in enumerate(pairs))


def diagram_pptx(key: int, name: str, region: str, pairs: list) -> bytes:
    text = lambda x: f"<p:txBody><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:txBody>"
    boxes, centres = grouped_shapes(pairs, "sp", text)
    hub = f'<p:sp><p:nv><p:cNvPr id="1"/></p:nv><p:spPr>{_xfrm(0, 90_000_000, BOX, BOX)}<a:prstGeom prst="ellipse"/></p:spPr>{text(name)}</p:sp>'
    return archive({
        "ppt/presentation.xml": '<p:p xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:p>',
        "ppt/_rels/presentation.xml.rels": RELS.format('<Relationship Id="rId1" Type="t/slide" Target="slides/slide1.xml"/>'),
        "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><p:spTree>{hub}{boxes}{connectors(pairs)}{loose_arrows(centres, "sp")}</p:spTree></p:sld>',
    })


def diagram_docx(key: int, name: str, region: str, pairs: list) -> bytes:
    text = lambda x: f"<p:txbx><w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p></p:txbx>"
    boxes, centres = grouped_shapes(pairs, "wsp", text)
    hub = f'<p:wsp><p:nv><p:cNvPr id="1"/></p:nv><p:spPr>{_xfrm(0, 90_000_000, BOX, BOX)}<a:prstGeom prst="ellipse"/></p:spPr>{text(name)}</p:wsp>'
    drawing = f"<w:drawing>{hub}{boxes}{connectors(pairs)}{loose_arrows(centres, 'wsp')}</w:drawing>"
    return archive({"word/document.xml": f'<w:document xmlns:w="w" xmlns:p="p" xmlns:a="a"><w:body><w:p><w:r><w:t>Part of {escape(region)}</w:t></w:r><w:r>{drawing}</w:r></w:p></w:body></w:document>'})


_SHAPE = "CASE i % 3 WHEN 0 THEN 'rect' WHEN 1 THEN 'diamond' ELSE 'rounded' END"
_CHART = "'### Diagram~~```mermaid~flowchart LR~  n1@{ shape: circle, label: \"' || name || '\" }~' || boxes || edges || '```~~'"


@query(f"""
WITH {BASE},
p AS (SELECT n_nationkey, string_agg(supplier || '~~', '' ORDER BY i) AS texts, string_agg('  n' || (k + 10) || '@{{ shape: ' || {_SHAPE} || ', label: "' || supplier || '" }}~', '' ORDER BY k) AS boxes FROM s GROUP BY 1),
j AS (SELECT a.n_nationkey, a.i, a.k + 10 AS f, b.k + 10 AS t FROM s a JOIN s b ON a.n_nationkey = b.n_nationkey AND b.i = a.i + 1),
h AS (SELECT n_nationkey, 1 AS f, k + 10 AS t, CASE WHEN balance < 0 THEN '-->|owes|' ELSE '-->' END AS a FROM s),
e AS (SELECT n_nationkey, 'pptx' AS doc_format, f, t, a FROM h UNION ALL SELECT n_nationkey, 'docx', f, t, a FROM h UNION ALL SELECT n_nationkey, 'pptx', f, t, '-->' FROM j
 UNION ALL SELECT n_nationkey, 'pptx', t, f, '-->' FROM j WHERE i % 2 = 1 UNION ALL SELECT n_nationkey, 'docx', CASE WHEN i % 2 = 0 THEN f ELSE f END, t, '<-->' FROM j),
g AS (SELECT n_nationkey, doc_format, string_agg('  n' || f || ' ' || a || ' n' || t || '~', '' ORDER BY f, t) AS edges FROM e GROUP BY 1, 2)
SELECT n_nationkey, 'pptx' AS doc_format, replace('# ' || name || '~~' || name || '~~' || coalesce(texts, '') || CASE WHEN edges IS NULL THEN '' ELSE {_CHART} END, '~', chr(10)) AS markdown
FROM n LEFT JOIN p USING (n_nationkey) LEFT JOIN (SELECT * FROM g WHERE doc_format = 'pptx') USING (n_nationkey)
UNION ALL SELECT n_nationkey, 'docx', replace('Part of ' || region || '~~' || CASE WHEN edges IS NULL THEN '' ELSE {_CHART} END, '~', chr(10))
FROM n LEFT JOIN p USING (n_nationkey) LEFT JOIN (SELECT * FROM g WHERE doc_format = 'docx') USING (n_nationkey)""")
def read_diagrams(spark: SparkSession, sf: str) -> DataFrame:
    """In a text the mere presence of both ends makes an arrow of two heads, on a slide their kind decides."""
    return read_markdown(spark, sf, diagram_pptx, "pptx").unionByName(read_markdown(spark, sf, diagram_docx, "docx"))


# OpenDocument slides: a page of texts, a page with a diagram.


def odp(key: int, name: str, region: str, pairs: list) -> bytes:
    p = lambda x: f"<t:p>{escape(x)}</t:p>"
    rows = "".join(f"<b:table-row><b:table-cell>{p(a)}</b:table-cell><b:table-cell>{p(c)}</b:table-cell></b:table-row>" for a, c in [("supplier", "balance"), *((s, b) for s, b, _ in pairs)])
    items = "".join(f"<t:list-item>{p(s)}</t:list-item>" for s, _, _ in pairs)
    first = f'<d:page d:name="first"><d:frame pr:class="title"><d:text-box>{p(name)}</d:text-box></d:frame><d:frame><d:text-box>{p(f"Part of {region}")}<t:list>{items}</t:list></d:text-box></d:frame><b:table>{rows}</b:table></d:page>'
    at = lambda i: f'svg:x="{10 * i}cm" svg:y="2cm" svg:width="2cm" svg:height="1cm"'
    box = lambda i, x, kind: f'<d:custom-shape d:id="b{i}" {at(i)}>{p(x)}<d:enhanced-geometry d:type="{kind}"/></d:custom-shape>'
    boxes = box(0, name, "ellipse") + "".join(box(i + 1, s, "rectangle") for i, (s, _, _) in enumerate(pairs))
    # Every third connector gives places instead of ids; a style draws the marker of each second one.
    ends = lambda i: f'svg:x1="1.2cm" svg:y1="25mm" svg:x2="{10 * i + 0.5}cm" svg:y2="1in"' if i % 3 == 0 else f'd:start-shape="b0" d:end-shape="b{i}"'
    lines = "".join(f'<d:connector d:style-name="{"arrow" if i % 2 else "bare"}" {ends(i)}>{p("owes") if int(b) < 0 else ""}</d:connector>' for i, (_, b, _) in enumerate(pairs, 1))
    styles = '<st:style st:name="arrow"><st:graphic-properties d:marker-end="Arrow"/></st:style><st:style st:name="bare"><st:graphic-properties d:marker-end=""/></st:style>'
    return archive({"content.xml": f'<o:d xmlns:o="o" xmlns:t="t" xmlns:b="b" xmlns:d="d" xmlns:pr="pr" xmlns:svg="svg" xmlns:st="st"><o:styles>{styles}</o:styles><o:presentation>{first}<d:page d:name="map of {escape(name)}">{boxes}{lines}</d:page></o:presentation></o:d>'})


@query(f"""
WITH {BASE},
g AS (SELECT n_nationkey, string_agg('- ' || supplier || '~', '' ORDER BY i) || '~' AS items, string_agg('| ' || supplier || ' | ' || balance || ' |~', '' ORDER BY i) AS cells,
 string_agg(supplier || '~~', '' ORDER BY i) AS texts, string_agg('  n' || (i + 2) || '@{{ shape: rect, label: "' || supplier || '" }}~', '' ORDER BY i) AS boxes,
 string_agg('  n1 ' || CASE WHEN i % 2 = 0 THEN '-->' ELSE '---' END || CASE WHEN balance < 0 THEN '|owes|' ELSE '' END || ' n' || (i + 2) || '~', '' ORDER BY i) AS edges FROM s GROUP BY 1)
SELECT n_nationkey, 'odp' AS doc_format, replace('# ' || name || '~~Part of ' || region || '~~' || coalesce(items, '') || '| supplier | balance |~|---|---|~' || coalesce(cells, '') || '~# map of ' || name || '~~' || name || '~~' || coalesce(texts, '')
 || CASE WHEN edges IS NULL THEN '' ELSE {_CHART} END, '~', chr(10)) AS markdown FROM n LEFT JOIN g USING (n_nationkey)""")
def read_odp(spark: SparkSession, sf: str) -> DataFrame:
    return read_markdown(spark, sf, odp, "odp")


# Merged cells.


def merged_docx(key: int, name: str, region: str, pairs: list) -> bytes:
    """region | debit or credit | supplier: the first column is one cell, the second merges runs; each third supplier has two columns."""
    cell = lambda x, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p></w:tc>"
    merge = lambda starts: '<w:vMerge w:val="restart"/>' if starts else "<w:vMerge/>"
    rows, last = "", None
    for i, (supplier, balance, _) in enumerate(pairs):
        sign = "debit" if int(balance) < 0 else "credit"
        rows += f"<w:tr>{cell(region if i == 0 else '', merge(i == 0))}{cell(sign if sign != last else '', merge(sign != last))}{cell(supplier, '<w:gridSpan w:val=\"2\"/>' if i % 3 == 0 else '')}</w:tr>"
        last = sign
    return archive({"word/document.xml": f'<w:document xmlns:w="w"><w:body><w:tbl>{rows}</w:tbl></w:body></w:document>'})


@query(f"""
WITH {BASE},
f AS (SELECT *, balance < 0 AS debit, coalesce((balance < 0) <> lag(balance < 0) OVER (PARTITION BY n_nationkey ORDER BY i), true) AS new FROM s),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY n_nationkey ORDER BY i) AS run FROM f),
l AS (SELECT *, count(*) OVER (PARTITION BY n_nationkey) AS whole, count(*) OVER (PARTITION BY n_nationkey, run) AS part FROM r)
SELECT n_nationkey, i::BIGINT AS row_no, 0::BIGINT AS cell_no, CASE WHEN i = 0 THEN region ELSE '' END AS text, 1::BIGINT AS colspan, CASE WHEN i = 0 THEN whole ELSE 0 END::BIGINT AS rowspan FROM l
UNION ALL SELECT n_nationkey, i, 1, CASE WHEN NOT new THEN '' WHEN debit THEN 'debit' ELSE 'credit' END, 1, CASE WHEN new THEN part ELSE 0 END FROM l
UNION ALL SELECT n_nationkey, i, 2, supplier, CASE WHEN i % 3 = 0 THEN 2 ELSE 1 END, 1 FROM l""")
def table_merges(spark: SparkSession, sf: str) -> DataFrame:
    blocks = reader.blocks_of(made_files(nations(spark, sf), merged_docx, "docx"), ["docx"])
    rows = blocks.where("block_type = 'table'").select(F.col("doc_id").cast("long").alias("n_nationkey"), F.posexplode("rows").alias("row_no", "_r"))
    cells = rows.select("n_nationkey", F.col("row_no").cast("long").alias("row_no"), F.posexplode("_r").alias("cell_no", "_c"))
    return cells.select("n_nationkey", "row_no", F.col("cell_no").cast("long").alias("cell_no"), "_c.text", F.col("_c.colspan").cast("long").alias("colspan"), F.col("_c.rowspan").cast("long").alias("rowspan"))


# Broken files.


def broken(key: int, doc_format: str, good: bytes, main: str | None) -> bytes:
    """A file with the fault that its key stands for; every sixth is whole."""
    fault = key % 6
    if doc_format == "json":
        return (good, b"[" * 1500 + b"]" * 1500, good[:-1], b'{"x": NaN}', b'{"x": "\xff"}', b"")[fault]
    if doc_format == "xml":
        return (good, good[:-1], b"<a><b></a>", b"", b"plain", b"<a>\xff</a>")[fault]
    if doc_format == "csv":
        return (good, good + b"a,b,c\n", good + b"\xff,1\n", good + b'"open,1\n', b"\xfe\xff", good + b"alone\n")[fault]
    if fault == 1:
        return good[: len(good) // 2]
    if fault == 5:
        return archive({"other.xml": "<a/>"})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(good)) as source, zipfile.ZipFile(out, "w") as made:
        for name in source.namelist():
            data = source.read(name)
            made.writestr(name, data[:-1] if fault == 4 and name == main else data)
    data = bytearray(out.getvalue())
    if fault in (2, 3):
        local, central = data.index(main.encode()), data.rindex(main.encode())
        if fault == 2:  # a byte of the stored entry changes, its checksum does not
            data[local + len(main) + 5] ^= 1
        else:
            data[local - 30 + 6] |= 1
            data[central - 46 + 8] |= 1
    return bytes(data)


BROKEN = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "odt": "content.xml", "json": None, "xml": None, "csv": None}
_FAULTS = {
    "archive": (("", "NoArchive"), ("main", "Damaged"), ("main", "Encrypted"), ("main", "Malformed"), ("", "MissingEntry")),
    "json": (("", "TooDeep"), ("", "Malformed"), ("", "Malformed"), ("", "NoUtf8"), ("", "Malformed")),
    "xml": (("", "Malformed"),) * 5,
    "csv": (("", "UnequalLengths"), ("", "NoUtf8"), ("", "Malformed"), ("", "NoUtf8"), ("", "UnequalLengths")),
}


def _fault_rows() -> str:
    rows = []
    for doc_format, main in BROKEN.items():
        for i, (where, error) in enumerate(_FAULTS["archive" if main else doc_format], 1):
            rows.append(f"('{doc_format}', {i}, {f"'{main}'" if where else 'NULL'}, '{error}')")
    return ", ".join(rows)


@query(f"""SELECT n_nationkey, doc_format, entry, error_class FROM nation JOIN (VALUES {_fault_rows()}) v(doc_format, fault, entry, error_class) ON n_nationkey % 6 = fault""")
def read_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Broken copies of the nations' files: each fault is a row, and none ends the job."""
    rows, out = nations(spark, sf), None
    for doc_format, main in BROKEN.items():
        make = FORMATS[doc_format][0]
        bad = lambda key, name, region, pairs, f=doc_format, m=main, make=make: broken(key, f, make(name, region, [(s, b) for s, b, _ in pairs]), m)
        found = reader.errors(made_files(rows, bad, doc_format), [doc_format])
        part = found.select(F.col("doc_id").cast("long").alias("n_nationkey"), F.lit(doc_format).alias("doc_format"), "entry", "error_class")
        out = part if out is None else out.unionByName(part)
    return out
