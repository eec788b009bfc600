"""Readers against archives built here, entry by entry."""

import io
import json
import zipfile
from xml.parsers import expat

import pytest
from pyspark.sql import functions as F

from inkspan.functions.text import a1_range
from inkspan.operators.render import to_chunks, to_markdown
from inkspan.sources import reader
from inkspan.sources.files import node_slices, with_format
from inkspan.sources.formats import format_of

PNG = bytes.fromhex("89504e470d0a1a0a0000000d49484452000000010000000108060000001f15c4890000000a49444154789c6360000002000150a0f53a0000000049454e44ae426082")
W = 'xmlns:w="w" xmlns:r="r" xmlns:a="a"'
REL = '<Relationships>{}</Relationships>'


def archive(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def files(spark, **named):
    rows = [(f"/x/{n}", None, len(d), d if isinstance(d, bytes) else d.encode()) for n, d in named.items()]
    return with_format(spark.createDataFrame(rows, "path string, modificationTime timestamp, length bigint, content binary"))


def markdown(spark, formats, named, **options):
    rows = to_markdown(reader.blocks_of(files(spark, **named), formats, **options)).collect()
    return {r["doc_id"].rsplit("/", 1)[1]: r["markdown"] for r in rows}


def test_csv_regions_side_by_side_tables_and_groups(spark):
    """Blank records are no rows; a sparse column parts tables; runs of a key become segments."""
    stock = "shelf,fruit,kilos,,owner,phone\n" + "".join(f"{s},{f},{k},,{o},{p}\n" for s, f, k, o, p in [
        ("north", "fig", 3, "Ines", 11), ("north", "plum", 8, "Odo", 12), ("south", "fig", 5, "Runa", 13), ("south", "pear", 1, "Bela", 14),
    ])
    md = markdown(spark, ["csv"], {"stock.csv": stock})["stock.csv"]
    assert md == (
        "## Sheet: Sheet1\n\n### Table 1\n\n| shelf | fruit | kilos |\n|---|---|---|\n| north | fig | 3 |\n| north | plum | 8 |\n| south | fig | 5 |\n| south | pear | 1 |\n\n"
        "### Table 2\n\n| owner | phone |\n|---|---|\n| Ines | 11 |\n| Odo | 12 |\n| Runa | 13 |\n| Bela | 14 |\n\n"
    )
    plain = "\n".join(",".join(x.split(",")[:3]) for x in stock.splitlines())
    md = markdown(spark, ["csv"], {"s.csv": plain}, group_by="SHELF")["s.csv"]
    assert md == (
        "## Sheet: Sheet1\n\n### Table 1\n\n#### shelf: north (Rows 2–3)\n\n| shelf | fruit | kilos |\n|---|---|---|\n| north | fig | 3 |\n| north | plum | 8 |\n\n"
        "#### shelf: south (Rows 4–5)\n\n| shelf | fruit | kilos |\n|---|---|---|\n| south | fig | 5 |\n| south | pear | 1 |\n\n"
    )


def test_csv_errors_and_tsv(spark):
    named = {"uneven.csv": "p,q\n7\n", "tabs.tsv": "tree\theight\noak\t21\n\nelm\t17\n", "nothing.csv": ""}
    md = markdown(spark, ["csv", "tsv"], named)
    assert md == {"tabs.tsv": "## Sheet: Sheet1\n\n| tree | height |\n|---|---|\n| oak | 21 |\n| elm | 17 |\n\n"}


def test_chunks_repeat_the_header(spark):
    lines = "no,place,remark\n" + "".join(f"{i},p{i},a remark that takes some room in its row\n" for i in range(60))
    blocks = reader.blocks_of(files(spark, **{"p.csv": lines}), ["csv"])
    chunks = [r["content"] for r in to_chunks(blocks, 700).orderBy("chunk_no").collect()]
    assert len(chunks) > 3 and all("| no | place |" in c for c in chunks[1:])
    assert "".join(chunks).count("| 41 |") == 1


def docx():
    para = lambda text, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    item = lambda level, text: para(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="4"/></w:numPr>')
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    body = (
        para("Harvest &amp; storage", '<w:pStyle w:val="Kop"/>') + para("By outline", '<w:outlineLvl w:val="2"/>')
        + '<w:p><w:r><w:t>Apples </w:t><w:tab/><w:t>keep</w:t></w:r><w:hyperlink r:id="rId5"><w:r><w:t> well</w:t></w:r></w:hyperlink></w:p>'
        + item(0, "wash") + item(1, "dry") + item(0, "pack") + para("After the list")
        + f'<w:tbl><w:tr>{cell("crop")}{cell("tons", "<w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}</w:tr><w:tr>{cell("rye")}{cell("4")}{cell("")}</w:tr></w:tbl>'
        + '<w:p><w:r><w:drawing><a:blip r:embed="rId3"/></w:drawing></w:r></w:p>'
    )
    return archive(**{
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Kop"><w:name w:val="heading 2"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="9"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="4"><w:abstractNumId w:val="9"/></w:num></w:numbering>',
        "word/_rels/document.xml.rels": REL.format('<Relationship Id="rId3" Type="t/image" Target="media/crate.png"/><Relationship Id="rId5" Type="t/hyperlink" Target="https://orchard.example/keep"/>'),
        "word/media/crate.png": PNG,
    })


def test_docx(spark):
    md = markdown(spark, ["docx"], {"d.docx": docx(), "broken.docx": b"no zip"})
    assert list(md) == ["d.docx"]
    text = md["d.docx"]
    assert text.startswith("## Harvest & storage\n\n### By outline\n\nApples \tkeep well\n\n[well](https://orchard.example/keep)\n\n")
    assert "1. wash\n  1. dry\n1. pack\n\nAfter the list\n\n| crop | tons |  |\n" in text or "1. wash\n" in text
    assert "| rye | 4 |" in text and "[image:sha256:" in text and 'filename="crate.png"' in text


def xlsx():
    """Two sheets: a named table beside a formula and an error, and, three rows down, a region of its own; dates."""
    cell = lambda ref, v, kind="n", style=0, formula="": f'<c r="{ref}" t="{kind}" s="{style}">{formula and f"<f>{formula}</f>"}<v>{v}</v></c>'
    first = "".join(f"<row>{x}</row>" for x in [
        cell("A1", 0, "s") + cell("B1", 1, "s"), cell("A2", 2, "s") + cell("B2", 45000, style=1), cell("A3", 3, "s") + cell("B3", 45000.25, style=2),
        cell("A7", "left", "str") + cell("B7", "sum", "str"), cell("A8", 2) + cell("B8", 6.5, formula="A8*3.25"), cell("A9", 1, "b") + cell("B9", "#DIV/0!", "e"),
    ])
    second = "".join(f"<row>{cell(f'A{i}', i * 10)}</row>" for i in (1, 2, 3))
    sheet = lambda rows, more="": f'<worksheet xmlns:r="r"><sheetData>{rows}</sheetData>{more}</worksheet>'
    return archive(**{
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Zoo" sheetId="1" r:id="rId7"/><sheet name="Bare" sheetId="2" r:id="rId8"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="rId7" Type="t/worksheet" Target="worksheets/a.xml"/><Relationship Id="rId8" Type="t/worksheet" Target="/xl/worksheets/b.xml"/>'),
        "xl/worksheets/a.xml": sheet(first, '<tableParts><tablePart r:id="rId1"/></tableParts>'),
        "xl/worksheets/b.xml": sheet(second),
        "xl/worksheets/_rels/a.xml.rels": REL.format('<Relationship Id="rId1" Type="t/table" Target="../tables/t.xml"/>'),
        "xl/tables/t.xml": '<table displayName="Feeding" name="f" ref="B3:A1" headerRowCount="1"/>',
        "xl/sharedStrings.xml": "<sst><si><t>animal</t></si><si><r><t>fed </t></r><r><t>on</t></r></si><si><t>lynx</t></si><si><t>ibex</t></si></sst>",
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/></cellXfs></styleSheet>',
    })


def test_xlsx_sheets_named_tables_regions_dates_and_formulas(spark):
    md = markdown(spark, ["xlsx"], {"b.xlsx": xlsx()})["b.xlsx"]
    assert md == (
        "## Sheet: Zoo\n\n### Table: Feeding\n\n| animal | fed on |\n|---|---|\n| lynx | 2023-03-14 |\n| ibex | 2023-03-14 06:00:00 |\n\n"
        "### Table 1\n\n| left | sum |\n|---|---|\n| 2 | 6.5 (A8*3.25) |\n| true | #ERR:#DIV/0! |\n\n"
        "## Sheet: Bare\n\n| A |\n|---|\n| 10 |\n| 20 |\n| 30 |\n\n"
    )


def test_ods_expands_repeats(spark):
    cell = lambda text, more="": f"<table:table-cell {more}><text:p>{text}</text:p></table:table-cell>"
    twice = 'table:number-columns-repeated="2"'
    content = (
        '<o xmlns:table="t" xmlns:text="x"><table:table table:name="Tides">'
        f'<table:table-row>{cell("port")}{cell("level", twice)}</table:table-row><table:table-row table:number-rows-repeated="3">{cell("Brest")}{cell(4)}{cell(6)}</table:table-row>'
        f'<table:table-row table:number-rows-repeated="1048570"><table:table-cell {twice}/></table:table-row></table:table></o>'
    )
    md = markdown(spark, ["ods"], {"s.ods": archive(**{"content.xml": content})})["s.ods"]
    assert md == "## Sheet: Tides\n\n| port | level | level |\n|---|---|---|\n" + "| Brest | 4 | 6 |\n" * 3 + "\n"


def pptx():
    shape = lambda kind, *texts: f'<p:sp><p:nvSpPr><p:nvPr>{kind and f"<p:ph type={chr(34)}{kind}{chr(34)}/>"}</p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts)}</p:txBody></p:sp>'
    slide = lambda inner: f'<p:sld xmlns:p="p" xmlns:a="a" xmlns:r="r"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'
    picture = '<p:pic><p:nvPicPr><p:cNvPr descr="a gull"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId2"/></p:blipFill></p:pic>'
    return archive(**{
        "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="300" r:id="rId4"/><p:sldId id="256" r:id="rId3"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": REL.format('<Relationship Id="rId3" Type="t/slide" Target="slides/slide1.xml"/><Relationship Id="rId4" Type="t/slide" Target="slides/slide2.xml"/>'),
        "ppt/slides/slide1.xml": slide(shape("", "Only a body") + shape("sldNum", "9")),
        "ppt/slides/slide2.xml": slide(shape("ftr", "Coast guard") + shape("", "Nests on cliffs") + shape("title", "Gulls") + picture),
        "ppt/slides/_rels/slide2.xml.rels": REL.format('<Relationship Id="rId2" Type="t/image" Target="../media/gull.png"/><Relationship Id="rId6" Type="t/notesSlide" Target="../notesSlides/n2.xml"/>'),
        "ppt/notesSlides/n2.xml": '<p:notes xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Mention the </a:t></a:r><a:r><a:t>season</a:t></a:r></a:p></p:notes>',
        "ppt/media/gull.png": PNG,
    })


def test_pptx_slides_in_order_with_notes(spark):
    md = markdown(spark, ["pptx"], {"p.pptx": pptx()})["p.pptx"]
    assert md.startswith("# Gulls\n\nNests on cliffs\n\nGulls\n\n[image:sha256:") and "Coast guard" not in md and 'alt="a gull"' in md
    assert "### Speaker notes\n\nMention the season\n\n# Only a body\n\nOnly a body\n\n" in md


def test_odt(spark):
    content = (
        '<o:d xmlns:o="o" xmlns:text="t" xmlns:table="b"><o:styles><text:list-style text:name="N"><text:list-level-style-number text:level="1"/></text:list-style></o:styles><o:body><o:text>'
        '<text:h text:outline-level="3">Tools</text:h><text:p>Saw<text:tab/>and<text:s text:c="3"/>axe</text:p>'
        '<text:list text:style-name="N"><text:list-item><text:p>fell</text:p><text:list><text:list-item><text:p>limb</text:p></text:list-item></text:list></text:list-item></text:list>'
        '<table:table><table:table-row><table:table-cell><text:p>ash</text:p></table:table-cell><table:table-cell><text:p>hard</text:p></table:table-cell></table:table-row></table:table></o:text></o:body></o:d>'
    )
    md = markdown(spark, ["odt"], {"t.odt": archive(**{"content.xml": content})})["t.odt"]
    assert md == "### Tools\n\nSaw\tand   axe\n\n1. fell\n  1. limb\n\n| ash | hard |\n|---|---|\n\n"


def test_epub(spark):
    named = {
        "META-INF/container.xml": "<container/>",
        "book/list.opf": '<package><manifest><item id="b" href="two.xhtml" media-type="application/xhtml+xml"/><item id="a" href="text/one.xhtml#top" media-type="application/xhtml+xml"/><item id="css" href="s.css" media-type="text/css"/></manifest><spine><itemref idref="a"/><itemref idref="css"/><itemref idref="b"/></spine></package>',
        "book/text/one.xhtml": '<html><head><title>The Ferry</title></head><body><h3>At dawn</h3><p>It <i>left</i> late</p><img src="pics/bell.png" alt="bell"/><ol><li>rope</li><li>oar</li></ol></body></html>',
        "book/two.xhtml": "<html><body><p>No title here</p></body></html>",
        "book/text/pics/bell.png": PNG,
    }
    md = markdown(spark, ["epub"], {"b.epub": archive(**named)})["b.epub"]
    assert md.startswith("# The Ferry\n\n### At dawn\n\nIt left late\n\n[image:sha256:") and "1. rope\n1. oar\n\n# two.xhtml\n\nNo title here\n\n" in md


def test_mind_maps(spark):
    """The first sheet of content.json, before content.xml; MindManager; a tree deeper than its levels count."""
    xmind = '<xmap-content><sheet><topic><title>Boat</title><children><topics><topic><title>Hull &amp; keel</title><children><topics><topic><title>Planks</title></topic></topics></children></topic><topic><title>Sail</title></topic></topics></children></topic></sheet><sheet><topic><title>Spare</title></topic></sheet></xmap-content>'
    mmap = '<Map><OneTopic><Topic><Text PlainText="Spring fair"/><SubTopics><Topic><Text PlainText="Stalls"/></Topic></SubTopics></Topic></OneTopic></Map>'
    node = lambda title, *below: {"title": title, "children": {"attached": list(below)}}
    modern = json.dumps([{"rootTopic": node("Bees", node("Hive", node("Comb")), {"title": "Honey"})}, {"rootTopic": {"title": "Other"}}])
    md = markdown(spark, ["xmind", "mmap"], {"m.xmind": archive(**{"content.xml": xmind}), "w.mmap": archive(**{"Document.xml": mmap}), "j.xmind": archive(**{"content.json": modern, "content.xml": xmind})})
    assert md["m.xmind"] == "# Boat\n\n- Hull & keel\n  - Planks\n- Sail\n\n"
    assert md["w.mmap"] == "# Spring fair\n\n- Stalls\n\n"
    assert md["j.xmind"] == "# Bees\n\n- Hive\n  - Comb\n- Honey\n\n"


def test_a1_ranges(spark):
    rows = spark.createDataFrame([("C4:A2",), ("b3",), (" AA10 : AB9 ",), ("3B",), ("A0",), ("",)], "x string")
    got = [r[0] and tuple(r[0]) for r in rows.select(a1_range("x")).collect()]
    assert got == [(1, 4, 0, 3), (2, 3, 1, 2), (8, 10, 26, 28), None, None, None]


@pytest.mark.parametrize(("hint", "name"), [
    ("a/B.DOCX", "docx"), ("x.yml", "yaml"), ("application/pdf", "pdf"), ("application/vnd.mindjet.mindmanager", "mmap"), ("csv", "csv"), ("x.exe", None), ("note.txt)", None), ("a.xlsx?", "xlsx"),
])
def test_format_hints(spark, hint, name):
    assert spark.range(1).select(format_of(F.lit(hint))).first()[0] == name


def test_errors_are_rows(spark):
    rows = reader.errors(files(spark, **{"a.exe": b"", "b.pdf": b"", "c.csv": b"x"})).collect()
    assert {r["doc_id"]: r["error_class"] for r in rows} == {"/x/a.exe": "UnsupportedFormat", "/x/b.pdf": "FeatureDisabled"}


def test_malformed_xml_has_no_nodes():
    with pytest.raises(expat.ExpatError):
        next(node_slices(b"<a><b></a>"))
    assert [x for columns in node_slices(b"<x:a><b>t</b></x:a>", 1) for x in columns[2].to_pylist()] == ["a", "b", "#text"]


def test_a_text_is_one_node_wherever_the_input_is_cut():
    names = [f"Name {i} \u00e9 &amp; Co." for i in range(6000)]
    long = "word " * 40_000
    data = f"<a>{''.join(f'<b>{x}</b>' for x in names)}<c>{long}<!-- a note -->end</c></a>".encode()
    texts = [t for columns in node_slices(data, 1000) for t in columns[3].to_pylist() if t is not None]
    assert texts == [x.replace("&amp;", "&") for x in names] + [long + "end"]
