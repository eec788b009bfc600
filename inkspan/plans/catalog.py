"""The registered queries over the harness tables and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.functions import numbers as N
from inkspan.functions import text as T
from inkspan.operators import assets, graph, layout, numbering, render, sheet, trees
from inkspan.plans import document_text, drawing_queries, reader_queries, stream_queries
from inkspan.session import table
from inkspan.sources.formats import MIME_TYPES, format_of

QUERIES: dict = reader_queries.QUERIES | drawing_queries.QUERIES | stream_queries.QUERIES
ORACLES: dict = reader_queries.ORACLES | drawing_queries.ORACLES | stream_queries.ORACLES

#: Characters that the SQL side must trim and collapse like WS in inkspan.functions.text.
SQL_WS = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return sql_trim(f"regexp_replace({x}, '{SQL_WS}+', ' ', 'g')")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- formats and scalars -------------------------------------------------------------------------

_SQL_FORMAT = "CASE " + " ".join(f"WHEN lower(trim(url)) = '{m}' THEN '{f}'" for m, f in MIME_TYPES.items())
_SQL_ENDING = r"regexp_replace(list_extract(string_split(lower(trim(url)), '.'), -1), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"


@query(f"""
SELECT page_id, {_SQL_FORMAT} WHEN {_SQL_ENDING} = 'yml' THEN 'yaml'
  WHEN {_SQL_ENDING} IN ('docx','odt','pptx','odp','xlsx','ods','csv','tsv','pdf','rtf','json','yaml','toml','xml','epub','xmind','mmap') THEN {_SQL_ENDING} END AS doc_format
FROM pages""")
def format_from_hint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", format_of("url").alias("doc_format"))


@query("""
SELECT CASE WHEN contains(lower(url), 'youtube.com') OR contains(lower(url), 'youtu.be') OR contains(lower(url), 'vimeo.com') THEN 'video'
  WHEN suffix(lower(url), '.mp3') OR suffix(lower(url), '.wav') OR suffix(lower(url), '.m4a') OR suffix(lower(url), '.flac') THEN 'audio'
  WHEN prefix(lower(url), 'http://') OR prefix(lower(url), 'https://') THEN 'web' ELSE 'unknown' END AS link_kind, count(*) AS pages
FROM pages GROUP BY 1""")
def link_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(T.link_kind("url").alias("link_kind")).agg(F.count(F.lit(1)).alias("pages"))


@query(r"""
SELECT page_id, CASE regexp_extract(lower(url), '\.([^.]*)$', 1) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg'
  WHEN 'webp' THEN 'image/webp' WHEN 'bmp' THEN 'image/bmp' WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff' ELSE 'application/octet-stream' END AS mime
FROM pages""")
def mime_from_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.image_type("url").alias("mime"))


@query("SELECT lang, sum(length(text))::BIGINT AS chars, count(*) AS docs FROM documents GROUP BY lang")
def text_length_by_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.count(F.lit(1)).alias("docs"))


@query(r"""
SELECT quality, count(*) AS docs, sum(n)::BIGINT AS alphanumerics FROM (
  SELECT n, CASE WHEN n > 500 THEN 'text_rich' WHEN n >= 50 THEN 'text_sparse' ELSE 'image_only' END AS quality
  FROM (SELECT length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS n FROM documents)) GROUP BY quality""")
def text_quality(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "documents").select(T.alphanumerics("text").alias("n"))
    return counted.groupBy(T.text_quality(F.col("n")).alias("quality")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").cast("long").alias("alphanumerics"))


@query(f"SELECT doc_id, {sql_collapse('text')} AS text FROM documents")
def collapse_white_space(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.collapse("text").alias("text"))


@query(f"SELECT doc_id, substring({sql_trim(chr(39).join(['translate(text, chr(13) || chr(10), ', '  ', ')']))}, 1, 200) AS cell FROM documents")
def cell_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.cell_text("text", 200).alias("cell"))


@query("SELECT doc_id, translate(replace(text, '|', '\\|'), chr(13) || chr(10), '  ') AS cell FROM documents")
def markdown_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.markdown_cell("text").alias("cell"))


@query(r"""
SELECT page_id, regexp_replace(trim(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[^A-Za-z0-9._ -]', '_', 'g')), '^\.+|\.+$', '', 'g') AS raw_name,
  CASE WHEN raw_name = '' THEN 'file' ELSE raw_name END AS safe_name FROM pages""".replace("AS raw_name,", "AS raw_name,"))
def safe_file_names(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "pages").select("page_id", T.base_name("url").alias("_b"))
    raw = F.regexp_replace(F.trim(F.regexp_replace("_b", r"[^A-Za-z0-9._ -]", "_")), r"^\.+|\.+$", "")
    return named.select("page_id", raw.alias("raw_name"), T.safe_file_name("_b").alias("safe_name"))


@query("""
SELECT p_partkey, CASE WHEN i >= 702 THEN chr(65 + ((i - 702) // 676) % 26) ELSE '' END || CASE WHEN i >= 26 THEN chr(65 + (i // 26 - 1) % 26) ELSE '' END || chr(65 + i % 26)
  || (p_size + 1)::VARCHAR AS ref FROM (SELECT p_partkey, p_size, (p_partkey % 900)::INT AS i FROM part)""")
def a1_reference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.cell_reference(F.col("p_size"), F.col("p_partkey") % 900).alias("ref"))


@query("SELECT p_partkey, (p_partkey % 900)::INT AS back FROM part")
def column_name_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.column_index(T.column_name(F.col("p_partkey") % 900)).cast("int").alias("back"))


@query("""
WITH s AS (SELECT o_orderkey, date_diff('day', DATE '1899-12-30', o_orderdate::DATE) + (o_orderkey % 24) / 24.0 AS serial FROM orders)
SELECT o_orderkey, strftime(DATE '1899-12-30' + (floor(serial)::INT - 1), '%Y-%m-%d') || ' ' || lpad((round((serial - floor(serial)) * 86400)::INT // 3600)::VARCHAR, 2, '0') || ':00:00' AS iso FROM s""")
def excel_serial(spark: SparkSession, sf: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    serial = days + (F.col("o_orderkey") % 24) / F.lit(24.0)
    return table(spark, sf, "orders").select("o_orderkey", N.serial_to_iso(serial, F.lit("datetime")).alias("iso"))


_CODES = [(14, "General"), (20, "General"), (22, "General"), (0, "yyyy-mm-dd"), (0, "[h]:mm:ss"), (0, '"days" 0'), (0, "dd/mm/yy hh:mm"), (0, "0.00%"), (0, "mmm")]


@query("""
SELECT r_regionkey, id AS format_id, code, kind FROM region, (VALUES (14,'General','date'),(20,'General','time'),(22,'General','datetime'),(0,'yyyy-mm-dd','date'),
 (0,'[h]:mm:ss','time'),(0,'"days" 0',NULL),(0,'dd/mm/yy hh:mm','datetime'),(0,'0.00%',NULL),(0,'mmm',NULL)) v(id, code, kind)""")
def number_format_kinds(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.array(*[F.struct(F.lit(i).alias("format_id"), F.lit(c).alias("code")) for i, c in _CODES])
    rows = table(spark, sf, "region").select("r_regionkey", F.explode(codes).alias("_c")).select("r_regionkey", "_c.*")
    return rows.withColumn("kind", N.format_kind("format_id", "code"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN t || '%' WHEN 1 THEN '$' || t WHEN 2 THEN t || ' kg' ELSE t END AS shown
FROM (SELECT p_partkey, p_size, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS t FROM part)""")
def values_with_units(spark: SparkSession, sf: str) -> DataFrame:
    code = F.element_at(F.array(F.lit("0.0%"), F.lit('"$"0'), F.lit('0 "kg"'), F.lit("0")), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.with_unit(F.col("p_retailprice"), T.unit_of_format(code)).alias("shown"))


@query(f"SELECT page_id, {sql_collapse(chr(39).join(['translate(html, ', '<>', ', ', '  ', ')']))} AS text, (contains(html, '<p') OR contains(html, '<div') OR contains(html, '<h') OR contains(html, '</')) AS is_html FROM pages")
def html_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.html_fallback("html").alias("text"), T.is_html("html").alias("is_html"))


@query(r"""
SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS urls FROM pages""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.array_sort(F.array_distinct(found)).alias("urls"))


def _sql_clean(x: str) -> str:
    """The rules of cleaned text, digit run by digit run: RE2 has no lookaround, so runs are taken out and judged."""
    joined = rf"regexp_replace({x}, '[-\x{{2010}}\x{{2011}}\x{{2012}}\x{{2013}}\x{{AD}}][ \t]*\r?\n[ \t]*(\p{{Ll}})', '\1', 'g')"
    month, day = "substr(d, 5, 2) BETWEEN '01' AND '12'", "substr(d, 7, 2) BETWEEN '01' AND '31'"
    return f"""trim(array_to_string(list_transform(regexp_extract_all({sql_collapse(joined)}, '[0-9]+|[^0-9]+'), lambda d:
  CASE WHEN NOT regexp_full_match(d, '[0-9]{{6,9}}') OR substr(d, 1, 4) NOT BETWEEN '1900' AND '2100' THEN d
  WHEN length(d) = 6 AND {month} THEN substr(d, 1, 4) || '-' || substr(d, 5)
  WHEN length(d) = 8 AND {month} AND {day} THEN substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7)
  ELSE substr(d, 1, 4) || ' ' || substr(d, 5) END), ''))"""


_CLEAN = f"SELECT doc_id, {_sql_clean('text')} AS text FROM documents"
_GLUED = "'hydro-' || chr(10) || ' gen 203070 202312 20250131 ' || text"


@query(f"SELECT doc_id, {_sql_clean(_GLUED)} AS text FROM documents")
def clean_pdf_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts behind a few cases that they do not hold themselves."""
    glued = F.concat(F.lit("hydro-\n gen 203070 202312 20250131 "), "text")
    return table(spark, sf, "documents").select("doc_id", T.clean_pdf_text(glued).alias("text"))


@query(_CLEAN)
def clean_pdf_text_whole(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.clean_pdf_text("text").alias("text"))


# --- spreadsheet operators -----------------------------------------------------------------------


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderstatus, o_orderkey, rn AS actual_row, row_number() OVER (PARTITION BY o_orderstatus ORDER BY rn) AS sample_row
FROM n WHERE rn <= 900 OR rn > n - 100 OR n <= 1000""")
def head_tail_sample(spark: SparkSession, sf: str) -> DataFrame:
    kept = sheet.head_tail(table(spark, sf, "orders"), ["o_orderstatus"], ["o_orderkey"], 1000, 100)
    return kept.select("o_orderstatus", "o_orderkey", F.col("actual_row").cast("long"), F.col("sample_row").cast("long"))


@query("""
SELECT l_returnflag, w AS "window", count(*) AS rows_n, min(l_orderkey) AS first_key FROM (
 SELECT l_returnflag, l_orderkey, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // 500 AS w FROM lineitem) GROUP BY 1, 2""")
def cap_windows(spark: SparkSession, sf: str) -> DataFrame:
    cut = sheet.cap_windows(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 500)
    return cut.groupBy("l_returnflag", "window").agg(F.count(F.lit(1)).alias("rows_n"), F.min("l_orderkey").alias("first_key"))


@query("""
WITH f AS (SELECT event_id // 1000 AS sheet, event_id AS r FROM events WHERE event_type <> 'error'),
 g AS (SELECT *, coalesce((r - lag(r) OVER (PARTITION BY sheet ORDER BY r) > 2)::INT, 0) AS new FROM f),
 i AS (SELECT *, sum(new) OVER (PARTITION BY sheet ORDER BY r) + 1 AS region FROM g)
SELECT sheet, region::BIGINT AS region, min(r) AS first_row, max(r) + 1 AS end_row FROM i GROUP BY 1, 2""")
def region_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("event_type <> 'error'").select(F.floor(F.col("event_id") / 1000).alias("sheet"), F.col("event_id").alias("r"))
    return sheet.region_bounds(rows, ["sheet"], gap=2).withColumn("region", F.col("region").cast("long"))


_PART_CELLS = """
 SELECT (p_partkey // 100)::BIGINT AS sheet, (p_partkey % 100)::INT AS r, c, CASE c WHEN 0 THEN p_name WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN NULL WHEN 3 THEN p_type
   WHEN 4 THEN CASE WHEN p_size > 45 THEN p_brand ELSE '' END WHEN 5 THEN p_brand ELSE (floor(p_retailprice)::INT)::VARCHAR END AS text
 FROM part, (SELECT unnest(range(7))::INT AS c)"""


def part_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as sheets of a hundred rows and seven columns, one of them empty and one sparse."""
    values = ["p_name", "p_size", None, "p_type", "_brand", "p_brand", "_price"]
    rows = table(spark, sf, "part").withColumns({"_brand": F.when(F.col("p_size") > 45, F.col("p_brand")).otherwise(""), "_price": F.floor("p_retailprice").cast("int")})
    cells = F.posexplode(F.array(*[F.col(v).cast("string") if v else F.lit(None).cast("string") for v in values]))
    return rows.select(F.floor(F.col("p_partkey") / 100).alias("sheet"), (F.col("p_partkey") % 100).cast("int").alias("r"), cells.alias("c", "text"))


@query(f"""SELECT sheet, min(r) AS min_r, max(r) AS max_r, min(c) AS min_c, max(c) AS max_c FROM ({_PART_CELLS}) WHERE coalesce(trim(text), '') <> '' GROUP BY sheet""")
def used_extents(spark: SparkSession, sf: str) -> DataFrame:
    return sheet.used_extent(part_cells(spark, sf), ["sheet"])


@query(f"""
WITH n AS (SELECT sheet, c, count(*) AS n FROM ({_PART_CELLS}) WHERE coalesce(trim(text), '') <> '' GROUP BY ALL),
 d AS (SELECT *, coalesce((c - lag(c) OVER (PARTITION BY sheet ORDER BY c) > 1)::INT, 0) AS new FROM n WHERE n > 2),
 i AS (SELECT *, sum(new) OVER (PARTITION BY sheet ORDER BY c) + 1 AS block FROM d),
 b AS (SELECT sheet, block, min(c) AS lo, max(c) + 1 AS hi FROM i GROUP BY 1, 2)
SELECT sheet, block::BIGINT AS block, CASE WHEN block = 1 THEN 0 ELSE lo END::INT AS first_column,
 CASE WHEN block = max(block) OVER (PARTITION BY sheet) THEN 7 ELSE hi END::INT AS end_column FROM b""")
def column_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return sheet.column_blocks(part_cells(spark, sf), ["sheet"], 100, 7).withColumn("block", F.col("block").cast("long"))


@query(f"""
WITH x AS ({_PART_CELLS}) SELECT sheet, count(*) AS cells, count(DISTINCT c) AS columns_n FROM x
WHERE (sheet, c) IN (SELECT (sheet, c) FROM x WHERE coalesce(trim(text), '') <> '') GROUP BY sheet""")
def drop_empty_columns(spark: SparkSession, sf: str) -> DataFrame:
    kept = sheet.drop_empty_columns(part_cells(spark, sf), ["sheet"])
    return kept.groupBy("sheet").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("c").alias("columns_n"))


_SQL_NUMBER = r"regexp_full_match(trim(text), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')"
_PROFILE = f"""SELECT sheet, r, count(*) FILTER (f) AS non_empty, count(*) FILTER (f AND n) AS numeric_like, count(*) FILTER (f AND NOT n) AS string_like
 FROM (SELECT *, coalesce(trim(text), '') <> '' AS f, coalesce({_SQL_NUMBER}, false) AS n FROM ({_PART_CELLS})) GROUP BY 1, 2"""


@query(_PROFILE)
def row_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return sheet.row_profile(part_cells(spark, sf), ["sheet"])


@query(f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY r) AS i FROM ({_PROFILE})), a AS (SELECT * FROM p WHERE i = 1), b AS (SELECT * FROM p WHERE i = 2)
SELECT a.sheet, a.non_empty > 0 AND a.string_like * 2 >= a.non_empty AND (b.sheet IS NULL OR b.numeric_like > 0 OR a.numeric_like = 0) AS has_header FROM a LEFT JOIN b USING (sheet)""")
def header_inference(spark: SparkSession, sf: str) -> DataFrame:
    return sheet.has_header(part_cells(spark, sf), ["sheet"])


_TOTALS = f"""SELECT sheet, r, c, CASE WHEN c = 0 AND r % 10 = 9 THEN 'Grand Total' WHEN r % 25 = 0 THEN 'h' || c ELSE text END AS text FROM ({_PART_CELLS})"""


def marked_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Part cells with a total in every tenth row and the header again every twenty-fifth."""
    text = F.when((F.col("c") == 0) & (F.col("r") % 10 == 9), "Grand Total").when(F.col("r") % 25 == 0, F.concat(F.lit("h"), "c")).otherwise(F.col("text"))
    return part_cells(spark, sf).withColumn("text", text)


@query(f"""
WITH x AS ({_TOTALS}), f AS (SELECT *, row_number() OVER (PARTITION BY sheet, r ORDER BY c) AS i FROM x WHERE coalesce(trim(text), '') <> ''),
 s AS (SELECT sheet, r, max((contains(lower(text), 'total'))::INT) = 1 AS says FROM f WHERE i <= 2 GROUP BY 1, 2),
 p AS (SELECT sheet, r, count(*) AS ne, count(*) FILTER ({_SQL_NUMBER}) AS nu FROM f GROUP BY 1, 2)
SELECT sheet, r, says AND ne >= 2 AND (nu > 0 OR (ne - nu) * 2 <= ne) AS is_total FROM s JOIN p USING (sheet, r)""")
def total_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sheet.total_rows(marked_cells(spark, sf), ["sheet"])


@query(f"""
WITH f AS (SELECT *, min(r) OVER (PARTITION BY sheet) AS top FROM ({_TOTALS}) WHERE coalesce(trim(text), '') <> ''),
 h AS (SELECT sheet, c, lower(trim(text)) AS h FROM f WHERE r = top), n AS (SELECT sheet, count(*) AS n FROM h GROUP BY 1),
 s AS (SELECT f.sheet, f.r, count(*) FILTER (lower(trim(f.text)) = h) AS same FROM f JOIN h USING (sheet, c) WHERE f.r > f.top GROUP BY 1, 2),
 p AS (SELECT sheet, r, count(*) AS ne, count(*) FILTER ({_SQL_NUMBER}) AS nu FROM f GROUP BY 1, 2)
SELECT sheet, r, same * 10 >= n * 8 AND ne - nu >= nu AS repeats_header FROM s JOIN n USING (sheet) JOIN p USING (sheet, r)""")
def repeated_headers(spark: SparkSession, sf: str) -> DataFrame:
    return sheet.repeated_headers(marked_cells(spark, sf), ["sheet"])


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS k FROM events),
 n AS (SELECT *, nullif(trim(k), '') AS nk FROM e),
 f AS (SELECT *, coalesce(last_value(nk IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
   first_value(nk IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS kk FROM n),
 g AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND kk IS DISTINCT FROM lag(kk) OVER w THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 s AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY event_id) + 1)::BIGINT AS segment FROM g)
SELECT user_id, segment, count(*) AS rows_n, min(kk) AS segment_key FROM s GROUP BY 1, 2""")
def group_by_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("k"))
    segments = sheet.key_segments(rows, ["user_id"], "event_id", "k")
    return segments.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("rows_n"), F.min("segment_key").alias("segment_key"))


@query()
def row_segments(spark: SparkSession, sf: str) -> DataFrame:
    cells = marked_cells(spark, sf)
    flags = sheet.total_rows(cells, ["sheet"]).join(sheet.repeated_headers(cells, ["sheet"]), ["sheet", "r"])
    return sheet.row_segments(flags, ["sheet"], 20)


@query(f"""
SELECT sheet, list(line ORDER BY r) AS lines FROM (SELECT sheet, r, string_agg(coalesce(text, ''), '|' ORDER BY c) AS line FROM ({_PART_CELLS}) GROUP BY 1, 2) GROUP BY 1""")
def grid_to_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = sheet.table_rows(part_cells(spark, sf), ["sheet"])
    return rows.select("sheet", F.transform("rows", lambda r: F.array_join(r, "|")).alias("lines"))


# --- joins, graphs, trees ------------------------------------------------------------------------


@query("""
WITH r AS (SELECT c_custkey AS slide, c_custkey * 40 AS lo, c_custkey * 40 + 60 AS hi FROM customer)
SELECT o_orderkey, min(slide) AS slide FROM orders LEFT JOIN r ON o_orderkey BETWEEN lo AND hi GROUP BY 1""")
def range_join(spark: SparkSession, sf: str) -> DataFrame:
    ranges = table(spark, sf, "customer").select(F.lit(1).alias("k"), F.col("c_custkey").alias("slide"), (F.col("c_custkey") * 40).alias("lo"), (F.col("c_custkey") * 40 + 60).alias("hi"))
    points = table(spark, sf, "orders").select(F.lit(1).alias("k"), "o_orderkey")
    return graph.first_match_range(points, ranges, ["k"], "o_orderkey", "lo", "hi", "slide").select("o_orderkey", "slide")


@query("""
SELECT c_custkey, coalesce(n_name, '?') AS nation, coalesce(r_name, '?') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def relationship_join_all(spark: SparkSession, sf: str) -> DataFrame:
    """With all nations."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    c = c.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.select("c_custkey", F.coalesce("n_name", F.lit("?")).alias("nation"), F.coalesce("r_name", F.lit("?")).alias("region"))


_BOXES = "SELECT s_suppkey, s_nationkey, (s_suppkey % 37)::INT AS r0, (s_suppkey % 37 + s_suppkey % 5)::INT AS r1, (s_suppkey % 11)::INT AS c0, (s_suppkey % 11 + s_suppkey % 3)::INT AS c1 FROM supplier"


@query(f"""
WITH b AS ({_BOXES}) SELECT s_suppkey FROM b x WHERE s_suppkey % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM b y WHERE y.s_suppkey % 4 = 0 AND x.s_nationkey = y.s_nationkey
 AND x.r0 <= y.r1 AND y.r0 <= x.r1 AND x.c0 <= y.c1 AND y.c0 <= x.c1)""")
def rectangle_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    boxes = table(spark, sf, "supplier").select(
        "s_suppkey", "s_nationkey", *[x.cast("int").alias(n) for n, x in (("r0", k % 37), ("r1", k % 37 + k % 5), ("c0", k % 11), ("c1", k % 11 + k % 3))]
    )
    return graph.rectangles_free_of(boxes.where("s_suppkey % 4 <> 0"), boxes.where("s_suppkey % 4 = 0"), ["s_nationkey"]).select("s_suppkey")


_POINTS = "SELECT vec_id, label, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y FROM embeddings"


@query(f"""
WITH p AS ({_POINTS}), d AS (SELECT a.vec_id, b.vec_id AS node_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.label = b.label WHERE a.vec_id <> b.vec_id)
SELECT vec_id, arg_min(node_id, (d, node_id)) AS node_id, round(min(d), 6) AS distance FROM d WHERE d <= 120 GROUP BY 1""")
def nearest_snap_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector against all the others."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", *[(F.col("embedding")[i].cast("double") * 1000).alias(n) for i, n in enumerate("xy")])
    nodes = e.select("label", F.col("vec_id").alias("ord"), F.col("vec_id").alias("node_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    found = graph.snap(e, nodes, ["label"], "vec_id", others=True)
    return found.select("vec_id", "node_id", F.round("distance", 6).alias("distance"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unattached_nodes_all(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without any order."""
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id"), "c_nationkey", F.lit(1).alias("k"))
    edges = table(spark, sf, "orders").select(F.col("o_custkey").alias("from_id"), F.col("o_custkey").alias("to_id"), F.lit(1).alias("k"))
    return graph.unattached(nodes, edges, ["k"]).select(F.col("node_id").alias("c_custkey"), "c_nationkey")


@query("""
WITH n AS (SELECT r_regionkey AS id, r_name AS label FROM region UNION ALL SELECT 100 + n_nationkey, n_name FROM nation),
 l AS (SELECT 0 AS k, id AS a, 0 AS b, '  n' || id || '@{ shape: rect, label: "' || label || '" }' AS line FROM n
  UNION ALL SELECT 1, n_regionkey, 100 + n_nationkey, '  n' || n_regionkey || ' --> n' || (100 + n_nationkey) FROM nation)
SELECT 'flowchart TD' || chr(10) || string_agg(line, chr(10) ORDER BY k, a, b) AS mermaid FROM l WHERE k = 1 OR a >= 100 OR a IN (SELECT n_regionkey FROM nation)""")
def mermaid_text(spark: SparkSession, sf: str) -> DataFrame:
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    nodes = region.select(F.lit(1).alias("k"), F.col("r_regionkey").cast("long").alias("node_id"), F.col("r_name").alias("label"), F.lit("rect").alias("shape")).unionByName(
        nation.select(F.lit(1).alias("k"), (F.col("n_nationkey") + 100).cast("long").alias("node_id"), F.col("n_name").alias("label"), F.lit("rect").alias("shape"))
    )
    edges = nation.select(F.lit(1).alias("k"), F.col("n_regionkey").cast("long").alias("from_id"), (F.col("n_nationkey") + 100).cast("long").alias("to_id"), F.lit("forward").alias("direction"), F.lit("").alias("label"))
    return graph.mermaid(nodes, edges, ["k"]).select("mermaid")


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations and customers as a forest."""
    r, n, c = (table(spark, sf, x) for x in ("region", "nation", "customer"))
    node = lambda df, p, k, parent, title: df.select(
        F.lit(1).alias("doc_id"), F.concat(F.lit(p), k).alias("node_id"), parent.alias("parent_id"), F.col(k).cast("int").alias("ord"), F.col(title).alias("title")
    )
    return (
        node(r, "R", "r_regionkey", F.lit(None).cast("string"), "r_name")
        .unionByName(node(n, "N", "n_nationkey", F.concat(F.lit("R"), "n_regionkey"), "n_name"))
        .unionByName(node(c, "C", "c_custkey", F.concat(F.lit("N"), "c_nationkey"), "c_name"))
    )


@query("""
WITH RECURSIVE n AS (SELECT 'R' || r_regionkey AS id, NULL AS parent, r_regionkey::INT AS ord, r_name AS title FROM region UNION ALL
  SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_nationkey::INT, n_name FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_custkey::INT, c_name FROM customer),
 t AS (SELECT id, title, 0 AS depth, lpad(ord::VARCHAR, 8, '0') AS path FROM n WHERE parent IS NULL UNION ALL
  SELECT n.id, n.title, t.depth + 1, t.path || '.' || lpad(n.ord::VARCHAR, 8, '0') FROM n JOIN t ON n.parent = t.id)
SELECT id AS node_id, title, depth, path FROM t""")
def tree_flatten(spark: SparkSession, sf: str) -> DataFrame:
    flat = trees.flatten(places(spark, sf))
    path = F.array_join(F.transform("path", lambda p: F.lpad(p.cast("string"), 8, "0")), ".")
    return flat.select("node_id", "title", "depth", path.alias("path"))


@query("""
WITH c AS (SELECT c_nationkey AS k, string_agg('{"title":' || to_json(c_name)::VARCHAR || ',"children":[]}', ',' ORDER BY c_custkey) AS j FROM customer GROUP BY 1),
 n AS (SELECT n_regionkey AS k, string_agg('{"title":' || to_json(n_name)::VARCHAR || ',"children":[' || coalesce(j, '') || ']}', ',' ORDER BY n_nationkey) AS j
 FROM nation LEFT JOIN c ON n_nationkey = k GROUP BY 1)
SELECT 'R' || r_regionkey AS node_id, '{"title":' || to_json(r_name)::VARCHAR || ',"children":[' || coalesce(j, '') || ']}' AS json FROM region LEFT JOIN n ON r_regionkey = k""")
def tree_json(spark: SparkSession, sf: str) -> DataFrame:
    return trees.nested_json(trees.flatten(places(spark, sf))).select("node_id", "json")


@query("""
WITH s AS (SELECT o_orderpriority AS series, o_orderstatus AS category, count(*) AS v FROM orders GROUP BY 1, 2)
SELECT series, list(v::VARCHAR ORDER BY category) AS cells FROM s GROUP BY 1""")
def chart_pivot(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("value")).select(
        F.lit(1).alias("k"), F.col("o_orderpriority").alias("series_no"), F.col("o_orderpriority").alias("series"), F.col("o_orderstatus").alias("cat_idx"), F.col("value").cast("double").alias("value")
    )
    return graph.chart_table(points, ["k"]).select("series", "cells")


@query("""
SELECT user_id, max(CASE reason WHEN 'connectors' THEN 0.95::DOUBLE WHEN 'chart' THEN 0.9 WHEN 'smartart' THEN 0.9 WHEN 'groups' THEN 0.8 ELSE 0.7 END) AS score, list_sort(list(DISTINCT reason)) AS reasons
FROM (SELECT user_id, ['connectors', 'chart', 'smartart', 'groups', 'images'][(event_id % 5)::INT + 1] AS reason FROM events) GROUP BY 1""")
def slide_score(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("connectors", "chart", "smartart", "groups", "images")])
    reasons = table(spark, sf, "events").select("user_id", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("reason"))
    return graph.slide_scores(reasons, ["user_id"])


# --- layout --------------------------------------------------------------------------------------


@query("""
SELECT l_returnflag, round(coalesce(median(CASE WHEN l_quantity > 10 THEN l_quantity END), 12.0), 6) AS body_size, round(median(l_extendedprice), 6) AS overall FROM lineitem GROUP BY 1""")
def median_font(spark: SparkSession, sf: str) -> DataFrame:
    large = F.when(F.col("l_quantity") > 10, F.col("l_quantity"))
    found = numbering.medians(table(spark, sf, "lineitem"), ["l_returnflag"], {"body_size": large, "overall": F.col("l_extendedprice")})
    return found.select("l_returnflag", F.round("body_size", 6).alias("body_size"), F.round("overall", 6).alias("overall"))


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000 AS y FROM events),
 g AS (SELECT *, coalesce((abs(y - lag(y) OVER (PARTITION BY user_id ORDER BY y, event_id)) > 3600)::INT, 0) AS new FROM e),
 p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY y, event_id ROWS UNBOUNDED PRECEDING) + 1 AS paragraph FROM g)
SELECT user_id, paragraph::BIGINT AS paragraph, count(*) AS events_n FROM p GROUP BY 1, 2""")
def gap_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("y"))
    groups = layout.gap_groups(e, ["user_id"], ["y", "event_id"], F.col("y"), F.lit(3600))
    return groups.groupBy("user_id", F.col("paragraph").cast("long")).agg(F.count(F.lit(1)).alias("events_n"))


_LINES = "SELECT doc_id, i - 1 AS line_no, list_extract(string_split(text, chr(10)), i) AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"


@query(f"""
SELECT doc_id, count(*) AS prefix FROM (SELECT doc_id, min((length(line) >= 20)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS ok FROM ({_LINES})) WHERE ok = 1 GROUP BY 1""")
def cover_prefix(spark: SparkSession, sf: str) -> DataFrame:
    lines = document_text.lines(table(spark, sf, "documents"))
    return layout.prefix_while(lines, ["doc_id"], ["line_no"], F.length("line") >= 20).groupBy("doc_id").agg(F.count(F.lit(1)).alias("prefix"))


_SMALL = ", ".join(f"'{w}'" for w in T.SMALL_WORDS)


def _sql_heading(rows: str, keys: str) -> str:
    """Which lines (column t, trimmed) look like headings, word by word."""
    return rf"""
WITH l AS ({rows}),
 w AS (SELECT *, list_transform(list_filter(list_transform(regexp_split_to_array(t, '{SQL_WS}+'), lambda x: regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')),
   lambda x: lower(x) NOT IN ({_SMALL})), lambda x: regexp_replace(x, '[^A-Za-z]', '', 'g')) AS bare FROM l),
 c AS (SELECT *, list_filter(bare, lambda x: x <> '') AS sig FROM w)
SELECT {keys}, length(t) <= 180 AND NOT suffix(t, '.') AND len(sig) >= 2 AND (len(list_filter(sig, lambda x: regexp_full_match(x, '[A-Z]+|[A-Z][a-z]*'))) * 100 >= len(sig) * 70
 OR length(regexp_replace(array_to_string(sig, ''), '[^A-Z]', '', 'g')) * 100 >= length(array_to_string(sig, '')) * 85) AS is_heading FROM c"""


@query(_sql_heading(f"SELECT doc_id, line_no, {sql_trim('line')} AS t FROM ({_LINES})", "doc_id, line_no"))
def heading_like_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of each document, not only the first."""
    return document_text.lines(table(spark, sf, "documents")).select("doc_id", "line_no", T.looks_like_heading("line").alias("is_heading"))


_TURNS = "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '- ' || text WHEN 1 THEN turn || '. ' || text ELSE text END AS line FROM conversations"


@query(rf"""
WITH l AS (SELECT conv_id, turn, i - 1 AS line_no, list_extract(string_split(line, chr(10)), i) AS line FROM (SELECT *, unnest(range(1, len(string_split(line, chr(10))) + 1)) AS i FROM ({_TURNS}))),
 i AS (SELECT *, coalesce(nullif(regexp_extract(line, '^\s*[•*–—-]\s+(\S.*)$', 1), ''), nullif(regexp_extract(line, '^\s*[0-9]{{1,8}}[.)]\s*(\S.*)$', 1), '')) AS item FROM l)
SELECT conv_id, turn, line_no, item, (item IS NOT NULL AND regexp_matches(line, '^\s*[0-9]{{1,8}}[.)]')) AS ordered FROM i""")
def list_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of each turn, a marker put before two of three turns."""
    m = F.col("turn") % 3
    marked = F.when(m == 0, F.concat(F.lit("- "), "text")).when(m == 1, F.concat("turn", F.lit(". "), "text")).otherwise(F.col("text"))
    lines = document_text.lines(table(spark, sf, "conversations").withColumn("text", marked), ["conv_id", "turn"])
    return lines.select("conv_id", "turn", "line_no", T.list_item("line").alias("item"), (T.list_item("line").isNotNull() & T.is_ordered_item("line")).alias("ordered"))


@query(r"""
WITH l AS (SELECT conv_id, turn, i - 1 AS line_no, list_extract(string_split(text, chr(10)), i) AS line FROM (SELECT conv_id, turn, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations)),
 i AS (SELECT *, coalesce(nullif(regexp_extract(line, '^\s*[•*–—-]\s+(\S.*)$', 1), ''), nullif(regexp_extract(line, '^\s*[0-9]{1,8}[.)]\s*(\S.*)$', 1), '')) AS item FROM l)
SELECT conv_id, turn, line_no, item, (item IS NOT NULL AND regexp_matches(line, '^\s*[0-9]{1,8}[.)]')) AS ordered FROM i""")
def list_item_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of each turn as it stands, without a marker put before it."""
    lines = document_text.lines(table(spark, sf, "conversations"), ["conv_id", "turn"])
    return lines.select("conv_id", "turn", "line_no", T.list_item("line").alias("item"), (T.list_item("line").isNotNull() & T.is_ordered_item("line")).alias("ordered"))


@query(f"""
WITH p AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(trim(replace(line, ' | ', chr(9))), '\\t| {{2,}}'), lambda x: trim(x) <> '') AS parts FROM ({_LINES}))
SELECT doc_id, line_no, len(parts) AS columns_n FROM p WHERE len(parts) >= 2""")
def table_like_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = document_text.lines(table(spark, sf, "documents")).withColumn("_p", T.table_columns(F.replace("line", F.lit(" | "), F.lit("\t"))))
    return lines.where("_p is not null").select("doc_id", "line_no", F.size("_p").cast("long").alias("columns_n"))


# --- images, JSON, rendering ---------------------------------------------------------------------


@query("""
SELECT source, 'sha256:' || sha256(text) AS image_id, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2""")
def image_dedup(spark: SparkSession, sf: str) -> DataFrame:
    images = table(spark, sf, "documents").select("source", "doc_id", F.col("text").cast("binary").alias("bytes"))
    return assets.first_copies(images, ["source"], ["doc_id"]).select("source", "image_id", "doc_id")


@query("""
WITH n AS (SELECT doc_id, lang, source || '.png' AS f, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS no FROM documents)
SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang, f ORDER BY no) = 1 THEN f ELSE lpad(no::VARCHAR, greatest(4, len(no::VARCHAR))::INT, '0') || '_' || f END AS asset_name FROM n""")
def asset_names(spark: SparkSession, sf: str) -> DataFrame:
    images = table(spark, sf, "documents").select("doc_id", "lang", F.concat("source", F.lit(".png")).alias("filename"), F.lit("image/png").alias("content_type"), F.lit("sha256:00").alias("image_id"))
    return assets.asset_names(images, ["lang"], ["doc_id"]).select("doc_id", "lang", "asset_name")


@query("""
SELECT event_id, json_keys(props)[1] AS key, (props ->> ('$.' || json_keys(props)[1])) AS value FROM events""")
def json_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from inkspan.operators.config import scalar_pairs

    return scalar_pairs(table(spark, sf, "events").select("event_id", "props"), ["event_id"], "props").select("event_id", "key", "value")


@query(f"""
WITH l AS (SELECT doc_id, line_no, {sql_trim('line')} || chr(10) || chr(10) AS md FROM ({_LINES}) WHERE {sql_trim('line')} <> '')
SELECT doc_id, row_number() OVER w - 1 AS block_index, (coalesce(sum(octet_length(encode(md))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS span_start,
 (sum(octet_length(encode(md))) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS span_end FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""")
def span_offsets(spark: SparkSession, sf: str) -> DataFrame:
    blocks = document_text.paragraph_blocks(table(spark, sf, "documents"))
    return render.with_spans(blocks).select("doc_id", "block_index", F.col("span_start").cast("long"), F.col("span_end").cast("long"))


@query(f"""
SELECT doc_id, string_agg({sql_trim('line')} || chr(10) || chr(10), '' ORDER BY line_no) AS markdown FROM ({_LINES}) WHERE {sql_trim('line')} <> '' GROUP BY 1""")
def render_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return render.to_markdown(document_text.paragraph_blocks(table(spark, sf, "documents")))


_CHUNKS = f"""
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, {sql_trim('line')} || chr(10) || chr(10) AS md FROM ({_LINES}) WHERE {sql_trim('line')} <> ''),
w AS (SELECT doc_id, i, 0 AS chunk_no, length(md) AS cur FROM p WHERE i = 1 UNION ALL
 SELECT p.doc_id, p.i, w.chunk_no + (w.cur >= {{n}} OR w.cur + length(p.md) > {{n}})::INT, CASE WHEN w.cur >= {{n}} OR w.cur + length(p.md) > {{n}} THEN length(p.md) ELSE w.cur + length(p.md) END
 FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)"""


@query(f"""WITH RECURSIVE {_CHUNKS.replace("{n}", "400")}
SELECT doc_id, chunk_no, string_agg(md, '' ORDER BY i) AS content, min(i) - 1 AS block_first, max(i) - 1 AS block_last FROM w JOIN p USING (doc_id, i) GROUP BY 1, 2""")
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    return render.to_chunks(document_text.paragraph_blocks(table(spark, sf, "documents")), 400)


@query(f"""WITH RECURSIVE {_CHUNKS.replace("{n}", "2000")}
SELECT source, count(*) AS chunks, count(DISTINCT doc_id) AS docs FROM (SELECT DISTINCT doc_id, chunk_no FROM w) JOIN documents USING (doc_id) GROUP BY 1""")
def chunks_per_source(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    chunks = render.to_chunks(document_text.paragraph_blocks(docs, "source"), 2000)
    return chunks.groupBy(F.split_part("doc_id", F.lit("/"), F.lit(1)).alias("source")).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("docs"))


@query(f"""
WITH l AS (SELECT doc_id, line_no, {sql_trim('line')} AS t FROM ({_LINES}) WHERE {sql_trim('line')} <> '')
SELECT doc_id, '{{"schema_version":1,"blocks":[' || string_agg('{{"type":"paragraph","text":' || to_json(t)::VARCHAR || '}}', ',' ORDER BY line_no) || ']}}' AS json FROM l GROUP BY 1""")
def json_render(spark: SparkSession, sf: str) -> DataFrame:
    return render.to_json_rows(document_text.paragraph_blocks(table(spark, sf, "documents")))


_KINDS = _sql_heading(f"SELECT doc_id, line_no, {sql_trim('line')} AS t FROM ({_LINES}) WHERE {sql_trim('line')} <> ''", "doc_id, line_no, t")


@query(rf"""
WITH h AS ({_KINDS}),
 k AS (SELECT *, CASE WHEN regexp_matches(t, '^\s*[•*–—-]\s+(\S.*)$') OR regexp_matches(t, '^\s*[0-9]{{1,8}}[.)]\s*(\S.*)$') THEN 'list' WHEN is_heading THEN 'heading' ELSE 'paragraph' END AS block_type FROM h),
 n AS (SELECT block_type, block_type <> 'list' OR lag(block_type, 1, '') OVER (PARTITION BY doc_id ORDER BY line_no) <> 'list' AS new FROM k)
SELECT block_type, count(*) FILTER (new) AS blocks FROM n GROUP BY 1""")
def classified_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return document_text.classified(table(spark, sf, "documents")).groupBy("block_type").agg(F.count(F.lit(1)).alias("blocks"))


@query(f"""
WITH g AS (SELECT sheet, r, string_agg(coalesce(replace(text, '|', '\\|'), ''), ' | ' ORDER BY c) AS line FROM ({_PART_CELLS}) GROUP BY 1, 2)
SELECT sheet, '| ' || string_agg(line, ' |' || chr(10) || '| ' ORDER BY r) || ' |' || chr(10) AS body FROM g GROUP BY 1""")
def table_render(spark: SparkSession, sf: str) -> DataFrame:
    rows = sheet.table_rows(part_cells(spark, sf), ["sheet"])
    cells = F.transform("rows", lambda r: F.transform(r, lambda x: F.struct(x.alias("text"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"))))
    md = rows.select("sheet", render.table_markdown(cells).alias("md"))
    body = F.regexp_replace(F.regexp_replace("md", r"\n\|(---\|)+\n", "\n"), r"\n\n$", "\n")
    return md.select("sheet", body.alias("body"))


@query("""
SELECT o_orderstatus, o_orderpriority, rank, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5""")
def top_of_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.ranked(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"])
    return rows.where("rank <= 5").select("o_orderstatus", "o_orderpriority", F.col("rank").cast("long"), "o_orderkey")


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus, o_orderpriority) AS place
FROM orders GROUP BY 1, 2""")
def grouped_totals(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "o_orderstatus", "o_orderpriority"))
    return g.withColumn("place", place.cast("long"))


#: Names under which queries that once read a part of the rows or lines are known too.
for _name, _whole in {"relationship_join": "relationship_join_all", "nearest_snap": "nearest_snap_all", "unattached_nodes": "unattached_nodes_all", "heading_like": "heading_like_lines"}.items():
    QUERIES[_name], ORACLES[_name] = QUERIES[_whole], ORACLES[_whole]
