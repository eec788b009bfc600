"""Queries that read all rows and whole texts, on small tables written here, against plain Python."""

import re

import duckdb
import pytest

from inkspan.operators import graph
from inkspan.plans import catalog


def small_tables(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


def clean(text):
    """The rules of the cleaned text, digit run by digit run."""
    text = re.sub(r"[-‐-–\xad][ \t]*\r?\n[ \t]*(?=[a-zäöüß])", "", text)
    text = re.sub(r"\s+", " ", text).strip()

    def run(m):
        d = m.group()
        if not 6 <= len(d) <= 9 or not 1900 <= int(d[:4]) <= 2100:
            return d
        month, day = d[4:6], d[6:8]
        if len(d) == 6 and "01" <= month <= "12":
            return f"{d[:4]}-{month}"
        if len(d) == 8 and "01" <= month <= "12" and "01" <= day <= "31":
            return f"{d[:4]}-{month}-{day}"
        return f"{d[:4]} {d[4:]}"

    return re.sub(r"[0-9]+", run, text)


def test_cleaned_text_is_whole(spark, tmp_path):
    body = "word " * 40
    rows = [
        (1, body + "hydro-\n gen 203070 202312 20250131 at the end"), (2, body + "19991 199913 20001301 210012 2101123 123456789 1999123456"),
        (3, "co-\noperate Co-\nOperate soft­\r\n hyphen\n\n" + body + "198712345"), (4, ""), (5, "  \n "),
    ]
    sf = small_tables(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    got = {r.doc_id: r.text for r in catalog.QUERIES["clean_pdf_text_whole"](spark, sf).collect()}
    assert got == {i: clean(t) for i, t in rows}
    assert got[1].endswith("hydrogen 2030 70 2023-12 2025-01-31 at the end")


def test_cleaned_text_of_the_documents(spark, small):
    got = {r.doc_id: r.text for r in catalog.QUERIES["clean_pdf_text_whole"](spark, small).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert got == {i: t if t is None else clean(t) for i, t in texts.items()}


def test_later_headings_count(spark, tmp_path):
    rows = [(1, "plain first line.\nThe Second Part\nmore text follows here\nANNUAL REPORT"), (2, "One Title")]
    sf = small_tables(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.line_no) for r in catalog.QUERIES["heading_like_lines"](spark, sf).collect() if r.is_heading)
    assert got == [(1, 1), (1, 3), (2, 0)]


def test_later_list_items_count(spark, tmp_path):
    rows = [(1, 0, "see\n- one\n2. two\n  • three"), (1, 1, "none")]
    sf = small_tables(spark, tmp_path, conversations=(rows, "conv_id long, turn int, text string"))
    got = sorted((r.turn, r.line_no, r.item, r.ordered) for r in catalog.QUERIES["list_item_lines"](spark, sf).collect() if r.item)
    assert got == [(0, 1, "one", False), (0, 2, "two", True), (0, 3, "three", False)]


def test_every_nation_and_missing_ones(spark, tmp_path):
    customers = [(1, 0), (2, 5), (3, 6), (4, 77), (5, 8)]
    sf = small_tables(
        spark, tmp_path, customer=(customers, "c_custkey long, c_nationkey int"), region=([(1, "R")], "r_regionkey int, r_name string"),
        nation=([(0, "A", 1), (5, "B", 1), (6, "C", 1), (8, "D", 9)], "n_nationkey int, n_name string, n_regionkey int"),
    )
    got = sorted(map(tuple, catalog.QUERIES["relationship_join_all"](spark, sf).collect()))
    assert got == [(1, "A", "R"), (2, "B", "R"), (3, "C", "R"), (4, "?", "?"), (5, "D", "?")]


def test_any_order_attaches_a_customer(spark, tmp_path):
    sf = small_tables(
        spark, tmp_path, customer=([(i, 0) for i in range(1, 6)], "c_custkey long, c_nationkey int"),
        orders=([(1, 1), (2, 2), (3, 3), (4, 1), (5, None)], "o_orderkey long, o_custkey long"),
    )
    assert sorted(r.c_custkey for r in catalog.QUERIES["unattached_nodes_all"](spark, sf).collect()) == [4, 5]


def test_every_vector_snaps_to_the_nearest_other(spark, tmp_path):
    points = [(0, 1, 0, 0), (1, 1, 0, 0), (2, 1, 100, 0), (3, 1, 219, 0), (4, 1, 900, 900), (5, 2, 0, 0), (6, 1, -60, -60), (7, 1, -10, 5), (8, 3, 0, 0), (9, 3, 0, 120.5)]
    sf = small_tables(spark, tmp_path, embeddings=([(i, k, [x / 1000, y / 1000]) for i, k, x, y in points], "vec_id long, label int, embedding array<double>"))
    expected = {}
    for i, k, x, y in points:
        near = [(((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, m, u, v in points if m == k and j != i]
        if near and min(near)[0] <= 120:
            expected[i] = (min(near)[1], round(min(near)[0], 4))
    got = {r.vec_id: (r.node_id, round(r.distance, 4)) for r in catalog.QUERIES["nearest_snap_all"](spark, sf).collect()}
    assert got == expected and len(got) == 6


def same_as_sql(spark, folder, name, suppliers):
    """A query that reads files against its SQL, on one nation with many suppliers."""
    sf = small_tables(
        spark, folder, nation=([(7, "A", 1)], "n_nationkey int, n_name string, n_regionkey int"), region=([(1, "R")], "r_regionkey int, r_name string"),
        supplier=([(i, f"Supplier#{i:09d}", 7, 1.5 * (i % 900 - 100)) for i in range(1, suppliers + 1)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
    )
    con = duckdb.connect()
    for table in ("nation", "region", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", ["read_csv", "read_diagrams", "read_odp", "read_ods", "read_xlsx", "stream_blocks", "read_charts"])
def test_a_long_file_is_read_as_its_sql_says(spark, tmp_path, name):
    same_as_sql(spark, tmp_path, name, 21_000 if name == "read_csv" else 1200)


def test_crowded_nodes_have_small_cells(spark):
    """Clusters of unlike density, copies at one place and points on their own; each finds what a search of all pairs finds."""
    spots = [(i % 30 * 0.4, i // 30 * 0.4) for i in range(600)] + [(50.0, 50.0)] * 40 + [(130.0 + 110 * i, 300.0) for i in range(5)] + [(5000.0, 5000.0)]
    rows = [(1, i, i, x, y) for i, (x, y) in enumerate(spots)]
    nodes = spark.createDataFrame(rows, "k int, ord int, node_id long, cx double, cy double")
    points = nodes.selectExpr("k", "node_id as id", "cx as x", "cy as y")
    assert graph._halvings(nodes.select("k", "cx", "cy").distinct(), ["k"], 120.0) > 4
    for others in (False, True):
        want = {}
        for i, (x, y) in enumerate(spots):
            best = min((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, (u, v) in enumerate(spots) if not (others and i == j))
            if best[0] <= 120:
                want[i] = round(best[0], 6)
        got = {r["id"]: (r["node_id"], r["distance"]) for r in graph.snap(points, nodes, ["k"], "id", others=others).collect()}
        assert {i: round(d, 6) for i, (_, d) in got.items()} == want
        first = lambda i: next(j for j in range(600, 640) if not (others and i == j))
        assert all(got[i][0] == first(i) for i in range(600, 640))
