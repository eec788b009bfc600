"""Fill-in-the-middle against the same rule in plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from inkspan.llm.infill import fill_in_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKS = "<P>", "<S>", "<M>"


def plainly(key, text, seed=42, rate=50, spm=80):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    odd = ["", None, " ", "\n\n", "a", " a", "a ", "x<P>y", "<M>", "<S", "naïve\x00 b", "a b c \x0b\x0c\r\x1c d", "é \U0001d518 ß", "<<P>"]
    made = ["".join(rng.choice(["ab", "ü", " ", "\n", "\t", "<", "P", "𝔘"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    return odd * 8 + made + ["long wörds " * 60_000, "x" * 500_000, " " * 300_000]


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 0), (0, 100)])
def test_every_row_follows_the_rule(spark, rate, spm):
    rows = [(i, t) for i, t in enumerate(texts())]
    out = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rate=rate, spm=spm).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, r.text, 42, rate, spm)
        assert r.restored == (r.text or "")
    if rate == 50:
        assert {r.form for r in out} == {"plain", "spm", "psm"}


def test_null_ids_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(None, "a b c d", 1, "kept", [1]), (7, "a b c d", 2, None, []), (7, "a b c d", 2, None, []), (None, None, 3, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, key string, `odd name` array<int>").selectExpr("*", "'q' AS batch", "1.5D AS output")
    out = fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "key", "odd name", "batch", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = out.collect()
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(map(repr, ((i, *plainly(i, t)) for i, t, *_ in rows)))
    assert sorted(str(r["odd name"]) for r in got) == ["None", "[1]", "[]", "[]"] and {r.batch for r in got} == {"q"}
    empty = fill_in_middle(docs.limit(0))
    assert empty.collect() == [] and empty.columns == out.columns


def test_other_names_and_seed(spark):
    out = fill_in_middle(spark.createDataFrame([("k1", "one two  three")], "id string, body string"), key="id", text="body", seed=5, rate=100).first()
    assert out.output == plainly("k1", "one two  three", 5, 100)[4] and out.restored == out.body
