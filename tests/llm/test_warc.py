"""WARC round trips, and chains past magic inside payloads."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest

from inkspan.llm.warc import MAGIC, candidates, reachable, read_archives, round_trip, write_archives

SCHEMA = "page_id long, url string, html string"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def expected(rows, min_bytes=0):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, _, h in rows:
        d = digest(h)
        first[d] = i if first.get(d) is None else first[d] if i is None else min(first[d], i)
    out = []
    for i, _, h in rows:
        d, n = digest(h), len((h or "").encode())
        revisit = n >= min_bytes and first[d] is not None and i != first[d]
        out.append((i, n, d, "revisit" if revisit else "response", first[d] if revisit else None))
    return sorted(out, key=str)


def run(spark, rows, **options):
    out = round_trip(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted((tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>") for i in range(40)] + [
        (100, None, None), (101, "u", ""), (102, "a b\r\nc", "x\r\n\r\ny"), (103, "u", FAKE), (104, "u", FAKE * 3), (105, "u", "\r\n\r\n" + FAKE + "é日"),
        (None, "u", "nobody else"), (None, "u", "<p>1</p>"), (7, "again", "<p>0</p>"), (0, "same", "<p>0</p>"), (-5, "u", "minus"),
        (106, "u", "WARC/1.1\r\n"), (107, "u", "Content-Length: 5\r\n\r\n"), (108, "u", "long " * 200_000),
    ]
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows, min_bytes=9) == expected(rows, 9)


def test_payloads_and_urls_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    rows = [(1, "http://a", "one"), (2, None, FAKE), (3, "c d", "one")]
    write_archives(spark.createDataFrame(rows, SCHEMA), path, pages_per_archive=2)
    out = {r.record_id: r for r in read_archives(spark, path).collect()}
    assert out["<urn:page:1>"].url == "http://a" and out["<urn:page:2>"].url == "urn:page:2" and out["<urn:page:3>"].url == "c%20d"
    assert out["<urn:page:2>"].payload_bytes == len(FAKE) and out["<urn:page:3>"].refers == "<urn:page:1>"


def test_broken_chain(spark, tmp_path):
    (tmp_path / "a").mkdir()
    good = FAKE.replace("666", "1").encode()
    (tmp_path / "a/part.txt").write_bytes(good + good[:-5])
    with pytest.raises(Exception, match="does not reach the end"):
        read_archives(spark, f"file://{tmp_path}/a").collect()
    assert read_archives(spark, f"file://{tmp_path}/a", strict=False).count() == 2


def test_empty_table(spark):
    assert run(spark, []) == []


def test_candidates_and_reachable():
    data = (FAKE + FAKE.replace("abc", "a" + "WARC/1.1\r\n")).encode()
    found = list(candidates(data))
    assert [f[0] for f in found][:2] == [0, len(FAKE)] and data[: len(MAGIC)] == MAGIC
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(0, 40))
        offsets = np.unique(np.append(rng.integers(0, 200, n), 0 if n % 2 else 1))
        successors = offsets + rng.integers(1, 30, len(offsets))
        to, at, seen = dict(zip(offsets.tolist(), successors.tolist())), 0, set()
        while at in to:
            seen.add(at)
            at = to[at]
        order = rng.permutation(len(offsets))
        assert set(offsets[order][reachable(offsets[order], successors[order])].tolist()) == seen


def test_garbage_is_an_error_unless_lenient(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g/part.warc").write_bytes(b"no record at all")
    with pytest.raises(Exception, match="does not reach the end"):
        read_archives(spark, f"file://{tmp_path}/g").collect()
    assert read_archives(spark, f"file://{tmp_path}/g", strict=False).collect() == []


def test_archives_of_a_member_a_record(spark, tmp_path):
    import gzip

    (tmp_path / "m").mkdir()
    records = [FAKE.replace("666", str(i)).replace("abc", f"a{i}c").encode() for i in range(5)]
    (tmp_path / "m/x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    out = read_archives(spark, f"file://{tmp_path}/m").collect()
    assert sorted(r.record_id for r in out) == [f"<urn:page:{i}>" for i in range(5)]
    assert {r.payload_bytes for r in out} == {3}


def test_clashing_columns_and_an_empty_table(spark):
    schema = SCHEMA + ", value string, _sha1 string, payload_bytes int"
    rows = [(1, "u", "x" * 300_000, "v", "s", 1), (2, "u", "x" * 300_000, "v", "s", 1)]
    out = round_trip(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out) == [(1, 300_000, "response", None), (2, 300_000, "revisit", 1)]
    assert round_trip(spark.createDataFrame([], schema)).collect() == []
