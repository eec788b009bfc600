"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing. A record is text with CRLF lines, so archives are written by Spark's own text writer with the
record terminator (two CRLFs) as line separator, compressed with gzip; they go wherever Spark can write. Of records whose
payloads are equal and of at least ``min_bytes`` bytes, the one with the smallest page_id is a response
and the others are revisits that refer to it and carry no payload.

Reading. A payload may hold anything, a WARC header included. Tasks emit, for every place where a record
could start, its offset (in the archive's own bytes, gzip undone, whether in one member or a member a record)
and the offset its length says comes next. Per archive, pointer jumping from offset 0 (each round doubles the
steps every pointer takes) finds what is reachable; only that is kept. A chain that does not end at the end
of the archive is an error unless ``strict`` is off; so is an archive in which no record could start.

The smallest page_id of a digest is found with a partial aggregate over ids and digests; payloads are dealt
out once, by page, so a payload that a third of the pages share makes no task larger. Memory of a reading
task: one archive, whose size writing bounds by ``pages_per_archive``; Spark's reader takes files of up to
2 GB. The chain of an archive is a list of offsets.

Payloads of any length are written and hashed whole. Columns other than page_id, url and html are ignored,
whatever their names. Nulls: a null html is an empty payload, a null url becomes urn:page:<id>, a null page_id is written as
an empty id and is never the smallest while another id is there. Repeated rows are records of their own;
those with the smallest page_id of their payload are all responses. Empty input writes no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import shared_dir

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of a SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(data)
    groups = []
    for i in range(8):
        n = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        groups += [F.substring(F.lit(BASE32), (F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*groups)


def revisits(ids: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, _bytes, _sha1) -> _id, _of, _first: rows that revisit _first. No payload moves here."""
    large = ids.where(F.col("_bytes") >= min_bytes)
    first = large.groupBy("_sha1").agg(F.min("page_id").alias("_first")).where("_first is not null")
    # Not by the key of the aggregate, so that Spark can split the rows of a payload that many pages share.
    first = first.select(F.reverse("_sha1").alias("_turned"), "_first")
    found = large.withColumn("_turned", F.reverse("_sha1")).join(first, "_turned")
    return found.where(~F.col("page_id").eqNullSafe(F.col("_first"))).select(F.col("page_id").alias("_id"), F.col("_sha1").alias("_of"), "_first").distinct()


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, value: each page's record without its terminator."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("_html"), F.octet_length(html).alias("_bytes"), F.sha1(html.cast("binary")).alias("_sha1"))
    again = revisits(rows.select("page_id", "_bytes", "_sha1"), min_bytes)
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_sha1") == F.col("_of"))
    rows = rows.join(again, same, "left")
    revisit = F.col("_first").isNotNull()
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), name)), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes"), F.lit("\r\n\r\n")
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("_html")))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("_html").cast("binary")),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
            F.col("_first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"),
    )
    return rows.select("page_id", F.concat(header, block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, pages_per_archive: int = 2000) -> None:
    """Archives of at most ``pages_per_archive`` records each under ``path``."""
    out = records(pages, min_bytes).select("value").write.option("lineSep", END).option("maxRecordsPerFile", pages_per_archive).option("compression", "gzip")
    out.mode("errorifexists").text(path)


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", re.I)


def candidates(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(offset, start of the block, offset of the successor) wherever a record could start."""
    at = data.find(MAGIC)
    while at >= 0:
        stop = data.find(b"\r\n\r\n", at)
        length = _LENGTH.search(data, at, stop + 2) if stop >= 0 else None
        if length:
            yield at, stop + 4, stop + 4 + int(length[1]) + len(END)
        at = data.find(MAGIC, at + 1)


def reachable(offsets: np.ndarray, successors: np.ndarray, start: int = 0) -> np.ndarray:
    """Which offsets the chain from ``start`` passes: pointer jumping in log2 rounds."""
    order = np.argsort(offsets)
    offs, n = offsets[order], len(offsets)
    to = np.searchsorted(offs, successors[order])
    ok = (to < n) & (offs[np.minimum(to, n - 1)] == successors[order]) if n else np.zeros(0, bool)
    jump = np.append(np.where(ok, to, n), n)  # n: nowhere
    seen = np.zeros(n + 1, bool)
    first = np.searchsorted(offs, start)
    if first < n and offs[first] == start:
        seen[first] = True
        while True:
            before = seen.sum()
            seen[jump[np.flatnonzero(seen)]] = True
            jump = jump[jump]
            if seen.sum() == before:
                break
    out = np.zeros(n, bool)
    out[order] = seen[:n]
    return out


def _header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


CANDIDATE = (
    "archive string, size long, start long, successor long, record_type string, record_id string, url string, "
    "digest string, refers string, payload_bytes long, payload_digest string"
)


def _archives(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"]):
            yield path, gzip.decompress(data) if path.endswith(".gz") else data


def _offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where records could start and end, and a row of an archive's own with start -1."""
    for path, data in _archives(batches):
        rows = [(path, len(data), at, to) for at, _, to in candidates(data)]
        yield pd.DataFrame([*rows, (path, len(data), -1, -1)], columns=["archive", "size", "start", "successor"]).astype({"archive": object})


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for path, data in _archives(batches):
        rows = []
        for at, block, to in candidates(data):
            h = _header(data[at : block - 4])
            http = data[block : to - len(END)]
            stop = http.find(b"\r\n\r\n")
            body = http[stop + 4 :] if stop >= 0 else http
            declared = _LENGTH.search(http, 0, stop + 2) if stop >= 0 else None
            kind = h.get("warc-type", "")
            own = base64.b32encode(hashlib.sha1(body).digest()).decode()
            rows.append((
                path, len(data), at, to, kind, h.get("warc-record-id", ""), h.get("warc-target-uri", ""),
                h.get("warc-payload-digest", "").removeprefix("sha1:"), h.get("warc-refers-to"),
                int(declared[1]) if kind == "revisit" and declared else len(body), own,
            ))
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATE.split(", ")]).astype({c: object for c in ("archive", "record_type", "record_id", "url", "digest", "refers", "payload_digest")})


def _keep(strict: bool):
    def run(chain: pd.DataFrame) -> pd.DataFrame:
        archive, size = chain["archive"].iloc[0], int(chain["size"].iloc[0])
        chain = chain[chain["start"] >= 0]
        seen = reachable(chain["start"].to_numpy(), chain["successor"].to_numpy())
        kept = chain[seen]
        if strict and size and (not len(kept) or kept["successor"].max() != size):
            raise ValueError(f"{archive}: the chain of records does not reach the end")
        return kept[["archive", "start"]]

    return run


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records of the archives under ``path``: record_id, url, record_type, refers, payload_bytes, payload_digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,txt.gz,warc,warc.gz}").load(path).select("path", "content")
    files = files.where("length(content) > 0")
    # Only offsets meet by archive; payloads stay where they are read, and their digests are made once.
    chain = files.mapInPandas(_offsets, "archive string, size long, start long, successor long")
    kept = chain.groupBy("archive").applyInPandas(_keep(strict), "archive string, start long")
    return files.mapInPandas(_emit, CANDIDATE).join(kept, ["archive", "start"], "left_semi")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to; a digest that does not match
    the payload read is null.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/inkspan/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_archives(spark, path).select(
        number("record_id").alias("page_id"), "url", "payload_bytes",
        F.when((F.col("record_type") == "revisit") | (F.col("digest") == F.col("payload_digest")), F.col("digest")).alias("payload_digest"),
        "record_type", number("refers").alias("refers_to"),
    )
