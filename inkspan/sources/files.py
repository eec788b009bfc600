"""Files as rows: whole files, entries of archives, and XML as nodes.

The only Python is decoding: unzip one file, parse one XML entry. What the nodes mean - styles, lists,
tables, relationships - is joined, grouped and windowed in Spark (see inkspan.sources.office). A step that cannot
decode something says so in a row of its own (see failures), and no file ends a job.
"""

from __future__ import annotations

import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.sources.formats import FORMATS, format_of

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
#: Formats that are zip archives.
ARCHIVES = ("docx", "odt", "pptx", "odp", "xlsx", "ods", "epub", "xmind", "mmap")


def with_format(files: DataFrame, doc_format: str | None = None, enabled=tuple(FORMATS)) -> DataFrame:
    """binaryFile rows -> doc_id, doc_format, error_class, content. Unknown and disabled formats are errors."""
    name = F.element_at(F.split("path", "/"), -1)
    found = F.lit(doc_format) if doc_format else format_of(name)
    error = F.when(found.isNull(), "UnsupportedFormat").when(~found.isin(*enabled), "FeatureDisabled")
    return files.select(F.col("path").alias("doc_id"), found.alias("doc_format"), error.alias("error_class"), "content")


def read_files(spark: SparkSession, path: str, doc_format: str | None = None, glob: str = "*", most_bytes: int | None = None, **options) -> DataFrame:
    """All files under a path. ``most_bytes`` is pushed to the scan, which then opens no larger file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    return with_format(files, doc_format, **options)


#: What a decode step adds to its rows. A row with error_class holds nothing else but where it happened.
ERROR_SCHEMA = "error_class string, message string"


def failures(rows: DataFrame) -> DataFrame:
    """doc_id, entry, error_class, message of a decode step's rows."""
    entry = F.col("entry") if "entry" in rows.columns else F.lit(None).cast("string")
    return rows.where("error_class is not null").select("doc_id", entry.alias("entry"), "error_class", "message")


def _entry_error(error: Exception) -> str:
    return {RuntimeError: "Encrypted", NotImplementedError: "UnknownCompression", EOFError: "Truncated"}.get(type(error), "Damaged")


def zip_entries(files: DataFrame, names: str | None = None) -> DataFrame:
    """doc_id, doc_format, entry, data, error_class, message: the entries of archives, those matching the regex ``names`` only.

    What cannot be read is a row with an error: the archive as a whole without an entry, or one entry of it; the
    other entries come out. Each entry leaves the task by itself.
    """
    import re

    wanted = re.compile(names) if names else None
    columns = ["doc_id", "doc_format", "entry", "data", "error_class", "message"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()]

    def rows(doc: str, kind: str, content: bytes) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
            found = archive.infolist()
        except (zipfile.BadZipFile, ValueError, EOFError, NotImplementedError, OSError, struct.error) as error:
            yield doc, kind, None, None, "NoArchive", str(error)
            return
        for info in found:
            if info.is_dir() or (wanted and not wanted.search(info.filename)):
                continue
            try:
                yield doc, kind, info.filename, archive.read(info), None, None
            except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, RuntimeError, EOFError, ValueError, OSError, struct.error) as error:
                yield doc, kind, info.filename, None, _entry_error(error), str(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, kind, content in zip(*batch.columns):
                for row in rows(doc.as_py(), kind.as_py(), content.as_py() or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], columns)

    return files.select("doc_id", "doc_format", "content").mapInArrow(run, f"doc_id string, doc_format string, entry string, data binary, {ERROR_SCHEMA}")


#: Nodes of an entry that leave a task together.
NODES = 20_000


class Nodes:
    """Elements and texts of an XML entry in document order, held as columns; take() empties them.

    The parser hands on a text in pieces, where its input or its buffer ends. They wait for the next tag and are one node.
    """

    TYPES = {"pre": pa.int32(), "parent": pa.int32(), "tag": pa.string(), "text": pa.string()}

    def __init__(self):
        self.open: list[tuple[int, str]] = []
        self.pieces: list[str] = []
        self.made = 0
        self.clear()

    def clear(self) -> None:
        self.columns: dict[str, list] = {c: [] for c in self.TYPES}
        self.names, self.values, self.attr_at = [], [], [0]
        self.path_pre, self.path_tag, self.path_at = [], [], [0]

    def add(self, tag: str, text: str | None, attrs: dict) -> int:
        for name, x in zip(self.TYPES, (self.made, self.open[-1][0] if self.open else -1, tag, text)):
            self.columns[name].append(x)
        self.names += attrs.keys()
        self.values += attrs.values()
        self.attr_at.append(len(self.names))
        for pre, above in self.open:
            self.path_pre.append(pre)
            self.path_tag.append(above)
        self.path_at.append(len(self.path_pre))
        self.made += 1
        return self.made - 1

    def end_text(self) -> None:
        if self.pieces:
            self.add("#text", "".join(self.pieces), {})
            self.pieces = []

    def end(self, _: str) -> None:
        self.end_text()
        self.open.pop()

    def start(self, name: str, attrs: dict) -> None:
        self.end_text()
        # xmlns declarations carry no content; a clash of local names keeps the first.
        own: dict[str, str] = {}
        for k, v in attrs.items():
            if k != "xmlns" and not k.startswith("xmlns:"):
                own.setdefault(k.rpartition(":")[2] if k != "r:id" else "rid", v)
        tag = name.rpartition(":")[2]
        self.open.append((self.add(tag, None, own), tag))

    def take(self) -> list[pa.Array]:
        path = pa.StructArray.from_arrays([pa.array(self.path_pre, pa.int32()), pa.array(self.path_tag, pa.string())], ["pre", "tag"])
        out = [pa.array(self.columns[c], t) for c, t in self.TYPES.items()]
        out.append(pa.MapArray.from_arrays(pa.array(self.attr_at, pa.int32()), pa.array(self.names, pa.string()), pa.array(self.values, pa.string())))
        out.append(pa.ListArray.from_arrays(pa.array(self.path_at, pa.int32()), path))
        self.clear()
        return out


def node_slices(data: bytes, size: int = NODES) -> Iterator[list[pa.Array]]:
    """pre, parent, tag, text, attrs, path of an entry's nodes in slices; names without prefix; entities resolved.

    The entry is read through once before, so a malformed one raises ExpatError before any node comes out.
    """
    expat.ParserCreate().Parse(data, True)
    nodes, parser = Nodes(), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = nodes.start, nodes.end
    parser.CharacterDataHandler = lambda value: nodes.pieces.append(value)
    step = 1 << 16
    for lo in range(0, len(data), step):
        parser.Parse(data[lo : lo + step], False)
        if len(nodes.columns["pre"]) >= size or len(nodes.path_pre) >= 10 * size:
            yield nodes.take()
    parser.Parse(b"", True)
    yield nodes.take()


def xml_nodes(entries: DataFrame) -> DataFrame:
    """(doc_id, entry, data, error_class, message) -> doc_id, entry, pre, parent, tag, text, attrs, path (ancestors, root first).

    Errors of the step before go through; a malformed entry becomes one of its own.
    """
    fields = ["pre", "parent", "tag", "text", "attrs", "path"]
    schema = (
        "doc_id string, entry string, pre int, parent int, tag string, text string, attrs map<string,string>, "
        f"path array<struct<pre:int,tag:string>>, {ERROR_SCHEMA}"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(doc, entry, columns, error=None, message=None) -> pa.RecordBatch:
            n = len(columns[0])
            told = [pa.array([x] * n, pa.string()) for x in (doc, entry, error, message)]
            return pa.RecordBatch.from_arrays([*told[:2], *columns, *told[2:]], ["doc_id", "entry", *fields, "error_class", "message"])

        empty = Nodes().take()
        no_node = [pa.nulls(1, x.type) for x in empty]
        for batch in batches:
            for row in zip(*batch.columns):
                doc, entry, data, error, message = (x.as_py() for x in row)
                try:
                    if error is None:
                        for columns in node_slices(data):
                            yield batch_of(doc, entry, columns)
                except expat.ExpatError as malformed:
                    error, message = "Malformed", str(malformed)
                if error is not None:
                    yield batch_of(doc, entry, no_node, error, message)

    return entries.select("doc_id", "entry", "data", "error_class", "message").mapInArrow(run, schema)


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def ancestor(*tags: str) -> Column:
    """pre of the nearest ancestor with one of the tags, or null."""
    up = F.filter("path", lambda p: p["tag"].isin(*tags))
    return F.when(F.size(up) > 0, F.element_at(up, -1)["pre"])


def under(*tags: str) -> Column:
    return F.exists("path", lambda p: p["tag"].isin(*tags))
