"""JSON and XML files as blocks: values as rows, and what they become in steps over these.

The only Python is decoding: one file becomes its values in document order. A value's heading level is its
depth, four at most. What is drawn where (runs of scalars, lists, tables, lines of JSON, payloads too deep for
headings) is joined and windowed in Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import trim_ws
from inkspan.session import stored
from inkspan.sources.delimited import complete
from inkspan.sources.files import ERROR_SCHEMA

MOST_LEVEL, MOST_COLUMNS = 4, 20
#: Containers inside each other; a file that nests deeper is an error.
MOST_DEPTH = 127
VALUE = pa.struct([
    ("pre", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("ord", pa.int32()), ("key", pa.string()), ("kind", pa.string()),
    ("shown", pa.string()), ("raw", pa.string()), ("above", pa.list_(pa.int32())),
])
SCHEMA = f"doc_id string, values array<struct<pre:int,parent:int,depth:int,ord:int,key:string,kind:string,shown:string,raw:string,above:array<int>>>, {ERROR_SCHEMA}"


class TooDeep(ValueError):
    pass


def _constant(name: str):
    raise ValueError(name)


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def shown(value) -> str:
    """A scalar on one line: blank text as "", text of several lines as JSON."""
    if not isinstance(value, str):
        return compact(value)
    text = value.strip()
    return '""' if not text else compact(value) if "\n" in text or "\r" in text else text


def kind_of(value) -> str:
    return "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "string" if isinstance(value, str) else "scalar"


def depth_of(root) -> int:
    """Containers on the longest way down, counted with a stack."""
    most, open_ = 0, [(root, 0)]
    while open_:
        value, depth = open_.pop()
        if isinstance(value, (dict, list)):
            most = max(most, depth + 1)
            if most > MOST_DEPTH:
                raise TooDeep(f"more than {MOST_DEPTH} containers inside each other")
            open_ += [(x, depth + 1) for x in (value.values() if isinstance(value, dict) else value)]
    return most


def parse_values(root) -> list[dict]:
    """A value and all below it, in document order; ``raw`` is a string's text, and the JSON of a container that may be drawn so.

    Those are the containers in arrays of unlike items and the objects under MOST_LEVEL. What lies inside one is never
    drawn by itself, so all JSON together is no longer than the file.
    """
    depth_of(root)
    out: list[dict] = []
    open_ = [(root if isinstance(root, dict) else {"value": root}, -1, 0, 0, None, [], False, False)]
    while open_:
        value, parent, depth, at, key, above, in_lines, covered = open_.pop()
        kind = kind_of(value)
        scalar = kind in ("string", "scalar")
        keep = not scalar and not covered and (in_lines or (kind == "object" and depth > MOST_LEVEL))
        pre = len(out)
        out.append({
            "pre": pre, "parent": parent, "depth": depth, "ord": at, "key": key, "kind": kind, "shown": shown(value) if scalar else None,
            "raw": value if kind == "string" else compact(value) if keep else None, "above": above,
        })
        if scalar:
            continue
        below = list(value.items()) if kind == "object" else [(None, v) for v in value]
        kinds = {kind_of(v) for _, v in below}
        lines = kind == "array" and not kinds <= {"string", "scalar"} and kinds != {"object"}
        inner = [*above, pre]
        open_ += [(v, pre, depth + 1, i, k, inner, lines, covered or keep) for i, (k, v) in reversed(list(enumerate(below)))]
    return out


def xml_value(data: bytes):
    """An element as JSON: @attributes, then #text, then children, repeated ones as an array; a mere text is a string."""
    open_: list[tuple[str, dict, list, dict]] = []
    done: dict = {}

    def start(name: str, attrs: dict) -> None:
        open_.append((name, {f"@{k}": v for k, v in attrs.items() if k != "xmlns" and not k.startswith("xmlns:")}, [], {}))

    def end(name: str) -> None:
        _, value, texts, children = open_.pop()
        text = "".join(texts).strip()
        if text and (value or children):
            value["#text"] = text
        value |= {k: v[0] if len(v) == 1 else v for k, v in children.items()}
        into = open_[-1][3] if open_ else done
        into.setdefault(name, []).append(value or text)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda x: open_[-1][2].append(x)
    parser.Parse(data, True)
    return {k: v[0] for k, v in done.items()}


def values(files: DataFrame) -> DataFrame:
    """doc_id, doc_format, content -> a row a value, and a row with error_class for a file that does not parse."""

    def parse(kind: str, content: bytes) -> tuple[list[dict], str | None, str | None]:
        try:
            return parse_values(xml_value(content) if kind == "xml" else json.loads(content.decode("utf-8"), parse_constant=_constant)), None, None
        except (RecursionError, TooDeep) as error:
            return [], "TooDeep", str(error)
        except UnicodeDecodeError as error:
            return [], "NoUtf8", str(error)
        except (ValueError, expat.ExpatError) as error:
            return [], "Malformed", str(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, kind, content in zip(*batch.columns):
                found, error, message = parse(kind.as_py(), content.as_py() or b"")
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.string()), pa.array([found], pa.list_(VALUE)), pa.array([error], pa.string()), pa.array([message], pa.string())], ["doc_id", "values", "error_class", "message"])

    parsed = files.select("doc_id", "doc_format", "content").mapInArrow(run, SCHEMA)
    return parsed.select("doc_id", "error_class", "message", F.explode_outer("values").alias("v")).select("doc_id", "v.*", "error_class", "message")


def value_blocks(files: DataFrame) -> DataFrame:
    return blocks_of_values(stored(values(files), "values"))


def blocks_of_values(found: DataFrame) -> DataFrame:
    """Values -> blocks: a heading a key, runs of scalars as paragraphs, arrays as lists, tables or items."""
    v = found.where("error_class is null").drop("error_class", "message")
    keys = ["doc_id", "pre"]
    scalar = F.col("kind").isin("string", "scalar")
    # What an array's items are, and whether it makes a table.
    parent = v.select("doc_id", F.col("pre").alias("parent"), F.col("kind").alias("parent_kind"), F.col("depth").alias("parent_depth"))
    rows = v.join(parent, ["doc_id", "parent"], "left")
    items = rows.where("parent_kind = 'array'").groupBy("doc_id", F.col("parent").alias("pre")).agg(F.every(scalar).alias("flat"), F.every(F.col("kind") == "object").alias("objects"))
    grand = rows.where("parent_kind = 'object'").join(v.select("doc_id", F.col("pre").alias("parent"), F.col("parent").alias("array")), ["doc_id", "parent"])
    width = grand.groupBy("doc_id", F.col("array").alias("pre")).agg(F.every(scalar).alias("plain"), F.countDistinct("key").alias("columns"))
    arrays = v.where("kind = 'array'").select(*keys).join(items, keys, "left").join(width, keys, "left")
    drawn = F.when(F.coalesce("flat", F.lit(True)), "list").when(F.col("objects") & F.coalesce("plain", F.lit(True)) & F.col("columns").between(1, MOST_COLUMNS), "table").when(F.col("objects"), "items").otherwise("lines")
    arrays = arrays.select(*keys, drawn.alias("drawn"))
    # An object below an object that has no heading left is a payload.
    payload = (F.col("kind") == "object") & (F.col("parent_kind") == "object") & (F.col("parent_depth") >= MOST_LEVEL)
    marked = stored(rows.join(arrays, keys, "left").withColumn("drawn", F.when(payload, "payload").otherwise(F.col("drawn"))), "marked")
    closed = marked.where("drawn in ('list', 'table', 'lines', 'payload')").select("doc_id", F.col("pre").alias("_up"))
    hidden = marked.select(*keys, F.explode("above").alias("_up")).join(closed, ["doc_id", "_up"]).select(*keys).distinct()
    live = stored(marked.join(hidden, keys, "left_anti").where("depth > 0"), "live")

    level = F.least(F.col("depth"), F.lit(MOST_LEVEL)).cast("smallint")
    block = lambda df, k, kind, **cols: df.select("doc_id", "pre", F.lit(k).alias("_k"), F.lit(kind).alias("block_type"), *[x.alias(n) for n, x in cols.items()])
    in_object = F.col("parent_kind") == "object"
    headed = live.where((in_object & ((F.col("depth") == 1) | (~scalar & (F.col("parent_depth") < MOST_LEVEL)))) | ((F.col("parent_kind") == "array") & (F.col("kind") == "object")))
    out = block(headed, 0, "heading", level=level, text=F.coalesce("key", F.concat(F.lit("item "), "ord")))
    # A scalar of the root stands alone, on its own lines; others gather to runs between their complex siblings.
    own = F.when((F.col("kind") == "string") & F.rlike("raw", F.lit(r"[\r\n]")), trim_ws(F.replace("raw", F.lit("\r"), F.lit("")))).otherwise(F.col("shown"))
    out = out.unionByName(block(live.where(scalar & (F.col("depth") == 1)), 1, "paragraph", text=own), allowMissingColumns=True)
    order = Window.partitionBy("doc_id", "parent").orderBy("ord")
    members = live.where(in_object & (F.col("depth") > 1)).withColumn("_run", F.sum((~scalar).cast("int")).over(order)).where(scalar)
    line = F.struct("ord", F.concat("key", F.lit(": "), "shown").alias("l"))
    runs = members.groupBy("doc_id", "parent", "_run").agg(F.min("pre").alias("pre"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("text"))
    out = out.unionByName(block(runs, 1, "paragraph", text=F.col("text")), allowMissingColumns=True)
    untitled = live.where((F.col("kind") == "array") & in_object & (F.col("parent_depth") >= MOST_LEVEL))
    out = out.unionByName(block(untitled, 0, "paragraph", text=F.concat("key", F.lit(":"))), allowMissingColumns=True)
    # Arrays.
    of = lambda name: live.where(F.col("drawn") == name).select(*keys)
    inside = v.select("doc_id", F.col("parent").alias("pre"), F.col("pre").alias("child"), "ord", "key", "shown", "raw", "kind")
    listed = lambda df, what: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", what.alias("x")))), lambda s: s["x"]).alias("_l"))
    bullets = listed(of("list").join(inside, keys), F.struct(F.lit(0).cast("smallint").alias("level"), F.col("shown").alias("text")))
    out = out.unionByName(block(bullets, 1, "list", ordered=F.lit(False), items=F.col("_l")), allowMissingColumns=True)
    lines = listed(of("lines").join(inside, keys), F.when(F.col("kind") == "string", F.regexp_extract(F.to_json(F.struct(F.col("raw").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)).otherwise(F.coalesce("raw", "shown")))
    out = out.unionByName(block(lines, 1, "paragraph", text=F.concat(F.lit("```jsonl\n"), F.array_join("_l", "\n"), F.lit("\n```\n"))), allowMissingColumns=True)
    out = out.unionByName(block(_tables(of("table"), inside), 1, "table", rows=F.col("rows")), allowMissingColumns=True)
    # Payloads: paths of scalars, or JSON if an array is below.
    deep = live.where("drawn = 'payload'").select("doc_id", "pre", "key", "raw")
    below = v.select("doc_id", F.explode("above").alias("pre"), F.col("pre").alias("_at"), "above", F.col("key").alias("_key"), "kind", F.col("shown").alias("_shown")).join(deep.select(*keys), keys)
    names = v.select("doc_id", F.col("pre").alias("_up"), F.col("key").alias("_name"))
    steps = below.where(scalar).select(*keys, "_at", "_shown", "_key", F.posexplode("above").alias("_i", "_up")).where("_up > pre").join(names, ["doc_id", "_up"], "left")
    path = steps.groupBy(*keys, "_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_name"))), lambda s: s["_name"]), ".").alias("_path"))
    leaf = below.where(scalar).join(path, [*keys, "_at"], "left").select(*keys, "_at", F.concat(F.lit("  "), F.concat_ws(".", "_path", "_key"), F.lit(": "), "_shown").alias("l"))
    flat = leaf.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "l"))), lambda s: s["l"]), "\n").alias("_flat"))
    holds = below.where("kind = 'array'").select(*keys).distinct().withColumn("_holds", F.lit(True))
    payloads = deep.join(flat, keys, "left").join(holds, keys, "left")
    body = F.when(F.col("_holds"), F.concat(F.lit("```json\n"), "raw", F.lit("\n```"))).otherwise(F.coalesce("_flat", F.lit("")))
    out = out.unionByName(block(payloads, 1, "paragraph", text=F.concat("key", F.lit(":\n"), body)), allowMissingColumns=True)
    out = out.where("block_type not in ('paragraph', 'list') or trim(coalesce(text, '')) <> '' or size(items) > 0")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre", "_k")) - 1
    return complete(out.withColumn("block_index", index.cast("bigint")))


def _tables(arrays: DataFrame, inside: DataFrame) -> DataFrame:
    """Arrays of flat objects -> rows: # and the keys in the order first seen, then the objects, numbered from 0."""
    keys = ["doc_id", "pre"]
    objects = arrays.join(inside, keys).select(*keys, F.col("child").alias("item"), F.col("ord").alias("no"))
    members = inside.select("doc_id", F.col("pre").alias("item"), "child", "key", "shown")
    cells = objects.join(members, ["doc_id", "item"], "left")
    columns = cells.where("key is not null").groupBy(*keys, "key").agg(F.min("child").alias("_at"))
    columns = columns.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "key"))), lambda s: s["key"]).alias("columns"))
    pair = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "shown")))
    row = cells.groupBy(*keys, "no").agg(F.map_from_entries(pair).alias("_m")).join(columns, keys)
    cell: Column = F.transform(F.concat(F.array(F.col("no").cast("string")), F.transform("columns", lambda k: F.coalesce(F.try_element_at("_m", k), F.lit("")))), _cell)
    body = row.groupBy(*keys, "columns").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", cell.alias("l")))), lambda s: s["l"]).alias("_b"))
    head = F.transform(F.concat(F.array(F.lit("#")), "columns"), _cell)
    return body.select(*keys, F.concat(F.array(head), "_b").alias("rows"))


def _cell(text: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"))
