"""Fill-in-the-middle: a document is cut into prefix, middle and suffix, and some are put down in another order.

A text is cut into units, each a word with the white space before it; white space at the end is a unit of its
own. The key ``<seed>:<id>`` decides all: the first four groups of 8 hex digits of its SHA-256 are h1 to h4. Of
n units the prefix takes the first min(h1, h2) mod (n + 1), the middle ends at the greater one. A text stays
``plain`` if it is empty, holds one of the three marks, or h3 % 100 is at least ``rate``; others become ``spm``
(suffix, prefix, middle) if h4 % 100 is below ``spm``, else ``psm``.

Each Arrow batch is registered with DuckDB in the task, which cuts, joins and hashes by SQL and gives Arrow
back; there is no Python code for a row. A batch holds BATCH_BYTES of text or one longer text, and its units as
a list; DuckDB runs in one thread, in memory. A row depends on itself alone, so lost tasks are run again.

Null texts are empty; a null id is the empty string in the key. Empty and very long texts are handled whole.
Repeated rows are each a row, equal ids and texts give equal results, and there are no other ties. An empty
table gives an empty result. Columns of docs are kept, whatever their names; those that this operator returns
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkspan.llm.common import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, restored string"


def batch_sql(seed: int, rate: int, spm: int) -> str:
    """One SELECT over ``batch`` (key, text); regexp_extract_all, list_slice and array_to_string do the work."""
    h = lambda i: f"('0x' || substr(hash, {8 * i + 1}, 8))::BIGINT"
    part = lambda lo, hi: f"coalesce(array_to_string(list_slice(units, {lo}, {hi}), ''), '')"
    held = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    # The text is taken apart again at the marks alone, which it does not hold elsewhere.
    at = lambda mark: f"strpos(output, '{mark}')"
    between = lambda a, b: f"substr(output, {at(a)} + 3, {at(b)} - {at(a)} - 3)"
    rest = f"substr(output, {at(MIDDLE)} + 3)"
    return f"""
WITH b AS (SELECT coalesce(text, '') AS text, sha256('{seed}:' || coalesce(key, '')) AS hash FROM batch),
u AS (SELECT *, regexp_extract_all(text, '{UNIT}') AS units FROM b),
c AS (SELECT *, len(units) AS n, {h(0)} % (len(units) + 1) AS a, {h(1)} % (len(units) + 1) AS z,
 CASE WHEN text = '' OR {held} OR {h(2)} % 100 >= {rate} THEN 'plain' WHEN {h(3)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT text, form, n, {part("1", "least(a, z)")} AS prefix, {part("least(a, z) + 1", "greatest(a, z)")} AS middle, {part("greatest(a, z) + 1", "n")} AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
 ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM p)
SELECT n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
 CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars, output,
 CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {between(PREFIX, SUFFIX)} || {rest} || {between(SUFFIX, MIDDLE)}
 ELSE {between(PREFIX, MIDDLE)} || {rest} || {between(SUFFIX, PREFIX)} END AS restored
FROM o"""


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs' columns with n, form, prefix_chars, middle_chars, output, and restored, which is rebuilt from output and form."""
    small_batches(docs.sparkSession)
    added = [c.split()[0] for c in SCHEMA.split(", ")]
    sql = batch_sql(int(seed), int(rate), int(spm))
    kept = [c for c in docs.columns if c not in added]
    # Fed by position, under names of its own; the text goes once.
    fed = [F.col(f"`{c}`") for c in kept] + [F.col(f"`{key}`").cast("string")]
    fed += [] if text in kept else [F.col(f"`{text}`")]
    text_at = kept.index(text) if text in kept else len(kept) + 1
    fed = docs.select([c.alias(f"c{i}") for i, c in enumerate(fed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:
            for batch in batches:
                db.register("batch", pa.table([batch.column(len(kept)), batch.column(text_at)], ["key", "text"]))
                out = db.sql(sql).to_arrow_table()
                db.unregister("batch")
                yield from pa.table([*batch.columns[: len(kept)], *out.columns], [*kept, *added]).to_batches()

    return fed.mapInArrow(run, StructType([*docs.select([f"`{c}`" for c in kept]).schema.fields, *StructType.fromDDL(SCHEMA).fields]))
