"""Which format a hint - a MIME type or a file name - stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.text import ascii_lower, c, trim_ws

FORMATS = "docx odt pptx odp xlsx ods csv tsv pdf rtf json yaml toml xml epub xmind mmap".split()
# The MIME types that are recognised.
MIME_TYPES = {
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.presentation": "odp",
    "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "text/csv": "csv",
    "text/tab-separated-values": "tsv",
    "application/pdf": "pdf",
    "text/rtf": "rtf",
    "application/rtf": "rtf",
    "application/json": "json",
    "application/yaml": "yaml",
    "application/x-yaml": "yaml",
    "text/yaml": "yaml",
    "text/x-yaml": "yaml",
    "application/toml": "toml",
    "application/x-toml": "toml",
    "text/toml": "toml",
    "text/x-toml": "toml",
    "application/xml": "xml",
    "text/xml": "xml",
    "application/rss+xml": "xml",
    "application/epub+zip": "epub",
    "application/vnd.xmind.workbook": "xmind",
    "application/x-mindmanager": "mmap",
    "application/vnd.mindjet.mindmanager": "mmap",
}


def format_of(hint: str | Column) -> Column:
    """The format's name, or null. The ending is what follows the last dot, or the hint without one."""
    h = ascii_lower(trim_ws(c(hint)))
    ending = F.regexp_replace(F.element_at(F.split(h, r"\."), -1), r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")
    known = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    by_ending = F.when(ending == "yml", "yaml").when(ending.isin(*FORMATS), ending)
    return F.coalesce(F.try_element_at(known, h), by_ending)
