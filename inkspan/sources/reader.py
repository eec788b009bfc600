"""Collections of files to blocks, format by format, and the rows of what could not be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators import trees
from inkspan.session import small_batches, stored
from inkspan.sources import delimited, office, values
from inkspan.sources.files import failures, read_files

ARCHIVE_BLOCKS = {"docx": office.docx_blocks, "pptx": office.pptx_blocks, "odt": office.odt_blocks, "odp": office.odp_blocks, "epub": office.epub_blocks}
SHEETS = {"xlsx": office.xlsx_blocks, "ods": office.ods_blocks}
SUPPORTED = (*ARCHIVE_BLOCKS, *SHEETS, "csv", "tsv", "xmind", "mmap", "json", "xml")
#: The entry without which an archive of a format is nothing.
MAIN_ENTRY = {
    "docx": r"^word/document\.xml$", "pptx": r"^ppt/presentation\.xml$", "xlsx": r"^xl/workbook\.xml$", "odt": r"^content\.xml$", "ods": r"^content\.xml$",
    "odp": r"^content\.xml$", "epub": r"\.opf$", "xmind": r"^content\.(json|xml)$", "mmap": r"^Document\.xml$",
}


def parse(files: DataFrame, formats=SUPPORTED, with_blocks: bool = True, **sheet_options) -> tuple[DataFrame | None, DataFrame]:
    """doc_id, doc_format, error_class, content rows -> blocks of all supported formats, and all errors.

    ``with_blocks`` false plans and stores nothing that only blocks need, and gives None for them.

    Each file is decoded once: entries, nodes, cells and values are stored, and blocks and errors are read from there.
    Errors are rows of doc_id, entry, error_class and message. A file that is broken in part has errors and the blocks
    of its other parts.
    """
    small_batches(files.sparkSession)
    good = files.where("error_class is null")
    known = F.when(F.col("doc_format").isin(*SUPPORTED), F.lit(None)).otherwise("FeatureDisabled")
    told = files.select("doc_id", F.lit(None).cast("string").alias("entry"), F.coalesce("error_class", known).alias("error_class"), F.col("doc_format").alias("message"))
    errors = told.where("error_class is not null")
    blocks = None
    for name in formats:
        own = good.where(F.col("doc_format") == name)
        if name in MAIN_ENTRY:
            part, failed = _archives(own, name, with_blocks, sheet_options)
        elif name in ("json", "xml"):
            found = stored(values.values(own), "values")
            part, failed = with_blocks and values.blocks_of_values(found), failures(found)
        else:
            found = stored(delimited.cells(own), "records")
            part, failed = with_blocks and delimited.sheet_blocks(found.where("error_class is null"), **sheet_options), failures(found)
        if with_blocks:
            blocks = part if blocks is None else blocks.unionByName(part)
        errors = errors.unionByName(failed)
    return blocks, errors


def _archives(own: DataFrame, name: str, with_blocks: bool, sheet_options: dict) -> tuple[DataFrame | None, DataFrame]:
    unzipped = office.entries(own)
    parsed = office.parsed(unzipped)
    failed = failures(parsed).unionByName(failures(unzipped.where(F.col("entry").isNotNull() & ~F.rlike("entry", F.lit(office.XML_ENTRY)))))
    main = unzipped.where(F.col("entry").isNull() | F.rlike("entry", F.lit(MAIN_ENTRY[name]))).select("doc_id").distinct()
    missing = own.join(main, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("string").alias("entry"), F.lit("MissingEntry").alias("error_class"), F.lit(MAIN_ENTRY[name]).alias("message"))
    failed = failed.unionByName(missing)
    nodes = parsed.where("error_class is null").drop("error_class", "message")
    if not with_blocks and name in (*ARCHIVE_BLOCKS, *SHEETS):
        return None, failed
    if name in ARCHIVE_BLOCKS:
        return ARCHIVE_BLOCKS[name](nodes, office.images(unzipped)), failed
    if name in SHEETS:
        return SHEETS[name](nodes, **sheet_options), failed
    topics, unread = office.mind_maps(unzipped, nodes)
    return delimited.complete(trees.tree_blocks(trees.flatten(topics))), failed.unionByName(unread)


def blocks_of(files: DataFrame, formats=SUPPORTED, **sheet_options) -> DataFrame:
    return parse(files, formats, **sheet_options)[0]


def read_blocks(spark: SparkSession, path: str, formats=SUPPORTED, **sheet_options) -> DataFrame:
    return blocks_of(read_files(spark, path), formats, **sheet_options)


def errors(files: DataFrame, formats=SUPPORTED, **sheet_options) -> DataFrame:
    """doc_id, entry, error_class, message of what no reader takes or can read."""
    return parse(files, formats, with_blocks=False, **sheet_options)[1]
