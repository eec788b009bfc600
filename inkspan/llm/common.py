"""What the operators share: the word definition, the shared folder and lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.session import shared_dir
from inkspan.session import stored as shared_table

__all__ = ["byte_words", "cut", "shared_dir", "shared_table", "small_batches", "word_count"]

#: A word is a maximal run of anything but space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def word_count(text: str | Column) -> Column:
    """Words of a text, 0 for null; stays in the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: bytes.split() cuts at exactly the six separators above."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, where the session leaves them as they are by default (64 MB).

    A batch of texts is held by the JVM and, several times over, by the Python worker; BATCH_BYTES of text
    are plenty to pay for the exchange. A setting that the session makes itself is kept.
    """
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
