"""A training corpus from ``documents``: five stages, each written as Parquet and reread by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. It works on all rows its predecessor kept, and what it decides takes effect.

1. language: documents without a language (no letters, or null text) go; lang becomes the prediction.
2. near_duplicates: of each class of near copies one row of the text with the least doc_id stays (null ids
   come last); other texts of a doc_id are judged by their own class.
3. substrings: words of passages of 50 words that a document with a smaller doc_id holds too are cut out;
   a document that loses a word holds its other words joined by one space; one that loses all its words goes.
4. mixing: each document appears as often as the mixture of the sources takes it (0, 1 or 2 times), dealt out by
   shard and in a hashed order within each.
5. sentencepiece: token ids and the decoded text of every row.

In every stage: an empty table gives an empty one; columns beyond those of documents are dropped, whatever their
names; texts of any length are worked on whole; a null doc_id, lang, source or n_chars is kept (lang is replaced
by the prediction), a null text goes in the first stage and is kept by the next three. Repeated rows are one row
after near_duplicates, and rows of their own in all other stages. Ties go by the rules of each operator: languages
to the smaller name, copies to the least doc_id and then the least digest.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import shared_dir
from inkspan.llm.darts import digest, least_texts, text_classes
from inkspan.llm.language import UNKNOWN, identify, train_profiles
from inkspan.llm.mixing import mix
from inkspan.llm.pieces import encode_documents
from inkspan.llm.substrings import drop_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "piece_bpe_32k.model"

#: SQL has no n-gram profiles, signatures or merges: the pipeline is tested against brute force instead.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    profiles = train_profiles(docs.where(~held_out).select("text", "lang"))
    judged = identify(docs.select(COLUMNS), profiles).where(F.col("lang_pred") != UNKNOWN)
    return judged.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(0)).alias("_i"), F.col("doc_id").isNull().alias("_none"), digest().alias("_d"), *COLUMNS)
    kept = least_texts(text_classes(docs.select("doc_id", "text")))
    kept = kept.select(F.coalesce("_id", F.lit(0)).alias("_i"), F.col("_id").isNull().alias("_none"), "_d")
    # One row of each (doc_id, text); repeats are folded before they move.
    rest = [c for c in COLUMNS if c != "text"]
    once = known.groupBy("_i", "_none", "_d").agg(F.min(F.struct(*rest)).alias("_r"), F.first("text").alias("text"))
    stay = once.join(kept, ["_i", "_none", "_d"], "left_semi").select("_r.*", "text")
    # A null text is in no class with others and stays.
    return docs.where("text is null").select(COLUMNS).unionByName(stay.select(COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = drop_repeats(docs.select(COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return (
        out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
        .withColumn("text", text)
        .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
        .select(COLUMNS)
    )


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, keep=COLUMNS).select(COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, os.environ.get("INKSPAN_PIECES") or public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("near_duplicates", near_copies),
    ("substrings", substrings),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is in the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/inkspan/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
