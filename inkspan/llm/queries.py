"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from inkspan.llm import oracles

QUERIES: dict = {"pipeline": corpus_pipeline.run}
ORACLES: dict = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
ORACLES |= {
    "op3_rendezvous_sharding": oracles.OP3,
    "op6_bm25_search": oracles.OP6,
    "op7_dart_minhash": oracles.OP7,
    "op9_substring_dedup": oracles.OP9,
    "op12_spelling_variants": oracles.OP12,
    "op13_fill_in_middle": oracles.OP13,
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.mixing import plan_mix

    return plan_mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), "draws"
    )


@query
def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.common import shared_table
    from inkspan.llm.sharding import assign_shards, number_within_shards, unit_hash

    sized = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = assign_shards(sized, "doc_id", [1.0] * 40, grown=1.0)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = placed.withColumn("_at", unit_hash(key, F.lit("slot"), F.when(F.col("doc_id").isNull(), F.col("text_crc32").cast("string"))))
    # Texts are read and keys are scored once; the lean rows are numbered from where they are stored.
    placed = shared_table(placed, "placed")
    return number_within_shards(placed, ["doc_id", "text_crc32", "size"], "_at", 40).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkspan.llm.pieces import encode_documents

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.language import identify, train_profiles

    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    profiles = train_profiles(docs.where(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), profiles).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.substrings import drop_repeats

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.toxicity import score, train

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    model = train(docs.where(~held_out), labels)
    return score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.warc import round_trip

    return round_trip(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT) >> {s}) & 31)::INT + 1, 1)"
    for i in range(8)
    for s in (15, 10, 5, 0)
)
ORACLES["op8_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (h)
"""


@query
def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.neighbours import search

    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 100 == 0, k=10)


@query
def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.darts import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.bm25 import search

    found = search(read(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 50 == 0, k=10)
    return found.withColumn("score", F.round("score", 6))


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are those of base spans, as base_sha256 is; n_added are the field's own."""
    from inkspan.llm.spans import KINDS, find_spans, train

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, train(docs)).select("doc_id", "spans", F.filter("spans", lambda s: s.base).alias("held"))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))
    of = lambda kind: F.size(F.filter("held", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(of, KINDS), F.sha2(listed("held"), 256).alias("base_sha256"), listed("spans").alias("spans"),
        (F.size("spans") - F.size("held")).cast("long").alias("n_added"),
    )


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.spelling import count_words, variant_groups

    return variant_groups(count_words(read(spark, sf_dir, "documents")))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.infill import fill_in_middle

    out = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
