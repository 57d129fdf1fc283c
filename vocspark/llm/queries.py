"""The queries of this package: thin, each applies one operator with its
production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, fingerprint, hnsw, jaccard, langid, licenses, mixing, packing, quality, quotes, repair,
               secret_scan, warc)
from .common import held_out, materialize, shared_dir, table
from .sql import ORACLE  # noqa: F401

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_model(spark: SparkSession, sf_dir: str):
    labels = table(spark, sf_dir, "labels").withColumn("held_out", held_out(F.col("doc_id")))
    return quality.fit(table(spark, sf_dir, "documents"), quality.labelled(labels))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, quality_model(spark, sf_dir)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def language_model(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents")
    return langid.fit(docs.where(~held_out(F.col("doc_id"))))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return langid.identify(docs, language_model(spark, sf_dir)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    folder = shared_dir(spark, "warc", uuid.uuid4().hex)
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = quotes.quoting_mails(table(spark, sf_dir, "conversations"))
    return quotes.link_quotes(materialize(mails))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.link_embeddings(table(spark, sf_dir, "embeddings"))[0]


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("spans").cast("bigint").alias("n_spans"), F.to_json("spans").alias("spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                      tokenizer_path("piece_bpe_32k.model"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_fingerprints, op3_mixing, op4_language, op5_warc, op6_quotes, op7_hnsw, op8_jaccard,
    op9_licenses, op10_packing, op11_secrets, op12_alignment, op13_repair)}
