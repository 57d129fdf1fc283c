"""A corpus pipeline: documents -> packed training sequences.

Each stage reads what the one before it wrote, works on all of it, and keeps the
columns of documents (the last gives pieces of sequences)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.llm import jaccard, langid, mixing, packing, quality, queries
from vocspark.llm.common import materialize, table

#: Below this score a text with letters has no language that the models know.
LEAST_LANGUAGE = 0.3
#: Near duplicates: word 5-shingles, similarity of 0.8 or more.
SHINGLE, SIMILAR = 5, 80
#: Passes over the bucket keys: more of them hold less on disk at a time.
KEY_PASSES = 4
#: Words that packing keeps per worker: its executors hold what four stages left.
CACHE_WORDS = 200_000

#: Spark's bound on the bytes of a batch that goes to a Python worker.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def with_text_once(docs: DataFrame) -> DataFrame:
    """The columns but the text as one struct, and the text: what an operator
    gives back holds each text once."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")


def as_documents(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select("row.*", "text").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no known language, go: null and empty
    texts too.  Repeated rows and null ids stay or go like any row.  Where no
    document has a language there is no model, and all documents pass."""
    spark.conf.set(*BATCH_BYTES)
    model = queries.language_model(spark, sf_dir)
    if model is None:
        return docs
    found = langid.identify(with_text_once(docs), model)
    return as_documents(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)), docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as label 0 go; null texts count as
    empty.  Repeated rows stay or go alike.  Where labels of one class or none
    give no model, all documents pass."""
    spark.conf.set(*BATCH_BYTES)
    model = queries.quality_model(spark, sf_dir)
    if model is None:
        return docs
    return as_documents(quality.score_quality(with_text_once(docs), model).where("score >= 0.7"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id (one row of
    it); documents without words and rows without an id all stay."""
    spark.conf.set(*BATCH_BYTES)
    return jaccard.drop_near_duplicates(docs, SIMILAR, 100, SHINGLE, KEY_PASSES)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, twice at most; documents
    without words once."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; null texts are empty ones."""
    spark.conf.set(*BATCH_BYTES)
    return packing.pack(docs, queries.tokenizer_path(), cache_words=CACHE_WORDS)


STAGES = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: Models and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
