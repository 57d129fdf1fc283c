"""Frames derived from the supplied tables (see FIXTURES.md).

Every frame is a projection (or a key join) of a supplied table, so its size
grows with the table and no data is made up on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.functions.labels import rule_scores
from vocspark.functions.text import clean_text, str_array

# Test bank (own sentences): row k = event_id % 24 -> (sentiment, text).
BANK = (
    ("Positive", "I love how fast the delivery was. Great packaging!"),
    ("Negative", "Terrible service, the agent was rude and never called back!!"),
    ("Neutral", "The parcel reached the depot on Monday."),
    ("Negative", "My order arrived broken. I hate waiting for a refund."),
    ("Positive", "Thanks to your helpful staff, the app login works again."),
    ("Negative", "WORST checkout page EVER!!! It is totally useless and slow."),
    ("Neutral", "Does the hotel menu list prices at www.example.org/menu today?"),
    ("Positive", "Amazing taste, fresh food, and the best meal this year."),
    ("Negative", "Sadly the material felt flimsy and the quality was poor."),
    ("Neutral", "I expected a reply from @helpdesk about the shipment."),
    ("Positive", "Excellent value. Absolutely worth the price, I recommend it."),
    ("Negative", "The app crash is frustrating. Support was helpful though."),
    ("Neutral", "He wore a red glove while loading the van."),
    ("Negative", "The courier was 'late' again."),
    ("Neutral", "Ticket late2 was moved to the next page."),
    ("Positive", "Love it! The terrible queue is gone. Very happy now."),
    ("Negative", "Overpriced and defective. Awful!"),
    ("Neutral", "ok"),
    ("Positive", "Wonderful stay, brilliant interface, perfect tracking."),
    ("Negative", "Unacceptable charge, see https://example.org/case?id=7 for the cost."),
    ("Neutral", "The manual has ten chapters about navigation."),
    ("Positive", "   Thank   you,  great   response.   "),
    ("Negative", "I am angry, furious and disappointed: cheap, defective, damaged!"),
    ("Neutral", "It's fine, no more to say."),
)

CHANNEL_BY_EVENT = (("click", "app_review"), ("view", "web_form"),
                    ("purchase", "email"), ("error", "twitter"))
OTHER_CHANNEL = "survey"
N_SEGMENTS = 7
HISTORY_CUTOFF = "2024-01-25"

# Raw label spellings for the label-rule operators, chosen by id % 8.
RAW_LABELS = ("negative", "neutral", "positive", "label_0", "LABEL_1", "Label_2",
              "POSITIVE", "other")
TEXT_LABELS = (" positive", "NEGATIVE ", "Neutral", "neutral ", "unknown", "pOsItIvE")

# Account fixture: domains by key, incl. typos and genuine look-alikes.
ACCOUNT_DOMAINS = ("gmail.com", "gmial.com", "yahoo.com", "hotmial.com", "outlook.com",
                   "company.org", "gnail.com", "mail.com", "ymail.com", "protonmail.com",
                   "yaho.com", "hotmail.co", "live.com", "outlok.com")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the scan into `defaultParallelism` partitions when it has
    fewer (a small table stored as one row group is one task otherwise).  At
    cluster scale the scan already has many more splits than cores and this
    adds nothing; the check is plan-time only (no job)."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One supplied table, pruned to `cols` before any spreading shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*cols) if cols else df)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")


def feedback_from_events(events: DataFrame) -> DataFrame:
    """One feedback row per event (pure projection, no shuffle)."""
    k = F.pmod(F.col("event_id"), F.lit(len(BANK))).cast("int")
    channel = F.when(F.lit(False), None)
    for ev, ch in CHANNEL_BY_EVENT:
        channel = channel.when(F.col("event_type") == ev, ch)
    channel = channel.otherwise(OTHER_CHANNEL)
    conf = ((F.lit(3400) + F.pmod(F.col("event_id") * 37, F.lit(6600))).cast("double")
            / F.lit(10000).cast("double"))
    return events.select(
        (F.col("event_id") + 1).alias("id"),
        F.get(str_array([t for _, t in BANK]), k).alias("text"),
        F.get(str_array([s for s, _ in BANK]), k).alias("sentiment"),
        conf.alias("confidence"),
        channel.alias("source"),
        F.col("ts").alias("created_at"),
        channel.alias("channel"),
        F.concat(F.lit("seg_"), F.pmod(F.col("user_id"), F.lit(N_SEGMENTS)).cast("string"))
        .alias("segment"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_from_events(_events(spark, sf_dir))


def raw_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`feedback` with rule-placed faults (FIXTURES.md 2.2)."""
    fb = feedback(spark, sf_dir)
    i = F.col("id")
    return fb.select(
        "id",
        F.when(i % 73 == 0, F.lit(None).cast("string"))
        .when(i % 79 == 0, F.lit("")).when(i % 71 == 0, F.lit("nan"))
        .otherwise(F.col("text")).alias("text"),
        F.when(i % 97 == 0, F.lit("Unknown")).otherwise(F.col("sentiment")).alias("sentiment"),
        F.when(i % 83 == 0, F.lit(None).cast("double"))
        .when(i % 89 == 0, F.lit(1.5)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(i % 61 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias("source"),
        F.when(i % 50 == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.col("created_at")).alias("created_at"),
        "channel", "segment",
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold sentiment of the fixture vs the rule scorer on the cleaned text."""
    fb = feedback(spark, sf_dir)
    _, pred, _ = rule_scores(clean_text("text"))
    return fb.select("id", "text", F.col("sentiment").alias("label"), pred.alias("pred"))


def labelled_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined to labels: gold = quality, predicted = n_chars rule."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "n_chars", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), "source",
        F.col("quality").cast("int").alias("label"),
        F.when(F.col("n_chars") >= 1000, 1).otherwise(0).cast("int").alias("pred"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text of documents and conversation turns: (id, origin, text)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text").select(
        F.col("doc_id").alias("id"), F.lit("document").alias("origin"), "text")
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.lit("conversation").alias("origin"), "text")
    return docs.unionByName(conv)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture rows with raw label spellings, stars and text labels."""
    fb = feedback(spark, sf_dir)
    i = F.col("id")
    return fb.select(
        "id", "text",
        F.get(str_array(RAW_LABELS), F.pmod(i, F.lit(len(RAW_LABELS))).cast("int")).alias("raw_label"),
        F.pmod(i, F.lit(5)).cast("int").alias("stars"),
        F.pmod(i, F.lit(2)).cast("int").alias("polarity"),
        F.get(str_array(TEXT_LABELS), F.pmod(i, F.lit(len(TEXT_LABELS))).cast("int")).alias("text_label"),
    )


def history_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fb = feedback(spark, sf_dir)
    cut = F.lit(HISTORY_CUTOFF).cast("timestamp_ntz")
    return fb.where(F.col("created_at") < cut), fb.where(F.col("created_at") >= cut)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account rows from `customer`: e-mails with typo domains, mixed case and
    spacing, and repeated addresses (every 13th key after 0 reuses the previous one)."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    key = F.col("c_custkey")
    owner = F.when((key % 13 == 0) & (key > 0), key - 1).otherwise(key)
    domain = F.get(str_array(ACCOUNT_DOMAINS), F.pmod(owner, F.lit(len(ACCOUNT_DOMAINS))).cast("int"))
    email = F.concat(F.lit("customer."), owner.cast("string"), F.lit("@"), domain)
    email = F.when(key % 17 == 0, F.concat(F.lit("  "), F.upper(email), F.lit(" "))).otherwise(email)
    email = F.when(key % 29 == 0, F.concat(F.lit("customer "), owner.cast("string"), F.lit("@"), domain)) \
        .otherwise(email)
    return c.select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        email.alias("email"),
        F.when(key % 5 == 0, "google").otherwise("local").alias("provider"),
        F.when(key == 1, "admin").otherwise("user").alias("role"),
        F.when(key % 3 == 0, 0).otherwise(1).cast("int").alias("verified"),
        (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
         + F.make_dt_interval(mins=F.pmod(key * 7919, F.lit(100000)).cast("int")))
        .alias("created_at"),
    )
