"""Windows, sorts and top-k.  Every order ends in a unique key (`id`, a word)
so ties are deterministic.  Global top-k plans as TakeOrderedAndProject
(each task keeps k rows); per-group top-k uses `row_number() <= k`, which
Spark turns into a WindowGroupLimit below the shuffle, so a hot group (one
class can hold a third of all rows) ships only k rows per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.functions import text as tx
from vocspark.operators.filters import high_risk


def top_per_group(df: DataFrame, group: str, order: list, k: int,
                  rank_name: str = "rank", task_rows: int | None = None) -> DataFrame:
    """Rows ranked 1..k within each group.

    Spark limits each input partition to k rows per group before the shuffle
    (WindowGroupLimit), so one group's final task receives partitions * k rows.
    For inputs of very many partitions, `task_rows` bounds that: buckets of input
    partitions are first reduced to k rows each.  Only then are partitions
    counted while the query is built; by default, building runs nothing.  The
    ranks do not depend on `task_rows`."""
    d = df
    parts = df.rdd.getNumPartitions() if task_rows else 0
    if task_rows and parts * k > task_rows:
        fan_in = max(2, min(parts, -(-parts * k // task_rows)))
        w1 = Window.partitionBy(group, "_bucket").orderBy(*order)
        d = (d.withColumn("_bucket", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
             .withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_bucket", "_r1"))
    w = Window.partitionBy(group).orderBy(*order)
    return d.withColumn(rank_name, F.row_number().over(w)).where(F.col(rank_name) <= k)


def per_class_quota(df: DataFrame, label: str = "label", pos: str = "pos",
                    n_train: int = 4000, n_test: int = 500, max_pos: int | None = None) -> DataFrame:
    """In stream order, first n_train rows per class -> train, next n_test ->
    test; other rows are not taken (that is the sampling rule itself).
    `max_pos` optionally bounds how far into the stream to look."""
    src = df.where(F.col(pos) < max_pos) if max_pos is not None else df
    d = top_per_group(src, label, [F.col(pos)], n_train + n_test, "_rn")
    split = F.when(F.col("_rn") <= n_train, "train").otherwise("test")
    return d.withColumn("split", split).drop("_rn")


def top_words_per_sentiment(df: DataFrame, n: int = 12, text: str = "text") -> DataFrame:
    words = df.select("sentiment", F.explode(tx.content_words(text)).alias("word"))
    c = words.groupBy("sentiment", "word").agg(F.count(F.lit(1)).alias("count"))
    return top_per_group(c, "sentiment", [F.desc("count"), F.asc("word")], n)


def top_phrases_per_sentiment(df: DataFrame, n: int = 6, text: str = "text",
                              min_count: int = 2) -> DataFrame:
    w = df.select("sentiment", tx.content_words(text).alias("_w"))
    ph = w.select("sentiment", F.explode(tx.bigrams("_w")).alias("phrase"))
    c = ph.groupBy("sentiment", "phrase").agg(F.count(F.lit(1)).alias("count")) \
        .where(F.col("count") >= min_count)
    return top_per_group(c, "sentiment", [F.desc("count"), F.asc("phrase")], n)


def voice_of_customer(df: DataFrame, n: int = 5, id_col: str = "id") -> DataFrame:
    """n most confident Negative and n most confident Positive items."""
    d = df.where(F.col("sentiment").isin("Negative", "Positive"))
    return top_per_group(d, "sentiment", [F.desc("confidence"), F.asc(id_col)], n)


def latest_feedback(df: DataFrame, limit: int | None = lx.PAGE_LIMIT_DEFAULT, offset: int = 0,
                    ts: str = "created_at", id_col: str = "id") -> DataFrame:
    """Newest first; LIMIT/OFFSET page (limit 1..1000, offset >= 0)."""
    if limit is not None and not lx.PAGE_LIMIT_MIN <= limit <= lx.PAGE_LIMIT_MAX:
        raise ValueError("limit must be within 1..1000")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    d = df.orderBy(F.desc(ts), F.desc(id_col))
    if offset:
        d = d.offset(offset)
    return d.limit(limit) if limit is not None else d


def deep_page(stored: DataFrame, limit: int = lx.PAGE_LIMIT_DEFAULT, offset: int = 0,
              ts: str = "created_at", id_col: str = "id") -> DataFrame:
    """A page at any depth of a table partitioned by `date` (the day of `ts`),
    newest first, with the table's `total`.  Rows per date, counted without
    reading a column, and their sums from the newest date on tell which dates
    hold the page; only their partitions are read and sorted.  Rows without a
    time come last.  A page past the end has no rows."""
    if not lx.PAGE_LIMIT_MIN <= limit <= lx.PAGE_LIMIT_MAX:
        raise ValueError("limit must be within 1..1000")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    # one row per date: a window over them is small
    newest = Window.orderBy(F.desc("date"))
    dates = stored.groupBy("date").count().select(
        "date", "count", (F.sum("count").over(newest) - F.col("count")).alias("before"),
        F.sum("count").over(Window.partitionBy()).alias("total"))
    # at most `limit` dates: each has a row
    hold = dates.where((F.col("before") < offset + limit) & (F.col("before") + F.col("count") > offset)) \
        .orderBy("before").collect()
    if not hold:
        return stored.withColumn("total", F.lit(0).cast("long")).limit(0)
    days = [r["date"] for r in hold if r["date"] is not None]
    mine = F.col("date").isin(days) if days else F.lit(False)
    if any(r["date"] is None for r in hold):
        mine = mine | F.col("date").isNull()
    return stored.where(mine).orderBy(F.desc(ts), F.desc(id_col)).offset(offset - hold[0]["before"]).limit(limit) \
        .withColumn("total", F.lit(hold[0]["total"]).cast("long"))


def page_after(df: DataFrame, last_ts, last_id, limit: int = lx.PAGE_LIMIT_DEFAULT,
               ts: str = "created_at", id_col: str = "id") -> DataFrame:
    """Key-set paging for deep pages: rows strictly after (last_ts, last_id)
    in newest-first order; the predicate reaches the scan."""
    t = F.lit(last_ts).cast("timestamp_ntz")
    cond = (F.col(ts) < t) | ((F.col(ts) == t) & (F.col(id_col) < F.lit(last_id)))
    return df.where(cond).orderBy(F.desc(ts), F.desc(id_col)).limit(limit)


def urgent_queue(enriched: DataFrame, n: int = 10, id_col: str = "id") -> DataFrame:
    """High risk by intensity desc then confidence desc, head n."""
    cols = [c for c in ("id", "text", "emotion", "intensity", "confidence", "driver",
                        "channel", "segment") if c in enriched.columns]
    return (high_risk(enriched)
            .orderBy(F.desc("intensity"), F.desc("confidence"), F.asc(id_col))
            .limit(n).select(*cols))


def urgent_by_confidence(df: DataFrame, n: int = 10, id_col: str = "id") -> DataFrame:
    """High risk (Negative when there is no risk column) top n by confidence."""
    urgent = high_risk(df) if "risk" in df.columns else df.where(F.col("sentiment") == "Negative")
    return urgent.orderBy(F.desc("confidence"), F.asc(id_col)).limit(n)


def urgent_by_intensity(enriched: DataFrame, n: int = 10, id_col: str = "id") -> DataFrame:
    top = (high_risk(enriched)
           .orderBy(F.desc("intensity"), F.asc(id_col)).limit(n))
    return top.select(id_col, tx.snippet("text").alias("snippet"), "emotion",
                      F.format_string("%d/100", "intensity").alias("intensity"),
                      "confidence")


def response_queue(df: DataFrame, n: int = 15, id_col: str = "id") -> DataFrame:
    return (df.where((F.col("sentiment") == "Negative")
                     & (F.col("confidence") >= F.lit(lx.URGENT_CONFIDENCE)))
            .orderBy(F.desc("confidence"), F.asc(id_col)).limit(n))


def recent_view(df: DataFrame, n: int = 100, id_col: str = "id") -> DataFrame:
    return (df.orderBy(F.desc("created_at"), F.desc(id_col)).limit(n)
            .select("created_at", id_col, "text", "sentiment", "confidence", "source"))


def preview(df: DataFrame, n: int = 5, order: str = "id") -> DataFrame:
    return df.orderBy(order).limit(n)


def seeded_key(id_col: str = "id", seed: int = 42):
    """Repeatable pseudo-random order key: md5 of 'id:seed' as hex text.  A
    standard digest, so any engine can reproduce (and check) the order."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def shuffle_rows(df: DataFrame, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Seeded full shuffle: order by a hash of (id, seed); repeatable."""
    return df.orderBy(seeded_key(id_col, seed), id_col)


def sample_n(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Seeded n rows (all when fewer): the n smallest hashes, a TakeOrdered."""
    return df.orderBy(seeded_key(id_col, seed), id_col).limit(n)

