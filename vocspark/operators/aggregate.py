"""Aggregation operators.  Each is one declarative plan: partial aggregation
before the shuffle, grouping sets instead of repeated scans, and scalar
subqueries (not cross joins, not driver collects) for global choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.functions import text as tx
from vocspark.operators.filters import high_risk


def _hundred() -> Column:
    return F.lit(100.0)


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def share(part: Column, total: Column) -> Column:
    """100 * part / total as the reference computes it (100 * mean(bool));
    0 for an empty frame."""
    return F.coalesce(_hundred() * F.try_divide(part.cast("double"), total), F.lit(0.0))


def net_score(n_pos: Column, n_neg: Column, total: Column) -> Column:
    """100 * (mean(Positive) - mean(Negative)); 0 for an empty frame."""
    return F.coalesce(_hundred() * (F.try_divide(n_pos.cast("double"), total)
                                 - F.try_divide(n_neg.cast("double"), total)), F.lit(0.0))


def _is(sent: str, col: str = "sentiment") -> Column:
    return F.col(col) == sent


def with_scalars(df: DataFrame, scalars: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """Adds each scalar subquery as a column in its own projection and returns
    column references to use instead.  Spark runs a scalar subquery once per
    occurrence in the plan; Catalyst does not inline a non-cheap expression
    that is read more than once, so every subquery runs exactly once however
    many output expressions use it."""
    out = df.withColumns(scalars)
    return out, {k: F.col(k) for k in scalars}


# E1-E4 ---------------------------------------------------------------------

def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def sentiment_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("sentiment").agg(F.count(F.lit(1)).alias("count"))


def daily_counts(df: DataFrame, ts: str = "created_at") -> DataFrame:
    return (df.groupBy(F.to_date(ts).alias("date"), "sentiment")
            .agg(F.count(F.lit(1)).alias("count")).orderBy("date", "sentiment"))


def stats(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """total, per class and per (date, class) counts in one pass (rollup)."""
    g = (df.withColumn("date", F.to_date(ts))
         .rollup("sentiment", "date")
         .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_g")))
    level = F.when(F.col("_g") == 0, "daily").when(F.col("_g") == 1, "sentiment") \
        .otherwise("total")
    return g.select(level.alias("level"), "sentiment", "date", "count")


# E5-E11 --------------------------------------------------------------------

def _class_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total"),
            _n(_is("Positive")).alias("n_positive"),
            _n(_is("Neutral")).alias("n_neutral"),
            _n(_is("Negative")).alias("n_negative")]


def sentiment_share(df: DataFrame) -> DataFrame:
    c = df.agg(*_class_counts())
    return c.select(
        share(F.col("n_positive"), F.col("total")).alias("pct_positive"),
        share(F.col("n_neutral"), F.col("total")).alias("pct_neutral"),
        share(F.col("n_negative"), F.col("total")).alias("pct_negative"))


def net_sentiment(df: DataFrame) -> DataFrame:
    c = df.agg(*_class_counts())
    return c.select("total", net_score(F.col("n_positive"), F.col("n_negative"),
                                       F.col("total")).alias("net"))


def avg_confidence(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def review_stats(df: DataFrame, threshold: float = lx.REVIEW_THRESHOLD) -> DataFrame:
    c = df.agg(F.count(F.lit(1)).alias("total"),
               _n(F.col("confidence") < F.lit(threshold)).alias("review_count"))
    return c.select("review_count", share(F.col("review_count"), F.col("total"))
                    .alias("review_share"))


def history_kpis(df: DataFrame) -> DataFrame:
    c = df.agg(*_class_counts())
    return c.select(
        "total",
        "n_positive", share(F.col("n_positive"), F.col("total")).alias("pct_positive"),
        "n_neutral", share(F.col("n_neutral"), F.col("total")).alias("pct_neutral"),
        "n_negative", share(F.col("n_negative"), F.col("total")).alias("pct_negative"))


def _velocity(n: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    us = F.timestamp_diff("MICROSECOND", lo, hi).cast("double")
    hours = F.greatest(us / F.lit(1e6) / F.lit(3600.0), F.lit(1.0))
    per_day = hours >= F.lit(float(lx.VELOCITY_DAY_HOURS))
    rate = F.when(per_day, n / (hours / F.lit(24.0))).otherwise(n / hours)
    unit = F.when(per_day, "Day").otherwise("Hour")
    return F.round(rate, 1), unit


def volume_velocity(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Items per day (span >= 48 h) or per hour, nulls excluded."""
    c = df.agg(F.count(ts).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    rate, unit = _velocity(F.col("n"), F.col("lo"), F.col("hi"))
    return c.select(rate.alias("velocity"), unit.alias("velocity_unit"),
                    F.format_string("%.1f/%s", rate, unit).alias("velocity_label"))


def batch_kpis(enriched: DataFrame, ts: str = "created_at") -> DataFrame:
    """Volume, net, mean CSAT, velocity, urgent count, mean confidence: one pass."""
    c = enriched.agg(*_class_counts(),
                     F.avg("csat").alias("_csat"), F.avg("confidence").alias("_conf"),
                     _n(F.col("risk") == "High").alias("urgent"),
                     F.count(ts).alias("_nt"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    rate, unit = _velocity(F.col("_nt"), F.col("_lo"), F.col("_hi"))
    return c.select(
        F.col("total").alias("volume"),
        net_score(F.col("n_positive"), F.col("n_negative"), F.col("total")).alias("net"),
        F.round("_csat", 6).alias("avg_csat"),
        rate.alias("velocity"), unit.alias("velocity_unit"),
        F.col("urgent"), F.round("_conf", 6).alias("avg_confidence"))


# E12-E18 -------------------------------------------------------------------

RISK_LEVELS = ("High", "Medium", "Low", "None")


def risk_counts(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("risk").agg(F.count(F.lit(1)).alias("count"))


def risk_profile(enriched: DataFrame, items: str | None = None) -> DataFrame:
    """All four levels including zeros, in report order (one pass, no join).
    `items` names a column of counts where a row stands for several items."""
    def number(level: str):
        own = F.col("risk") == level
        return _n(own) if items is None else F.coalesce(F.sum(F.when(own, F.col(items))), F.lit(0))

    c = enriched.agg(*[number(lvl).alias(f"n{i}") for i, lvl in enumerate(RISK_LEVELS)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(lvl).alias("risk"),
                              F.col(f"n{i}").alias("count"))
                     for i, lvl in enumerate(RISK_LEVELS)])
    return c.select(F.inline(rows))


def channel_volume(df: DataFrame, key: str = "channel") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def channel_sentiment_counts(df: DataFrame, key: str = "channel") -> DataFrame:
    """(channel, sentiment) counts plus channel totals (sentiment null)."""
    g = df.rollup(key, "sentiment").agg(F.count(F.lit(1)).alias("count"),
                                        F.grouping_id().alias("_g"))
    return g.where(F.col("_g") < 3).select(key, "sentiment", "count")


def emotion_counts(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("emotion", "sentiment").agg(F.count(F.lit(1)).alias("count"))


def emotion_pivot(enriched: DataFrame) -> DataFrame:
    return (enriched.groupBy("emotion")
            .agg(*[_n(_is(s)).alias(s) for s in lx.CLASSES]))


def aspect_patterns(aspects=lx.ASPECTS) -> list[tuple[int, str, str]]:
    return [(i + 1, name, r"(?U)\b(" + "|".join(words) + r")\b")
            for i, (name, words) in enumerate(aspects)]


def aspect_breakdown(df: DataFrame, text: str = "text") -> DataFrame:
    """Items per (aspect, sentiment) by word-boundary keyword regex on the
    lower-cased text; one scan for all aspects, zero rows omitted."""
    low = F.lower(F.col(text))
    flagged = F.array(*[F.when(low.rlike(p), F.struct(F.lit(r).alias("aspect_rank"),
                                                      F.lit(n).alias("aspect")))
                        for r, n, p in aspect_patterns()])
    hits = df.select("sentiment", F.explode(F.filter(flagged, lambda x: x.isNotNull())).alias("a"))
    return (hits.groupBy(F.col("a.aspect_rank").alias("aspect_rank"),
                         F.col("a.aspect").alias("aspect"), "sentiment")
            .agg(F.count(F.lit(1)).alias("count")))


def aspect_pivot(breakdown: DataFrame) -> DataFrame:
    return (breakdown.groupBy("aspect_rank", "aspect")
            .agg(*[F.sum(F.when(_is(s), F.col("count")).otherwise(0)).alias(s)
                   for s in lx.CLASSES]))


def worst_best_aspect(breakdown: DataFrame) -> DataFrame:
    """Aspect with most Negative and most Positive items; ties -> declared order."""
    neg = F.when(_is("Negative"), F.struct(F.col("count"), -F.col("aspect_rank"), F.col("aspect")))
    pos = F.when(_is("Positive"), F.struct(F.col("count"), -F.col("aspect_rank"), F.col("aspect")))
    g = breakdown.agg(F.max(neg).alias("w"), F.max(pos).alias("b"))
    return g.select(F.col("w.aspect").alias("worst_aspect"), F.col("w.count").alias("worst_count"),
                    F.col("b.aspect").alias("best_aspect"), F.col("b.count").alias("best_count"))


# E19-E23 -------------------------------------------------------------------

def trend_unit(df: DataFrame, ts: str = "created_at") -> Column:
    """'day' when the timestamped span is >= 3 whole days, else 'hour'
    (a scalar subquery: one small aggregate, no join, no collect)."""
    span = df.agg(F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)).alias("us"))
    us = span.scalar()
    return F.when(F.floor(us / F.lit(86_400_000_000)) >= lx.TREND_DAY_SPAN_DAYS,
                  F.lit("day")).otherwise(F.lit("hour"))


def sentiment_trend(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Counts per (bucket, sentiment); empty buckets are not filled."""
    valid = df.where(F.col(ts).isNotNull())
    unit = trend_unit(valid, ts)
    bucket = F.when(unit == "day", F.date_trunc("day", F.col(ts))) \
        .otherwise(F.date_trunc("hour", F.col(ts)))
    return (valid.groupBy(bucket.alias("bucket"), "sentiment")
            .agg(F.count(F.lit(1)).alias("count")))


def trend_matrix(df: DataFrame, ts: str = "created_at", min_rows: int = 5) -> DataFrame:
    """Trend pivoted to one column per class (0 fill); empty below min_rows."""
    valid = df.where(F.col(ts).isNotNull())
    unit = trend_unit(valid, ts)
    enough = valid.agg(F.count(F.lit(1))).scalar() >= min_rows
    bucket = F.when(unit == "day", F.date_trunc("day", F.col(ts))) \
        .otherwise(F.date_trunc("hour", F.col(ts)))
    return (valid.where(enough).groupBy(bucket.alias("bucket"))
            .agg(*[_n(_is(s)).alias(s) for s in lx.CLASSES]))


def group_net_sentiment(df: DataFrame, key: str = "channel", n: int | None = 10) -> DataFrame:
    """Items and net per group, most items first (ties by key); top n.  Items
    without a group are left out, as in `group_gap`."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("items"),
                            _n(_is("Positive")).alias("_p"), _n(_is("Negative")).alias("_q"))
    g = g.select(key, "items", net_score(F.col("_p"), F.col("_q"), F.col("items")).alias("net"))
    g = g.orderBy(F.desc("items"), F.asc(key))
    return g.limit(n) if n else g


def group_gap(df: DataFrame, keys=("channel", "segment")) -> DataFrame:
    """Per dimension: lowest and highest net group (ties -> smallest key), only
    when the dimension has more than one group; one row per dimension."""
    kind, grp = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:
        kind = F.when(F.col(f"_no_{k}") == 0, k).otherwise(kind)
        grp = F.when(F.col(f"_no_{k}") == 0, F.col(k)).otherwise(grp)
    # one pass for all dimensions
    g = df.groupingSets([[F.col(k)] for k in keys], *keys).agg(
        F.count(F.lit(1)).alias("n"), _n(_is("Positive")).alias("p"), _n(_is("Negative")).alias("q"),
        *[F.grouping(k).alias(f"_no_{k}") for k in keys])
    g = g.select(kind.alias("dimension"), grp.alias("grp"), net_score(F.col("p"), F.col("q"), F.col("n")).alias("net"))
    r = g.where(F.col("grp").isNotNull()).groupBy("dimension").agg(
        F.count(F.lit(1)).alias("groups"),
        F.min(F.struct("net", "grp")).alias("lo"),
        F.min(F.struct((-F.col("net")).alias("neg"), "grp")).alias("hi"))
    return r.where(F.col("groups") > 1).select(
        "dimension", "groups", F.col("lo.grp").alias("worst"), F.col("lo.net").alias("worst_net"),
        F.col("hi.grp").alias("best"), (-F.col("hi.neg")).alias("best_net"))


def modal_emotion(enriched: DataFrame) -> DataFrame:
    """Most common emotion among High-risk items (ties -> smallest name)."""
    return high_risk(enriched).agg(F.count(F.lit(1)).alias("high_risk"),
                    F.coalesce(F.mode("emotion", True),
                               F.lit(lx.FALLBACK_HIGH_RISK_EMOTION)).alias("emotion"))


# E24-E33 -------------------------------------------------------------------

def top_words(df: DataFrame, n: int | None = 12, text: str = "text",
              stopwords=lx.STOPWORDS) -> DataFrame:
    """Most frequent content words; ties alphabetical.  Map-side partial
    counts shrink the shuffle; the top-n is a TakeOrderedAndProject."""
    words = df.select(F.explode(tx.content_words(text, stopwords)).alias("word"))
    c = words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    c = c.orderBy(F.desc("count"), F.asc("word"))
    return c.limit(n) if n else c


def top_phrases(df: DataFrame, n: int | None = 6, text: str = "text",
                min_count: int = 2) -> DataFrame:
    """Most frequent adjacent content-word pairs with count >= 2."""
    # words in their own projection: the pair expression reads them four times
    w = df.select(tx.content_words(text).alias("_w"))
    ph = w.select(F.explode(tx.bigrams("_w")).alias("phrase"))
    c = ph.groupBy("phrase").agg(F.count(F.lit(1)).alias("count")) \
        .where(F.col("count") >= min_count).orderBy(F.desc("count"), F.asc("phrase"))
    return c.limit(n) if n else c


def confidence_histogram(df: DataFrame, bins: int = 15, lo: float = 0.3, hi: float = 1.0,
                         scale: int = 10_000) -> DataFrame:
    """Equal bins on [lo, hi], last bin closed, values outside dropped, per
    sentiment.  Confidences are 4-place decimals, so the bin index is exact
    integer arithmetic on confidence * 10^4."""
    k = F.round(F.col("confidence") * scale).cast("long")
    klo, khi = round(lo * scale), round(hi * scale)
    b = F.least(F.floor((k - klo) * bins / F.lit(khi - klo)) + 1, F.lit(bins)).cast("int")
    return (df.where((k >= klo) & (k <= khi))
            .groupBy("sentiment", b.alias("bin")).agg(F.count(F.lit(1)).alias("count")))


def intensity_histogram(enriched: DataFrame, width: int = 5, bins: int = 20) -> DataFrame:
    b = F.least(F.floor(F.col("intensity") / width), F.lit(bins - 1)).cast("int")
    return enriched.groupBy("sentiment", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def length_stats(df: DataFrame, text: str = "text") -> DataFrame:
    w = tx.word_count(text)
    return df.agg(F.round(F.avg(w), 6).alias("avg_words"), F.max(w).alias("max_words"))


def length_profile(df: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """Per label: count, mean, std, min, quartiles (linear), max of word counts,
    1 decimal.  `percentile` keeps a value -> frequency map per group, so its
    memory is bounded by distinct lengths, not rows."""
    d = df.select(label, tx.word_count(text).alias("_w"))
    q = F.percentile("_w", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = d.groupBy(label).agg(F.count("_w").alias("count"), F.avg("_w").alias("mean"),
                             F.stddev_samp("_w").alias("std"), F.min("_w").alias("min"),
                             q.alias("_q"), F.max("_w").alias("max"))
    return g.select(label, "count", F.round("mean", 1).alias("mean"),
                    F.round("std", 1).alias("std"), F.col("min").cast("double").alias("min"),
                    F.round(F.col("_q")[0], 1).alias("p25"), F.round(F.col("_q")[1], 1).alias("p50"),
                    F.round(F.col("_q")[2], 1).alias("p75"), F.col("max").cast("double").alias("max"))


def length_histogram(df: DataFrame, bins: int = 40, text: str = "text") -> DataFrame:
    """Word-count histogram with equal bins between the global min and max.
    The texts are scanned once: rows collapse to (word count, rows) first (at
    most one row per distinct length, aggregated map-side), and both the
    min/max subquery and the binning read that small frame (AQE reuses its
    exchange)."""
    d = (df.select(tx.word_count(text).alias("_w"))
         .groupBy("_w").agg(F.count(F.lit(1)).alias("_c")))
    # min/max over lengths that occur (`_c > 0`, always true): reading `_c`
    # keeps the subquery on the aggregate instead of a rewrite to a re-scan
    occurs = F.col("_c") > 0
    d, sc = with_scalars(d, {"_mm": d.agg(F.struct(
        F.min(F.when(occurs, F.col("_w"))).alias("lo"),
        F.max(F.when(occurs, F.col("_w"))).alias("hi"))).scalar()})
    lo, hi = sc["_mm"]["lo"], sc["_mm"]["hi"]
    width = F.greatest(hi - lo, F.lit(1))
    b = F.least(F.floor((F.col("_w") - lo) * bins / width), F.lit(bins - 1)).cast("int")
    return d.groupBy(b.alias("bin")).agg(F.sum("_c").alias("count"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def high_confidence_share(df: DataFrame, threshold: float = lx.HIGH_CONFIDENCE) -> DataFrame:
    c = df.agg(F.count(F.lit(1)).alias("t"), _n(F.col("confidence") >= F.lit(threshold)).alias("h"))
    return c.select(share(F.col("h"), F.col("t")).alias("high_confidence_pct"))


def distinct_values(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)


def date_range(df: DataFrame, ts: str = "created_at") -> DataFrame:
    d = F.to_date(ts)
    return df.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"))


def daily_sketches(df: DataFrame, keys=("channel", "segment"), ts: str = "created_at", lg_k: int = 12) -> DataFrame:
    """Per day and dimension an HLL sketch of its groups, of bounded size
    whatever their number: (date, dimension, sketch).  Null groups don't count."""
    kinds = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("grp")) for k in keys])
    return df.select(F.to_date(ts).alias("date"), F.inline(kinds)).where(F.col("grp").isNotNull()) \
        .groupBy("date", "dimension").agg(F.hll_sketch_agg("grp", F.lit(lg_k)).alias("sketch"))


def merged_group_counts(sketches: DataFrame) -> DataFrame:
    """(dimension, groups, multi) over any days of a sketch table, without the
    items.  The count is exact while a sketch keeps its hashes (some hundred
    groups at lg_k = 12), later within about 1.6 % (one standard error)."""
    n = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy("dimension").agg(n.alias("groups")).withColumn("multi", F.col("groups") > 1)


def group_counts(df: DataFrame, keys=("channel", "segment")) -> DataFrame:
    """Distinct groups per dimension and whether there is more than one."""
    aggs = []
    for k in keys:
        aggs += [F.count_distinct(k).alias(f"{k}_groups")]
    c = df.agg(*aggs)
    return c.select("*", *[(F.col(f"{k}_groups") > 1).alias(f"{k}_multi") for k in keys])


def cloud_terms(df: DataFrame, n: int = 15, text: str = "text",
                min_chars: int = lx.CLOUD_MIN_CHARS) -> DataFrame:
    """Word frequencies of Negative text, only when the Negative text joined
    by single spaces has >= 30 characters (checked without joining it)."""
    neg = df.where(_is("Negative"))
    joined_len = neg.agg((F.sum(F.length(text)) + F.count(F.lit(1)) - 1).alias("l")).scalar()
    return top_words(neg.where(F.coalesce(joined_len >= min_chars, F.lit(False))), n, text)
