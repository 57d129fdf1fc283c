"""Queries over the supplied tables, one or more per operator, each with its
DuckDB oracle where SQL can state it.  Importing this module fills the
registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocspark.operators import aggregate as ag
from vocspark.operators import enrich as en
from vocspark.plans import sql as S
from vocspark.plans.registry import query
from vocspark.sources import fixture as fx

FB_COLS = "id, text, sentiment, confidence, source, created_at, channel, segment"
TS = "strftime(created_at, '%Y-%m-%d %H:%M:%S.%f')"
FB_OUT = FB_COLS.replace("created_at", TS + " AS created_at")
ENRICHED = S.with_(S.FEEDBACK, S.enriched_ctes())


def enriched(spark, sf):
    return en.enrich_feedback(fx.feedback(spark, sf))


# Flagship --------------------------------------------------------------------

def flagship(spark, sf):
    """Fixture -> enrich -> per-channel items, net, high-risk count and mean
    intensity, busiest channel first."""
    e = enriched(spark, sf)
    g = e.groupBy("channel").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("sentiment") == "Positive").alias("_p"),
        F.count_if(F.col("sentiment") == "Negative").alias("_q"),
        F.count_if(F.col("risk") == "High").alias("high_risk"),
        F.round(F.avg("intensity"), 6).alias("avg_intensity"))
    return (g.select("channel", "items",
                     ag.net_score(F.col("_p"), F.col("_q"), F.col("items")).alias("net"),
                     "high_risk", "avg_intensity")
            .orderBy(F.desc("items"), "channel"))


query("channel_risk_overview", "E21+B16", ENRICHED + f"""
SELECT channel, count(*) AS items,
       {S.net_sql("count(*) FILTER (WHERE sentiment = 'Positive')",
                  "count(*) FILTER (WHERE sentiment = 'Negative')", "count(*)")} AS net,
       count(*) FILTER (WHERE risk = 'High') AS high_risk,
       round(avg(intensity), 6) AS avg_intensity
FROM enriched GROUP BY channel""")(flagship)


# A: sources ------------------------------------------------------------------

@query("read_feedback", "A1", S.with_(S.FEEDBACK) + f"SELECT {FB_OUT} FROM feedback")
def q_read_feedback(spark, sf):
    return fx.feedback(spark, sf)


# E1-E4 -------------------------------------------------------------------------

@query("total_count", "E1", S.with_(S.FEEDBACK) + "SELECT count(*) AS total FROM feedback")
def q_total_count(spark, sf):
    return ag.total_count(fx.feedback(spark, sf))


@query("sentiment_counts", "E2", S.with_(S.FEEDBACK)
       + "SELECT sentiment, count(*) AS count FROM feedback GROUP BY sentiment")
def q_sentiment_counts(spark, sf):
    return ag.sentiment_counts(fx.feedback(spark, sf))


@query("daily_counts", "E3", S.with_(S.FEEDBACK) + """
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, sentiment, count(*) AS count
FROM feedback GROUP BY 1, 2 ORDER BY 1, 2""")
def q_daily_counts(spark, sf):
    return ag.daily_counts(fx.feedback(spark, sf))


@query("stats", "E4", S.with_(S.FEEDBACK) + """
SELECT CASE WHEN grouping(sentiment, date) = 0 THEN 'daily'
            WHEN grouping(sentiment, date) = 1 THEN 'sentiment' ELSE 'total' END AS level,
       sentiment, strftime(date, '%Y-%m-%d') AS date, count(*) AS count
FROM (SELECT sentiment, CAST(created_at AS DATE) AS date FROM feedback)
GROUP BY ROLLUP (sentiment, date)""")
def q_stats(spark, sf):
    return ag.stats(fx.feedback(spark, sf))


# B16 ---------------------------------------------------------------------------

@query("enrich_feedback", "B16", ENRICHED + f"SELECT {FB_OUT}, emotion, intensity, risk, "
       "driver, csat FROM enriched")
def q_enrich(spark, sf):
    return enriched(spark, sf)


from vocspark.plans import catalog_text  # noqa: E402,F401
from vocspark.plans import catalog_agg  # noqa: E402,F401
from vocspark.plans import catalog_report  # noqa: E402,F401
from vocspark.plans import catalog_io  # noqa: E402,F401
