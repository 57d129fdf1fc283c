"""Queries for filters, aggregations, windows, top-k, sets and evaluation
(C*, E*, F*, G*, H*, I3/I5/I6, A2/A9-A14/A19/A20)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.operators import accounts as acc
from vocspark.operators import aggregate as ag
from vocspark.operators import enrich as en
from vocspark.operators import evaluate as ev
from vocspark.operators import filters as fl
from vocspark.operators import rank as rk
from vocspark.plans import sql as S
from vocspark.plans.registry import query
from vocspark.session import materialize, shared_dir
from vocspark.sources import fixture as fx
from vocspark.sources import ingest as ing

FB = S.with_(S.FEEDBACK)
ENR = S.with_(S.FEEDBACK, S.enriched_ctes())
TSF = "'%Y-%m-%d %H:%M:%S.%f'"


def fb(spark, sf):
    return fx.feedback(spark, sf)


def enr(spark, sf):
    return en.enrich_feedback(fb(spark, sf))


def _counts(src: str) -> str:
    return (f"(SELECT count(*) AS total, count(*) FILTER (WHERE sentiment = 'Positive') AS n_positive, "
            f"count(*) FILTER (WHERE sentiment = 'Neutral') AS n_neutral, "
            f"count(*) FILTER (WHERE sentiment = 'Negative') AS n_negative FROM {src})")


# C ------------------------------------------------------------------------------

HF_SOURCES = ("email", "twitter", "web_form")
HF_FROM, HF_TO = "2024-01-05", "2024-01-20"


@query("history_filter", "C1", FB + f"""SELECT id FROM feedback
WHERE sentiment IN ('Positive', 'Negative') AND source IN {tuple(HF_SOURCES)!r}
  AND CAST(created_at AS DATE) BETWEEN DATE '{HF_FROM}' AND DATE '{HF_TO}'""".replace('"', "'"))
def q_history_filter(spark, sf):
    d = fl.history_filter(fb(spark, sf), ["Positive", "Negative"], HF_SOURCES, HF_FROM, HF_TO)
    return d.select("id")


@query("table_filter", "C2", ENR + """SELECT id FROM enriched
WHERE sentiment IN ('Negative', 'Neutral') AND risk IN ('High', 'Low')
  AND contains(lower(text), 'the')""")
def q_table_filter(spark, sf):
    return fl.table_filter(enr(spark, sf), ["Negative", "Neutral"], ["High", "Low"], " The ") \
        .select("id")


@query("text_search", "C3", FB + "SELECT id, text FROM feedback WHERE contains(lower(text), 'delivery')")
def q_text_search(spark, sf):
    return fl.text_search(fb(spark, sf), "DELIVERY").select("id", "text")


@query("needs_review", "C4", FB + "SELECT id, confidence FROM feedback "
       "WHERE confidence < CAST(0.6 AS DOUBLE)")
def q_needs_review(spark, sf):
    return fl.needs_review(fb(spark, sf), 0.60).select("id", "confidence")


@query("high_risk", "C5", ENR + "SELECT id, emotion, intensity FROM enriched WHERE risk = 'High'")
def q_high_risk(spark, sf):
    return fl.high_risk(enr(spark, sf)).select("id", "emotion", "intensity")


@query("urgent_negative", "C6", FB + "SELECT id, confidence FROM feedback WHERE sentiment = 'Negative' "
       "AND confidence >= CAST(0.7 AS DOUBLE)")
def q_urgent_negative(spark, sf):
    return fl.urgent_negative(fb(spark, sf)).select("id", "confidence")


@query("with_timestamp", "C7", S.with_(S.RAW_FEEDBACK)
       + "SELECT id FROM raw_feedback WHERE created_at IS NOT NULL")
def q_with_ts(spark, sf):
    return fl.with_timestamp(fx.raw_feedback(spark, sf)).select("id")


LABELLED = S.with_(S.FEEDBACK, f"""labelled AS (SELECT id, text, sentiment AS label,
  {S.rule_scores_sql(S.clean_sql('text'))[0]} AS pred FROM feedback)""")


@query("misclassified", "C9", LABELLED + "SELECT id, label, pred FROM labelled "
       "WHERE label IS DISTINCT FROM pred")
def q_misclassified(spark, sf):
    return fl.misclassified(fx.labelled(spark, sf)).select("id", "label", "pred")


# E5-E11 --------------------------------------------------------------------------

@query("sentiment_share", "E5", FB + f"""SELECT {S.share_sql('n_positive', 'total')} AS pct_positive,
  {S.share_sql('n_neutral', 'total')} AS pct_neutral, {S.share_sql('n_negative', 'total')} AS pct_negative
FROM {_counts('feedback')}""")
def q_share(spark, sf):
    return ag.sentiment_share(fb(spark, sf))


@query("net_sentiment", "E6", FB + f"SELECT total, {S.net_sql('n_positive', 'n_negative', 'total')} "
       f"AS net FROM {_counts('feedback')}")
def q_net(spark, sf):
    return ag.net_sentiment(fb(spark, sf))


@query("avg_confidence", "E7", FB + "SELECT round(avg(confidence), 6) AS avg_confidence FROM feedback")
def q_avg_conf(spark, sf):
    return ag.avg_confidence(fb(spark, sf))


@query("review_stats", "E8", FB + f"""SELECT review_count, {S.share_sql('review_count', 'total')}
  AS review_share FROM (SELECT count(*) AS total,
  count(*) FILTER (WHERE confidence < CAST(0.6 AS DOUBLE)) AS review_count FROM feedback)""")
def q_review(spark, sf):
    return ag.review_stats(fb(spark, sf), 0.60)


@query("history_kpis", "E9", FB + f"""SELECT total, n_positive,
  {S.share_sql('n_positive', 'total')} AS pct_positive, n_neutral,
  {S.share_sql('n_neutral', 'total')} AS pct_neutral, n_negative,
  {S.share_sql('n_negative', 'total')} AS pct_negative
FROM {_counts("(SELECT * FROM feedback WHERE source <> 'survey')")}""")
def q_history_kpis(spark, sf):
    return ag.history_kpis(fb(spark, sf).where(F.col("source") != "survey"))


def _velocity_sql(n: str, lo: str, hi: str) -> tuple[str, str]:
    hours = (f"greatest(CAST(date_diff('microsecond', {lo}, {hi}) AS DOUBLE) / CAST(1000000 AS DOUBLE)"
             f" / CAST(3600 AS DOUBLE), CAST(1 AS DOUBLE))")
    rate = (f"round(CASE WHEN {hours} >= CAST({lx.VELOCITY_DAY_HOURS} AS DOUBLE) THEN {n} / "
            f"({hours} / CAST(24 AS DOUBLE)) ELSE {n} / {hours} END, 1)")
    unit = f"CASE WHEN {hours} >= CAST({lx.VELOCITY_DAY_HOURS} AS DOUBLE) THEN 'Day' ELSE 'Hour' END"
    return rate, unit


_R, _U = _velocity_sql("n", "lo", "hi")


@query("volume_velocity", "E11", FB + f"""SELECT {_R} AS velocity, {_U} AS velocity_unit,
  printf('%.1f/%s', {_R}, {_U}) AS velocity_label
FROM (SELECT count(created_at) AS n, min(created_at) AS lo, max(created_at) AS hi FROM feedback)""")
def q_velocity(spark, sf):
    return ag.volume_velocity(fb(spark, sf))


@query("volume_velocity_24h", "E11", FB + f"""SELECT {_R} AS velocity, {_U} AS velocity_unit,
  printf('%.1f/%s', {_R}, {_U}) AS velocity_label
FROM (SELECT count(created_at) AS n, min(created_at) AS lo, max(created_at) AS hi FROM feedback
      WHERE created_at < TIMESTAMP '2024-01-02 00:00:00')""")
def q_velocity_24h(spark, sf):
    d = fb(spark, sf).where(F.col("created_at") < F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    return ag.volume_velocity(d)


_RB, _UB = _velocity_sql("nt", "lo", "hi")


@query("batch_kpis", "E10", ENR + f"""SELECT total AS volume,
  {S.net_sql('p', 'q', 'total')} AS net, round(avg_csat, 6) AS avg_csat,
  {_RB} AS velocity, {_UB} AS velocity_unit, urgent, round(avg_conf, 6) AS avg_confidence
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE sentiment = 'Positive') AS p,
             count(*) FILTER (WHERE sentiment = 'Negative') AS q, avg(csat) AS avg_csat,
             avg(confidence) AS avg_conf, count(*) FILTER (WHERE risk = 'High') AS urgent,
             count(created_at) AS nt, min(created_at) AS lo, max(created_at) AS hi FROM enriched)""")
def q_batch_kpis(spark, sf):
    return ag.batch_kpis(enr(spark, sf))


# E12-E18 -----------------------------------------------------------------------------

@query("risk_counts", "E12", ENR + "SELECT risk, count(*) AS count FROM enriched GROUP BY risk")
def q_risk_counts(spark, sf):
    return ag.risk_counts(enr(spark, sf))


@query("risk_profile", "E12", ENR + """SELECT r.rank, r.risk, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (VALUES (1, 'High'), (2, 'Medium'), (3, 'Low'), (4, 'None')) r(rank, risk)
LEFT JOIN (SELECT risk, count(*) AS n FROM enriched GROUP BY risk) c USING (risk)""")
def q_risk_profile(spark, sf):
    return ag.risk_profile(enr(spark, sf))


@query("channel_volume", "E13", FB + "SELECT channel, count(*) AS count FROM feedback GROUP BY channel")
def q_channel_volume(spark, sf):
    return ag.channel_volume(fb(spark, sf))


@query("channel_sentiment_counts", "E14", FB + """SELECT channel, sentiment, count(*) AS count
FROM feedback GROUP BY ROLLUP (channel, sentiment) HAVING grouping(channel) = 0""")
def q_channel_sentiment(spark, sf):
    return ag.channel_sentiment_counts(fb(spark, sf))


@query("emotion_counts", "E15", ENR + "SELECT emotion, sentiment, count(*) AS count FROM enriched "
       "GROUP BY emotion, sentiment")
def q_emotion_counts(spark, sf):
    return ag.emotion_counts(enr(spark, sf))


@query("emotion_pivot", "E15", ENR + """SELECT emotion,
  count(*) FILTER (WHERE sentiment = 'Negative') AS "Negative",
  count(*) FILTER (WHERE sentiment = 'Neutral') AS "Neutral",
  count(*) FILTER (WHERE sentiment = 'Positive') AS "Positive"
FROM enriched GROUP BY emotion""")
def q_emotion_pivot(spark, sf):
    return ag.emotion_pivot(enr(spark, sf))


def _aspect_hits_sql(src: str = "feedback") -> str:
    parts = []
    for rank_, name, _ in ag.aspect_patterns():
        words = dict(lx.ASPECTS)[name]
        pat = "\\b(" + "|".join(words) + ")\\b"
        parts.append(f"SELECT {rank_} AS aspect_rank, {S.q(name)} AS aspect, sentiment FROM {src} "
                     f"WHERE regexp_matches(lower(text), {S.q(pat)})")
    return "\nUNION ALL ".join(parts)


ASPECT_BREAKDOWN = (FB + "SELECT aspect_rank, aspect, sentiment, count(*) AS count FROM ("
                    + _aspect_hits_sql() + ") GROUP BY aspect_rank, aspect, sentiment")


@query("aspect_breakdown", "E16", ASPECT_BREAKDOWN)
def q_aspect_breakdown(spark, sf):
    return ag.aspect_breakdown(fb(spark, sf))


@query("aspect_pivot", "E17", "WITH ab AS (" + ASPECT_BREAKDOWN + """)
SELECT aspect_rank, aspect,
  CAST(sum(CASE WHEN sentiment = 'Negative' THEN count ELSE 0 END) AS BIGINT) AS "Negative",
  CAST(sum(CASE WHEN sentiment = 'Neutral' THEN count ELSE 0 END) AS BIGINT) AS "Neutral",
  CAST(sum(CASE WHEN sentiment = 'Positive' THEN count ELSE 0 END) AS BIGINT) AS "Positive"
FROM ab GROUP BY aspect_rank, aspect""")
def q_aspect_pivot(spark, sf):
    return ag.aspect_pivot(ag.aspect_breakdown(fb(spark, sf)))


@query("worst_best_aspect", "E18", "WITH ab AS (" + ASPECT_BREAKDOWN + """),
w AS (SELECT aspect, count FROM ab WHERE sentiment = 'Negative' ORDER BY count DESC, aspect_rank LIMIT 1),
b AS (SELECT aspect, count FROM ab WHERE sentiment = 'Positive' ORDER BY count DESC, aspect_rank LIMIT 1)
SELECT (SELECT aspect FROM w) AS worst_aspect, (SELECT count FROM w) AS worst_count,
       (SELECT aspect FROM b) AS best_aspect, (SELECT count FROM b) AS best_count""")
def q_worst_best(spark, sf):
    return ag.worst_best_aspect(ag.aspect_breakdown(fb(spark, sf)))


# E19-E23 ---------------------------------------------------------------------------

def _trend_sql(src: str) -> str:
    unit = (f"(SELECT CASE WHEN floor(date_diff('microsecond', min(created_at), max(created_at)) "
            f"/ 86400000000) >= {lx.TREND_DAY_SPAN_DAYS} THEN 'day' ELSE 'hour' END FROM {src} "
            f"WHERE created_at IS NOT NULL)")
    return f"strftime(date_trunc({unit}, created_at), {TSF})"


@query("sentiment_trend", "E19", FB + f"""SELECT {_trend_sql('feedback')} AS bucket, sentiment,
  count(*) AS count FROM feedback WHERE created_at IS NOT NULL GROUP BY 1, 2""")
def q_trend(spark, sf):
    return ag.sentiment_trend(fb(spark, sf))


DAY2 = "(SELECT * FROM feedback WHERE created_at < TIMESTAMP '2024-01-03 00:00:00')"


@query("sentiment_trend_hourly", "E19", FB + f"""SELECT {_trend_sql(DAY2)} AS bucket, sentiment,
  count(*) AS count FROM {DAY2} WHERE created_at IS NOT NULL GROUP BY 1, 2""")
def q_trend_hourly(spark, sf):
    d = fb(spark, sf).where(F.col("created_at") < F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
    return ag.sentiment_trend(d)


@query("trend_matrix", "E20", FB + f"""SELECT {_trend_sql('feedback')} AS bucket,
  count(*) FILTER (WHERE sentiment = 'Negative') AS "Negative",
  count(*) FILTER (WHERE sentiment = 'Neutral') AS "Neutral",
  count(*) FILTER (WHERE sentiment = 'Positive') AS "Positive"
FROM feedback WHERE created_at IS NOT NULL
  AND (SELECT count(*) FROM feedback WHERE created_at IS NOT NULL) >= 5 GROUP BY 1""")
def q_trend_matrix(spark, sf):
    return ag.trend_matrix(fb(spark, sf))


def _group_net_sql(key: str, n: int | None) -> str:
    lim = f" LIMIT {n}" if n else ""
    return FB + f"""SELECT {key}, items, {S.net_sql('p', 'q', 'items')} AS net FROM (
  SELECT {key}, count(*) AS items, count(*) FILTER (WHERE sentiment = 'Positive') AS p,
         count(*) FILTER (WHERE sentiment = 'Negative') AS q FROM feedback GROUP BY {key})
ORDER BY items DESC, {key}{lim}"""


@query("group_net_channel", "E21", _group_net_sql("channel", 10))
def q_group_net_channel(spark, sf):
    return ag.group_net_sentiment(fb(spark, sf), "channel", 10)


@query("group_net_segment", "E21", _group_net_sql("segment", 12))
def q_group_net_segment(spark, sf):
    return ag.group_net_sentiment(fb(spark, sf), "segment", 12)


def _gap_sql(key: str, src: str = "feedback") -> str:
    return f"""SELECT '{key}' AS dimension, groups, worst, worst_net, best, best_net FROM (
  SELECT count(*) AS groups, arg_min(grp, struct_pack(n := net, g := grp)) AS worst, min(net) AS worst_net,
         arg_min(grp, struct_pack(n := -net, g := grp)) AS best, max(net) AS best_net
  FROM (SELECT {key} AS grp, {S.net_sql('p', 'q', 'n')} AS net FROM (
          SELECT {key}, count(*) AS n, count(*) FILTER (WHERE sentiment = 'Positive') AS p,
                 count(*) FILTER (WHERE sentiment = 'Negative') AS q
          FROM {src} WHERE {key} IS NOT NULL GROUP BY {key})))
WHERE groups > 1"""


@query("group_gap", "E22", FB + _gap_sql("channel") + "\nUNION ALL\n" + _gap_sql("segment"))
def q_group_gap(spark, sf):
    return ag.group_gap(fb(spark, sf))


@query("modal_emotion", "E23", ENR + """SELECT (SELECT count(*) FROM enriched WHERE risk = 'High') AS high_risk,
  coalesce((SELECT emotion FROM enriched WHERE risk = 'High' GROUP BY emotion
            ORDER BY count(*) DESC, emotion LIMIT 1), 'Anger') AS emotion""")
def q_modal_emotion(spark, sf):
    return ag.modal_emotion(enr(spark, sf))


# E24-E33, E39 ----------------------------------------------------------------------

def _top_words_sql(src: str, n: int) -> str:
    return (f"SELECT word, count(*) AS count FROM (SELECT unnest({S.content_words()}) AS word "
            f"FROM {src}) GROUP BY word ORDER BY count DESC, word LIMIT {n}")


@query("top_words", "E24", FB + _top_words_sql("feedback", 12))
def q_top_words(spark, sf):
    return ag.top_words(fb(spark, sf), 12)


@query("top_words_documents", "E24", S.with_(S.TEXTS) + _top_words_sql("texts", 15))
def q_top_words_docs(spark, sf):
    return ag.top_words(fx.texts(spark, sf), 15)


def _top_phrases_sql(src: str, n: int) -> str:
    return (f"SELECT phrase, count(*) AS count FROM (SELECT unnest({S.bigrams('w')}) AS phrase FROM "
            f"(SELECT {S.content_words()} AS w FROM {src})) GROUP BY phrase HAVING count(*) >= 2 "
            f"ORDER BY count DESC, phrase LIMIT {n}")


@query("top_phrases", "E25", FB + _top_phrases_sql("feedback", 6))
def q_top_phrases(spark, sf):
    return ag.top_phrases(fb(spark, sf), 6)


@query("top_phrases_documents", "E25", S.with_(S.TEXTS) + _top_phrases_sql("texts", 6))
def q_top_phrases_docs(spark, sf):
    return ag.top_phrases(fx.texts(spark, sf), 6)


@query("confidence_histogram", "E26", FB + """SELECT sentiment,
  CAST(least(floor((k - 3000) * 15 / 7000) + 1, 15) AS INTEGER) AS bin, count(*) AS count
FROM (SELECT sentiment, CAST(round(confidence * 10000) AS BIGINT) AS k FROM feedback)
WHERE k >= 3000 AND k <= 10000 GROUP BY 1, 2""")
def q_conf_hist(spark, sf):
    return ag.confidence_histogram(fb(spark, sf))


@query("intensity_histogram", "E27", ENR + """SELECT sentiment,
  CAST(least(floor(intensity / 5), 19) AS INTEGER) AS bin, count(*) AS count
FROM enriched GROUP BY 1, 2""")
def q_int_hist(spark, sf):
    return ag.intensity_histogram(enr(spark, sf))


@query("length_stats", "E28", FB + f"SELECT round(avg(w), 6) AS avg_words, max(w) AS max_words FROM "
       f"(SELECT {S.word_count_sql('text')} AS w FROM feedback)")
def q_length_stats(spark, sf):
    return ag.length_stats(fb(spark, sf))


def _profile_sql(src: str, label: str) -> str:
    return f"""SELECT {label}, count(w) AS count, round(avg(w), 1) AS mean, round(stddev_samp(w), 1) AS std,
  CAST(min(w) AS DOUBLE) AS min, round(quantile_cont(w, 0.25), 1) AS p25,
  round(quantile_cont(w, 0.5), 1) AS p50, round(quantile_cont(w, 0.75), 1) AS p75,
  CAST(max(w) AS DOUBLE) AS max
FROM (SELECT {label}, {S.word_count_sql('text')} AS w FROM {src}) GROUP BY {label}"""


@query("length_profile", "E29", FB + _profile_sql("feedback", "sentiment"))
def q_length_profile(spark, sf):
    return ag.length_profile(fb(spark, sf), "sentiment")


@query("length_profile_documents", "E29", S.with_(S.TEXTS) + _profile_sql("texts", "origin"))
def q_length_profile_docs(spark, sf):
    return ag.length_profile(fx.texts(spark, sf), "origin")


@query("length_histogram", "E29", S.with_(S.TEXTS) + f"""SELECT
  CAST(least(floor((w - lo) * 40 / greatest(hi - lo, 1)), 39) AS INTEGER) AS bin, count(*) AS count
FROM (SELECT {S.word_count_sql('text')} AS w FROM texts),
     (SELECT min({S.word_count_sql('text')}) AS lo, max({S.word_count_sql('text')}) AS hi FROM texts)
GROUP BY 1""")
def q_length_hist(spark, sf):
    return ag.length_histogram(fx.texts(spark, sf), 40)


BINARY = S.with_("""lb AS (SELECT d.doc_id AS id, d.source, CAST(l.quality AS INTEGER) AS label,
  CAST(CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS INTEGER) AS pred
  FROM documents d JOIN labels l USING (doc_id))""")


@query("class_balance", "E30", BINARY + "SELECT label, count(*) AS count FROM lb GROUP BY label")
def q_class_balance(spark, sf):
    return ag.class_balance(fx.labelled_binary(spark, sf))


@query("high_confidence_share", "E31", FB + f"""SELECT {S.share_sql('h', 't')} AS high_confidence_pct
FROM (SELECT count(*) AS t, count(*) FILTER (WHERE confidence >= CAST(0.85 AS DOUBLE)) AS h FROM feedback)""")
def q_high_conf(spark, sf):
    return ag.high_confidence_share(fb(spark, sf))


@query("distinct_sources", "E32", FB + "SELECT DISTINCT source FROM feedback WHERE source IS NOT NULL")
def q_distinct_sources(spark, sf):
    return ag.distinct_values(fb(spark, sf), "source")


@query("date_range", "E32", FB + "SELECT strftime(min(CAST(created_at AS DATE)), '%Y-%m-%d') AS min_date, "
       "strftime(max(CAST(created_at AS DATE)), '%Y-%m-%d') AS max_date FROM feedback")
def q_date_range(spark, sf):
    return ag.date_range(fb(spark, sf))


@query("group_counts", "E33", FB + """SELECT channel_groups, segment_groups,
  channel_groups > 1 AS channel_multi, segment_groups > 1 AS segment_multi
FROM (SELECT count(DISTINCT channel) AS channel_groups, count(DISTINCT segment) AS segment_groups FROM feedback)""")
def q_group_counts(spark, sf):
    return ag.group_counts(fb(spark, sf))


@query("cloud_terms", "E39", FB + f"""SELECT word, count(*) AS count FROM (
  SELECT unnest({S.content_words()}) AS word FROM feedback WHERE sentiment = 'Negative'
    AND (SELECT sum(length(text)) + count(*) - 1 FROM feedback WHERE sentiment = 'Negative') >= 30)
GROUP BY word ORDER BY count DESC, word LIMIT 15""")
def q_cloud(spark, sf):
    return ag.cloud_terms(fb(spark, sf))


# F ----------------------------------------------------------------------------------

@query("per_class_quota", "F1", FB + """SELECT id, sentiment AS label,
  CASE WHEN rn <= 4000 THEN 'train' ELSE 'test' END AS split
FROM (SELECT id, sentiment, row_number() OVER (PARTITION BY sentiment ORDER BY id) AS rn FROM feedback)
WHERE rn <= 4500""")
def q_quota(spark, sf):
    d = fb(spark, sf).select("id", F.col("sentiment").alias("label"), F.col("id").alias("pos"))
    return rk.per_class_quota(d, "label", "pos", 4000, 500).select("id", "label", "split")


@query("top_words_per_sentiment", "F2", FB + f"""SELECT sentiment, word, count, CAST(rank AS INTEGER) AS rank
FROM (SELECT sentiment, word, count, row_number() OVER (PARTITION BY sentiment ORDER BY count DESC, word) AS rank
      FROM (SELECT sentiment, word, count(*) AS count FROM
            (SELECT sentiment, unnest({S.content_words()}) AS word FROM feedback) GROUP BY 1, 2))
WHERE rank <= 12""")
def q_words_per_sentiment(spark, sf):
    return rk.top_words_per_sentiment(fb(spark, sf), 12)


@query("top_phrases_per_sentiment", "F3", FB + f"""SELECT sentiment, phrase, count, CAST(rank AS INTEGER) AS rank
FROM (SELECT sentiment, phrase, count, row_number() OVER (PARTITION BY sentiment ORDER BY count DESC, phrase) AS rank
      FROM (SELECT sentiment, phrase, count(*) AS count FROM
            (SELECT sentiment, unnest({S.bigrams('w')}) AS phrase FROM
              (SELECT sentiment, {S.content_words()} AS w FROM feedback)) GROUP BY 1, 2 HAVING count(*) >= 2))
WHERE rank <= 6""")
def q_phrases_per_sentiment(spark, sf):
    return rk.top_phrases_per_sentiment(fb(spark, sf), 6)


@query("voice_of_customer", "F4", FB + """SELECT id, sentiment, confidence, text, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY confidence DESC, id) AS rank
      FROM feedback WHERE sentiment IN ('Negative', 'Positive')) WHERE rank <= 5""")
def q_voice(spark, sf):
    return rk.voice_of_customer(fb(spark, sf)).select("id", "sentiment", "confidence", "text", "rank")


# G ----------------------------------------------------------------------------------

@query("latest_feedback", "G1", FB + f"""SELECT id, strftime(created_at, {TSF}) AS created_at, sentiment
FROM feedback ORDER BY created_at DESC, id DESC LIMIT 100""")
def q_latest(spark, sf):
    return rk.latest_feedback(fb(spark, sf), 100).select("id", "created_at", "sentiment")


@query("latest_feedback_page", "G1", FB + f"""SELECT id, strftime(created_at, {TSF}) AS created_at, sentiment
FROM feedback ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 200""")
def q_latest_page(spark, sf):
    return rk.latest_feedback(fb(spark, sf), 50, 200).select("id", "created_at", "sentiment")


@query("latest_feedback_deep", "G1", FB + f"""SELECT id, strftime(created_at, {TSF}) AS created_at, sentiment,
  (SELECT count(*) FROM feedback) AS total
FROM feedback ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 800""")
def q_latest_deep(spark, sf):
    """A deep page of the stored table, with its total."""
    path = shared_dir(spark, "io", f"pages-{uuid.uuid4().hex}")
    ing.append_feedback(fb(spark, sf), path)
    return rk.deep_page(ing.read_feedback(spark, path), 50, 800).select("id", "created_at", "sentiment", "total")


@query("latest_feedback_after", "G1", FB + f"""SELECT id, strftime(created_at, {TSF}) AS created_at, sentiment
FROM feedback WHERE created_at < TIMESTAMP '2024-01-20 12:00:00' ORDER BY created_at DESC, id DESC LIMIT 50""")
def q_latest_after(spark, sf):
    """Key-set paging: what follows a given place."""
    return rk.page_after(fb(spark, sf), "2024-01-20 12:00:00", 0, 50).select("id", "created_at", "sentiment")


@query("group_sketches", "E33+E32", FB + """SELECT dimension, groups, groups > 1 AS multi FROM (
  SELECT 'channel' AS dimension, count(DISTINCT channel) AS groups FROM feedback
  UNION ALL SELECT 'segment', count(DISTINCT segment) FROM feedback)""")
def q_group_sketches(spark, sf):
    """Daily sketches merged over all days; few groups, so the counts are exact."""
    return ag.merged_group_counts(materialize(ag.daily_sketches(fb(spark, sf))))


@query("urgent_queue", "G2", ENR + """SELECT id, text, emotion, intensity, confidence, driver, channel, segment
FROM enriched WHERE risk = 'High' ORDER BY intensity DESC, confidence DESC, id LIMIT 10""")
def q_urgent_queue(spark, sf):
    return rk.urgent_queue(enr(spark, sf))


@query("urgent_by_confidence", "G3", ENR + """SELECT id, confidence FROM enriched WHERE risk = 'High'
ORDER BY confidence DESC, id LIMIT 10""")
def q_urgent_conf(spark, sf):
    return rk.urgent_by_confidence(enr(spark, sf)).select("id", "confidence")


@query("urgent_by_intensity", "G4", ENR + """SELECT id,
  CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS snippet,
  emotion, printf('%d/100', intensity) AS intensity, confidence
FROM (SELECT * FROM enriched WHERE risk = 'High' ORDER BY intensity DESC, id LIMIT 10)""")
def q_urgent_int(spark, sf):
    return rk.urgent_by_intensity(enr(spark, sf))


@query("response_queue", "G5", FB + """SELECT id, confidence FROM feedback
WHERE sentiment = 'Negative' AND confidence >= CAST(0.7 AS DOUBLE) ORDER BY confidence DESC, id LIMIT 15""")
def q_response_queue(spark, sf):
    return rk.response_queue(fb(spark, sf)).select("id", "confidence")


@query("recent_view", "G6", FB + f"""SELECT strftime(created_at, {TSF}) AS created_at, id, text, sentiment,
  confidence, source FROM feedback
WHERE sentiment IN ('Positive', 'Negative') AND source IN ('email', 'twitter', 'web_form')
  AND CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
ORDER BY created_at DESC, id DESC LIMIT 100""")
def q_recent(spark, sf):
    d = fl.history_filter(fb(spark, sf), ["Positive", "Negative"], HF_SOURCES, HF_FROM, HF_TO)
    return rk.recent_view(d)


@query("preview", "G7", FB + "SELECT id, text FROM feedback ORDER BY id LIMIT 5")
def q_preview(spark, sf):
    return rk.preview(fb(spark, sf)).select("id", "text")


def _seeded_sql(id_col: str = "id", seed: int = 42) -> str:
    return f"md5(CAST({id_col} AS VARCHAR) || ':' || '{seed}')"


@query("shuffle_rows", "G9", S.with_(S.FEEDBACK) + f"""SELECT id, sentiment FROM feedback
ORDER BY {_seeded_sql()}, id""")
def q_shuffle(spark, sf):
    return rk.shuffle_rows(fb(spark, sf).select("id", "sentiment"))


@query("sample_n", "A19", S.with_(S.FEEDBACK) + f"""SELECT id, text, sentiment FROM feedback
ORDER BY {_seeded_sql()}, id LIMIT 400""")
def q_sample(spark, sf):
    return rk.sample_n(fb(spark, sf).select("id", "text", "sentiment"), 400)


# H / I ----------------------------------------------------------------------------------

@query("combine_corpora", "H1", S.with_(S.FEEDBACK) + """SELECT origin, label, count(*) AS count FROM (
  SELECT 'feedback' AS origin, CAST(list_position(['Negative', 'Neutral', 'Positive'], sentiment) - 1 AS INTEGER)
         AS label FROM feedback
  UNION ALL
  SELECT 'documents', CAST(CASE WHEN l.quality = 0 THEN 0 ELSE 2 END AS INTEGER)
  FROM documents d JOIN labels l USING (doc_id)) GROUP BY origin, label""")
def q_combine(spark, sf):
    from vocspark.functions import labels as lb
    a = fb(spark, sf).select("text", lb.class_index("sentiment").alias("label"))
    docs = fx.documents(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    b = docs.select("text", lb.binary_to_label("quality").alias("label"))
    u = ev.combine_corpora([("feedback", a), ("documents", b)])
    return u.groupBy("origin", "label").agg(F.count(F.lit(1)).alias("count"))


def _report_sql(src: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""pairs AS (SELECT {g}label, pred, count(*) AS n FROM {src} GROUP BY ALL),
roles AS (SELECT {g}CAST(label AS VARCHAR) AS cls, n AS support, 0 AS predicted,
                 CASE WHEN label IS NOT DISTINCT FROM pred THEN n ELSE 0 END AS tp FROM pairs
          UNION ALL SELECT {g}CAST(pred AS VARCHAR), 0, n, 0 FROM pairs),
per AS (SELECT {g}cls, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted,
               CAST(sum(tp) AS BIGINT) AS tp FROM roles GROUP BY ALL),
m AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / NULLIF(predicted, 0), 0) AS precision,
             coalesce(CAST(tp AS DOUBLE) / NULLIF(support, 0), 0) AS recall,
             coalesce(CAST(2 * tp AS DOUBLE) / NULLIF(support + predicted, 0), 0) AS f1
      FROM per WHERE support + predicted > 0),
tot AS (SELECT {g}CAST(sum(support) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS tp, avg(precision) AS mp,
               avg(recall) AS mr, avg(f1) AS mf, sum(precision * support) AS wp,
               sum(recall * support) AS wr, sum(f1 * support) AS wf FROM m {gb})
SELECT {g}cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m
UNION ALL SELECT {g}'accuracy', round(CAST(tp AS DOUBLE) / n, 6), round(CAST(tp AS DOUBLE) / n, 6),
                 round(CAST(tp AS DOUBLE) / n, 6), n FROM tot
UNION ALL SELECT {g}'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), n FROM tot
UNION ALL SELECT {g}'weighted avg', round(wp / n, 6), round(wr / n, 6), round(wf / n, 6), n FROM tot"""


@query("classification_report", "E35", LABELLED.rstrip() + ",\n" + _report_sql("labelled"))
def q_report3(spark, sf):
    return ev.classification_report(fx.labelled(spark, sf))


@query("classification_report_binary", "E35", BINARY.rstrip() + ",\n" + _report_sql("lb"))
def q_report2(spark, sf):
    return ev.classification_report(fx.labelled_binary(spark, sf))


EVAL_SETS = S.with_(S.FEEDBACK, """ts AS (
  SELECT 'feedback_test' AS test_set, sentiment AS label, """ + S.rule_scores_sql(S.clean_sql('text'))[0]
                    + """ AS pred FROM feedback
  UNION ALL
  SELECT 'documents_test', CAST(l.quality AS VARCHAR), CASE WHEN d.n_chars >= 1000 THEN '1' ELSE '0' END
  FROM documents d JOIN labels l USING (doc_id))""")


@query("evaluate_model", "I5", EVAL_SETS.rstrip() + ",\n" + _report_sql("ts", "test_set"))
def q_evaluate(spark, sf):
    a = fx.labelled(spark, sf).select(F.lit("feedback_test").alias("test_set"), "label", "pred")
    b = fx.labelled_binary(spark, sf).select(F.lit("documents_test").alias("test_set"),
                                             F.col("label").cast("string").alias("label"),
                                             F.col("pred").cast("string").alias("pred"))
    return ev.classification_report(a.unionByName(b), group="test_set")


@query("confusion_matrix", "E36", LABELLED + """SELECT label, pred, count,
  round(CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY label), 6) AS share
FROM (SELECT label, pred, count(*) AS count FROM labelled GROUP BY 1, 2)""")
def q_confusion(spark, sf):
    return ev.confusion_matrix(fx.labelled(spark, sf))


@query("error_rate", "E37", LABELLED + """SELECT n, errors, coalesce(CAST(errors AS DOUBLE) / NULLIF(n, 0), 0)
  AS error_share FROM (SELECT count(*) AS n, count(*) FILTER (WHERE label IS DISTINCT FROM pred) AS errors
  FROM labelled)""")
def q_error_rate(spark, sf):
    return ev.error_rate(fx.labelled(spark, sf))


@query("sample_errors", "I6", LABELLED + f"""SELECT id, text, label, pred FROM labelled
WHERE label IS DISTINCT FROM pred ORDER BY {_seeded_sql()}, id LIMIT 10""")
def q_sample_errors(spark, sf):
    return ev.sample_errors(fx.labelled(spark, sf)).select("id", "text", "label", "pred")


@query("train_baseline", "I3")
def q_train_baseline(spark, sf):
    """Fit TF-IDF + LR on the fixture's training part (hash split), report on the rest."""
    from vocspark.functions import labels as lb
    d = fb(spark, sf).select("id", "text", lb.class_index("sentiment").alias("label"))
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5))
    train, test = d.where(part != 0), d.where(part == 0)
    model = ev.train_baseline(train, max_iter=50)
    pred = ev.predict_baseline(model, test)
    return ev.classification_report(pred.select("label", "pred"))


# A -------------------------------------------------------------------------------------

def _failed_sql() -> str:
    rules = [("text_missing", "text IS NULL"),
             ("sentiment_invalid", "NOT coalesce(sentiment IN ('Positive', 'Negative', 'Neutral'), false)"),
             ("confidence_missing", "confidence IS NULL"),
             ("confidence_range", "(confidence < 0 OR confidence > 1)"),
             ("created_at_missing", "created_at IS NULL"),
             ("text_empty", "length(text) < 1"),
             ("text_too_long", f"length(text) > {lx.MAX_TEXT_CHARS}"),
             ("source_too_long", f"length(source) > {lx.MAX_SOURCE_CHARS}")]
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN coalesce({c}, false) THEN '{n}' END" for n, c in rules) + ")"


@query("validate_feedback", "A2", S.with_(S.RAW_FEEDBACK) + f"""SELECT id, failed FROM (
  SELECT id, {_failed_sql()} AS failed FROM raw_feedback) WHERE failed <> ''""")
def q_validate(spark, sf):
    _, rejects = ing.validate_feedback(fx.raw_feedback(spark, sf))
    return rejects.select("id", "failed")


MIXED_TS = """mixed AS (SELECT id, CASE id % 4
  WHEN 0 THEN strftime(created_at, '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN strftime(created_at, '%m/%d/%Y %H:%M')
  WHEN 2 THEN strftime(created_at, '%d.%m.%Y')
  ELSE 'not a date' END AS created_at FROM feedback)"""


@query("parse_mixed_timestamps", "A11", S.with_(S.FEEDBACK, MIXED_TS) + f"""SELECT id, strftime(coalesce(
  try_strptime(created_at, '%Y-%m-%d %H:%M:%S'), try_strptime(created_at, '%m/%d/%Y %H:%M'),
  try_strptime(created_at, '%d.%m.%Y')), {TSF}) AS created_at FROM mixed""")
def q_mixed_ts(spark, sf):
    c = F.col("created_at")
    i = F.col("id") % 4
    txt = (F.when(i == 0, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
           .when(i == 1, F.date_format(c, "MM/dd/yyyy HH:mm"))
           .when(i == 2, F.date_format(c, "dd.MM.yyyy")).otherwise(F.lit("not a date")))
    d = fb(spark, sf).select("id", txt.alias("created_at"))
    return ing.parse_mixed_timestamps(d, "created_at")


@query("drop_blank_items", "A12", S.with_(S.RAW_FEEDBACK) + f"""SELECT id, t AS text FROM (
  SELECT id, trim({S.ws_trim_sql('text')}, '"') AS t FROM raw_feedback)
WHERE t IS NOT NULL AND length(t) > 0 AND lower(t) <> 'nan'""")
def q_drop_blank(spark, sf):
    return ing.drop_blank_items(fx.raw_feedback(spark, sf)).select("id", "text")


@query("cap_items", "A13", FB + "SELECT id, text FROM feedback ORDER BY id LIMIT 1000")
def q_cap(spark, sf):
    return ing.cap_items(fb(spark, sf).withColumnRenamed("id", "row_id"), 1000) \
        .select(F.col("row_id").alias("id"), "text")


@query("items_only", "A14", FB + "SELECT text FROM feedback")
def q_items_only(spark, sf):
    return ing.items_only(fb(spark, sf))


UPLOAD_COLS = {"id": "ID", "text": "Review Text", "sentiment": "Label", "channel": "Platform",
               "created_at": "Posted Date", "segment": "City"}


@query("detect_columns", "A9+A10", FB + "SELECT text, channel, strftime(created_at, " + TSF
       + ") AS created_at, segment FROM feedback")
def q_detect(spark, sf):
    up = fb(spark, sf).select(*[F.col(k).alias(v) for k, v in UPLOAD_COLS.items()])
    text_col = ing.detect_text_column(up)
    meta = ing.detect_metadata_columns(up, text_col)
    return up.select(F.col(text_col).alias("text"), *[F.col(s).alias(t) for t, s in meta.items()])


@query("conform_schema", "A20", S.with_(S.FEEDBACK) + "SELECT id, text, 'api' AS source, "
       "CAST(0 AS INTEGER) AS verified FROM feedback")
def q_conform(spark, sf):
    d = fb(spark, sf).select("id", "text")
    d = acc.conform_schema(d, {"source": "api", "verified": 0})
    return acc.conform_schema(d, {"source": "other", "verified": 1})


def _unit_hash_sql(key: str, k: int, digits: int = 8, seed: int = 42) -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}:{k}'), 1, {digits}))::BIGINT"


@query("synthesize_feedback", "A18", S.with_(S.FEEDBACK) + f"""SELECT {_unit_hash_sql('id', 0, 15)} AS id,
  text, sentiment,
  CAST(7200 + floor(({_unit_hash_sql('id', 1)} * 2700 + 2147483648) / 4294967296.0) AS DOUBLE) / 10000.0
    AS confidence,
  ['web_form', 'app_review', 'email', 'twitter', 'survey'][CAST({_unit_hash_sql('id', 3)} % 5 AS INTEGER) + 1]
    AS source,
  strftime(TIMESTAMP '2024-02-01 00:00:00' - to_seconds(CAST(floor({_unit_hash_sql('id', 2)} * 2592000
    / 4294967296.0) AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM feedback""")
def q_synth(spark, sf):
    return ing.synthesize_feedback(spark, fb(spark, sf).select("id", "text", "sentiment"))
