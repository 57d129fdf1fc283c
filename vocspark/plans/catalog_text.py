"""Queries for text, label and enrichment projections (B*, I1/I2/I4/I7, D1-D3, D6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.functions import labels as lb
from vocspark.functions import lexical as lex
from vocspark.functions import text as tx
from vocspark.operators import enrich as en
from vocspark.operators import filters as fl
from vocspark.operators import score as sco
from vocspark.plans import sql as S
from vocspark.plans.registry import query
from vocspark.session import shared_dir
from vocspark.sources import fixture as fx
from vocspark.sources import ingest as ing

FB = S.with_(S.FEEDBACK)
TX = S.with_(S.TEXTS)
SIG = S.with_(S.FEEDBACK, S.signals_cte("feedback"))
ENR = S.with_(S.FEEDBACK, S.enriched_ctes())


def fb(spark, sf):
    return fx.feedback(spark, sf)


def texts(spark, sf):
    return fx.texts(spark, sf)


# B1 ---------------------------------------------------------------------------

@query("clean_text", "B1", FB + f"SELECT id, {S.clean_sql('text')} AS clean_text FROM feedback")
def q_clean_text(spark, sf):
    return fb(spark, sf).select("id", tx.clean_text("text").alias("clean_text"))


@query("clean_text_documents", "B1", TX + f"SELECT id, origin, {S.clean_sql('text')} AS clean_text "
       "FROM texts")
def q_clean_text_docs(spark, sf):
    return texts(spark, sf).select("id", "origin", tx.clean_text("text").alias("clean_text"))


# B2-B4 -------------------------------------------------------------------------

@query("content_words", "B2", FB + f"SELECT id, array_to_string({S.content_words()}, ' ') AS words "
       "FROM feedback")
def q_content_words(spark, sf):
    return fb(spark, sf).select("id", F.array_join(tx.content_words("text"), " ").alias("words"))


@query("content_words_documents", "B2", TX + f"SELECT id, origin, "
       f"array_to_string({S.content_words()}, ' ') AS words FROM texts")
def q_content_words_docs(spark, sf):
    return texts(spark, sf).select("id", "origin",
                                   F.array_join(tx.content_words("text"), " ").alias("words"))


@query("word_tokens", "B3", FB + f"SELECT id, array_to_string({S.tokens()}, ' ') AS tokens, "
       f"len({S.tokens()}) AS n_tokens FROM feedback")
def q_word_tokens(spark, sf):
    t = tx.word_tokens("text")
    return fb(spark, sf).select("id", F.array_join(t, " ").alias("tokens"),
                                F.size(t).alias("n_tokens"))


@query("bigrams", "B4", FB + f"SELECT id, array_to_string({S.bigrams('w')}, '|') AS bigrams FROM "
       f"(SELECT id, {S.content_words()} AS w FROM feedback)")
def q_bigrams(spark, sf):
    w = fb(spark, sf).select("id", tx.content_words("text").alias("_w"))
    return w.select("id", F.array_join(tx.bigrams("_w"), "|").alias("bigrams"))


@query("bigrams_documents", "B4", TX + f"SELECT id, origin, array_to_string({S.bigrams('w')}, '|') "
       f"AS bigrams FROM (SELECT id, origin, {S.content_words()} AS w FROM texts)")
def q_bigrams_docs(spark, sf):
    w = texts(spark, sf).select("id", "origin", tx.content_words("text").alias("_w"))
    return w.select("id", "origin", F.array_join(tx.bigrams("_w"), "|").alias("bigrams"))


# B5-B8 -------------------------------------------------------------------------

def _sentences_query(src_cte: str, src: str, extra: str = "") -> str:
    return (S.with_(src_cte) + f"SELECT id, {extra} unnest(l) AS sentence, "
            f"CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos "
            f"FROM (SELECT id, {extra} {S.sentences_sql('text')} AS l FROM {src})")


@query("split_sentences", "B5", _sentences_query(S.FEEDBACK, "feedback"))
def q_split_sentences(spark, sf):
    return fb(spark, sf).select("id", F.posexplode(tx.split_sentences("text")).alias("pos", "sentence"))


@query("split_sentences_documents", "B5", _sentences_query(S.TEXTS, "texts", "origin,"))
def q_split_sentences_docs(spark, sf):
    return texts(spark, sf).select("id", "origin", F.posexplode(tx.split_sentences("text"))
                                   .alias("pos", "sentence"))


def _stats_sql(src: str, extra: str = "") -> str:
    return (f"SELECT id, {extra} {S.word_count_sql('text')} AS words, length(text) AS characters, "
            f"greatest(len({S.sentences_sql('text')}), 1) AS sentences, "
            f"length(text) - length(replace(text, '!', '')) AS exclamations FROM {src}")


@query("text_stats", "B6", FB + _stats_sql("feedback"))
def q_text_stats(spark, sf):
    return en.text_profile(fb(spark, sf)).select("id", "words", "characters", "sentences",
                                                 "exclamations")


@query("text_stats_documents", "B6", TX + _stats_sql("texts", "origin,"))
def q_text_stats_docs(spark, sf):
    return en.text_profile(texts(spark, sf)).select("id", "origin", "words", "characters",
                                                    "sentences", "exclamations")


@query("shout_count", "B7", FB + "SELECT id, len(regexp_extract_all(text, '\\b[A-Z]{3,}\\b')) "
       "AS caps_words FROM feedback")
def q_shout(spark, sf):
    return fb(spark, sf).select("id", tx.shout_count("text").alias("caps_words"))


@query("intensifier_count", "B8", SIG + "SELECT id, intens AS intensifiers, exclaim AS exclamations "
       "FROM sig")
def q_intensifiers(spark, sf):
    return en.emotion_signals(fb(spark, sf)).select("id", "intensifiers", "exclamations")


# B9-B17 ------------------------------------------------------------------------

HIT_NAMES = ([f"hits_{en.slug(n)}" for n, _ in lx.EMOTION_LEXICON]
             + [f"aspect_{en.slug(n)}" for n, _ in lx.ASPECTS])


@query("lexicon_hits", "B9", SIG + "SELECT id, " + ", ".join(
    f"{c} AS {h}" for c, h in zip(S.EMO_COLS + S.ASP_COLS, HIT_NAMES)) + " FROM sig")
def q_lexicon_hits(spark, sf):
    d = en.lexicon_hits(fb(spark, sf), lexicon=lx.EMOTION_LEXICON, prefix="hits_")
    d = en.lexicon_hits(d, lexicon=lx.ASPECTS, prefix="aspect_")
    return d.select("id", *HIT_NAMES)


def _enriched(spark, sf):
    return en.enrich_feedback(fb(spark, sf))


@query("dominant_emotion", "B10", ENR + "SELECT id, sentiment, emotion FROM enriched")
def q_emotion(spark, sf):
    return _enriched(spark, sf).select("id", "sentiment", "emotion")


@query("emotion_intensity", "B11", ENR + "SELECT id, intensity FROM enriched")
def q_intensity(spark, sf):
    return _enriched(spark, sf).select("id", "intensity")


@query("risk_level", "B12", ENR + "SELECT id, risk FROM enriched")
def q_risk(spark, sf):
    return _enriched(spark, sf).select("id", "risk")


@query("category_driver", "B13", ENR + "SELECT id, driver FROM enriched")
def q_driver(spark, sf):
    return _enriched(spark, sf).select("id", "driver")


@query("matched_aspects", "B14+B30", SIG + f"SELECT id, array_to_string({S.aspects_list_sql()}, '; ') "
       f"AS aspects, coalesce(lower({S.aspects_list_sql()}[1]), {S.q(lx.DEFAULT_TOPIC)}) AS topic "
       "FROM sig")
def q_aspects(spark, sf):
    d = en.with_aspects(fb(spark, sf))
    return d.select("id", F.array_join("aspects", "; ").alias("aspects"), "topic")


@query("csat_equivalent", "B15", FB + f"SELECT id, {S.csat_sql()} AS csat FROM feedback")
def q_csat(spark, sf):
    return fb(spark, sf).select("id", lex.csat_equivalent("sentiment", "confidence").alias("csat"))


def _band_sql() -> str:
    (t1, b1, n1), (t2, b2, n2), (_, b3, n3) = lx.CONFIDENCE_BANDS
    band = (f"CASE WHEN confidence >= CAST({t1} AS DOUBLE) THEN {S.q(b1)} WHEN confidence >= "
            f"CAST({t2} AS DOUBLE) THEN {S.q(b2)} ELSE {S.q(b3)} END")
    note = (f"CASE WHEN confidence >= CAST({t1} AS DOUBLE) THEN {S.q(n1)} WHEN confidence >= "
            f"CAST({t2} AS DOUBLE) THEN {S.q(n2)} ELSE {S.q(n3)} END")
    return f"{band} AS band, {note} AS band_note"


@query("confidence_band", "B17", FB + f"SELECT id, {_band_sql()} FROM feedback")
def q_band(spark, sf):
    return en.with_confidence_band(fb(spark, sf)).select("id", "band", "band_note")


# B18-B30 ------------------------------------------------------------------------

def _tag_sql() -> str:
    low = "lower(token)"
    tag = (f"CASE WHEN list_contains({S.lst(lx.POSITIVE_SIGNAL_WORDS)}, {low}) THEN 'positive' "
           f"WHEN list_contains({S.lst(lx.NEGATIVE_SIGNAL_WORDS)}, {low}) THEN 'negative' "
           f"WHEN list_contains({S.lst(lx.INTENSIFIERS)}, {low}) THEN 'intensifier' "
           f"ELSE 'plain' END")
    return (FB + f"SELECT id, pos, token, {tag} AS tag FROM (SELECT id, unnest(l) AS token, "
            f"CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM "
            f"(SELECT id, regexp_extract_all(text, '(\\w+|\\W+)', 1) AS l FROM feedback))")


@query("tag_sentiment_words", "B18", _tag_sql())
def q_tag(spark, sf):
    return en.tag_sentiment_words(fb(spark, sf))


RL_CTE = f"""rl AS (SELECT id,
  {S.lst(fx.RAW_LABELS)}[CAST(id % {len(fx.RAW_LABELS)} AS INTEGER) + 1] AS raw_label,
  CAST(id % 5 AS INTEGER) AS stars, CAST(id % 2 AS INTEGER) AS polarity,
  {S.lst(fx.TEXT_LABELS)}[CAST(id % {len(fx.TEXT_LABELS)} AS INTEGER) + 1] AS text_label
FROM feedback)"""


def _raw_labels_from(select: str) -> str:
    return S.with_(S.FEEDBACK, RL_CTE) + select


@query("normalize_label", "B19", _raw_labels_from(
    f"SELECT id, raw_label, {S.case_lookup('lower(raw_label)', lx.LABEL_MAP)} AS label FROM rl"))
def q_normalize_label(spark, sf):
    return fx.raw_labels(spark, sf).select("id", "raw_label",
                                           lb.normalize_label("raw_label").alias("label"))


@query("stars_to_label", "B21", _raw_labels_from(
    "SELECT id, stars, CASE WHEN stars <= 1 THEN 0 WHEN stars = 2 THEN 1 ELSE 2 END AS label, "
    "polarity, CASE WHEN polarity = 0 THEN 0 ELSE 2 END AS binary_label FROM rl"))
def q_stars(spark, sf):
    return fx.raw_labels(spark, sf).select(
        "id", "stars", lb.stars_to_label("stars").alias("label"), "polarity",
        lb.binary_to_label("polarity").alias("binary_label"))


@query("parse_text_label", "B22", _raw_labels_from(
    f"SELECT id, text_label, CAST(list_position({S.lst(lx.CLASSES)}, "
    f"{S.title_sql(S.ws_trim_sql('text_label'))}) - 1 AS INTEGER) AS label FROM rl"))
def q_text_label(spark, sf):
    return fx.raw_labels(spark, sf).select("id", "text_label",
                                           lb.parse_text_label("text_label").alias("label"))


@query("truncate_text", "B23", S.with_("d AS (SELECT * FROM documents)")
       + "SELECT doc_id, substring(text, 1, 1200) AS text_1200, CASE WHEN length(text) > 80 THEN "
       "substring(text, 1, 80) || '...' ELSE text END AS snippet FROM d")
def q_truncate(spark, sf):
    return fx.documents(spark, sf).select("doc_id", tx.truncate_text("text").alias("text_1200"),
                                          tx.snippet("text").alias("snippet"))


@query("feedback_date", "B24", FB + "SELECT id, strftime(CAST(created_at AS DATE), '%Y-%m-%d') "
       "AS date FROM feedback")
def q_date(spark, sf):
    return fb(spark, sf).select("id", F.to_date("created_at").alias("date"))


def _reply_sql() -> str:
    topic = f"coalesce(lower({S.aspects_list_sql()}[1]), {S.q(lx.DEFAULT_TOPIC)})"
    tmpl = S.case_lookup("sentiment", lx.RESPONSE_TEMPLATES)
    reply = f"replace(replace({tmpl}, '{{name}}', {S.q(lx.DEFAULT_CUSTOMER_NAME)}), '{{topic}}', {topic})"
    return (SIG + f"SELECT id, {S.case_lookup('sentiment', lx.WHAT_IT_MEANS)} AS meaning, "
            f"{S.case_lookup('sentiment', lx.RECOMMENDED_ACTION)} AS action, {reply} AS reply FROM sig")


@query("reply_draft", "B25", _reply_sql())
def q_reply(spark, sf):
    return en.reply_draft(fb(spark, sf)).select("id", "meaning", "action", "reply")


@query("template_lookup", "D6", FB + f"SELECT id, sentiment, "
       f"{S.case_lookup('sentiment', lx.RESPONSE_TEMPLATES)} AS template FROM feedback")
def q_template(spark, sf):
    return fb(spark, sf).select("id", "sentiment",
                                lex.lookup("sentiment", lx.RESPONSE_TEMPLATES).alias("template"))


@query("flag_to_label", "B28", S.with_("l AS (SELECT * FROM labels)")
       + "SELECT doc_id, CASE WHEN toxic = 1 THEN 'Yes' WHEN toxic = 0 THEN 'No' END AS toxic_flag, "
       "CASE WHEN quality = 1 THEN 'Yes' WHEN quality = 0 THEN 'No' END AS quality_flag FROM l")
def q_flag(spark, sf):
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    return lab.select("doc_id", lb.flag_to_label("toxic").alias("toxic_flag"),
                      lb.flag_to_label("quality").alias("quality_flag"))


# I1 / B20 / B29 / I2 / I4 / I7 / D1 ------------------------------------------------

SCORE_SQL = FB + f"SELECT id, {S.rule_scores_full_sql(S.clean_sql('text'))}, " \
                 f"{S.q(lx.RULE_MODEL_NAME)} AS model FROM feedback"


def _score_cols(d):
    return d.select("id", "sentiment", "confidence",
                    F.col("scores")["Negative"].alias("score_negative"),
                    F.col("scores")["Neutral"].alias("score_neutral"),
                    F.col("scores")["Positive"].alias("score_positive"), "model")


@query("score_rules", "I1", SCORE_SQL)
def q_score_rules(spark, sf):
    return _score_cols(sco.score_rules(fb(spark, sf).drop("sentiment", "confidence")))


@query("argmax_scores", "B20", SCORE_SQL.replace(f", {S.q(lx.RULE_MODEL_NAME)} AS model", ""))
def q_argmax(spark, sf):
    d = sco.score_rules(fb(spark, sf).drop("sentiment", "confidence")).drop("sentiment", "confidence")
    return _score_cols(sco.argmax_scores(d)).drop("model")


@query("score_with_model", "I2", SCORE_SQL.replace(S.q(lx.RULE_MODEL_NAME), "'rules-hook'"))
def q_score_model(spark, sf):
    d = sco.score_with_model(fb(spark, sf).select("id", "text"), sco.rule_model_loader,
                             model_name="rules-hook")
    return _score_cols(d)


@query("explode_scores", "B29", "WITH s AS (" + SCORE_SQL + """)
SELECT id, 'Negative' AS class, score_negative AS probability FROM s
UNION ALL SELECT id, 'Neutral', score_neutral FROM s
UNION ALL SELECT id, 'Positive', score_positive FROM s""")
def q_explode_scores(spark, sf):
    return sco.explode_scores(sco.score_rules(fb(spark, sf).drop("sentiment", "confidence")))


@query("attach_metadata", "D1", FB + f"SELECT id, {S.rule_scores_sql(S.clean_sql('text'))[0]} AS "
       "sentiment, channel, segment FROM feedback")
def q_attach(spark, sf):
    return sco.score_rules(fb(spark, sf).drop("sentiment", "confidence")) \
        .select("id", "sentiment", "channel", "segment")


def _sentence_scores_sql() -> str:
    sent, conf = S.rule_scores_sql(S.clean_sql("sentence"))
    return (FB + f"SELECT id, pos, sentence, {sent} AS sentiment, {conf} AS confidence FROM ("
            f"SELECT id, unnest(l) AS sentence, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos "
            f"FROM (SELECT id, {S.sentences_sql('text')} AS l FROM feedback "
            f"WHERE len({S.sentences_sql('text')}) >= 2))")


@query("score_sentences", "I4", _sentence_scores_sql())
def q_score_sentences(spark, sf):
    return sco.score_sentences(fb(spark, sf))


@query("classify_and_store", "I7", S.with_(S.RAW_FEEDBACK) + f"""
SELECT id, text, {S.rule_scores_sql(S.clean_sql('text'))[0]} AS sentiment,
       {S.rule_scores_sql(S.clean_sql('text'))[1]} AS confidence, coalesce(source, 'api') AS source
FROM raw_feedback
WHERE text IS NOT NULL AND length(text) BETWEEN 1 AND {lx.MAX_TEXT_CHARS}
  AND (source IS NULL OR length(source) <= {lx.MAX_SOURCE_CHARS})""")
def q_classify_store(spark, sf):
    raw = fx.raw_feedback(spark, sf).select("id", "text", "source")
    out, _ = sco.classify_and_store(raw, persist=False)
    return out.select("id", "text", "sentiment", "confidence", "source")


@query("classify_store_and_read", "I7+A3+A1", S.with_(S.RAW_FEEDBACK) + f"""
SELECT id, text, {S.rule_scores_sql(S.clean_sql('text'))[0]} AS sentiment,
       round({S.rule_scores_sql(S.clean_sql('text'))[1]}, 4) AS confidence, coalesce(source, 'api') AS source
FROM raw_feedback
WHERE text IS NOT NULL AND length(text) BETWEEN 1 AND {lx.MAX_TEXT_CHARS}
  AND (source IS NULL OR length(source) <= {lx.MAX_SOURCE_CHARS}) AND id % 10 <> 0""")
def q_classify_persisted(spark, sf):
    """The batch form with its store: scored rows are appended and read back;
    items whose label maps to no class (every tenth) go to the rejects."""
    base = shared_dir(spark, "io", f"classified-{uuid.uuid4().hex}")
    raw = fx.raw_feedback(spark, sf).select("id", "text", "source")

    def scorer(d):
        scored = sco.score_rules(d)
        return scored.withColumn("sentiment", F.when(F.col("id") % 10 != 0, F.col("sentiment")))

    sco.classify_and_store(raw, f"{base}/store", scorer=scorer, now="2024-02-01 00:00:00",
                           rejects_path=f"{base}/rejects")
    return ing.read_feedback(spark, f"{base}/store").select("id", "text", "sentiment", "confidence", "source")


# D2 / D3 -------------------------------------------------------------------------

def _lexicon_values() -> str:
    rows = ", ".join(f"({S.q(cat)}, {rank}, {S.q(w)})"
                     for rank, (cat, words) in enumerate(lx.EMOTION_LEXICON) for w in words)
    return f"lex AS (SELECT * FROM (VALUES {rows}) v(category, cat_rank, word))"


@query("lexicon_match_join", "D2", S.with_(S.FEEDBACK, _lexicon_values()) + f"""
SELECT id, category, cat_rank, count(*) AS hits
FROM (SELECT id, unnest(list_distinct({S.tokens()})) AS word FROM feedback) t
JOIN lex USING (word) GROUP BY id, category, cat_rank""")
def q_lexicon_join(spark, sf):
    lexdf = lx.lexicon_frame(spark, lx.EMOTION_LEXICON)
    return en.lexicon_match_join(fb(spark, sf), lexdf)


@query("remove_stopwords", "D3", FB + f"""
SELECT id, CAST(pos AS INTEGER) AS pos, word FROM (
  SELECT id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT id, regexp_extract_all(lower(text), '{S.CONTENT_RE}') AS l FROM feedback))
WHERE NOT list_contains({S.lst(lx.STOPWORDS)}, word)""")
def q_remove_stop(spark, sf):
    stop = spark.createDataFrame([(w,) for w in lx.STOPWORDS], "word string")
    return fl.remove_stopwords_exploded(fb(spark, sf), stop)
