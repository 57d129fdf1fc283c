"""Hand-worked edges of the reference rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vocspark.operators import aggregate as ag
from vocspark.operators import enrich as en
from vocspark.operators import report as rp


def _one(spark, text, sentiment, confidence):
    df = spark.createDataFrame([(1, text, sentiment, confidence)],
                               "id long, text string, sentiment string, confidence double")
    return en.enrich_feedback(df).first()


def test_emotion_candidates_depend_on_sentiment(spark):
    # 'love' is Joy but a Negative item only considers negative emotions
    assert _one(spark, "I love it", "Negative", 0.5).emotion == "Displeasure"
    assert _one(spark, "I love it", "Positive", 0.5).emotion == "Joy"
    assert _one(spark, "I love it", "Neutral", 0.5).emotion == "Joy"
    assert _one(spark, "nothing here", "Neutral", 0.5).emotion == "Calm"
    assert _one(spark, "nothing here", "Positive", 0.5).emotion == "Satisfaction"


def test_emotion_tie_goes_to_first_declared(spark):
    # one Anger word and one Frustration word: Anger is declared first
    assert _one(spark, "rude and slow", "Negative", 0.5).emotion == "Anger"


def test_intensity_formula_and_cap(spark):
    r = _one(spark, "AWFUL AWFUL terrible!!! very very", "Negative", 0.8)
    # base 36 + 14*2 hits + 8*2 intensifiers + 6*3 '!' + 6*2 caps words = 110 -> 100
    assert r.intensity == 100
    r = _one(spark, "plain", "Neutral", 0.9)
    assert r.intensity == 13  # int(15 * 0.9) = int(13.5)


@pytest.mark.parametrize("conf,intensity_text,expected", [
    (0.90, "plain", "High"), (0.8999, "plain", "Medium"), (0.5, "awful terrible rude!!", "High")])
def test_risk_edges(spark, conf, intensity_text, expected):
    assert _one(spark, intensity_text, "Negative", conf).risk == expected


def test_risk_none_is_a_value(spark):
    assert _one(spark, "great", "Positive", 0.9).risk == "None"


def test_keyword_rules_differ_by_design(spark):
    # token rule: "'late'" is the token 'late' (apostrophes kept) -> no hit;
    # 'late2' gives the token 'late' -> hit.  The word-boundary rule is the reverse.
    assert _one(spark, "It was 'late' again.", "Negative", 0.5).driver == "General Experience"
    assert _one(spark, "Ticket late2 moved", "Neutral", 0.5).driver == "Delivery & Shipping"
    df = spark.createDataFrame([("It was 'late' again.", "Negative"),
                                ("Ticket late2 moved", "Neutral")], "text string, sentiment string")
    got = {(r.aspect, r.sentiment) for r in ag.aspect_breakdown(df).collect()}
    assert ("Delivery & Shipping", "Negative") in got
    assert ("Delivery & Shipping", "Neutral") not in got


def test_driver_tie_and_default(spark):
    assert _one(spark, "delivery price", "Neutral", 0.5).driver == "Delivery & Shipping"
    assert _one(spark, "nothing", "Neutral", 0.5).driver == "General Experience"


@pytest.mark.parametrize("s,c,expected", [("Positive", 0.7251, 4.73), ("Negative", 0.7251, 1.27),
                                          ("Neutral", 0.99, 3.0), ("Positive", 0.725, 4.73)])
def test_csat_half_up(spark, s, c, expected):
    assert _one(spark, "x", s, c).csat == expected


@pytest.mark.parametrize("c,band", [(0.85, "High"), (0.8499, "Moderate"), (0.60, "Moderate"),
                                    (0.5999, "Low")])
def test_confidence_band_edges(spark, c, band):
    df = spark.createDataFrame([(c,)], "confidence double")
    assert en.with_confidence_band(df).first().band == band


def _batch(spark, n_pos, n_neg, n_neu):
    rows = ([("great", "Positive", 0.9)] * n_pos + [("awful", "Negative", 0.9)] * n_neg
            + [("plain", "Neutral", 0.9)] * n_neu)
    return spark.createDataFrame(rows, "text string, sentiment string, confidence double")


@pytest.mark.parametrize("p,n,u,mood", [(7, 3, 0, "strongly positive"), (6, 3, 1, "moderately positive"), (70, 30, 0, "strongly positive"),
                                        (14, 10, 76, "mixed"), (45, 55, 0, "negative — action needed"),
                                        (55, 45, 0, "moderately positive")])
def test_mood_thresholds(spark, p, n, u, mood):
    line = rp.executive_summary(_batch(spark, p, n, u)).first().summary
    assert f"overall mood is **{mood}**" in line


def test_net_format_half_even(spark):
    # net = 100 * (4/8 - 3/8) = 12.5 -> Python prints +12
    line = rp.executive_summary(_batch(spark, 4, 3, 1)).first().summary
    assert "(Net Sentiment Score +12," in line


def _times(spark, hours):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=h), "Positive") for h in hours]
    return spark.createDataFrame(rows, "created_at timestamp_ntz, sentiment string")


def test_velocity_unit_edge(spark):
    assert ag.volume_velocity(_times(spark, [0, 47])).first().velocity_unit == "Hour"
    r = ag.volume_velocity(_times(spark, [0, 48])).first()
    assert r.velocity_unit == "Day" and r.velocity == 1.0
    assert ag.volume_velocity(_times(spark, [0])).first().velocity == 1.0  # span floored to 1 h


def test_trend_unit_edge(spark):
    hourly = ag.sentiment_trend(_times(spark, [0, 71])).collect()
    daily = ag.sentiment_trend(_times(spark, [0, 72])).collect()
    assert {r.bucket.hour for r in hourly} == {0, 23}
    assert len(daily) == 2 and all(r.bucket.hour == 0 for r in daily)


def test_empty_frame_shares_are_zero(spark):
    empty = _batch(spark, 0, 0, 0).where(F.lit(False))
    r = ag.sentiment_share(empty).first()
    assert (r.pct_positive, r.pct_neutral, r.pct_negative) == (0.0, 0.0, 0.0)
    assert ag.net_sentiment(empty).first().net == 0.0
    assert ag.avg_confidence(empty).first().avg_confidence is None


def test_top_phrases_need_two(spark):
    df = spark.createDataFrame([("fast delivery here",), ("fast delivery again",), ("slow page",)],
                               "text string")
    got = [(r.phrase, r["count"]) for r in ag.top_phrases(df).collect()]
    assert got == [("fast delivery", 2)]


def test_cloud_terms_guard(spark):
    short = spark.createDataFrame([("bad", "Negative")], "text string, sentiment string")
    assert ag.cloud_terms(short).count() == 0
    long_ = spark.createDataFrame([("bad service and a broken box again", "Negative")],
                                  "text string, sentiment string")
    assert ag.cloud_terms(long_).count() > 0


def test_lexicon_hits_both_paths(spark):
    """Distinct lexicon words per category, for disjoint categories (index
    codes) and for categories sharing a word (per-category filter)."""
    from vocspark.operators import enrich as en
    df = spark.createDataFrame([(1, "Slow slow app, slow refund; great app!"), (2, None), (3, "")],
                               "id long, text string")
    disjoint = (("A", ("slow", "refund")), ("B", ("app", "great", "late")))
    shared = (("A", ("slow", "app")), ("B", ("app", "great")))
    for lexicon, want in ((disjoint, (2, 2)), (shared, (2, 2))):
        rows = {r.id: r for r in en.lexicon_hits(df, lexicon=lexicon, prefix="h_").collect()}
        assert (rows[1].h_a, rows[1].h_b) == want
        assert (rows[3].h_a, rows[3].h_b) == (0, 0)
        assert rows[2].h_a is None


def test_every_sentence_counts(spark):
    from vocspark.operators import report as rp
    from vocspark.operators import score as sco
    text = " ".join(["This is plain."] * 35 + ["I love it."] * 5 + ["It is awful."])
    df = spark.createDataFrame([(1, text)], "id long, text string")
    row = rp.with_sentence_mix(df).first()
    assert (row.sentences, row.positive_sentences, row.negative_sentences, row.mixed) == (41, 5, 1, True)
    assert sco.score_sentences(df).count() == 41 and sco.score_sentences(df, max_sentences=30).count() == 30


def test_report_of_a_plain_text_upload(spark):
    """Neither channel, segment nor risk: those sections go, urgent ones are Negative."""
    from vocspark.operators import report as rp
    df = spark.createDataFrame([(1, "awful soup", "Negative", 0.9), (2, "lovely", "Positive", 0.8)],
                               "id long, text string, sentiment string, confidence double")
    lines = rp.report_sections(df).collect()
    assert [r.line for r in lines if r.section == "urgent_queue"] == ["- (90%) awful soup"]
    assert not {"risk_profile", "channels", "segments"} & {r.section for r in lines}
    assert all(r.line for r in lines)
