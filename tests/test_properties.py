"""Property tests on small random inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vocspark.functions import text as tx
from vocspark.operators import aggregate as ag
from vocspark.operators import enrich as en

WORDS = st.sampled_from(["love", "awful", "very", "TERRIBLE", "slow", "price", "the", "!",
                         "@bob", "http://x.y/z", "  ", "late", "ok.", "Great!", "é", "a\tb"])
TEXTS = st.lists(WORDS, min_size=0, max_size=12).map(" ".join)
ROWS = st.lists(st.tuples(TEXTS, st.sampled_from(["Positive", "Negative", "Neutral"]),
                          st.integers(0, 10000).map(lambda k: k / 10000)), min_size=1, max_size=40)


@settings(max_examples=5, deadline=None)
@given(ROWS)
def test_enrichment_invariants(spark, rows):
    df = spark.createDataFrame(rows, "text string, sentiment string, confidence double")
    e = en.enrich_feedback(df)
    out = e.collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.intensity <= 100
        assert r.risk in ("High", "Medium", "Low", "None")
        assert 1.0 <= r.csat <= 5.0
    s = ag.sentiment_share(df).first()
    assert abs(s.pct_positive + s.pct_neutral + s.pct_negative - 100.0) < 1e-9
    n = ag.net_sentiment(df).first().net
    assert abs(n - (s.pct_positive - s.pct_negative)) < 1e-9
    assert sum(r["count"] for r in ag.sentiment_counts(df).collect()) == len(rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_clean_text_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    once = df.select(tx.clean_text("text").alias("c"))
    twice = once.select(F.col("c"), tx.clean_text("c").alias("cc")).collect()
    assert all(r.c == r.cc for r in twice)
