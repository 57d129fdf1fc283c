"""The reference's API behaviours, restated as DataFrame tests of
classify-and-store, validation, paging and stats."""

import pytest
from pyspark.sql import functions as F

from vocspark.operators import aggregate as ag
from vocspark.operators import rank as rk
from vocspark.operators.score import classify_and_store
from vocspark.sources import ingest as ing


def _items(spark, texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "id long, text string")


def test_three_classes_and_score_invariants(spark):
    out, rejects = classify_and_store(_items(spark, [
        "I love this product, it is great", "Terrible and broken, I hate it", "The box is blue"]),
        persist=False)
    rows = {r.id: r for r in out.collect()}
    assert rejects.count() == 0
    assert [rows[i].sentiment for i in (1, 2, 3)] == ["Positive", "Negative", "Neutral"]
    for r in rows.values():
        assert 0.0 <= r.confidence <= 1.0
        assert set(r.scores) == {"Negative", "Neutral", "Positive"}
        assert r.scores[r.sentiment] == r.confidence
        assert r.source == "api"


def test_rejects_empty_missing_and_too_long(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "x" * 3000), (4, "fine")],
                               "id long, text string")
    out, rejects = classify_and_store(df, persist=False)
    assert sorted(r.id for r in rejects.collect()) == [1, 2, 3]
    assert [r.id for r in out.collect()] == [4]
    failed = {r.id: r.failed for r in rejects.collect()}
    assert failed[1] == "text_empty" and failed[2] == "text_missing" and failed[3] == "text_too_long"


def test_source_limit(spark):
    df = spark.createDataFrame([(1, "ok", "s" * 51), (2, "ok", None)], "id long, text string, source string")
    out, rejects = classify_and_store(df, persist=False)
    assert [r.id for r in rejects.collect()] == [1]
    assert out.first().source == "api"


def test_batch_keeps_item_keys(spark):
    out, _ = classify_and_store(_items(spark, ["love it", "awful", "plain words"]), persist=False)
    got = [r.sentiment for r in out.orderBy("id").collect()]
    assert got == ["Positive", "Negative", "Neutral"]


@pytest.mark.parametrize("limit", [0, 5000])
def test_page_limit_bounds(spark, limit):
    with pytest.raises(ValueError):
        rk.latest_feedback(_items(spark, ["a"]), limit)


def test_negative_offset_rejected(spark):
    with pytest.raises(ValueError):
        rk.latest_feedback(_items(spark, ["a"]), 10, -1)


def test_store_then_stats(spark, tmp_path):
    path = str(tmp_path / "fb")
    df = _items(spark, ["I love it", "It is broken"])
    classify_and_store(df, path=path, now="2024-03-01 10:00:00")
    stored = ing.read_feedback(spark, path)
    assert stored.count() == 2
    st = {(r.level, r.sentiment): r["count"] for r in ag.stats(stored).collect()}
    assert st[("total", None)] == 2
    assert st[("sentiment", "Positive")] == 1 and st[("sentiment", "Negative")] == 1
    listing = rk.latest_feedback(stored, 1).collect()
    assert len(listing) == 1 and listing[0].text in ("I love it", "It is broken")
    # the stored text is the raw text; the stored time is the given 'now'
    assert stored.where(F.col("text") == "I love it").first().created_at.hour == 10
