"""Stream = batch: each streaming operator over files equals its batch form."""

import datetime as dt

import pytest

from vocspark.operators import aggregate as ag
from vocspark.operators import enrich as en
from vocspark.sources import fixture as fx
from vocspark.streaming import stream as st
from tests.conftest import SF_SMALL


def _input(spark, tmp_path):
    fb = fx.feedback(spark, SF_SMALL).select("id", "text", "sentiment", "confidence", "source",
                                             "created_at")
    path = str(tmp_path / "in")
    fb.repartition(4).write.parquet(path)
    return fb, st.read_feedback_stream(spark, path, max_files_per_trigger=1)


def test_daily_counts_stream_equals_batch(spark, tmp_path):
    fb, s = _input(spark, tmp_path)
    q = st.stream_daily_counts(s, str(tmp_path / "d"), checkpoint=str(tmp_path / "ck"),
                               watermark="400 days")
    q.awaitTermination()
    got = st.read_daily_counts(spark, str(tmp_path / "d"))
    want = ag.daily_counts(fb)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_kpis_stream(spark, tmp_path):
    fb, s = _input(spark, tmp_path)
    st.stream_kpis(s, str(tmp_path / "k"), checkpoint=str(tmp_path / "ck")).awaitTermination()
    got = {r.sentiment: r["count"] for r in st.read_kpis(spark, str(tmp_path / "k")).collect()}
    want = {r.sentiment: r["count"] for r in ag.sentiment_counts(fb).collect()}
    assert got == want


def test_urgent_stream_equals_batch(spark, tmp_path):
    fb, s = _input(spark, tmp_path)
    st.stream_urgent(s, str(tmp_path / "u"), checkpoint=str(tmp_path / "ck")).awaitTermination()
    got = {r.id for r in spark.read.parquet(str(tmp_path / "u")).collect()}
    want = {r.id for r in en.enrich_feedback(fb).where("risk = 'High'").collect()}
    assert got == want


def test_classify_stream_splits_rejects(spark, tmp_path):
    raw = fx.raw_feedback(spark, SF_SMALL).select("id", "text", "sentiment", "confidence", "source",
                                                  "created_at")
    path = str(tmp_path / "raw")
    raw.repartition(3).write.parquet(path)
    from vocspark import schema as sc
    s = spark.readStream.schema(sc.FEEDBACK_SCHEMA).parquet(path)
    st.stream_classify(s, str(tmp_path / "o"), str(tmp_path / "r"),
                       checkpoint=str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "o")).count()
    rej = spark.read.parquet(str(tmp_path / "r")).count()
    assert out + rej == raw.count() and rej > 0


def _feed(spark, path, rows):
    from vocspark import schema as sc
    spark.createDataFrame(rows, sc.FEEDBACK_SCHEMA).write.parquet(path)
    return st.read_feedback_stream(spark, path, max_files_per_trigger=1)


def _items(first, n, day):
    return [(i, "love it", "Positive", 0.9, "web", dt.datetime(2024, 1, day)) for i in range(first, first + n)]


def test_second_run_keeps_the_first_ones_rows(spark, tmp_path):
    for run, rows in (("a", _items(0, 30, 5)), ("b", _items(30, 20, 5))):
        s = _feed(spark, str(tmp_path / run), rows)
        st.stream_classify(s.drop("event_time"), str(tmp_path / "o"), str(tmp_path / "r"),
                           checkpoint=str(tmp_path / f"ck-{run}")).awaitTermination()
        st.stream_daily_counts(s, str(tmp_path / "d"),
                               checkpoint=str(tmp_path / f"ckd-{run}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).select("id").distinct().count() == 50
    assert [tuple(r) for r in st.read_daily_counts(spark, str(tmp_path / "d")).collect()] \
        == [(dt.date(2024, 1, 5), "Positive", 50)]


def test_feeds_of_one_kind_have_checkpoints_of_their_own(spark, tmp_path):
    for run, n in (("a", 3), ("b", 4)):
        s = _feed(spark, str(tmp_path / run), _items(0, n, 5))
        st.stream_kpis(s, str(tmp_path / f"k{run}")).awaitTermination()
        assert st.read_kpis(spark, str(tmp_path / f"k{run}")).first()["count"] == n


def test_late_rows_count(spark, tmp_path):
    s = _feed(spark, str(tmp_path / "in"), _items(0, 2, 30))
    st.stream_daily_counts(s, str(tmp_path / "d"), checkpoint=str(tmp_path / "ck")).awaitTermination()
    from vocspark import schema as sc
    spark.createDataFrame(_items(2, 3, 1), sc.FEEDBACK_SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    st.stream_daily_counts(s, str(tmp_path / "d"), checkpoint=str(tmp_path / "ck")).awaitTermination()
    got = {r.date.day: r["count"] for r in st.read_daily_counts(spark, str(tmp_path / "d")).collect()}
    assert got == {30: 2, 1: 3}


def _counts(spark, path):
    return {(r.date.day, r.sentiment): r["count"] for r in st.read_daily_counts(spark, path).collect()}


def test_compaction_changes_no_count(spark, tmp_path, monkeypatch):
    from vocspark.sources import snapshots
    path, want = str(tmp_path / "d"), {}
    for run, days in (("a", (5, 5, 6, 7)), ("b", (5, 8, 8))):
        feed = str(tmp_path / run)
        for i, day in enumerate(days):
            spark.createDataFrame(_items(100 * i, 10 + i, day), st.sc.FEEDBACK_SCHEMA).coalesce(1) \
                .write.mode("append").parquet(feed)
            want[day, "Positive"] = want.get((day, "Positive"), 0) + 10 + i
        st.stream_daily_counts(st.read_feedback_stream(spark, feed, max_files_per_trigger=1), path,
                               checkpoint=str(tmp_path / f"ck-{run}")).awaitTermination()
    assert _counts(spark, path) == want

    # ended before the base is published, and before the folders go: nothing changes
    def stop(*_):
        raise RuntimeError("ended")

    monkeypatch.setattr(snapshots, "mark", stop)
    with pytest.raises(RuntimeError):
        st.compact_daily_counts(spark, path)
    monkeypatch.undo()
    assert _counts(spark, path) == want
    monkeypatch.setattr(snapshots, "delete_folders", stop)
    with pytest.raises(RuntimeError):
        st.compact_daily_counts(spark, path)
    monkeypatch.undo()
    assert _counts(spark, path) == want

    def folders():
        return len({f.rpartition("/")[0] for f in spark.read.parquet(path).inputFiles()})

    assert folders() == 7
    assert st.compact_daily_counts(spark, path) == 5
    assert _counts(spark, path) == want and folders() == 2
    assert st.compact_daily_counts(spark, path) == 0

    # the feed goes on after compaction
    spark.createDataFrame(_items(900, 4, 5), st.sc.FEEDBACK_SCHEMA).write.mode("append").parquet(str(tmp_path / "a"))
    st.stream_daily_counts(st.read_feedback_stream(spark, str(tmp_path / "a")), path,
                           checkpoint=str(tmp_path / "ck-a")).awaitTermination()
    want[5, "Positive"] += 4
    assert _counts(spark, path) == want and st.compact_daily_counts(spark, path) == 1
    assert _counts(spark, path) == want


def test_late_rows_are_kept_apart(spark, tmp_path):
    feed, out, late = (str(tmp_path / x) for x in ("in", "d", "late"))
    steps = [_items(0, 5, 10), _items(10, 4, 9) + _items(20, 3, 12),  # day 9 ends with day 10's start, less a day: open
             _items(30, 2, 9) + _items(40, 6, 11) + [(50, "x", "Negative", 0.5, "web", None)], _items(60, 1, 10)]
    for rows in steps:
        spark.createDataFrame(rows, st.sc.FEEDBACK_SCHEMA).write.mode("append").parquet(feed)
        st.stream_daily_counts(st.read_feedback_stream(spark, feed), out, checkpoint=str(tmp_path / "ck"),
                               watermark="1 day", late_path=late).awaitTermination()
        st.compact_daily_counts(spark, out)
    got = sorted(r.id for r in spark.read.parquet(late).collect())
    assert got == [30, 31, 50, 60]
    assert _counts(spark, out) == {(10, "Positive"): 5, (9, "Positive"): 4, (12, "Positive"): 3, (11, "Positive"): 6}
    assert sum(_counts(spark, out).values()) + len(got) == sum(map(len, steps))
    with pytest.raises(ValueError):
        st.stream_daily_counts(st.read_feedback_stream(spark, feed), out, late_path=late)


def test_published_table_outlives_an_interrupted_write(spark, tmp_path, monkeypatch):
    from vocspark.sources import snapshots
    path = str(tmp_path / "t")
    assert snapshots.read_published(spark, path) is None
    for n in range(1, 6):
        assert snapshots.publish(spark.range(n), path) == n
        opened = snapshots.read_published(spark, path)
        assert opened.count() == n
    broken = spark.range(100).selectExpr("IF(id = 99, raise_error('ended'), id) AS id").repartition(4)
    with pytest.raises(Exception, match="ended"):
        snapshots.publish(broken, path)
    assert snapshots.read_published(spark, path).count() == 5
    monkeypatch.setattr(snapshots, "mark", lambda *_: (_ for _ in ()).throw(RuntimeError("ended")))
    with pytest.raises(RuntimeError):
        snapshots.publish(spark.range(50), path)
    monkeypatch.undo()
    assert snapshots.read_published(spark, path).count() == 5 and opened.count() == 5
    # from the table itself
    assert snapshots.publish(snapshots.read_published(spark, path).where("id > 2"), path) == 6
    assert snapshots.read_published(spark, path).count() == 2
