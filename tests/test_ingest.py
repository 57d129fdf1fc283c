"""Uploads written by the tests (own sentences) into a temp folder."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vocspark.sources import ingest as ing

WRAPPED = [
    '"Comment, Sentiment, Channel, Date/Time, User ID, City, Score"',
    '"""The soup was cold, and the bread stale."", Negative, Web, 2024-02-01 10:00:00, u1, Oslo, 0.8"',
    '',
    '""',
    '"""She said """"wow"""" twice!"", Positive, App, 2024-02-02 11:30:00, u2, Lima, 0.9"',
    '"""Plain note"", Neutral, Email, not a time, u3, Pune, 0.7"',
    '"""Short"", Positive, Web, 2024-02-03 09:00:00, u4, Oslo, 0.6"',
    '"""Odd label"", Maybe, Web, 2024-02-04 09:00:00, u5, Oslo, 0.6"',
]


def _write(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(p)


def test_repair_wrapped_csv(spark, tmp_path):
    df = ing.repair_wrapped_csv(spark, _write(tmp_path, "w.csv", WRAPPED))
    assert df.columns == ["Comment", "Sentiment", "Channel", "Date/Time", "User ID", "City", "Score"]
    rows = df.collect()
    assert len(rows) == 5
    texts = [r.Comment for r in rows]
    assert "The soup was cold, and the bread stale." in texts
    assert 'She said "wow" twice!' in texts


def test_extract_feedback_detects_columns(spark, tmp_path):
    out = ing.extract_feedback(spark, _write(tmp_path, "w.csv", WRAPPED))
    assert set(out.columns) == {"text", "created_at", "channel", "segment", "row_id"}
    r = {x.text: x for x in out.collect()}
    assert r["Plain note"].created_at is None
    assert r["The soup was cold, and the bread stale."].segment == "Oslo"
    assert r["She said \"wow\" twice!"].channel == "App"


def test_mostly_bad_timestamps_are_dropped(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "2024-01-01"), ("c", "y")], "text string, created_at string")
    assert "created_at" not in ing.parse_mixed_timestamps(df).columns
    df2 = spark.createDataFrame([("a", "2024-01-01 10:00"), ("b", "01/02/2024")], "text string, created_at string")
    got = [r.created_at for r in ing.parse_mixed_timestamps(df2).orderBy("text").collect()]
    assert [g.month for g in got] == [1, 1] and got[1].day == 2


def test_txt_items(spark, tmp_path):
    df = ing.read_txt_items(spark, _write(tmp_path, "a.txt", ["  first  ", "", "   ", "second"]))
    assert [r.text for r in df.collect()] == ["first", "second"]


def test_plain_csv_text_column_by_length(spark, tmp_path):
    p = _write(tmp_path, "p.csv", ["a,b", "x,this is the long one", "y,another long text"])
    df = ing.read_csv_items(spark, p)
    assert ing.detect_text_column(df) == "b"


def test_drop_blank_items(spark):
    df = spark.createDataFrame([(1, '  "quoted"  '), (2, "NaN"), (3, "  "), (4, None), (5, "ok")],
                               "id long, text string")
    got = {r.id: r.text for r in ing.drop_blank_items(df).collect()}
    assert got == {1: "quoted", 5: "ok"}


def test_append_replace_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "hello", "Positive", 0.912345, None, None)],
                               "id long, text string, sentiment string, confidence double, "
                               "source string, created_at timestamp_ntz")
    ing.append_feedback(df, path, now="2024-05-01 08:00:00")
    ing.append_feedback(df.withColumn("id", F.lit(2)), path, now="2024-05-02 08:00:00")
    stored = ing.read_feedback(spark, path)
    rows = stored.orderBy("id").collect()
    assert [r.source for r in rows] == ["api", "api"]
    assert rows[0].confidence == 0.9123
    assert str(rows[1].date) == "2024-05-02"
    # partition pruning on the date column
    plan = stored.where(F.col("date") == "2024-05-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    assert ing.replace_feedback(spark, None, path) == 2
    assert ing.read_feedback(spark, path).count() == 0


def test_bootstrap_if_empty(spark, tmp_path):
    snap = _write(tmp_path, "snap.csv", ["text,sentiment,confidence,source,created_at",
                                         "nice,Positive,0.9,web,2024-01-01 00:00:00"])
    df = ing.bootstrap_if_empty(spark, str(tmp_path / "fresh"), snap)
    assert df.count() == 1


def test_validate_split_conserves_rows(spark):
    df = spark.createDataFrame([(1, "a", "Positive", 0.5, "2024-01-01"), (2, None, "Bad", 1.5, None)],
                               "id long, text string, sentiment string, confidence double, created_at string")
    valid, rejects = ing.validate_feedback(df)
    assert valid.count() + rejects.count() == 2
    assert rejects.first().failed == "text_missing,sentiment_invalid,confidence_range,created_at_missing"


def test_export_csv_drops_date(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "2024-01-01")], "id long, text string, date string")
    ing.export_csv(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["id", "text"]


def test_wrapped_corpus_labels(spark, tmp_path):
    df = ing.wrapped_csv_corpus(spark, _write(tmp_path, "w.csv", WRAPPED))
    got = {r.text: r.label for r in df.collect()}
    assert got["The soup was cold, and the bread stale."] == 0
    assert got["Plain note"] == 1
    assert "Odd label" not in got


def test_metrics_round_trip(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"accuracy": 0.5}))
    assert ing.read_metrics(spark, [str(tmp_path / "missing.json"), str(p)]) == {"accuracy": 0.5}
    assert ing.read_metrics(spark, [str(tmp_path / "none.json")]) is None


def test_replace_with_rows_from_the_same_table(spark, tmp_path):
    """The new rows may be derived from the table being replaced."""
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "good", "Positive", 0.9, "2024-01-01 10:00:00"),
                                (2, "bad", "Negative", 0.8, "2024-02-01 10:00:00")],
                               "id long, text string, sentiment string, confidence double, "
                               "created_at string")
    ing.append_feedback(df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), path)
    stored = ing.read_feedback(spark, path)
    assert ing.replace_feedback(spark, stored.where(F.col("id") == 2), path) == 2
    assert [r.id for r in ing.read_feedback(spark, path).collect()] == [2]


def test_replacement_that_ends_midway_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(i, "t", "Neutral", 0.5, "web", dt.datetime(2024, 1, 1 + i)) for i in range(4)], STORE)
    ing.append_feedback(rows, path)
    opened = ing.read_feedback(spark, path)
    broken = rows.withColumn("text", F.when(F.col("id") == 3, F.raise_error(F.lit("ended"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="ended"):
        ing.replace_feedback(spark, broken, path)
    assert ing.read_feedback(spark, path).count() == 4
    assert ing.replace_feedback(spark, rows.where("id = 0"), path) == 4
    ing.append_feedback(rows.where("id = 2"), path)
    assert sorted(r.id for r in ing.read_feedback(spark, path).collect()) == [0, 2] and opened.count() == 4


def test_metric_rows_fall_back_and_summarise(spark, tmp_path):
    from vocspark.operators import evaluate as ev
    rows = spark.createDataFrame(
        [("tweets", "accuracy", 0.68, 0.68, 0.68, 100), ("reviews", "accuracy", 0.73, 0.73, 0.73, 1500),
         ("reviews", "Negative", 0.7, 0.6, 0.65, 500)],
        "test_set string, cls string, precision double, recall double, f1 double, support long")
    ing.write_metrics(rows, str(tmp_path / "v1"))
    back = ing.read_metric_rows(spark, [str(tmp_path / "v2"), str(tmp_path / "v1")])
    got = ev.metrics_summary(back, preferred=("reviews", "tweets")).first()
    assert (got.accuracy, got.accuracy_label, got.test_size, got.test_size_label) == (0.73, "73%", 1600, "1,600")
    assert ing.read_metric_rows(spark, [str(tmp_path / "none")]) is None


def test_synthesize_feedback_ranges_and_repeats(spark):
    """Per-row draws: confidence 0.72..0.99 at 4 places, age < 30 days to the
    second, a seed channel, one id per key; the same rows on a rerun."""
    import datetime as dt
    from vocspark import lexicon as lx
    src = spark.range(2000).select("id", F.lit("same text").alias("text"),
                                   F.lit("Positive").alias("sentiment"))
    a = ing.synthesize_feedback(spark, src).collect()
    b = ing.synthesize_feedback(spark, src).collect()
    assert sorted(a) == sorted(b)
    assert len({r.id for r in a}) == 2000
    anchor = dt.datetime(2024, 2, 1)
    for r in a:
        assert 0.72 <= r.confidence <= 0.99 and round(r.confidence, 4) == r.confidence
        assert dt.timedelta(0) <= anchor - r.created_at < dt.timedelta(days=30)
        assert r.created_at.microsecond == 0 and r.source in lx.SEED_SOURCES
    assert len({r.source for r in a}) == 5


STORE = "id long, text string, sentiment string, confidence double, source string, created_at timestamp_ntz"


def _to_store(spark):
    return spark.createDataFrame([
        (1, "good", "Positive", 0.9, "web", None), (2, "x" * 5000, "Negative", 0.8, "s" * 80, None),
        (3, "bad", "Angry", 0.5, None, None), (4, None, "Neutral", 2.0, None, None)], STORE)


def test_append_loses_no_row(spark, tmp_path):
    path, rejects = str(tmp_path / "store"), str(tmp_path / "rejects")
    ing.append_feedback(_to_store(spark), path, now="2024-05-01 08:00:00", rejects_path=rejects)
    stored = {r.id: r for r in ing.read_feedback(spark, path).collect()}
    refused = {r.id: r.failed for r in spark.read.parquet(rejects).collect()}
    assert set(stored) == {1, 2} and len(stored[2].text) == 5000 and len(stored[2].source) == 80
    assert refused == {3: "sentiment_invalid", 4: "text_missing,confidence_range"}


def test_append_without_rejects_stores_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(Exception, match="break the rules"):
        ing.append_feedback(_to_store(spark), path, now="2024-05-01 08:00:00")
    assert ing._if_there(lambda: ing.read_feedback(spark, path).count()) in (None, 0)


def test_append_writes_few_files(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(1000).repartition(8).selectExpr(
        "id", "'t' AS text", "'Neutral' AS sentiment", "0.5D AS confidence", "'web' AS source",
        "timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id % 15 AS INT)) AS created_at")
    ing.append_feedback(rows, path)
    assert ing.read_feedback(spark, path).count() == 1000
    assert len(ing.read_feedback(spark, path).inputFiles()) == 15


def test_bootstrap_gives_equal_records_ids_of_their_own(spark, tmp_path):
    row = "nice,Positive,0.9,web,2024-01-01 00:00:00"
    snap = _write(tmp_path, "twice.csv", ["text,sentiment,confidence,source,created_at", row, row])
    df = ing.bootstrap_if_empty(spark, str(tmp_path / "fresh"), snap)
    assert df.count() == df.select("id").distinct().count() == 2


def test_unreadable_store_is_not_an_empty_one(spark, tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "part-0.parquet").write_text("no parquet")
    snap = _write(tmp_path, "s.csv", ["text,sentiment,confidence,source,created_at"])
    with pytest.raises(Exception):
        ing.bootstrap_if_empty(spark, str(tmp_path / "store"), snap)


def test_iso_timestamps(spark):
    texts = ["2024-03-01T10:20:30Z", "2024-03-01T12:20:30+02:00", "2024-03-01T10:20:30.5",
             "2024-03-01 10:20:30.000000", "03/01/2024 10:20:30 AM", "2024-03-01T10:20", "2024-13-01"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, created_at string")
    got = [str(r.created_at) for r in ing.parse_mixed_timestamps(df).orderBy("k").collect()]
    assert got == ["2024-03-01 10:20:30"] * 2 + ["2024-03-01 10:20:30.500000"] \
        + ["2024-03-01 10:20:30"] * 2 + ["2024-03-01 10:20:00", "None"]


def test_replies_reading_none_are_kept(spark, tmp_path):
    p = _write(tmp_path, "na.csv", ["text,channel", "none,web", "Na,NA", "NA,web", "nan,web", "ok,None"])
    got = {r.text: r.channel for r in ing.extract_feedback(spark, p).collect()}
    assert got == {"none": "web", "Na": None, "ok": None}


def test_header_after_blank_lines(spark, tmp_path):
    p = _write(tmp_path, "blank.csv", [""] * 8 + ["text"])
    assert ing.first_line(spark, p) == "text"
    with pytest.raises(ValueError):
        ing.first_line(spark, _write(tmp_path, "blanks.csv", [""] * 8))


def test_cap_is_off_unless_asked_for(spark):
    df = spark.range(1200).withColumnRenamed("id", "row_id")
    assert ing.cap_items(df).count() == 1200 and ing.cap_items(df, 5).count() == 5


def test_history_filter_prunes_partitions(spark, tmp_path):
    from vocspark.operators.filters import history_filter
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(i, "t", "Neutral", 0.5, "web", dt.datetime(2024, 1, i, 23, 30))
                                  for i in range(1, 6)], STORE)
    ing.append_feedback(rows, path)
    got = history_filter(ing.read_feedback(spark, path), date_from="2024-01-02", date_to="2024-01-03")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert {r.id for r in got.collect()} == {2, 3}
