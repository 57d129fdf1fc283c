"""Pages, look-ups, sketches, domain lists and stores against plain Python."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.operators import accounts as acc
from vocspark.operators import aggregate as ag
from vocspark.operators import evaluate as ev
from vocspark.operators import rank as rk
from vocspark.operators import score as sco
from vocspark.sources import ingest as ing

STORE = "id long, text string, sentiment string, confidence double, source string, created_at timestamp_ntz"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "store")
    r = random.Random(3)
    rows = [(i, "t", "Neutral", 0.5, "web", dt.datetime(2024, 1, 1 + r.randrange(20), r.randrange(24))) for i in range(500)]
    ing.append_feedback(spark.createDataFrame(rows, STORE), path)
    return ing.read_feedback(spark, path), sorted(rows, key=lambda x: (x[5], x[0]), reverse=True)


def test_deep_pages(spark, stored):
    table, rows = stored
    for limit, offset in ((10, 0), (50, 333), (1000, 0), (7, 498), (1, 499)):
        page = rk.deep_page(table, limit, offset).collect()
        assert [x.id for x in page] == [x[0] for x in rows[offset:offset + limit]]
        assert {x.total for x in page} == {500}
    assert rk.deep_page(table, 10, 500).count() == 0
    assert rk.deep_page(table.where("id < 0"), 10, 0).count() == 0
    for bad in ((0, 0), (1001, 0), (5, -1)):
        with pytest.raises(ValueError):
            rk.deep_page(table, *bad)


def test_deep_page_reads_its_dates_only(stored):
    table, rows = stored
    page = rk.deep_page(table, 5, 400)
    days = {x[5].date() for x in rows[400:405]}
    read = page._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[(isnotnull\()?date", read)
    assert all(str(d) in read or str((d - dt.date(1970, 1, 1)).days) in read for d in days) and len(days) <= 2


def test_rows_without_time_are_the_last_page(spark):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3) if i % 4 else None) for i in range(20)]
    d = spark.createDataFrame(rows, "id long, created_at timestamp_ntz").withColumn("date", F.to_date("created_at"))
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or dt.datetime.min, x[0]), reverse=True)
    assert [x.id for x in rk.deep_page(d, 10, 12).collect()] == [x[0] for x in want[12:]]


def test_domain_join_equals_all_pairs(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abc.") for _ in range(r.randrange(1, 6))) for _ in range(120)]
    known = sorted(set(base[:60]))
    mine = base[30:] + [None, "", "mail.com", known[0]]
    k = spark.createDataFrame([(x, i % 7) for i, x in enumerate(known)], "domain string, rank int")
    got = acc.domain_suggestions(spark.createDataFrame([(x,) for x in mine], "domain string"), k)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()

    def apart(a, b):
        edits = {a[:i] + a[i + 1:] for i in range(len(a))}
        edits |= {a[:i] + c + a[i + 1:] for i in range(len(a)) for c in "abc."} - {a}
        edits |= {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc."}
        edits |= {a[:i] + a[i + 1] + a[i] + a[i + 2:] for i in range(len(a) - 1) if a[i] != a[i + 1]}
        return b in edits

    want = {}
    for x in set(mine) - {None, "mail.com"} - set(known):
        near = [(i % 7, y) for i, y in enumerate(known) if apart(x, y)]
        if near:
            want[x] = min(near)[1]
    assert {x.domain: x.suggestion for x in got.collect()} == want


def test_stored_accounts_are_found_in_one_partition(spark, tmp_path):
    path = str(tmp_path / "accounts")
    rows = [(i, f" User{i % 50}@Mail.org " if i % 5 else None) for i in range(300)]
    acc.write_accounts(spark.createDataFrame(rows, "id long, email string"), path)
    found = acc.lookup_account(spark, path, "USER7@mail.org ")
    assert sorted(x.id for x in found.collect()) == [i for i in range(300) if i % 5 and i % 50 == 7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(email_norm,user7@mail.org)" in plan
    assert acc.lookup_account(spark, path, "nobody@mail.org").count() == 0
    assert spark.read.parquet(path).count() == 300


def test_accounts_without_address_all_stay(spark):
    rows = [(1, None, "2024-01-02"), (2, None, "2024-01-01"), (3, "a@b.c", "2024-01-03"), (4, " A@B.C", "2024-01-01")]
    d = spark.createDataFrame(rows, "id long, email string, created_at string")
    assert sorted(x.id for x in acc.unique_accounts(d).collect()) == [1, 2, 4]


def test_merged_sketches(spark):
    d = spark.range(40_000).select(
        F.concat(F.lit("c"), F.pmod("id", F.lit(20_000)).cast("string")).alias("channel"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("segment"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.pmod("id", F.lit(9)).cast("int"))).alias("created_at"))
    sketches = ag.daily_sketches(d)
    assert sketches.count() == 18
    got = {x.dimension: x for x in ag.merged_group_counts(sketches).collect()}
    assert got["segment"].groups == 20 and got["segment"].multi
    assert abs(got["channel"].groups - 20_000) <= 3 * 0.016 * 20_000
    one = ag.merged_group_counts(ag.daily_sketches(d.where("channel = 'c2'"), ("channel",))).first()
    assert one.groups == 1 and not one.multi


def test_labels_without_class_go_to_rejects(spark, tmp_path):
    items = spark.createDataFrame([(1, "I love it", "web"), (2, "no idea", "web"), (3, "", "web")],
                                  "id long, text string, source string")

    def scorer(d):
        return sco.score_rules(d).withColumn("sentiment", F.when(F.col("id") != 2, F.col("sentiment")))

    _, rejects = sco.classify_and_store(items, str(tmp_path / "s"), scorer=scorer, now="2024-01-01 00:00:00",
                                        rejects_path=str(tmp_path / "r"))
    assert [x.id for x in ing.read_feedback(spark, str(tmp_path / "s")).collect()] == [1]
    assert [(x.id, x.failed) for x in spark.read.parquet(str(tmp_path / "r")).collect()] == [(2, "sentiment_invalid")]
    assert [x.id for x in rejects.collect()] == [3]


def test_model_figures_fall_back(spark, tmp_path):
    fixed = (lx.DEFAULT_MODEL_FIGURES["accuracy"], lx.DEFAULT_MODEL_FIGURES["test_size"])
    assert tuple(ev.model_figures(spark, [str(tmp_path / "none")]).first()) == fixed == ("68%", "12,284")
    rows = spark.createDataFrame([("documents_test", "accuracy", 0.73, 0.73, 0.73, 1500)],
                                 "test_set string, cls string, precision double, recall double, f1 double, support long")
    ing.write_metrics(rows, str(tmp_path / "v1"))
    assert tuple(ev.model_figures(spark, [str(tmp_path / "v2"), str(tmp_path / "v1")]).first()) == ("73%", "1,500")
    ing.write_metrics(rows.where("support = 0"), str(tmp_path / "empty"))
    assert tuple(ev.model_figures(spark, [str(tmp_path / "empty")]).first()) == fixed
