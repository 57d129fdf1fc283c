"""Fingerprints whatever the ids are: seams of ranges, hot null ids,
rows alike; and no Python on the path of the native operators."""

import hashlib
import random

import pyspark.sql.functions as F
import pytest
from pyspark.sql import DataFrame
from pyspark.sql.group import GroupedData

from vocspark.llm import fingerprint, queries


def _brute(spark, df):
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")) \
        .select("doc_id", "t", F.xxhash64("t").alias("h"), fingerprint.paragraph_digests(F.col("t")).alias("p")).collect()
    rows.sort(key=lambda x: (x.doc_id is not None, x.doc_id or 0, x.h))
    out, edits = [], []
    for i, x in enumerate(rows):
        n, after = len(x.t) // 4, rows[(i + 1) % len(rows)]
        edits.append((i, x.t[:len(x.t) - n] + after.t[:n]))
    edit = {x.i: set(x.p) for x in spark.createDataFrame(edits, "i long, t string").select(
        "i", fingerprint.paragraph_digests(F.col("t")).alias("p")).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, x in enumerate(rows):
        a, b = set(x.p), set(rows[(i + 1) % len(rows)].p)
        out.append((x.doc_id or 0, len(x.t), hashlib.sha256(edits[i][1].encode()).hexdigest(),
                    round(like(a, edit[i]), 9), round(like(a, b), 9)))
    return sorted(out)


def _got(df, **how):
    return sorted((x.doc_id or 0, x.n_chars, x.edited_sha256, round(x.near_edited, 9), round(x.near_next, 9))
                  for x in fingerprint.fingerprints(df, **how).collect())


def _text(r):
    return " ".join(f"w{r.randrange(50)}" + r.choice(["", "", ".", "!"]) for _ in range(r.randrange(0, 60)))


@pytest.mark.parametrize("range_docs", [5, 128])
def test_hashed_ids_and_a_third_of_null_ids(spark, range_docs):
    r = random.Random(11)
    rows = [(None if i % 3 == 0 else r.randrange(-(1 << 62), 1 << 62), _text(r)) for i in range(600)]
    rows += [(5, "one text. said again"), (5, "one text. said again"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash"))
    assert _got(df, range_docs=range_docs) == _brute(spark, df)


def test_rows_alike_outweigh_a_range(spark):
    r = random.Random(12)
    rows = [(i, _text(r)) for i in range(100)] + [(None, "the same row. again and again")] * 60 + [(200, "end. of all")] * 45
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(df, range_docs=20) == _brute(spark, df)


def test_no_catalog_table_is_left(spark):
    before = {t.name for t in spark.catalog.listTables()}
    df = fingerprint.fingerprints(spark.createDataFrame([(1, "a. b"), (2, "c")], "doc_id long, text string"))
    assert {t.name for t in spark.catalog.listTables()} == before and df.count() == 2


@pytest.mark.parametrize("name", ["op2_fingerprints", "op6_quotes"])
def test_native_operators_use_no_python(spark, monkeypatch, name):
    def python(*_, **__):
        raise AssertionError("Python code on the native path")

    for what in ("mapInArrow", "mapInPandas", "toPandas", "toArrow", "foreachPartition"):
        monkeypatch.setattr(DataFrame, what, python)
    for what in ("applyInPandas", "applyInArrow"):
        monkeypatch.setattr(GroupedData, what, python)
    for what in ("udf", "pandas_udf"):
        monkeypatch.setattr(F, what, python)
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and df.count() > 0
