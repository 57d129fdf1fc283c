"""The corpus pipeline, stage by stage, against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from vocspark.llm import langid, queries
from vocspark.llm.quality import indicators

LANGS = {"en": "the of and that with have this from they would there their what about which".split(),
         "de": "der die und nicht ist ein das mit sich auch auf werden eine über wird".split()}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, h int"


def prose(r, lang, n):
    return " ".join(r.choice(LANGS[lang]) + r.choice(["", "", "en", "ly"]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of two languages; good ones hold `study`, bad ones `click`."""
    r = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        lang, good = ("en", "de")[i % 2], i % 3 > 0
        text = prose(r, lang, r.randrange(30, 90)) + (" study result method." if good else " click buy now.") * 4
        rows.append((i, text, lang if i % 11 else None, "abc"[i % 3], len(text), "x", "y", 1))
        labels.append((i, int(good), 0))
    near = prose(r, "en", 120).split() + "study result method".split() * 3
    for i in range(300, 306):
        own = list(near)
        own[r.randrange(100)] = "else"
        rows.append((i, " ".join(own), "en", None, 1, None, None, None))
    rows += [(400, None, None, None, None, None, None, None), (401, "", "en", "a", 0, "x", "y", 1),
             (402, "123 ½ !!!", "en", "a", 9, "x", "y", 1), (403, rows[1][1], "de", "b", 1, "x", "y", 1),
             (404, "study method", "en", "a", 9, "x", "y", 1), (404, "study method", "en", "a", 9, "x", "y", 1),
             (None, prose(r, "de", 40) + " study result method" * 3, "de", "a", 9, "x", "y", 1),
             (405, " ".join(prose(r, "en", 20_000).split()) + " study result method" * 900, "en", "c", 9, "x", "y", 1)]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(frame):
    return collections.Counter(map(tuple, frame.collect()))


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = docs.columns

    lang = queries.language_model(spark, folder)
    first = cp.language(spark, docs, folder)
    assert first.columns == want
    keep = collections.Counter()
    for x in docs.collect():
        if langid.has_letter(x.text):
            name, score = lang.predict(x.text)
            if name != langid.UNKNOWN and score >= cp.LEAST_LANGUAGE:
                keep[tuple(x)] += 1
    assert rows_of(first) == keep and 230 <= sum(keep.values()) < docs.count()
    first = spark.createDataFrame(first.collect(), docs.schema)

    good = queries.quality_model(spark, folder)
    second = cp.good_quality(spark, first, folder)
    assert second.columns == want
    assert rows_of(second) == collections.Counter(
        {k: n for k, n in rows_of(first).items() if good.score(indicators(k[1])) >= 0.7})
    kept = {x.doc_id for x in second.collect()}
    clean = {i for i in range(240) if i % 3}
    assert len(kept & clean) >= 0.95 * len(clean) and len(kept & (set(range(240)) - clean)) <= 8
    second = spark.createDataFrame(second.collect(), docs.schema)

    third = cp.near_duplicates(spark, second, folder)
    assert third.columns == want
    rows = [tuple(x) for x in second.collect()]
    sets = {}
    for x in rows:
        w = x[1].lower().split()
        sets.setdefault(x[0], set()).update({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    stay = {i for i in ids if find(i) == i} | {None}
    got = third.collect()
    assert collections.Counter(x.doc_id for x in got) == collections.Counter(
        {i: 1 for i in stay if i is not None} | {None: sum(x[0] is None for x in rows)})
    assert set(map(tuple, got)) <= set(rows) and len(stay) < len(sets)
    third = spark.createDataFrame(got, docs.schema)

    fourth = cp.mixed(spark, third, folder)
    assert fourth.columns == want
    assert set(rows_of(fourth)) <= set(rows_of(third)) and max(rows_of(fourth).values()) <= 2
    fourth = spark.createDataFrame(fourth.collect(), docs.schema)

    pieces = cp.packed(spark, fourth, folder).collect()
    tokens = collections.Counter()
    for x in pieces:
        tokens[x.doc_id, x.doc_tokens] += x.length
    times = collections.Counter(x.doc_id for x in fourth.collect())
    assert all(n == k[1] * times[k[0]] for k, n in tokens.items() if k[0] is not None)
    assert {x.doc_id for x in pieces} == set(times)


def test_whole_run(spark, folder):
    pieces = cp.run(spark, folder)
    total = pieces.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert total[0] > 1000 and total[1] >= total[0] / 4096


def test_without_models_all_documents_pass(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = str(tmp_path)
    docs.withColumn("lang", F.lit(None).cast("string")).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").write.parquet(f"{path}/labels.parquet")
    assert rows_of(cp.language(spark, docs, path)) == rows_of(docs)
    assert rows_of(cp.good_quality(spark, docs, path)) == rows_of(docs)


def test_nothing_in_nothing_out(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0
