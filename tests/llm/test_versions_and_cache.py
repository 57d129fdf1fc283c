"""Versions of one text that don't link, and the halves of the word cache."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vocspark.llm import common, jaccard, packing


def pairs_of(rows):
    by = {}
    for x in rows:
        by.setdefault(x.key, []).append((x.cls, x.c))
    return [tuple(sorted((a[0], b[0]))) for v in by.values() for a, b in itertools.combinations(v, 2) if a[1] != b[1]]


def test_pairs_that_share_many_buckets_are_compared_once(spark):
    r = random.Random(3)
    rows = [(1000 + key, cls, min(cls, 18)) for key in range(60) for cls in r.sample(range(20), 14)]  # one family
    rows += [(2000 + i, cls, cls) for i in range(30) for cls in (100 + i, 101 + i)]  # a chain: its buckets are less
    open_ = spark.createDataFrame(rows, "key long, cls long, c long")
    sizes = open_.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(
        F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("m2"))
    before, after = pairs_of(open_.collect()), pairs_of(jaccard._families(open_, sizes).collect())
    assert set(before) <= set(after) and len(set(before)) < len(before) // 20
    assert len(after) == len(set(after)) == 20 * 19 // 2 - 1 + 30


def test_versions_about_the_threshold_against_brute_force(spark):
    r = random.Random(4)
    base, rows = [f"w{i}" for i in range(160)], []
    for i in range(36):
        own = list(base)
        for at in r.sample(range(160), r.choice((1, 2, 4, 5))):
            own[at] = f"v{i}x{at}"
        rows.append((i, " ".join(own)))
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    label = {i: i for i in sets}
    for _ in sets:
        for i, j in itertools.combinations(sets, 2):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[i] = label[j] = min(label[i], label[j])
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100, 5).collect()
    assert {x.doc_id: x.component_id for x in got} == label and 1 < len(set(label.values())) < 36


def test_bound_of_the_sketches_is_that_of_the_sets(spark):
    # 80 and 80 shingles: 18 apart is 71 of 89, no link at 0.8; 16 apart is 72 of 88, one
    sketch = [[0] * 8, [(1 << 18) - 1] + [0] * 7, [(1 << 16) - 1] + [0] * 7]
    df = spark.createDataFrame([(80, sketch[0], 80, x) for x in sketch], "n long, s array<long>, n2 long, s2 array<long>")
    ok = jaccard._may_link(F.col("n"), F.col("s"), F.col("n2"), F.col("s2"), 80, 100)
    assert [x.ok for x in df.select(ok.alias("ok")).collect()] == [True, False, True]


def test_frequent_words_outlive_a_full_cache(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    name = public_tokenizers.path("word_bpe_49k.json")
    tok, _, size = packing._tokenizer(name)
    sent = []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(" ".join(texts).split())
            return tok.encode_batch_fast(texts, **kw)

    cache = {}
    monkeypatch.setitem(common.worker_state(), ("tokenizer", name), (Counted(), cache, size))
    monkeypatch.setitem(common.worker_state(), ("older words", name), {})
    for i in range(40):
        texts = [" ".join(f"new{i}n{j} often{j % 7}" for j in range(30))]
        got = packing.encode(texts, name, 100)
        assert got[0].tolist() == tok.encode(texts[0], add_special_tokens=False).ids
        assert len(cache) + len(common.worker_state()["older words", name]) <= 100 + 2 * 37
    assert sent.count("often3") == 1 and sent.count("new39n29") == 1
