"""Wide buckets: classes compared by what sets them apart from a centre."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocspark.llm import jaccard


def versions(r, n, words, edits, first=0, shared=()):
    """Texts of `words` words, each with some words replaced, at times as in others."""
    base, rows = [f"w{first}x{i}" for i in range(words)], []
    for i in range(n):
        own = list(base)
        for at in r.sample(range(words), r.choice(edits)):
            own[at] = f"v{at}" if r.random() < 0.3 else f"v{first}x{i}x{at}"
        rows.append((first + i, " ".join([*shared, *own])))
    return rows


def reachable(sets, num, den, links=None):
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    if links is None:
        links = [(i, j) for i, j in itertools.combinations(sets, 2)
                 if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    for i, j in links:
        a, b = sorted((root(i), root(j)))
        label[b] = a
    return {i: root(i) for i in sets}


def kept_pairs(spark, rows, num, den, k):
    """Sets by class, and what `_wide_pairs` gives for all of them in two buckets."""
    sets = {i: {int(x) for x in jaccard.shingles(t, k)} for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    info = [(i, i, len(sets[i]), [int(x) for x in jaccard.sketch_of(jaccard.shingles(t, k))]) for i, t in rows]
    reps = spark.createDataFrame(info, "cls long, rep long, n long, sketch array<long>") \
        .join(docs.select(F.col("doc_id").alias("cls"), F.xxhash64("text").alias("rep_hash")), "cls")
    wide = spark.createDataFrame([(key, i, i) for key in (1, 2) for i in sets], "key long, cls long, c long")
    star, pairs = jaccard._wide_pairs(wide, reps, docs, num, den, k)
    return sets, [tuple(x) for x in star.collect()], [tuple(x) for x in pairs.collect()]


@pytest.mark.parametrize(("num", "k", "edits"), [(80, 5, (0, 1, 2, 3, 4, 5)), (90, 3, (1, 2, 3)), (80, 5, (4, 5, 6)),
                                                 (50, 2, (5, 20, 30))])
def test_pairs_of_a_bucket_join_what_brute_force_joins(spark, num, k, edits):
    r = random.Random(num + len(edits))
    rows = versions(r, 70, 90, edits) + versions(r, 20, 120, edits, 1000) + [(2000, "w0x1 w0x2 w0x3 w0x4 w0x5 w0x6")]
    sets, star, pairs = kept_pairs(spark, rows, num, 100, k)
    real = [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    assert all(100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) for i, j in star)
    assert reachable(sets, num, 100, star + real) == reachable(sets, num, 100)


def test_a_crowd_without_links_gives_few_pairs(spark):
    r = random.Random(7)
    crowd = []
    for i in range(300):
        at = set(r.sample(range(150), 4))
        crowd.append((i, " ".join(f"v{i}x{j}" if j in at else f"w{j}" for j in range(150))))
    passage = [f"p{j}" for j in range(60)]
    others = [(1000 + i, " ".join([*passage, *(f"o{i}x{j}" for j in range(90))])) for i in range(100)]
    _, star, pairs = kept_pairs(spark, crowd + others, 80, 100, 5)
    assert len(star) + len(pairs) < 400 * 20  # 79,800 pairs in each of the buckets


def test_wide_buckets_give_the_components_of_narrow_ones(spark, monkeypatch):
    r = random.Random(8)
    rows = versions(r, 90, 140, (2, 3, 4, 5)) + versions(r, 30, 60, (1, 2, 3), 500, [f"p{j}" for j in range(50)])
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    called, wide = [], jaccard._wide_pairs
    monkeypatch.setattr(jaccard, "WIDE", 6)
    monkeypatch.setattr(jaccard, "_wide_pairs", lambda *a: called.append(1) or wide(*a))
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (2000, rows[0][1]), (2001, None)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(docs, 80, 100, 5).collect()}
    want = reachable(sets, 80, 100)
    assert {i: got[i] for i in want} == want and called
    assert got[2000] == want[rows[0][0]] and got[2001] == 2001 and got[None] is None
    assert 1 < len(set(want.values())) < len(want)


def test_differences_hold_what_is_not_in_the_centre_first():
    import pyarrow as pa

    x, z = np.array([1, 5, 9, *range(20, 60)], np.uint64), np.array([2, 5, *range(20, 60)], np.uint64)
    one = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([8]), pa.array([8]), pa.array([x.tobytes()], pa.binary()),
                                      pa.array([z.tobytes()], pa.binary())], ["centre", "cls", "c", "x", "z"])
    (out,) = jaccard._apart(80, 100)([one])
    assert out.to_pylist() == [{"centre": 7, "cls": 8, "c": 8, "n": 43, "d": 3, "near": True, "heads": [1, 9]}]
