"""Pairs of long texts: most are ruled out before their sets are brought together."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocspark.llm import jaccard


def text(r, words, own):
    """One text of all, `own` of its words, side by side, replaced."""
    at, new = r.randrange(words - own + 1), r.random()
    return " ".join(f"n{new}x{i}" if at <= i < at + own else f"w{i}" for i in range(words))


def crowd(seed=3):
    r = random.Random(seed)
    rows = [(i, text(r, 6000, 2100)) for i in range(24)]  # similar by 0.2 to 0.5
    rows += [(100 + i, f"{rows[i][1]} and {i}") for i in range(3)]
    rows += [(200 + i, text(r, words, 6)) for i, words in enumerate((120, 130, 260, 280, 520))]
    return rows


def similar(sets, a, b, num):
    return 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])


@pytest.mark.parametrize(("num", "k"), [(80, 5), (90, 3)])
def test_long_texts_without_a_link_are_not_compared(spark, monkeypatch, num, k):
    rows = crowd()
    sets = {i: {int(x) for x in jaccard.shingles(t, k)} for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    info = [(i, i, len(sets[i]), [int(x) for x in jaccard.sketch_of(jaccard.shingles(t, k))],
             jaccard.long_sketch(jaccard.shingles(t, k))) for i, t in rows]
    reps = spark.createDataFrame(info, "cls long, rep long, n long, sketch array<long>, long binary") \
        .join(docs.select(F.col("doc_id").alias("cls"), F.xxhash64("text").alias("rep_hash")), "cls")
    pairs = list(itertools.combinations(sorted(sets), 2))
    possible = jaccard._possible(spark.createDataFrame(pairs, "a long, b long"), reps, num, 100)
    assert possible.where("b < 24").count() == 24 * 23 / 2  # too much for the 512 bits
    asked, sets_of = [], jaccard._sets_of
    monkeypatch.setattr(jaccard, "_sets_of", lambda need, *a: asked.extend(x.cls for x in need.collect()) or sets_of(need, *a))
    want = {(a, b) for a, b in pairs if similar(sets, a, b, num)}
    got = jaccard._links(possible, reps, docs, num, 100, k)
    assert {tuple(x) for x in got.collect()} == want and len(want) >= 3
    assert not set(asked) & set(range(3, 24)) and len(asked) == len(set(asked))


def test_sketches_of_any_lengths_bound_the_difference():
    r = np.random.default_rng(4)
    all_ = r.integers(0, 1 << 63, 9000, dtype=np.uint64)
    for n, m, first in ((1, 2, 0), (250, 300, 20), (300, 600, 100), (3000, 3300, 1000), (4000, 4097, 3900)):
        x, y = np.unique(all_[:n]), np.unique(all_[first:first + m])
        apart = jaccard.least_apart(jaccard.long_sketch(x), jaccard.long_sketch(y))
        assert apart == jaccard.least_apart(jaccard.long_sketch(y), jaccard.long_sketch(x))
        assert apart <= len(np.setxor1d(x, y)) and (n <= 256 or m <= 256 or apart > 0.4 * len(np.setxor1d(x, y)))
    assert [len(jaccard.long_sketch(all_[:n])) for n in (0, 256, 257, 512, 513)] == [0, 0, 128, 128, 256]


def test_passes_give_the_same_groups(spark, monkeypatch):
    rows = [*crowd(5), (None, "no id"), (900, None), (900, crowd(5)[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def groups(k, num):
        return sorted(jaccard.jaccard_components(docs, num, 100, k).collect(), key=str)

    want = groups(2, 30)
    shares, share = [], jaccard._share
    monkeypatch.setattr(jaccard, "PASS_SHINGLES", 1 << 8)
    monkeypatch.setattr(jaccard, "WIDE", 8)
    monkeypatch.setattr(jaccard, "_share", lambda d, passes, i, *c: shares.append(passes) or share(d, passes, i, *c))
    assert groups(2, 30) == want and max(shares) > 1
    assert len({x.component_id for x in want}) < len(rows) - 3
