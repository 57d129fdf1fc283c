"""The mixing schedule against plain Python, sources smaller than a block among them."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vocspark.llm import mixing

DOCS = "doc_id long, text string, source string, size int"


def small_sources(spark):
    rows = [(2 * s + k, " ".join(f"w{s}" for _ in range(5)), f"s{s:03}", None) for s in range(200) for k in (0, 1)]
    rows += [(1000 + i, "word " * 700, "large", 1) for i in range(20)]
    rows += [(None, "no id", None, 1), (2000, None, "s000", 1), (2001, " \t", "only blank", 1), (2002, "x y", "s001", 1),
             (2002, "x y", "s001", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_every_source_is_taken_to_its_target(spark):
    docs = small_sources(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    words, target, size = defaultdict(int), {}, {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        words[x.source] += x.taken
        target[x.source], size[x.source] = x.target, x.source_size
    for s, t in target.items():
        assert abs(words[s] - t) <= 0.5 + 1e-6 and t <= 2 * size[s] + 1e-6
    assert sum(words.values()) == pytest.approx(1.5 * sum(size.values()), abs=100)


def plain_schedule(plan, block):
    """The golden-ratio points mapped through the cumulative targets, one by one."""
    rows = sorted((x for x in plan if x.target > 0), key=lambda x: x.pos)
    mix_size = rows[0].mix_size
    due = {x.pos: math.floor(x.target + 0.5) for x in rows}
    rank, out, width = dict.fromkeys(due, 0), [], 1 << 31
    slots = round(mix_size / block)
    for t in range(slots):
        u = (t * mixing.GOLDEN + width // 2) % width / width
        pos = next((x.pos for x in rows if u < x.upto / mix_size), rows[-1].pos)
        if rank[pos] * block < due[pos]:
            out.append((pos, rank[pos], min(block, due[pos] - rank[pos] * block), t))
        rank[pos] += 1
    for pos, r in rank.items():
        while r * block < due[pos]:
            out.append((pos, r, min(block, due[pos] - r * block), slots))
            r += 1
    return sorted(out)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_schedule_against_plain_python(spark, block):
    docs = small_sources(spark).withColumn("size", mixing.word_count(F.col("text")))
    plan = mixing.materialize(mixing.targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"))))
    got = sorted(tuple(x) for x in mixing.schedule(plan, block).select("pos", "block", "words", "slot").collect())
    assert got == plain_schedule(plan.collect(), block)


def test_whole_documents_keep_the_targets(spark):
    docs = small_sources(spark)
    target = {x.source: x.target for x in mixing.mix(docs).collect()}
    longest = {x.source: x.n for x in docs.groupBy("source").agg(F.max(mixing.word_count(F.col("text"))).alias("n")).collect()}
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns
    got = {x.source: x.n for x in kept.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    for s, t in target.items():
        # two alike rows of s001 are dealt evenly
        assert abs(got.get(s, 0) - t) <= longest[s] / 2 + 0.5 + (2 if s == "s001" else 0)


def test_no_rows_and_no_words(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a", 1), (2, "", None, 1)], DOCS)
    assert [x.taken for x in mixing.mix(blank).collect()] == [0, 0]
    assert mixing.mixed_documents(blank).count() == 2
