"""Shards of the WARC writer: hot and sparse keys, and a commit taken up again."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vocspark.llm import common, warc


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_null_and_hashed_ids_are_dealt_by_bytes(spark, tmp_path):
    r = random.Random(3)
    rows = [(None if i % 3 == 0 else r.randrange(-(1 << 62), 1 << 62), f"u{i}", f"page {i} " + "x" * 400) for i in range(900)]
    folders = [str(tmp_path / f"w{i}") for i in range(2)]
    sums = []
    for i, folder in enumerate(folders):
        m = warc.write_warc(_pages(spark, rows).repartition(1 + 6 * i), folder, shard_bytes=40_000).collect()
        sums.append(sorted((x.file, x.sha256, x.records) for x in m))
    assert sums[0] == sums[1]
    total = 900 * (warc.RECORD_BYTES + 409)
    assert total // 40_000 <= len(m) <= 2 * total // 40_000 + 2  # files follow bytes, not ids
    nulls = [x for x in m if x.first_page is None and x.last_page is None]
    assert len(nulls) >= 5 and max(x.records for x in m) < 120  # a third of all rows is cut
    got = warc.read_warc(spark, folders[0]).collect()
    assert sorted((x.page_id or 0, x.payload_digest) for x in got) == sorted(
        (p or 0, hashlib.sha256(h.encode()).hexdigest()) for p, _, h in rows) and all(x.sound for x in got)
    # a range sort: the ids of files in their order ascend
    spans = [(x.first_page, x.last_page) for x in sorted(m, key=lambda x: x.file) if x.first_page is not None]
    flat = [x for s in spans for x in s if x is not None]
    assert flat == sorted(flat)


def test_commit_is_taken_up_again(spark, tmp_path, monkeypatch):
    rows = [(i, "u", f"page {i} " + "x" * 300) for i in range(60)]
    folder = tmp_path / "w"
    with monkeypatch.context() as m:
        def broken(*_):
            raise RuntimeError("lost between manifest and rename")
        m.setattr(warc, "finish_warc", broken)
        with pytest.raises(RuntimeError):
            warc.write_warc(_pages(spark, rows), str(folder), shard_bytes=10_000)
    assert not list(folder.glob("part-*")) and warc.read_warc(spark, str(folder)).count() == 0
    (folder / "_tmp-of-a-failed-task").write_bytes(b"half")
    with pytest.raises(FileExistsError):
        warc.write_warc(_pages(spark, rows), str(folder))
    for _ in range(2):
        n = warc.finish_warc(spark, str(folder)).agg(F.sum("records")).first()[0]
        assert n == 60 and not list(folder.glob("_tmp-*"))
        got = warc.read_warc(spark, str(folder)).collect()
        assert sorted(x.page_id for x in got) == list(range(60)) and all(x.sound for x in got)


def test_unfinished_manifest_is_written_again(spark, tmp_path):
    folder = tmp_path / "w"
    (folder / "_manifest").mkdir(parents=True)
    (folder / "_manifest" / "part-half.parquet").write_bytes(b"PAR1")
    warc.write_warc(_pages(spark, [(1, "u", "a")]), str(folder))
    assert warc.read_warc(spark, str(folder)).count() == 1


@pytest.mark.parametrize("keys", [
    [], [5], [-(1 << 63), 0, (1 << 63) - 1], list(range(1000)),
    [(1 << 60) + i for i in range(500)], [7] * 600 + list(range(400))])
def test_ranges_are_even_and_ascend(spark, keys):
    count = {k: keys.count(k) for k in keys}
    weights = spark.createDataFrame(list(count.items()), "k long, w long")
    add, n = common.deal_ranges(weights, 50)
    rows = spark.createDataFrame([(k, (i % 97) / 97) for i, k in enumerate(keys)], "k long, at double")
    got = add(rows).select("k", "range").collect()
    assert len(got) == len(keys) and all(0 <= x.range < n for x in got)
    own = {}
    for x in got:
        own.setdefault(x.range, []).append(x.k)
    order = [k for i in sorted(own) for k in (min(own[i]), max(own[i]))]
    assert order == sorted(order)
    if max(keys, default=0) < 1 << 53:
        assert all(len(v) <= 110 for v in own.values())
