"""Graphs stay out of Spark's rows, and scans of crowds find a few pairs at a time."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vocspark.llm import hnsw
from vocspark.session import shared_dir


def vectors(n=900, dim=16):
    r = np.random.default_rng(6)
    x = r.normal(size=(n, dim))
    x[100:160] = x[5] + r.normal(size=(60, dim)) * 0.08
    x[300:340] = x[700:740] + r.normal(size=(40, dim)) * 0.1
    x[800] = x[801] = x[802]
    return np.float32(x)


def near(x):
    v = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = v @ v.T >= 0.95
    np.fill_diagonal(hit, False)
    return hit


def written(spark):
    """Number of graph files in the shared folder."""
    from pathlib import Path

    return len([*Path(shared_dir(spark, "graphs").removeprefix("file:")).rglob("*.npz")])


def test_graphs_are_no_rows_and_are_read_by_each_block(spark, monkeypatch):
    x, seen, files, write = vectors(), [], [], hnsw.materialize

    def materialize(df):
        out = write(df)
        seen.append(dict(out.dtypes))
        files.append(written(spark))
        return out

    monkeypatch.setattr(hnsw, "materialize", materialize)
    monkeypatch.setattr(hnsw, "BLOCK", 200)
    for kind in ("float", "double"):
        before = written(spark)
        rows = [(i, [float(v) for v in y]) for i, y in enumerate(x)] + [(950, [1.0, 2.0]), (951, [2.0, 4.0]), (7, [1.0, 2.0])]
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        out, audits = hnsw.link_embeddings(df, shard_vectors=300)
        got = {}
        for y in out.collect():
            got.setdefault(y.vec_id, y)
        want = near(x)
        want_links = want.sum(1).tolist()
        want_links[7] += 2  # its other vector links with 950 and 951
        assert [got[i].n_links for i in range(len(x))] == want_links
        assert got[950].n_links == got[951].n_links == 2 and got[951].component_id == 7
        assert got[100].component_id == 5 and got[802].component_id == 800 and got[739].component_id == 339
        assert audits.groupBy("dim", "shard").count().where("dim = 16").agg(F.count("*"), F.min("count")).first()[:] == (4, 6)
        assert all(t != "binary" for s in seen for t in s.values())
        assert max(files) > before and written(spark) == before  # they go when all blocks have asked


def test_graph_bytes_keep_vectors_that_are_no_floats():
    for x in (vectors()[:50], np.random.default_rng(1).normal(size=(50, 16))):
        g = hnsw.Graph(np.arange(50), x.astype(float)).build()
        g.comp = np.arange(50)
        again = hnsw.Graph.from_bytes(g.to_bytes())
        assert again.raw.dtype == float and (again.raw == g.raw).all() and (again.unit == g.unit).all()


def test_scans_of_a_crowd_hold_few_pairs():
    r = np.random.default_rng(2)
    x = r.normal(size=(1, 8)) + r.normal(size=(12_000, 8)) * 0.01
    g = hnsw.Graph(np.arange(len(x)), x)
    tracemalloc.start()
    found = g.linked(x[:256], np.arange(256), 0.95, hnsw.SCAN)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == len(x) - 1).all()
    assert peak < 150 << 20  # 3 million pairs, in several arrays, took more


def test_ids_of_several_vectors_in_a_crowd(monkeypatch):
    monkeypatch.setattr(hnsw, "SCAN_PAIRS", 1)  # each query's links come alone
    r = np.random.default_rng(3)
    x = r.normal(size=(1, 8)) + r.normal(size=(300, 8)) * 0.01
    ids = np.array([*range(296), 0, 0, 1, 295])
    out = hnsw._build(0.95)((8, 0), pd.DataFrame({"vec_id": ids, "embedding": list(x)}))
    got = out[out["root"].isnull() & out["vec_id"].notnull()].groupby("vec_id")["n_links"].sum()
    times = np.bincount(ids)
    assert got.to_dict() == {int(i): int(n * (300 - n)) for i, n in enumerate(times)}
