"""Audits end in a beam of the graph, and the graph finds planted links."""

import numpy as np
from pyspark.sql import functions as F

from vocspark.llm import hnsw


def planted(n=4000, dim=32, pairs=400):
    r = np.random.default_rng(11)
    x = r.normal(size=(n, dim))
    x[n - pairs:] = x[:pairs] + r.normal(size=(pairs, dim)) * 0.2
    x[pairs:pairs + 150] = x[pairs] + r.normal(size=(150, dim)) * 0.1  # a crowd
    return x


def test_probes_link_with_their_nodes():
    x = planted(600, 24, 20)
    g = hnsw.Graph(np.arange(600), x).build()
    nodes, turned = g.probes(3, 0.95)
    cos = (turned * x[nodes]).sum(1) / np.linalg.norm(turned, axis=1) / np.linalg.norm(x[nodes], axis=1)
    assert len(set(nodes)) == hnsw.AUDIT and (cos >= 0.95).all() and (cos < 0.96).all()
    assert (g.probes(3, 0.95)[1] == turned).all() and (g.probes(4, 0.95)[0] != nodes).any()


def test_audit_without_links_stays_on_the_graph():
    x = np.random.default_rng(2).normal(size=(3000, 32))
    g = hnsw.Graph(np.arange(3000), x).build()
    recall, beam = g.audit(g.ids, x, g.ids, 0.95)
    assert recall >= hnsw.AUDIT_RECALL and beam <= hnsw.WIDEST_BEAM


def test_query_finds_planted_links_by_the_graph(spark):
    x = planted()
    rows = [(i, [float(v) for v in np.float32(y)]) for i, y in enumerate(x)]
    v = np.array([y for _, y in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    out, audits = hnsw.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_vectors=1000)
    got = {y.vec_id: y.n_links for y in out.collect()}
    seen = audits.agg(F.min("recall"), F.max("beam"), F.count("*")).first()
    assert seen[0] >= hnsw.AUDIT_RECALL and seen[1] <= hnsw.WIDEST_BEAM and seen[2] > 4
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.99 * near.sum()
