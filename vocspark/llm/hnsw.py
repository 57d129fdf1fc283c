"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Vectors are dealt to shards by hash.  Each shard folds equal vectors into one
node that counts as often as it has ids, builds its graph in one task, audits it,
links its own vectors and writes the graph to the shared folder, once.  Every vector
then queries every other shard, in blocks that read one graph after the other and
are audited too.  An audit asks a set number
of probes, nodes turned away from themselves to a cosine just above the threshold,
whose link is known without a scan whether or not the vectors have any, and scans
a set number of the queries for links of their own; the beam widens until it finds
nearly all of both.  A beam filled with links is widened until it holds a vector
that is none; only beams beyond the widest scan the shard.  Every link is
verified by cosine in double precision.  Pairs live as long as their block of
queries; tasks return, per vector, the number of links and edges to the
components it touches in a shard, never all pairs of a group."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, mix64, release, remove, shared_dir
from .warc import _store

THRESHOLD = 0.95
#: Vectors in a shard at most (about), and shards at least.
SHARD_VECTORS = 50_000
LEAST_SHARDS = 2
DEGREE = 12
BUILD_BEAM = 40
BEAM = 24
WIDEST_BEAM = 192
#: Probes of an audit, as many queries that it scans, and the least mean recall.
AUDIT = 200
AUDIT_RECALL = 0.995
#: How far a probe lies inside the threshold, as a share of what is left to 1.
INSIDE = 0.02
SCAN = 1 << 40
#: Vectors of one block of queries, about.
BLOCK = 8192
#: Pairs that a scan may find at a time, and that are verified at a time.
SCAN_PAIRS, VERIFY_PAIRS = 1 << 20, 1 << 14


class Layer:
    """Neighbour lists of the nodes of one level, padded with -1."""

    def __init__(self, nodes: np.ndarray, n: int, degree: int):
        self.degree, self.cap = degree, 2 * degree
        self.nodes = nodes
        self.row = np.full(n, -1, np.int32)
        self.row[nodes] = np.arange(len(nodes), dtype=np.int32)
        self.nbr = np.full((len(nodes), self.cap), -1, np.int32)
        self.deg = np.zeros(len(nodes), np.int32)


class Graph:
    def __init__(self, ids: np.ndarray, raw: np.ndarray, mult: np.ndarray | None = None):
        self.ids, self.raw = ids, raw
        self.mult = np.ones(len(ids), np.int64) if mult is None else mult
        self.norm = np.sqrt((raw * raw).sum(1))
        self.unit = (raw / self.norm[:, None]).astype(np.float32)
        self.beam = BEAM
        n = len(ids)
        u = (mix64(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / 2.0 ** 53
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(DEGREE)).astype(int), 8)
        self.layers = [Layer(np.flatnonzero(level >= k), n, DEGREE * (2 if k == 0 else 1))
                       for k in range(int(level.max()) + 1 if n else 0)]
        self.entry = int(level.argmax()) if n else -1
        self.done = np.zeros(n, bool)

    def search(self, layer: Layer, q: np.ndarray, start: np.ndarray, ef: int, stride: int = 3):
        """Ids and similarities of the `ef` best nodes found for each query by
        best-first steps from `start`, all queries side by side."""
        m, n, cap = len(q), len(self.ids), layer.cap
        start = start.reshape(m, -1)
        width = max(ef, start.shape[1])
        ids = np.full((m, width), -1, np.int64)
        sims = np.full((m, width), -np.inf, np.float32)
        out = np.ones((m, width), bool)  # expanded, or nothing there
        stamp = np.full((m, n), -1, np.int16)
        k = start.shape[1]
        ids[:, :k] = start
        sims[:, :k] = np.einsum("qd,qkd->qk", q, self.unit[start])
        out[:, :k] = False
        stamp[np.arange(m)[:, None], start] = 0
        act = np.arange(m)
        stride = min(stride, width)
        while len(act):
            open_ = np.where(out[act], -np.inf, sims[act])
            pick = np.argpartition(-open_, stride - 1, axis=1)[:, :stride]
            some = np.take_along_axis(open_, pick, 1) > -np.inf
            go = some.any(1)
            act, pick, some = act[go], pick[go], some[go]
            if not len(act):
                break
            r = np.arange(len(act))[:, None]
            out[act[:, None], pick] = True
            at = layer.row[np.where(some, ids[act[:, None], pick], self.entry)]
            nb = np.where(some[:, :, None], layer.nbr[at], -1).reshape(len(act), -1)
            flat = np.flatnonzero(nb >= 0)
            qr, col, node = flat // nb.shape[1], flat % nb.shape[1], nb.ravel()[flat]
            new = stamp[act[qr], node] < 0
            qr, col, node = qr[new], col[new], node[new]
            stamp[act[qr], node] = col
            once = stamp[act[qr], node] == col
            qr, col, node = qr[once], col[once], node[once]
            s = np.full(nb.shape, -np.inf, np.float32)
            s[qr, col] = np.einsum("nd,nd->n", q[act[qr]], self.unit[node])
            all_s = np.concatenate([sims[act], s], 1)
            best = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            all_i = np.concatenate([ids[act], nb], 1)
            all_o = np.concatenate([out[act], s == -np.inf], 1)
            ids[act], sims[act], out[act] = all_i[r, best], all_s[r, best], all_o[r, best]
        return ids, sims

    def descend(self, q: np.ndarray, bottom: int, ef: int, upto: int = 0):
        """Entry points at level `bottom`, from the top through all levels."""
        start = np.full((len(q), 1), self.entry, np.int64)
        for k in range(len(self.layers) - 1, bottom, -1):
            ids, sims = self.search(self.layers[k], q, start, 4)
            start = self._good(ids, sims)
        return start

    @staticmethod
    def _good(ids, sims):
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(sims > -np.inf, ids, ids[:, :1])[:, :1] if (sims == -np.inf).any() else ids

    def choose(self, sims: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
        """Up to m candidates, close ones first, each closer to the node than to
        any chosen before; open places go to the closest of the others."""
        order = np.argsort(-sims, kind="stable")
        cand, sims = cand[order], sims[order]
        if len(cand) <= m:
            return cand
        among = self.unit[cand] @ self.unit[cand].T
        near = np.full(len(cand), -np.inf, np.float32)
        take = []
        for i in range(len(cand)):
            if sims[i] > near[i]:
                take.append(i)
                if len(take) == m:
                    break
                np.maximum(near, among[i], out=near)
        if len(take) < m:
            rest = np.setdiff1d(np.arange(len(cand)), take, assume_unique=True)
            take += rest[: m - len(take)].tolist()
        return cand[take]

    def connect(self, layer: Layer, node: int, cand: np.ndarray, sims: np.ndarray) -> None:
        got = self.choose(sims, cand, layer.degree // 2 if layer.degree > DEGREE else layer.degree)
        r = layer.row[node]
        old = layer.nbr[r, :layer.deg[r]]
        got = got[~np.isin(got, old)][: layer.cap - layer.deg[r]]
        layer.nbr[r, layer.deg[r]:layer.deg[r] + len(got)] = got
        layer.deg[r] += len(got)
        for other in got:
            o = layer.row[other]
            if layer.deg[o] == layer.cap:
                have = layer.nbr[o].astype(np.int64)
                kept = self.choose(self.unit[have] @ self.unit[other], have, layer.degree)
                layer.nbr[o] = -1
                layer.nbr[o, :len(kept)] = kept
                layer.deg[o] = len(kept)
            layer.nbr[o, layer.deg[o]] = node
            layer.deg[o] += 1

    def build(self) -> Graph:
        """Inserts nodes in growing batches, the entry point first."""
        n = len(self.ids)
        if not n:
            return self
        rest = np.delete(np.arange(n), self.entry)
        self.done[self.entry] = True
        at, ready = 0, 1
        while at < len(rest):
            batch = rest[at:at + max(1, min(ready, 256, self._side()))]
            q = self.unit[batch]
            start = np.full((len(batch), 1), self.entry, np.int64)
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            for k in range(len(self.layers) - 1, -1, -1):
                layer = self.layers[k]
                ids, sims = self.search(layer, q, start, BUILD_BEAM if k == 0 else 12)
                here = layer.row[batch] >= 0
                for i in np.flatnonzero(here):
                    ok = sims[i] > -np.inf
                    # those of the batch that are in already
                    mates = np.flatnonzero(here[:i])
                    if len(mates) > 16:
                        mates = mates[np.argpartition(-own[i, mates], 16)[:16]]
                    cand = np.concatenate([ids[i][ok], batch[mates]])
                    self.connect(layer, int(batch[i]), cand, np.concatenate([sims[i][ok], own[i, mates]]))
                start = self._good(ids, sims)
            self.done[batch] = True
            at += len(batch)
            ready += len(batch)
        return self

    def _side(self) -> int:
        """Queries side by side, so that their marks take 16 MB at most."""
        return max(8, min(256, (8 << 20) // max(len(self.ids), 1)))

    def scan(self, q: np.ndarray, floor: float):
        """(query, node) of every pair over `floor`, by products in blocks."""
        a, b = [], []
        step = max(1, (4 << 20) // max(len(q), 1))
        for at in range(0, len(self.ids), step):
            x, y = np.nonzero(q @ self.unit[at:at + step].T >= floor)
            a.append(x)
            b.append(y + at)
        return np.concatenate(a or [np.zeros(0, int)]), np.concatenate(b or [np.zeros(0, int)])

    def links(self, raw: np.ndarray, twin: np.ndarray, threshold: float, beam: int | None = None):
        """For blocks of queries: bounds and (query, node) of every link found but
        the one with the query's equal, verified in double precision.  All of a
        query's links come at once; scanned queries come apart, a few at a time."""
        norm = np.sqrt((raw * raw).sum(1))
        unit = (raw / norm[:, None]).astype(np.float32)
        floor, side = np.float32(threshold - 1e-4), self._side()
        few = max(1, SCAN_PAIRS // max(len(self.ids), 1))

        def verified(x, y):
            other = y != twin[x]
            x, y = x[other], y[other]
            keep = np.zeros(len(x), bool)
            for k in range(0, len(x), VERIFY_PAIRS):
                s = slice(k, k + VERIFY_PAIRS)
                cos = np.einsum("nd,nd->n", raw[x[s]], self.raw[y[s]]) / (norm[x[s]] * self.norm[y[s]])
                keep[s] = cos >= threshold
            return x[keep], y[keep]

        for at in range(0, len(raw), side):
            end = min(at + side, len(raw))
            todo, found = np.arange(at, end), []
            ef = beam or self.beam
            while len(todo) and ef <= WIDEST_BEAM and ef < len(self.ids):
                q = unit[todo]
                got, sims = self.search(self.layers[0], q, self.descend(q, 0, ef), ef)
                hit = sims >= floor
                full = hit.sum(1) >= ef // 2
                x, y = np.nonzero(hit & ~full[:, None])
                found.append((todo[x], got[x, y]))
                todo, ef = todo[full], ef * 4
            if found:
                yield at, end, *verified(*(np.concatenate([f[i] for f in found]).astype(int) for i in (0, 1)))
            for k in range(0, len(todo), few):
                x, y = self.scan(unit[todo[k:k + few]], floor)
                yield at, end, *verified(todo[k + x], y)

    def linked(self, raw: np.ndarray, twin: np.ndarray, threshold: float, beam: int | None = None) -> np.ndarray:
        """Number of nodes that each query links with, its equal left out."""
        out = np.zeros(len(raw), int)
        for at, end, x, _ in self.links(raw, twin, threshold, beam):
            out[at:end] += np.bincount(x - at, minlength=end - at)
        return out

    def probes(self, salt: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Nodes in an order by hash, and for each a vector that links with it at
        a cosine just above the threshold, in a direction given by its id."""
        key = mix64(self.ids.view(np.uint64) ^ mix64(np.array([salt], np.int64).view(np.uint64)))
        nodes = np.argsort(key, kind="stable")[:AUDIT]
        dim = self.raw.shape[1]
        cells = mix64(key[nodes, None] + np.arange(1, dim + 1, dtype=np.uint64)[None])
        away = (cells >> np.uint64(11)).astype(float) / 2.0 ** 53 - 0.5
        own = self.raw[nodes] / self.norm[nodes, None]
        away -= (away * own).sum(1, keepdims=True) * own
        size = np.sqrt((away * away).sum(1, keepdims=True))
        cos = threshold + (1 - threshold) * INSIDE
        return nodes, own * cos + np.where(size > 1e-9, away / np.maximum(size, 1e-9), 0.0) * np.sqrt(1 - cos * cos)

    def audit(self, ids: np.ndarray, raw: np.ndarray, twin: np.ndarray, threshold: float) -> tuple[float, int]:
        """Widens the beam until the search finds nearly all links of the probes,
        and of those queries, AUDIT in an order by hash, that have any: the lowest
        mean recall among probes, queries with few links, and queries in crowds."""
        if not len(ids) or not len(self.ids):
            return 1.0, self.beam
        nodes, turned = self.probes(int(ids.min()), threshold)
        pick = np.argsort(mix64(ids.view(np.uint64)), kind="stable")[:AUDIT]
        want = self.linked(raw[pick], twin[pick], threshold, SCAN)
        pick, want = pick[want > 0], want[want > 0]
        crowd = want > WIDEST_BEAM // 2
        strata = [np.flatnonzero(~crowd), np.flatnonzero(crowd)]
        while True:
            hit = sum(int((y == nodes[x]).sum())
                      for _, _, x, y in self.links(turned, np.full(len(nodes), -1), threshold))
            recall = min([hit / len(nodes)] + [
                float((self.linked(raw[pick[i]], twin[pick[i]], threshold) / want[i]).mean())
                for i in strata if len(i)])
            if recall >= AUDIT_RECALL or self.beam > WIDEST_BEAM or self.beam >= len(self.ids):
                return recall, self.beam
            self.beam *= 2

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        short = self.raw.astype(np.float32)
        arrays = {"ids": self.ids, "raw": short if (short == self.raw).all() else self.raw, "mult": self.mult, "beam": np.array(self.beam),
                  "comp": self.comp}
        for k, x in enumerate(self.layers):
            arrays |= {f"nodes{k}": x.nodes, f"nbr{k}": x.nbr}
        np.savez(out, **arrays)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Graph:
        z = np.load(io.BytesIO(data))
        g = Graph(z["ids"], z["raw"].astype(float), z["mult"])
        for k, x in enumerate(g.layers):
            x.nbr = z[f"nbr{k}"]
        g.beam, g.comp = int(z["beam"]), z["comp"]
        return g


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable, by passing minima along links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


FOUND = "vec_id bigint, n_links bigint, root bigint"


def _fold(rows: pd.DataFrame):
    """(id and node of each row, smallest id and vector of each node): equal
    vectors are one node, nodes in the order of their ids."""
    rows = rows.sort_values("vec_id", kind="stable")
    ids, raw = rows["vec_id"].to_numpy(np.int64), np.stack(rows["embedding"].to_numpy()).astype(float) + 0.0
    at = {}
    node = np.array([at.setdefault(v.tobytes(), len(at)) for v in raw])
    first = np.unique(node, return_index=True)[1]
    one = np.unique(np.stack([ids, node]), axis=1)
    return one[0], one[1], ids[first], raw[first]


def _found(ids: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Numbers of links (root null) and edges to roots."""
    some, edge = n > 0, a != b
    return pd.DataFrame({
        "vec_id": pd.array(np.concatenate([ids[some], a[edge]]), "Int64"),
        "n_links": pd.array(np.concatenate([n[some], np.zeros(int(edge.sum()), np.int64)]), "Int64"),
        "root": pd.array([None] * int(some.sum()) + b[edge].tolist(), "Int64")})


def _report(key, head: dict, found: pd.DataFrame) -> pd.DataFrame:
    out = pd.concat([pd.DataFrame({k: [v] for k, v in head.items()}), found], ignore_index=True)
    out["dim"], out["shard"] = int(key[0]), int(key[1])
    for c in ("vec_id", "n_links", "root", "beam"):
        out[c] = out[c].astype("Int64")
    return out[["dim", "shard", *head, "vec_id", "n_links", "root"]]


def _build(threshold: float):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        ids, node, rep, raw = _fold(rows)
        g = Graph(rep, raw, np.bincount(node)).build()
        n, twin = len(rep), np.arange(len(rep))
        recall, beam = g.audit(rep, raw, twin, threshold)
        links, label = g.mult - 1, np.arange(n)
        # rows of an id with several vectors do not link with each other
        lost = np.zeros(len(ids), np.int64)
        low, high = np.searchsorted(ids, ids, "left"), np.searchsorted(ids, ids, "right")
        several = np.flatnonzero(high - low > 1)
        for at, end, x, y in g.links(raw, twin, threshold):
            links[at:end] += np.bincount(x - at, weights=g.mult[y], minlength=end - at).astype(np.int64)
            a, b = label[x], label[y]
            if (a != b).any():
                label = local_components(n, a[a != b], b[a != b])[label]
            own = several[(node[several] >= at) & (node[several] < end)]
            if len(own):
                hit = np.zeros((end - at, n), bool)
                hit[x - at, y] = True
                for r in own:
                    lost[r] += hit[node[r] - at, node[low[r]:high[r]]].sum()
        g.comp = rep[label]
        return _report(key, {"graph": g.to_bytes(), "recall": recall, "beam": beam},
                       _found(ids, links[node] - lost, ids, g.comp[node]))
    return run


def _query(threshold: float):
    def run(key, rows: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(graph):
            return pd.DataFrame({"dim": [], "shard": [], "recall": [], "beam": pd.array([], "Int64"),
                                 "vec_id": pd.array([], "Int64"), "n_links": pd.array([], "Int64"),
                                 "root": pd.array([], "Int64")})
        g = Graph.from_bytes(graph["graph"].iloc[0])
        ids, node, rep, raw = _fold(rows)
        at = {v.tobytes(): i for i, v in enumerate(g.raw)}
        twin = np.array([at.get(v.tobytes(), -1) for v in raw])
        recall, beam = g.audit(rep, raw, twin, threshold)
        links = np.where(twin >= 0, g.mult[twin], 0)
        roots, of = np.unique(g.comp, return_inverse=True)
        same = np.flatnonzero(twin >= 0)
        a, b = [rep[same]], [g.comp[twin[same]]]
        for at, end, x, y in g.links(raw, twin, threshold):
            links[at:end] += np.bincount(x - at, weights=g.mult[y], minlength=end - at).astype(np.int64)
            touched = np.unique((x - at) * len(roots) + of[y])
            a.append(rep[at + touched // len(roots)])
            b.append(roots[touched % len(roots)])
        # copies hang on their smallest id, which has the edges
        some = links[node] > 0
        return _report(key, {"recall": recall, "beam": beam}, _found(
            ids, links[node], np.concatenate([*a, ids[some]]), np.concatenate([*b, rep[node[some]]])))
    return run


def _build_apart(threshold: float, folder: str):
    """`_build`, with the graph in a file of its own and the file's name in its row."""
    build = _build(threshold)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = build(key, rows)
        name = f"{folder}/{uuid.uuid4().hex}.npz"
        store, path = _store(name)
        with store.open_output_stream(path, compression=None) as f:
            f.write(out["graph"].iloc[0])
        out["graph"] = [name, *[None] * (len(out) - 1)]
        return out
    return run


def _query_all(threshold: float):
    """`_query` of one block of vectors on one graph after the other, but of no
    vector on its own shard, from (shard, graph) with the graphs' file names."""
    query = _query(threshold)

    def run(key, rows: pd.DataFrame, graphs: pd.DataFrame) -> pd.DataFrame:
        out = [query((key[0], -1, key[1]), rows[:0], graphs[:0])]
        for shard, name in sorted(zip(graphs["shard"], graphs["graph"], strict=True)):
            others = rows[rows["shard"] != shard]
            if len(others):
                store, path = _store(name)
                with store.open_input_stream(path, compression=None) as f:
                    graph = pd.DataFrame({"graph": [f.read()]})
                out.append(query((key[0], shard, key[1]), others, graph))
        return pd.concat(out[1:] or out, ignore_index=True)
    return run


def link_embeddings(vectors: DataFrame, threshold: float = THRESHOLD,
                    shard_vectors: int = SHARD_VECTORS) -> tuple[DataFrame, DataFrame]:
    """(result, audits) for (vec_id, embedding).  Result: one row per input row
    with vec_id, n_links, component_id and kept.  Audits: beam and recall of
    each shard for its own vectors and for each block of others'.

    Vectors that are null, empty, zero or hold null or non-finite parts link
    with nothing; so do vectors of different lengths.  Equal rows count once;
    rows of one vec_id are one vertex and never link with each other.  A row
    without id has no links and no component, and is kept.  An empty table
    gives no rows; other columns are not read."""
    e = F.col("embedding").cast("array<double>")
    big = F.lit(float("inf"))
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)) & F.exists(e, lambda v: v != 0)
    good = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("embedding")) \
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    # scaled by its largest part, so no square over- or underflows
    scale = F.array_max(F.transform("embedding", F.abs))
    good = good.withColumn("embedding", F.when((scale < 1e-100) | (scale > 1e100), F.transform(
        "embedding", lambda v: v / scale)).otherwise(F.col("embedding"))) \
        .groupBy("vec_id", F.xxhash64("embedding").alias("h")).agg(F.first("embedding").alias("embedding")).drop("h")
    if vectors.schema["embedding"].dataType.simpleString() == "array<float>":  # as they came: none is scaled
        good = good.withColumn("embedding", F.col("embedding").cast("array<float>"))
    good = materialize(good.withColumn("dim", F.size("embedding")))
    n = good.count()
    shards = max(LEAST_SHARDS, -(-n // shard_vectors))
    parts = max(2, -(-n // BLOCK))
    at = good.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    folder = shared_dir(vectors.sparkSession, "graphs", uuid.uuid4().hex)
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    built = materialize(at.groupBy("dim", "shard").applyInPandas(
        _build_apart(threshold, folder), "dim int, shard int, graph string, recall double, beam bigint, " + FOUND))
    graphs = built.where("graph is not null").select("dim", "shard", "graph") \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = at.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int"))
    keys = ["dim", "part"]
    found = queries.groupBy(*keys).cogroup(graphs.groupBy(*keys)).applyInPandas(
        _query_all(threshold), "dim int, shard int, recall double, beam bigint, " + FOUND)
    asked = materialize(found)
    release(good)
    remove(vectors.sparkSession, folder)
    found = asked.where("recall is null").select("vec_id", "n_links", "root") \
        .unionByName(built.where("graph is null").select("vec_id", "n_links", "root"))
    label = components(found.where("root is not null").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    out = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).join(counts, "vec_id", "left") \
        .join(label.withColumnRenamed("vertex", "vec_id"), "vec_id", "left") \
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                F.coalesce("component", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    audits = built.where("graph is not null").select("dim", "shard", "recall", "beam")
    return out, audits.unionByName(asked.where("recall is not null").select("dim", "shard", "recall", "beam"))


__all__ = ["link_embeddings", "Graph"]
