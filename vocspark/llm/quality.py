"""Quality classifier: Naive Bayes support vectors.

Indicators of hashed n-grams (bytes in runs of 1 to 4, words, word pairs and
patterns of word repetition) are scaled by the log ratio of their smoothed class
counts; a linear hinge-loss machine is fitted on the scaled unit vectors by dual
coordinate descent, and its margin is mapped to a probability on rows that the
machine did not see."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import blocks, bounded_sample, char_grams, dual_descent, packed, platt, word_grams

BITS = 16
#: Labelled rows of each class that the fit reads at most (about).
MAX_PER_CLASS = 4000


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct feature ids of a whole text."""
    seen = np.zeros(1 << BITS, bool)
    b = (text or "").encode()
    for part in blocks(b, 3):
        for n in range(1, 5):
            seen[char_grams(part, n, BITS)] = True
    words = b.split()
    for at in range(0, len(words), 1 << 18):
        seen[word_grams(words[at:at + (1 << 18) + 3], BITS)] = True
    return np.flatnonzero(seen).astype(np.uint16)


class Model:
    """weights: per feature, the machine's weight times the log ratio;
    square: the squared log ratio, for the unit length."""

    def __init__(self, weights, square, bias, a, b):
        self.weights, self.square, self.bias, self.a, self.b = weights, square, bias, a, b

    def score(self, ids: np.ndarray) -> float:
        length = np.sqrt(self.square[ids].sum())
        margin = self.weights[ids].sum() / length + self.bias if length > 0 else self.bias
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30))))


class Scaled:
    """Rows of indicators as unit vectors of log ratios, made when they are asked
    for: the sample is held as ids only."""

    def __init__(self, rows, ratio):
        self.rows, self.ratio = rows, ratio
        self.length = [max(float(np.sqrt((ratio[x] ** 2).sum())), 1e-12) for x in rows]

    def __len__(self):
        return len(self.rows)

    def __getitem__(self, i):
        if i >= len(self.rows):
            raise IndexError(i)
        return self.rows[i], self.ratio[self.rows[i]] / self.length[i]


def fit_rows(rows: list[np.ndarray], y: np.ndarray, share: float, seed: int = 1) -> Model | None:
    """y: 1 and -1; share: of label 1 among all labelled rows, for calibration.
    None where a class is missing."""
    if not (y > 0).any() or not (y < 0).any():
        return None
    dim = 1 << BITS
    hold = np.random.default_rng(seed).random(len(rows)) < 0.25
    for sign in (1, -1):  # both parts need both classes
        own = np.flatnonzero(y == sign)
        hold[own[0]] = False
        if len(own) > 1:
            hold[own[1]] = True
    counts = {s: np.ones(dim) for s in (1, -1)}
    for x, s, h in zip(rows, y, hold, strict=True):
        if not h:
            counts[int(s)][x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    square = ratio * ratio
    w = dual_descent(Scaled([rows[i] for i in np.flatnonzero(~hold)], ratio), y[~hold].astype(float), dim, c=4.0, seed=seed)
    model = Model((w[:dim] * ratio), square, w[dim], 1.0, 0.0)
    test = np.flatnonzero(hold) if (y[hold] > 0).any() and (y[hold] < 0).any() else np.arange(len(rows))
    margin = np.array([model.weights[rows[i]].sum() / max(np.sqrt(square[rows[i]].sum()), 1e-12) + model.bias
                       for i in test])
    yt = y[test]
    weight = np.where(yt > 0, share / max((yt > 0).sum(), 1), (1 - share) / max((yt < 0).sum(), 1)) * len(yt)
    model.a, model.b = platt(margin, yt, weight)
    return model


def _features(batches):
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), packed([indicators(t.as_py()) for t in part.column(1)])], ["label", "ids"])


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model | None:
    """docs (doc_id, text), labels (doc_id, label 0 or 1; others are ignored).
    Only ids and labels are sampled and broadcast (bounded by 2 * max_per_class);
    texts meet them without a shuffle."""
    labels = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    share = labels.agg(F.avg("label")).first()[0]
    if share is None:
        return None
    picked = bounded_sample(labels, "label", max_per_class, F.xxhash64("doc_id"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "text") \
        .mapInArrow(_features, "label int, ids binary").toArrow()
    order = sorted(zip(rows.column("ids").to_pylist(), rows.column("label").to_pylist(), strict=True))
    del rows
    return fit_rows([np.frombuffer(x, np.uint16) for x, _ in order],
                    np.array([1 if s else -1 for _, s in order]), float(share))


def _scores(model: Model | None):
    def run(batches):
        for b in batches:
            s = [0.5 if model is None else model.score(indicators(t.as_py())) for t in b.column("text")]
            rest = [b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(s, pa.float64())], [*b.schema.names, "score"])
    return run


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds `score` (probability of label 1) from the whole of `text` alone; any
    `score` column that was there is replaced.  Null and empty texts get the
    score of no features; without a model every score is 0.5.  Repeated rows
    are scored alike, an empty table stays empty, other columns pass through."""
    docs = docs.drop("score")
    schema = docs.withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(_scores(model), schema)


def labelled(labels: DataFrame, held: str = "held_out") -> DataFrame:
    """(doc_id, label) of the rows that may be learned from."""
    return labels.where(~F.col(held)).select("doc_id", F.col("quality").cast("int").alias("label"))
