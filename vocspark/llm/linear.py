"""Hashed n-gram features and linear support vector machines."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20


def char_grams(b: bytes, n: int, bits: int) -> np.ndarray:
    """Hashed ids in [0, 2**bits) of the byte n-grams of `b`, one per place."""
    a = np.frombuffer(b, np.uint8).astype(np.uint32)
    m = len(a) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h = (h ^ a[i:i + m]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def blocks(b: bytes, overlap: int):
    """A long text in overlapping blocks, so its arrays stay small."""
    for at in range(0, max(len(b), 1), CHUNK):
        yield b[at:at + CHUNK + overlap]


def word_grams(words: list[bytes], bits: int) -> np.ndarray:
    """Hashed ids of words, of word pairs, and of patterns of repetition: which
    of four neighbouring words equal the one before."""
    if not words:
        return np.zeros(0, np.uint32)
    h = np.array([zlib.crc32(w) for w in words], np.uint32) * np.uint32(0x9E3779B1)
    out = [h]
    if len(h) > 1:
        out.append((h[:-1] * np.uint32(3)) ^ (h[1:] * np.uint32(0x85EBCA6B)))
    if len(h) > 3:
        same = (h[1:] == h[:-1]).astype(np.uint32)
        out.append((same[:-2] * np.uint32(4) + same[1:-1] * np.uint32(2) + same[2:] + np.uint32(1))
                   * np.uint32(0x7FEB352D))
    h = np.concatenate(out)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def dual_descent(rows, y: np.ndarray, dim: int,
                 c: np.ndarray | float = 1.0, epochs: int = 12, seed: int = 1) -> np.ndarray:
    """rows: a sequence of (ids, values).  Weights (bias last) of a hinge-loss machine, by coordinate descent on its
    dual: each step solves one row's multiplier exactly within [0, c]."""
    w, rng = np.zeros(dim + 1), np.random.default_rng(seed)
    alpha, cost = np.zeros(len(rows)), np.broadcast_to(np.asarray(c, float), len(rows))
    q = np.array([v @ v + 1.0 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            g = y[i] * (w[idx] @ val + w[dim]) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[idx] += step * val
                w[dim] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic curve sigmoid(a * margin + b), by Newton steps."""
    a, b = 1.0, 0.0
    target = (y > 0).astype(float)
    n1, n0 = weight[y > 0].sum(), weight[y <= 0].sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        s = weight * p * (1 - p)
        g = np.array([(weight * (p - target) * margin).sum() + 1e-3 * (a - 1), (weight * (p - target)).sum()])
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()],
                      [(s * margin).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        top = np.abs(d).max()
        d *= min(1.0, 2.0 / max(top, 1e-12))
        a, b = a - d[0], b - d[1]
        if top < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def bounded_sample(rows: DataFrame, label: str, bound: int, order: Column) -> DataFrame:
    """About `bound` rows of each label at most, all where there are fewer:
    those whose hash falls under the label's share.  No sort, no window; the
    shares are broadcast: one row per label, of which a model has few."""
    share = rows.groupBy(label).agg(F.least(F.lit(1.0), F.lit(float(bound)) / F.count("*")).alias("share"))
    u = F.pmod(order, F.lit(1 << 20)) / float(1 << 20)
    return rows.join(F.broadcast(share), label).where(u < F.col("share")).drop("share")


def packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())
