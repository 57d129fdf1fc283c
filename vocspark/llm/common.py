"""Helpers shared by the operators: table access, hashing, components."""

from __future__ import annotations

import sys
import types

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.session import materialize, shared_dir  # noqa: F401

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id written as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` wrote.  Only for those whose readers
    are all written themselves: a frame still to run must not read them."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            remove(t.sparkSession, folder)


def worker_state() -> dict:
    """A dict that lives as long as the Python worker process, for caches that
    are costly to fill.  Holds nothing a result depends on."""
    name = "_worker_state_of_text_operators"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__.setdefault("state", {})


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply) over uint64 arrays."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Ranges at most, and sampled keys per range.
MOST_RANGES, RANGE_SAMPLE = 50_000, 16


def deal_ranges(weights: DataFrame, size: int, most: int = MOST_RANGES):
    """Cuts keys into ranges of about equal weight: a function that adds the
    column `range` (0 ... n - 1, ascending with k) to a frame with k bigint and
    at double (0 to 1, evenly spread within a key), and n.

    `weights`: (k, w), one row per key, k not null.  A range weighs about `size`,
    or more where that would make over `most` ranges.  A key heavier than a range
    has ranges of its own, dealt by `at`.  The cuts follow from the keys alone:
    keys are sampled by their hash, and heavy ones are all known.  The driver sees
    at most `most` heavy keys and about RANGE_SAMPLE keys a range."""
    spark = weights.sparkSession
    keys, total = weights.agg(F.count("*"), F.sum("w")).first()
    total = total or 0
    n = max(1, min(most, -(-total // size)))
    size = max(1, -(-total // n))
    heavy = {r.k: r.w for r in weights.where(F.col("w") > size).collect()}
    rate = min(1.0, RANGE_SAMPLE * n / max(1, keys))
    light = weights.where(F.col("w") <= size).where(
        F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))).select("k", "w").collect()
    scale = (total - sum(heavy.values())) / max(1, sum(r.w for r in light))
    slots, fill = [[-np.inf, 1]], 0.0
    for k, w in sorted([*heavy.items(), *((r.k, r.w) for r in light)]):
        if k in heavy:
            slots += [[float(k), -(-w // size)], [float(np.nextafter(float(k), np.inf)) if abs(k) >= 1 << 53 else float(k + 1), 1]]
            fill = 0.0
        elif fill and fill + w * scale > size:
            slots.append([float(k), 1])
            fill = w * scale
        else:
            fill += w * scale
    cuts = []  # ids beyond 2**53 may meet in one double: such cuts are one
    for low, parts in slots:
        if cuts and low <= cuts[-1][0]:
            cuts[-1][1] = max(parts, cuts[-1][1])
        else:
            cuts.append([low, parts])
    n = sum(parts for _, parts in cuts)
    firsts = np.cumsum([0, *[parts for _, parts in cuts]])
    plan = spark.createDataFrame([(float(i), int(firsts[i]), int(parts)) for i, (_, parts) in enumerate(cuts)],
                                 "_slot double, _first long, _parts long")

    def add(df: DataFrame) -> DataFrame:
        if n == 1:
            return df.withColumn("range", F.lit(0))
        from pyspark.ml.feature import Bucketizer

        df = df.withColumn("_key", F.col("k").cast("double"))
        if len(cuts) == 1:
            df = df.withColumn("_slot", F.lit(0.0))
        else:
            df = Bucketizer(splits=[low for low, _ in cuts] + [np.inf], inputCol="_key", outputCol="_slot").transform(df)
        part = F.least(F.floor(F.col("at") * F.col("_parts")), F.col("_parts") - 1)
        return df.join(F.broadcast(plan), "_slot").withColumn("range", (F.col("_first") + part).cast("int")) \
            .drop("_slot", "_first", "_parts", "_key")

    return add, n


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (vertex, component): the smallest vertex reachable.

    Rounds of contraction: every vertex points at the smallest id among itself
    and its neighbours, pointers are followed three more steps, and edges move
    to the ids pointed at, until none is left.  The smallest id of a component
    always points at itself, so it is the last one standing.  Each round is
    written to the shared folder, so lineage stays short and a lost executor
    costs one round at most.  Nothing is collected but one emptiness test per
    round.  Null or equal ends are ignored; an empty input gives no rows."""
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .where(F.col("a") < F.col("b")).distinct())
    done = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("v"), F.col("b").alias("n")).unionByName(
            e.select(F.col("b").alias("v"), F.col("a").alias("n")))
        step = both.groupBy("v").agg(F.min("n").alias("n")).select("v", F.least("v", "n").alias("l"))
        step = materialize(step)
        jump = step.select(F.col("v").alias("l"), F.col("l").alias("l2"))
        for _ in range(2):
            step = step.join(jump, "l", "left").select("v", F.coalesce("l2", "l").alias("l"))
        step = materialize(step)
        to = step.select(F.col("v").alias("l"), F.col("l").alias("l2"))
        done = step if done is None else \
            done.join(to, "l", "left").select("v", F.coalesce("l2", "l").alias("l"))
        done = materialize(done)
        e = materialize(
            e.join(step.select(F.col("v").alias("a"), F.col("l").alias("la")), "a")
            .join(step.select(F.col("v").alias("b"), F.col("l").alias("lb")), "b")
            .where(F.col("la") != F.col("lb"))
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    if done is None:
        return e.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return done.select(F.col("v").alias("vertex"), F.col("l").alias("component"))
