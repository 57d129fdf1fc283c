"""Structured Streaming forms of classify-and-store, daily counts, live KPIs
and the urgent queue.  The per-row operators are the batch ones (stateless
projections); state lives only in the aggregations, bounded by a watermark
where the key is time.  Checkpoints go under the shared checkpoint folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vocspark import schema as sc
from vocspark.operators.enrich import enrich_feedback
from vocspark.operators.filters import high_risk
from vocspark.operators.score import score_rules
from vocspark.session import shared_dir
from vocspark.sources import snapshots
from vocspark.sources.ingest import validate_request, with_defaults

EVENT_TIME = "event_time"


def read_feedback_stream(spark: SparkSession, path: str, schema=None,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder, read as a stream with a fixed
    schema; event time as TIMESTAMP (watermarks need it, trap T9)."""
    r = spark.readStream.schema(schema or sc.FEEDBACK_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    d = r.parquet(path)
    return d.withColumn(EVENT_TIME, F.col("created_at").cast("timestamp"))


def _digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:16]


def _checkpoint(spark: SparkSession, name: str, checkpoint: str | None, sink: str) -> str:
    """The checkpoint given, or one of this operator and sink alone."""
    return checkpoint or shared_dir(spark, "streams", f"{name}-{_digest(sink)}")


def stream_classify(stream: DataFrame, out_path: str, rejects_path: str,
                    checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """validate -> clean -> score -> append; rejects to a second sink.  Each
    micro-batch is written by foreachBatch under its own `epoch=` folder (named
    by checkpoint and epoch) in overwrite mode: a batch replayed after a failure
    replaces its own output, and a run with another checkpoint, which counts
    epochs from 0 again, adds to the table."""
    spark = stream.sparkSession
    checkpoint = _checkpoint(spark, "classify", checkpoint, out_path)
    run = _digest(checkpoint)

    def write(batch: DataFrame, epoch: int) -> None:
        # two sinks read the batch: cache it for the two writes (lost blocks
        # are recomputed from the source files, so this survives executor loss)
        batch = batch.persist()
        try:
            valid, rejects = validate_request(batch)
            scored = score_rules(valid).withColumn("confidence", F.round("confidence", 4))
            cols = [f.name for f in sc.FEEDBACK_SCHEMA.fields]
            with_defaults(scored.select(*[c for c in cols if c in scored.columns])) \
                .write.mode("overwrite").partitionBy("date").parquet(f"{out_path}/epoch={run}-{epoch}")
            rejects.write.mode("overwrite").parquet(f"{rejects_path}/epoch={run}-{epoch}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(write) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def daily_counts_stream(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Counts per (day window, sentiment).  State is a row per day and class, so
    none needs to go and late rows count, however late.  A `watermark` frees the
    state of old days, and Spark then drops rows later than that."""
    timed = stream.withWatermark(EVENT_TIME, watermark) if watermark else stream
    return (timed.groupBy(F.window(EVENT_TIME, "1 day"), "sentiment")
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.to_date(F.col("window.start")).alias("date"), "sentiment", "count"))


def stream_daily_counts(stream: DataFrame, out_path: str, checkpoint: str | None = None,
                        watermark: str | None = None, trigger: dict | None = None,
                        late_path: str | None = None) -> StreamingQuery:
    """Update mode: each trigger writes the (day, sentiment) counts it changed
    to its own `run=/epoch=` folder, named by checkpoint and epoch (overwrite, so
    a replayed trigger replaces its rows, and none of another checkpoint's).
    `read_daily_counts` gives the current count per key.

    With a `watermark` and a `late_path`, no row goes: those whose day was closed
    by the watermark before their trigger, and those without a time, are stored
    under `late_path`, and counts and late rows add up to the input."""
    spark = stream.sparkSession
    checkpoint = _checkpoint(spark, "daily", checkpoint, out_path)
    run = _digest(checkpoint)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/run=r{run}/epoch={epoch}")

    def write_apart(batch: DataFrame, epoch: int) -> None:
        # several passes over the batch; lost blocks are read from the source again
        batch = batch.persist()
        try:
            closed = _watermark(spark, out_path, run, epoch, batch, watermark)
            late = F.col(EVENT_TIME).isNull() | F.coalesce(
                F.date_trunc("day", EVENT_TIME) + F.expr("INTERVAL 1 DAY") <= F.lit(closed), F.lit(False))
            batch.where(late).write.mode("overwrite").parquet(f"{late_path}/epoch={run}-{epoch}")
            added = batch.where(~late).groupBy(F.to_date(EVENT_TIME).alias("date"), "sentiment") \
                .agg(F.count(F.lit(1)).alias("added"))
            write(_with_earlier(spark, out_path, run, epoch, added), epoch)
        finally:
            batch.unpersist()

    if late_path is not None and watermark is None:
        raise ValueError("rows are late by a watermark: give one with late_path")
    split = late_path is not None
    return ((stream if split else daily_counts_stream(stream, watermark)).writeStream
            .outputMode("append" if split else "update")
            .foreachBatch(write_apart if split else write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _watermark(spark: SparkSession, out_path: str, run: str, epoch: int, batch: DataFrame, delay: str):
    """The time up to which days are closed for this trigger: the latest event
    of all triggers before it, less the delay (null in the first one).  The
    latest event so far is written under the epoch, so a replay finds the same."""
    marks = f"{out_path}/_latest/run=r{run}"
    seen = snapshots.if_there(lambda: spark.read.schema("latest timestamp").json(f"{marks}/epoch={epoch - 1}"))
    before = seen.agg(F.max("latest")).first()[0] if seen is not None else None
    latest = batch.agg(F.greatest(F.max(EVENT_TIME), F.lit(before).cast("timestamp")).alias("latest"))
    latest.coalesce(1).write.mode("overwrite").json(f"{marks}/epoch={epoch}")
    if before is None:
        return None
    return spark.range(1).select(F.lit(before).cast("timestamp") - F.expr(f"INTERVAL '{delay}'")).first()[0]


LOG = "date date, sentiment string, count long, run string, epoch long"


def _daily_log(spark: SparkSession, out_path: str) -> DataFrame:
    """Rows (run, epoch, date, sentiment, count): the base that compaction made
    and the epochs still in folders.  A row in both does no harm."""
    names = ("run", "epoch", "date", "sentiment", "count")
    log = snapshots.if_there(lambda: spark.read.schema(LOG).parquet(out_path))
    base = snapshots.read_published(spark, f"{out_path}/_base", LOG)
    parts = [d.select(*names) for d in (log, base) if d is not None]
    if not parts:
        return spark.createDataFrame([], LOG).select(*names)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _latest(log: DataFrame) -> DataFrame:
    """Of each run and key the row of the last epoch (aggregated before the shuffle)."""
    return log.groupBy("run", "date", "sentiment").agg(
        F.max_by("count", "epoch").alias("count"), F.max("epoch").alias("epoch"))


def _with_earlier(spark: SparkSession, out_path: str, run: str, epoch: int, added: DataFrame) -> DataFrame:
    """Counts of the keys that a trigger changes, with those of the triggers before."""
    log = _daily_log(spark, out_path).where((F.col("run") == f"r{run}") & (F.col("epoch") < epoch))
    had = _latest(log).select(F.col("date").alias("d"), F.col("sentiment").alias("s"), F.col("count").alias("had"))
    same = F.col("date").eqNullSafe(F.col("d")) & F.col("sentiment").eqNullSafe(F.col("s"))
    return added.join(had, same, "left").select(
        "date", "sentiment", (F.col("added") + F.coalesce("had", F.lit(0))).alias("count"))


def read_daily_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """Current count per (date, sentiment): of each run the row of the latest
    epoch that changed the key, added over runs."""
    latest = _latest(_daily_log(spark, out_path))
    return latest.groupBy("date", "sentiment").agg(F.sum("count").alias("count"))


def compact_daily_counts(spark: SparkSession, out_path: str) -> int:
    """Merges the epochs of each run but its last one, which may still be being
    written, into the base table, and deletes their folders; gives how many.

    The base keeps a row per run and key with the epoch it comes from, so what is
    read is the same before, during and after: until the base is published it is
    not read, and a folder not yet deleted, or written again by a replay, holds
    nothing newer than the base.  Afterwards a read lists one folder a run."""
    epochs = snapshots.if_there(
        lambda: spark.read.schema(LOG).parquet(out_path).select("run", "epoch").distinct())
    if epochs is None:
        return 0
    known = epochs.collect()  # names of folders since the last compaction
    last: dict[str, int] = {}
    for e in known:
        last[e["run"]] = max(last.get(e["run"], -1), e["epoch"])
    done = [(e["run"], e["epoch"]) for e in known if e["epoch"] < last[e["run"]]]
    if not done:
        return 0
    ends = spark.createDataFrame(list(last.items()), "run string, last long")
    closed = _daily_log(spark, out_path).join(F.broadcast(ends), "run", "left") \
        .where(F.col("last").isNull() | (F.col("epoch") < F.col("last")))
    snapshots.publish(_latest(closed), f"{out_path}/_base")
    snapshots.delete_folders(spark, [f"{out_path}/run={run}/epoch={epoch}" for run, epoch in done])
    return len(done)


def stream_kpis(stream: DataFrame, table_path: str, checkpoint: str | None = None,
                trigger: dict | None = None) -> StreamingQuery:
    """Running class counts (complete mode: three rows of state), published as a
    new version of a small table on every trigger; `read_kpis` reads the last
    complete one."""
    spark = stream.sparkSession
    counts = stream.groupBy("sentiment").agg(F.count(F.lit(1)).alias("count"))

    def write(batch: DataFrame, epoch: int) -> None:
        snapshots.publish(batch.coalesce(1), table_path)

    return (counts.writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", _checkpoint(spark, "kpis", checkpoint, table_path))
            .trigger(**(trigger or {"availableNow": True})).start())


def read_kpis(spark: SparkSession, table_path: str) -> DataFrame:
    """Class counts of the last complete trigger; no rows before the first."""
    rows = snapshots.read_published(spark, table_path, "sentiment string, count long")
    return rows if rows is not None else spark.createDataFrame([], "sentiment string, count long")


def stream_urgent(stream: DataFrame, out_path: str, checkpoint: str | None = None,
                  trigger: dict | None = None) -> StreamingQuery:
    """Enrich each arriving item; append the High-risk ones."""
    spark = stream.sparkSession
    urgent = high_risk(enrich_feedback(stream)).drop(EVENT_TIME)
    return (urgent.writeStream.outputMode("append").format("parquet")
            .option("path", out_path)
            .option("checkpointLocation", _checkpoint(spark, "urgent", checkpoint, out_path))
            .trigger(**(trigger or {"availableNow": True})).start())
