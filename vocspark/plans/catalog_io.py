"""Round-trip queries for file sources and sinks: rows derived from the
supplied tables are written under the shared folder and read back through
the library's readers (A1, A3, A6-A8, A15, A16, B27)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vocspark.functions import labels as lb
from vocspark.operators import filters as fl
from vocspark.plans import sql as S
from vocspark.plans.registry import query
from vocspark.session import shared_dir
from vocspark.sources import fixture as fx
from vocspark.sources import ingest as ing

TSF = "'%Y-%m-%d %H:%M:%S.%f'"


def _fresh(spark, name):
    return shared_dir(spark, "io", f"{name}-{uuid.uuid4().hex}")


@query("append_and_read", "A3+A1", S.with_(S.FEEDBACK) + f"""SELECT id, text, sentiment,
  round(confidence, 4) AS confidence, coalesce(source, 'api') AS source,
  strftime(created_at, {TSF}) AS created_at, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date
FROM feedback""")
def q_append(spark, sf):
    path = _fresh(spark, "store")
    ing.append_feedback(fx.feedback(spark, sf), path)
    return ing.read_feedback(spark, path)


@query("txt_items", "A6", S.with_(S.FEEDBACK) + f"""SELECT t AS text FROM (
  SELECT {S.ws_trim_sql('text')} AS t FROM feedback) WHERE length(t) > 0""")
def q_txt(spark, sf):
    path = _fresh(spark, "txt")
    fx.feedback(spark, sf).select("text").write.text(path)
    return ing.read_txt_items(spark, path)


@query("export_and_read_csv", "A15+A7", S.with_(S.FEEDBACK)
       + "SELECT CAST(id AS VARCHAR) AS id, text, sentiment, source FROM feedback")
def q_csv(spark, sf):
    path = _fresh(spark, "csv")
    d = fx.feedback(spark, sf).select("id", "text", "sentiment", "source",
                                      F.to_date("created_at").alias("date"))
    ing.export_csv(d, path)
    return ing.read_csv_items(spark, path)


@query("csv_multiline_upload", "A7+A9", S.with_(S.FEEDBACK) + """SELECT CAST(id AS VARCHAR) AS id,
  CASE WHEN id % 3 = 0 THEN text || chr(10) || '"quoted", line ' || id || chr(10) || text
       WHEN id % 5 = 0 THEN 'caf' || text ELSE text END AS text, channel FROM feedback""")
def q_csv_multiline(spark, sf):
    """Fixture rows written as an upload with a dotted header, line breaks and
    quotes inside fields and a malformed byte, read back."""
    path = _fresh(spark, "multiline")
    i, quote = F.col("id"), F.lit('"')
    broken = F.unhex(F.lit("636166E9")).cast("string")  # Latin-1 text: its last byte is not UTF-8
    text = F.when(i % 3 == 0, F.concat("text", F.lit('\n"quoted", line '), i.cast("string"), F.lit("\n"), "text")) \
        .when(i % 5 == 0, F.concat(broken, F.col("text"))).otherwise(F.col("text"))
    record = F.concat(i.cast("string"), F.lit(","), quote, F.replace(text, quote, F.lit('""')), quote, F.lit(","),
                      "channel")
    fb = fx.feedback(spark, sf)
    spark.createDataFrame([("No.,Said.,From",)], "value string").coalesce(1).write.text(f"{path}/00-header")
    fb.select(record.alias("value")).write.text(f"{path}/body")
    up = ing.read_csv_items(spark, f"{path}/*")
    return up.select(F.col("`No.`").alias("id"), F.col("`Said.`").alias("text"), F.col("From").alias("channel"))


HEADER = "Text, Sentiment, Source, Date/Time, User ID, Location, Confidence Score"


@query("wrapped_csv_upload", "A8+A9+A10+A11", S.with_(S.FEEDBACK) + f"""SELECT t AS text,
  strftime(date_trunc('second', created_at), {TSF}) AS created_at, channel, segment FROM (
  SELECT *, trim({S.ws_trim_sql('text')}, '"') AS t FROM feedback)
WHERE length(t) > 0 AND lower(t) <> 'nan' AND text NOT IN (
  '', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND',
  '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')""")
def q_wrapped(spark, sf):
    """Fixture rows written as an upload whose every line wraps one CSV
    record in quotes (header file first), then parsed back."""
    path = _fresh(spark, "wrapped")
    fb = fx.feedback(spark, sf)
    rec = F.concat_ws(", ", F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"')),
                      "sentiment", "channel", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"),
                      F.concat(F.lit("user"), F.col("id").cast("string")), "segment",
                      F.col("confidence").cast("string"))
    line = F.concat(F.lit('"'), F.replace(rec, F.lit('"'), F.lit('""')), F.lit('"'))
    spark.createDataFrame([(f'"{HEADER}"',)], "value string").coalesce(1) \
        .write.text(f"{path}/00-header")
    fb.select(line.alias("value")).write.text(f"{path}/body")
    up = ing.extract_feedback(spark, f"{path}/*")
    return up.select("text", "created_at", "channel", "segment")


@query("wrapped_csv_training", "A8+B22", S.with_(S.FEEDBACK) + f"""SELECT trim({S.ws_trim_sql('text')}, '"') AS text,
  CAST(CASE sentiment WHEN 'Negative' THEN 0 WHEN 'Neutral' THEN 1 ELSE 2 END AS INTEGER) AS label
FROM feedback WHERE id % 9 <> 0""")
def q_wrapped_training(spark, sf):
    """The training form of the wrapped file: label spellings vary, and every
    ninth record has a label that is no class."""
    path = _fresh(spark, "wrapped-training")
    fb = fx.feedback(spark, sf)
    label = F.when(F.col("id") % 9 == 0, "Maybe").when(F.col("id") % 2 == 0, F.upper("sentiment")) \
        .otherwise(F.concat(F.lit(" "), F.lower("sentiment")))
    rec = F.concat_ws(", ", F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"')), label, "channel")
    line = F.concat(F.lit('"'), F.replace(rec, F.lit('"'), F.lit('""')), F.lit('"'))
    spark.createDataFrame([(f'"{HEADER}"',)], "value string").coalesce(1).write.text(f"{path}/00-header")
    fb.select(line.alias("value")).write.text(f"{path}/body")
    return ing.wrapped_csv_corpus(spark, f"{path}/*")


@query("read_labelled_corpus", "A16", """WITH c AS (SELECT d.text, l.quality FROM documents d
  JOIN labels l USING (doc_id))
SELECT text, CAST(CASE WHEN quality = 0 THEN 0 ELSE 2 END AS INTEGER) AS label FROM c""")
def q_corpus(spark, sf):
    docs = fx.documents(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return ing.read_labelled_corpus(docs.select("text", lb.binary_to_label("quality").alias("label")))


@query("project_available", "B27", S.with_(S.FEEDBACK)
       + "SELECT text, sentiment, confidence, channel, segment FROM feedback")
def q_project(spark, sf):
    wanted = ("text", "sentiment", "confidence", "driver", "emotion", "channel", "segment")
    return fl.project_available(fx.feedback(spark, sf), wanted)


CUT = f"TIMESTAMP '{fx.HISTORY_CUTOFF} 00:00:00'"


@query("replace_and_read", "A4+A3+A1", S.with_(S.FEEDBACK) + f"""SELECT id, text, sentiment,
  round(confidence, 4) AS confidence, coalesce(source, 'api') AS source,
  strftime(created_at, {TSF}) AS created_at, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date,
  (SELECT count(*) FROM feedback) AS removed
FROM feedback WHERE created_at >= {CUT}""")
def q_replace(spark, sf):
    """Store the fixture, then replace the table with rows derived from the
    table itself (the items from the cutoff on) and read it back."""
    path = _fresh(spark, "store")
    ing.append_feedback(fx.feedback(spark, sf), path)
    stored = ing.read_feedback(spark, path)
    keep = stored.where(F.col("created_at") >= F.lit(fx.HISTORY_CUTOFF).cast("timestamp_ntz"))
    removed = ing.replace_feedback(spark, keep, path)
    return ing.read_feedback(spark, path).withColumn("removed", F.lit(removed).cast("long"))


@query("bootstrap_and_read", "A5+A15+A3", S.with_(S.FEEDBACK) + f"""SELECT text, sentiment,
  round(confidence, 4) AS confidence, source,
  strftime(date_trunc('second', created_at), {TSF}) AS created_at FROM feedback""")
def q_bootstrap(spark, sf):
    """A CSV snapshot of the fixture (timestamps to the second, as stored
    rows are) loads into a table that does not exist yet."""
    snap = _fresh(spark, "snapshot")
    fb = fx.feedback(spark, sf).select("text", "sentiment", "confidence", "source",
                                       F.date_trunc("second", "created_at").cast("timestamp_ntz")
                                       .alias("created_at"))
    ing.export_csv(fb, snap)
    stored = ing.bootstrap_if_empty(spark, _fresh(spark, "store"), snap)
    return stored.select("text", "sentiment", "confidence", "source", "created_at")


def _metrics_sql() -> str:
    from vocspark.plans.catalog_agg import EVAL_SETS, _report_sql
    return EVAL_SETS.rstrip() + ",\nrep AS (SELECT * FROM (WITH " + _report_sql("ts", "test_set") + """)),
s AS (SELECT arg_min(precision, CASE test_set WHEN 'documents_test' THEN 1 WHEN 'feedback_test' THEN 2 END)
        AS accuracy, CAST(sum(support) AS BIGINT) AS test_size FROM rep WHERE cls = 'accuracy')
SELECT accuracy, """ + S.fmt0_sql("accuracy * CAST(100 AS DOUBLE)") + """ || '%' AS accuracy_label,
  test_size, format('{:,}', test_size) AS test_size_label FROM s"""


@query("metrics_round_trip", "A17+I5", _metrics_sql())
def q_metrics(spark, sf):
    """The evaluation report stored as metric rows (only the older file
    exists, so the reader falls back to it), read back into the landing
    figures."""
    from vocspark.operators import evaluate as ev
    from vocspark.plans.catalog_agg import q_evaluate
    path = _fresh(spark, "metrics")
    ing.write_metrics(q_evaluate(spark, sf), f"{path}/metrics_v1")
    rows = ing.read_metric_rows(spark, [f"{path}/metrics_v2", f"{path}/metrics_v1"])
    return ev.metrics_summary(rows)
