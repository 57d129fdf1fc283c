"""Sources and sinks: stored feedback table, uploads (text, CSV, wrapped CSV),
column detection, validation, append/replace, corpora and metrics files."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocspark import lexicon as lx
from vocspark import schema as sc
from vocspark.functions import text as tx
from vocspark.sources import csv_records, snapshots

# A1 / A3 / A4 / A5 -----------------------------------------------------------


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Stored feedback (Parquet, partitioned by date); no schema inference.  A
    table that was replaced is read from its last complete version."""
    return spark.read.schema(STORED_SCHEMA).parquet(_folder(spark, path))


#: The stored table: the feedback columns and the partition column.
STORED_SCHEMA = T.StructType(sc.FEEDBACK_SCHEMA.fields + [T.StructField("date", T.DateType())])


def _folder(spark: SparkSession, path: str) -> str:
    """Where the table's rows are: its current version, or the path itself while
    it was never replaced."""
    return snapshots.current(spark, path)[1] or path


def with_defaults(df: DataFrame, now=None) -> DataFrame:
    """source 'api' when missing, created_at = now to the second, confidence
    rounded to 4 places, and the `date` partition column."""
    now_col = (F.lit(now).cast("timestamp_ntz") if now is not None
               else F.date_trunc("second", F.localtimestamp()).cast("timestamp_ntz"))
    d = df
    if "source" not in d.columns:
        d = d.withColumn("source", F.lit(None).cast("string"))
    if "created_at" not in d.columns:
        d = d.withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    d = d.withColumns({
        "source": F.coalesce(F.col("source"), F.lit(lx.DEFAULT_SOURCE)),
        "created_at": F.coalesce(F.col("created_at").cast("timestamp_ntz"), now_col),
        "confidence": F.round(F.col("confidence").cast("double"), 4),
    })
    return d.withColumn("date", F.to_date("created_at"))


def append_feedback(df: DataFrame, path: str, now=None, rejects_path: str | None = None) -> None:
    """Append rows partitioned by date.  No row is lost: one that breaks the
    table's rules goes, with their names in `failed`, to `rejects_path`; without
    that folder it ends the append and nothing is stored.  Rows are gathered by
    date (AQE splits a hot date), so a date gets few files."""
    rows = with_defaults(df, now)
    cols = [f.name for f in sc.FEEDBACK_SCHEMA.fields] + ["date"]
    failed = failed_rules(_rules_table())
    if rejects_path is not None:
        from vocspark.session import materialize
        checked = materialize(rows.select(*cols, failed.alias("failed")))
        checked.where("failed <> ''").write.mode("append").parquet(rejects_path)
        rows = checked.where("failed = ''")
    else:
        stop = F.raise_error(F.concat(F.lit("rows break the rules of the table: "), failed))
        rows = rows.withColumn("text", F.when(failed == "", F.col("text")).otherwise(stop))
    rows.select(*cols).hint("rebalance", "date").write.mode("append").partitionBy("date") \
        .parquet(_folder(df.sparkSession, path))


_if_there = snapshots.if_there


def replace_feedback(spark: SparkSession, df: DataFrame | None, path: str) -> int:
    """Remove every stored row (and write `df` if given); returns rows removed.
    The new rows are a new version of the table, which readers see when it is
    complete: until then, and if the write ends midway, they read the old one.
    `df` may be derived from the table it replaces."""
    stored = _if_there(lambda: read_feedback(spark, path))
    removed = stored.count() if stored is not None else 0
    new = df if df is not None else spark.createDataFrame([], STORED_SCHEMA)
    new = with_defaults(new) if "date" not in new.columns else new
    snapshots.publish(new.select(*STORED_SCHEMA.fieldNames()).hint("rebalance", "date"), path, ("date",))
    return removed


def bootstrap_if_empty(spark: SparkSession, path: str, snapshot_csv: str) -> DataFrame:
    """When the table is empty (or absent), load a CSV snapshot into it; each of
    its records gets an id of its own, equal records too."""
    stored = _if_there(lambda: read_feedback(spark, path))
    if stored is None or stored.isEmpty():
        snap = read_csv_items(spark, snapshot_csv)
        kinds = {"text": "string", "sentiment": "string", "confidence": "double", "source": "string",
                 "created_at": "timestamp_ntz"}
        given = {c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) for c in snap.columns}
        snap = snap.select(*[given.get(c, F.lit(None)).try_cast(kind).alias(c) for c, kind in kinds.items()])
        append_feedback(snap.withColumn("id", F.monotonically_increasing_id() + 1), path)
    return read_feedback(spark, path)


# A2 ----------------------------------------------------------------------------

def _rules_table() -> list[tuple[str, Column]]:
    """What the stored table itself demands: no limit on lengths."""
    return [
        ("text_missing", F.col("text").isNull()),
        ("sentiment_invalid", ~F.coalesce(F.col("sentiment").isin(*lx.CLASSES), F.lit(False))),
        ("confidence_missing", F.col("confidence").isNull()),
        ("confidence_range", (F.col("confidence") < 0) | (F.col("confidence") > 1)),
        ("created_at_missing", F.col("created_at").isNull()),
    ]


def _rules_stored(columns=("source",)) -> list[tuple[str, Column]]:
    rules = _rules_table() + [
        ("text_empty", F.length(F.col("text")) < 1),
        ("text_too_long", F.length(F.col("text")) > lx.MAX_TEXT_CHARS),
    ]
    if "source" in columns:
        rules.append(("source_too_long", F.length(F.col("source")) > lx.MAX_SOURCE_CHARS))
    return rules


def _rules_request() -> list[tuple[str, Column]]:
    n = F.length(F.col("text"))
    return [
        ("text_missing", F.col("text").isNull()),
        ("text_empty", n < 1),
        ("text_too_long", n > lx.MAX_TEXT_CHARS),
        ("source_too_long", F.length(F.col("source")) > lx.MAX_SOURCE_CHARS),
    ]


def failed_rules(rules) -> Column:
    """Comma-separated names of the rules a row fails ('' when none)."""
    return F.concat_ws(",", *[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules])


def _split(df: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    d = df.withColumn("failed", failed_rules(rules))
    return d.where(F.col("failed") == "").drop("failed"), d.where(F.col("failed") != "")


def validate_feedback(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored-table rules (text and created_at present, sentiment one of the
    three classes, confidence in 0..1) and the single-item limits (text
    1..2000 characters, source <= 50).  Returns (valid, rejects + `failed`)."""
    return _split(df, _rules_stored(df.columns))


def validate_request(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single-item rules: text 1..2000 characters, source <= 50 characters
    (missing source takes the default)."""
    d = df if "source" in df.columns else df.withColumn("source", F.lit(None).cast("string"))
    d = d.withColumn("source", F.coalesce(F.col("source"), F.lit(lx.DEFAULT_SOURCE)))
    return _split(d, _rules_request())


def with_failed_rules(df: DataFrame) -> DataFrame:
    return df.withColumn("failed", failed_rules(_rules_stored(df.columns)))


# A6-A14 -------------------------------------------------------------------------

def read_txt_items(spark: SparkSession, path: str) -> DataFrame:
    """One item per non-blank line, stripped."""
    t = tx.ws_trim(csv_records.valid_text(F.col("value")))
    return spark.read.text(path).select(t.alias("text")).where(F.length("text") > 0)


def read_csv_items(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column as text; quoted fields may span lines and a file
    is read by as many tasks as it has splits (see csv_records); malformed bytes
    are dropped, empty fields are null, an empty file gives no rows."""
    return csv_records.read_csv(spark, path)


def _unwrap(line: Column) -> Column:
    s = tx.ws_trim(line)
    quoted = s.startswith('"') & s.endswith('"') & (F.length(s) >= 2)
    inner = F.replace(F.substring(s, F.lit(2), F.length(s) - 2), F.lit('""'), F.lit('"'))
    return F.when(quoted, inner).otherwise(s)


def _split_header(line: str) -> list[str]:
    import csv
    import io
    return [h.strip() for h in next(csv.reader(io.StringIO(line), skipinitialspace=True))]


def first_line(spark: SparkSession, path: str) -> str:
    """First non-blank line under `path`, files in name order: the header of an
    upload.  Each look takes one line; files of blank lines are passed over."""
    for file in sorted(spark.read.text(path).inputFiles()):
        line = spark.read.text(file).where(F.length(tx.ws_trim("value")) > 0).first()
        if line is not None:
            return line["value"]
    raise ValueError(f"no header line in {path}")


def repair_wrapped_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files where every line is one quoted string holding a whole CSV record:
    drop blank and '""' lines, strip the outer quotes, unescape doubled quotes,
    re-parse each record with leading-space skipping.  Only the header line
    reaches the driver (it names the columns); header lines repeated at the
    top of further files are dropped with it."""
    raw = spark.read.text(path).select(_unwrap(csv_records.valid_text(F.col("value"))).alias("line"))
    raw = raw.where((F.length("line") > 0) & (F.col("line") != '""'))
    header_line = spark.range(1).select(_unwrap(F.lit(first_line(spark, path)))).first()[0]
    names = _split_header(header_line)
    ddl = ", ".join(f"`c{i}` STRING" for i in range(len(names)))
    body = raw.where(F.col("line") != F.lit(header_line))
    parsed = body.select(F.from_csv("line", ddl, CSV_RECORD_OPTIONS).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


# one record per line: "" inside quotes is a quote, spaces after a comma skipped
CSV_RECORD_OPTIONS = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "false",
                      "escape": '"', "quote": '"'}


def is_wrapped(df: DataFrame) -> bool:
    return len(df.columns) == 1 and "," in df.columns[0]


def detect_text_column(df: DataFrame, needles=lx.TEXT_COLUMN_NEEDLES) -> str:
    """First column whose lower-cased name holds a needle; else the column
    with the greatest mean text length (one small aggregate); the first one
    where there are no rows."""
    for c in df.columns:
        if any(k in c.lower() for k in needles):
            return c
    means = df.agg(*[F.avg(F.length(df[f"`{c}`"].cast("string"))).alias(f"m{i}")
                     for i, c in enumerate(df.columns)]).first()
    best = max(range(len(df.columns)), key=lambda i: (means[i] or 0, -i))
    return df.columns[best]


def detect_metadata_columns(df: DataFrame, text_col: str,
                            targets=lx.METADATA_COLUMNS, overrides: dict | None = None) -> dict:
    """target -> source column: the first non-text column whose lower-cased
    name holds one of the target's needles (explicit overrides win)."""
    out = {}
    for target, needles in targets:
        if overrides and target in overrides:
            out[target] = overrides[target]
            continue
        for c in df.columns:
            if c != text_col and any(n in c.lower() for n in needles):
                out[target] = c
                break
    return out


# a fraction of one to six digits and an offset (Z, +02:00) may follow ISO times;
# times with an offset become UTC
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm[:ss][.SSSSSS][XXX]", "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][XXX]",
                     "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd",
                     "MM/dd/yyyy HH:mm[:ss]", "MM/dd/yyyy hh:mm[:ss] a", "MM/dd/yyyy",
                     "yyyy-MM-dd hh:mm[:ss] a", "dd.MM.yyyy HH:mm",
                     "dd.MM.yyyy", "d MMM yyyy", "MMM d, yyyy")


def parse_mixed_timestamp(c, formats=TIMESTAMP_FORMATS) -> Column:
    """Each value parsed on its own by the first matching format; bad -> null."""
    s = tx.ws_trim(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parse_mixed_timestamps(df: DataFrame, c: str = "created_at", min_share: float = 0.5,
                           formats=TIMESTAMP_FORMATS) -> DataFrame:
    """Parse the column; keep it only if at least half the values parsed,
    otherwise drop it (the decision is one small aggregate)."""
    d = df.withColumn(c, parse_mixed_timestamp(c, formats))
    share = d.agg(F.avg(F.col(c).isNotNull().cast("double"))).first()[0]
    return d if share is not None and share >= min_share else d.drop(c)


def drop_blank_items(df: DataFrame, text: str = "text", na_tokens=("nan",)) -> DataFrame:
    """Strip spaces then quotes; drop empty, null and na-token texts."""
    t = F.btrim(tx.ws_trim(F.col(text)), F.lit('"'))
    d = df.withColumn(text, t)
    return d.where(F.col(text).isNotNull() & (F.length(text) > 0)
                   & ~F.lower(F.col(text)).isin(*na_tokens))


def cap_items(df: DataFrame, n: int | None = None, order: str = "row_id") -> DataFrame:
    """The first `n` rows by `order`; all of them unless a limit is asked for."""
    return df if n is None else df.orderBy(order).limit(n)


def items_only(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(text)


def extract_feedback(spark: SparkSession, path: str, overrides: dict | None = None) -> DataFrame:
    """Upload -> (row_id, text [, created_at, channel, segment])."""
    if path.lower().endswith(".txt"):
        d = read_txt_items(spark, path)
        return d.withColumn("row_id", F.monotonically_increasing_id())
    d = read_csv_items(spark, path)
    if is_wrapped(d):
        d = repair_wrapped_csv(spark, path)
    text_col = detect_text_column(d)
    meta = detect_metadata_columns(d, text_col, overrides=overrides)

    def present(c: str) -> Column:
        return F.when(~F.col(f"`{c}`").isin(*sc.NA_TOKENS), F.col(f"`{c}`"))

    cols = [present(text_col).alias("text")]
    cols += [tx.ws_trim(present(src)).alias(target) for target, src in meta.items()]
    out = d.select(*cols).withColumn("row_id", F.monotonically_increasing_id())
    if "created_at" in out.columns:
        out = parse_mixed_timestamps(out, "created_at")
    return drop_blank_items(out, "text")


def export_csv(df: DataFrame, path: str, drop=("date",)) -> None:
    """All result columns as CSV with a header (the derived `date` dropped);
    text is written as is (no trimming), quotes doubled."""
    df.drop(*[c for c in drop if c in df.columns]).write.mode("overwrite") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) \
        .csv(path, header=True, escape='"')


# A16-A18 ------------------------------------------------------------------------

def read_labelled_corpus(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    return df.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))


def wrapped_csv_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Training form of the wrapped sample file: lines shorter than 5 chars
    dropped, records with >= 2 fields, label title-cased and mapped to 0/1/2."""
    from vocspark.functions.labels import parse_text_label
    raw = spark.read.text(path).select(_unwrap(F.col("value")).alias("line"))
    header_line = first_line(spark, path)
    raw = raw.where((F.length(tx.ws_trim("line")) >= 5) & (F.col("line") != _unwrap(F.lit(header_line))))
    parsed = raw.select(F.from_csv("line", "a STRING, b STRING", CSV_RECORD_OPTIONS).alias("r"))
    d = parsed.where(F.col("r.b").isNotNull()).select(
        F.btrim(tx.ws_trim("r.a"), F.lit('"')).alias("text"),
        parse_text_label(F.col("r.b")).alias("label"))
    return d.where(F.col("label").isNotNull() & (F.length("text") > 0))


METRIC_ROWS_SCHEMA = ("test_set string, cls string, precision double, recall double, "
                      "f1 double, support long")


def write_metrics(report: DataFrame, path: str) -> None:
    """Evaluation rows (test_set, cls, precision, recall, f1, support) as JSON
    lines.  A report has classes + 3 rows per test set, so one file is enough."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_metric_rows(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Evaluation rows from the first path that exists (v2, then v1); None
    when there is none.  Only file listing happens on the driver."""
    for p in paths:
        rows = _if_there(lambda: spark.read.schema(METRIC_ROWS_SCHEMA).json(p))
        if rows is not None:
            return rows
    return None


def read_metrics(spark: SparkSession, paths: list[str]) -> dict | None:
    """A nested metrics document (one small JSON file, e.g. a training run's
    summary): the first of `paths` that is there, else None."""
    for p in paths:
        doc = _if_there(lambda: spark.read.text(p, wholetext=True))
        if doc is not None:
            return json.loads(doc.first()[0])
    return None


def _unit_hash(key: Column, seed: int, k: int, hex_digits: int = 8) -> Column:
    """Integer from the first hex digits of md5('key:seed:k'): a standard
    digest, so the seeded values repeat on every run and in every engine."""
    h = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(str(k))))
    return F.conv(F.substring(h, 1, hex_digits), 16, 10).cast("long")


def synthesize_feedback(spark: SparkSession, texts_df: DataFrame, seed: int = 42,
                        max_age_days: int = lx.SEED_MAX_AGE_DAYS, anchor=None,
                        key: str | None = "id") -> DataFrame:
    """Seeded demo rows from given (text, sentiment) rows: confidence uniform
    in 0.72..0.99 at 4 places, age uniform in [0, max_age_days) days to the
    second before the anchor, one of the seed channels.  Each row draws from
    its own `key` (the text when absent), so reruns repeat row for row."""
    anchor = anchor or dt.datetime(2024, 2, 1)
    k = F.col(key) if key and key in texts_df.columns else F.col("text")
    two32 = F.lit(1 << 32)
    lo, hi = lx.SEED_CONFIDENCE
    span = round((hi - lo) * 10000)
    # round(lo + u * (hi - lo), 4) with u = h / 2^32, half-up, in integers
    conf_units = F.lit(round(lo * 10000)) + F.floor((_unit_hash(k, seed, 1) * span + (1 << 31)) / two32)
    conf = conf_units.cast("double") / F.lit(10000.0)
    age = F.floor(_unit_hash(k, seed, 2) * F.lit(max_age_days * 86400) / two32).cast("int")
    sources = lx.SEED_SOURCES
    ch = F.get(tx.str_array(sources), F.pmod(_unit_hash(k, seed, 3), F.lit(len(sources))).cast("int"))
    return texts_df.select(_unit_hash(k, seed, 0, 15).alias("id"), "text", "sentiment",
                           conf.alias("confidence"), ch.alias("source"),
                           (F.lit(anchor).cast("timestamp_ntz") - F.make_dt_interval(secs=age))
                           .alias("created_at"))
