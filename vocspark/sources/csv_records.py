"""CSV with quoted line breaks, read in parallel.

A line can't tell alone whether it begins a record: that depends on all quotes
before it.  Each line is therefore read both ways, as if it began outside and as
if it began inside a quoted field; what it makes of the two is one of four
functions (keep, swap, always outside, always inside).  Prefixes of functions
combine: inside a file split by a window, over the splits by a second window of
one row a split.  So a file of any size is read by as many tasks as it has
splits, whatever its records span."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# places in a record: at a field's start, in a plain field, in a quoted one, after its closing quote
START, PLAIN, QUOTED, CLOSED = range(4)

#: One record a string; an empty field is null like one that is not there, a quoted empty one is ''.
RECORD_OPTIONS = {"escape": '"', "quote": '"', "nullValue": "\u0000", "emptyValue": ""}

# a character no text should hold, to tell apart what was read from what stood there
_MARK, _BAD = "\U0010ffff", "�"


def valid_text(c: Column) -> Column:
    """The text without its malformed UTF-8 bytes; U+FFFD that stood in the text stays."""
    kept = F.replace(F.replace(c, F.lit(_MARK), F.lit(_MARK + "0")), F.lit(_BAD), F.lit(_MARK + "1"))
    dropped = F.replace(F.make_valid_utf8(kept), F.lit(_BAD), F.lit(""))
    back = F.replace(F.replace(dropped, F.lit(_MARK + "1"), F.lit(_BAD)), F.lit(_MARK + "0"), F.lit(_MARK))
    return F.when(F.is_valid_utf8(c), c).otherwise(back)


def _ends_inside(line: Column, start: int) -> Column:
    """1 if a line that begins in place `start` ends inside a quoted field.  A
    quote opens a field only at its start; a doubled one stays inside."""
    def step(state: Column, piece: Column) -> Column:
        # the quote before the piece, then the piece
        quote = F.when(state == START, QUOTED).when(state == QUOTED, CLOSED) \
            .when(state == CLOSED, QUOTED).otherwise(state)
        return after(quote, piece)

    def after(state: Column, piece: Column) -> Column:
        return F.when((state == QUOTED) | (piece == ""), state) \
            .when(piece.endswith(","), START).otherwise(PLAIN)

    pieces = F.split(line, '"', -1)
    first = after(F.lit(start), F.element_at(pieces, 1))
    last = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), first.cast("int"),
                       lambda s, p: step(s, p).cast("int"))
    plain = F.lit(int(start == QUOTED))
    return F.when(F.contains(line, F.lit('"')), (last == QUOTED).cast("int")).otherwise(plain)


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, id, line): `id` rises inside a split, lines end at LF."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"), valid_text(F.col("value")).alias("line"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, n, record): the records of the files under `path`, in the
    order of (file, split, n).  Blank lines between records are passed over; a
    carriage return before a record's end belongs to the line end.  A field left
    open at a file's end makes one record of all that follows."""
    lines = csv_lines(spark, path).withColumns({
        "outside": _ends_inside(F.col("line"), START), "inside": _ends_inside(F.col("line"), QUOTED)})
    is_fixed = F.col("outside") == F.col("inside")
    lines = lines.withColumns({
        "fixed": F.when(is_fixed, F.col("outside")),
        "swap": F.when(F.col("outside") > F.col("inside"), 1).otherwise(0)}).drop("outside", "inside")

    # inside a split: the last line of fixed outcome before, and the swaps since
    before = Window.partitionBy("file", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("swaps", F.sum("swap").over(upto))
    mark = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "swaps"))
    lines = lines.withColumn("last", F.last(mark, ignorenulls=True).over(before)) \
        .withColumn("own", F.coalesce(F.lag("swaps").over(Window.partitionBy("file", "split").orderBy("id")), F.lit(0)))

    # over the splits of a file: one row each
    ends = lines.groupBy("file", "split").agg(
        F.max_by(mark, F.when(F.col("fixed").isNotNull(), F.col("id"))).alias("end"), F.max("swaps").alias("swaps"))
    chain = Window.partitionBy("file").orderBy("split")
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    # swaps of a split after its last fixed line count on; before it they don't matter
    ends = ends.withColumn("total", F.sum("swaps").over(chain))
    anchor = F.when(F.col("end").isNotNull(), F.struct(
        F.col("end.fixed").alias("fixed"), (F.col("total") - F.col("swaps") + F.col("end.swaps")).alias("at")))
    ends = ends.withColumn("from", F.last(anchor, ignorenulls=True).over(earlier)) \
        .withColumn("past", F.coalesce(F.lag("total").over(chain), F.lit(0)))
    came = F.when(F.col("from").isNull(), F.col("past") % 2) \
        .otherwise((F.col("from.fixed") + F.col("past") - F.col("from.at")) % 2)
    starts = ends.select("file", "split", came.alias("came"))

    inside = F.when(F.col("last").isNull(), (F.col("came") + F.col("own")) % 2) \
        .otherwise((F.col("last.fixed") + F.col("own") - F.col("last.swaps")) % 2)
    lines = lines.join(starts, ["file", "split"]).select(
        "file", "split", "id", "line", (1 - inside).cast("long").alias("begins"))

    # a line belongs to the last record that began before it, maybe in an earlier split
    lines = lines.withColumn("n", F.sum("begins").over(upto))
    counts = lines.groupBy("file", "split").agg(F.max("n").alias("n"))
    some = F.when(F.col("n") > 0, F.struct(F.col("split").alias("home"), F.col("n").alias("home_n")))
    homes = counts.select("file", "split", F.last(some, ignorenulls=True).over(earlier).alias("h"))
    whole = lines.join(homes, ["file", "split"]).select(
        "file", F.when(F.col("n") > 0, F.col("split")).otherwise(F.col("h.home")).alias("at"),
        F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("h.home_n")).alias("n"),
        F.struct("split", "id", "line").alias("part"))
    record = F.rtrim(F.array_join(F.transform(F.sort_array("parts"), lambda p: p["line"]), "\n"), F.lit("\r"))
    return whole.groupBy("file", "at", "n").agg(F.collect_list("part").alias("parts")) \
        .select("file", F.col("at").alias("split"), "n", record.alias("record")) \
        .where(F.length(F.btrim("record", F.lit(" \t\r\x0b\x0c"))) > 0)


def column_names(header: str) -> list[str]:
    """Names of a header record: a name that comes again gets a number, one
    that is missing its place."""
    fields = next(csv.reader(io.StringIO(header.removeprefix("﻿")), strict=False), [])
    out: list[str] = []
    for i, name in enumerate(fields):
        name = name or f"Unnamed: {i}"
        k, new = 0, name
        while new in out:
            k += 1
            new = f"{name}.{k}"
        out.append(new)
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column as text: quoted fields may span lines, malformed
    bytes are dropped, empty and missing fields are null, surplus ones are left out.  The
    first record of the first file is the header; further files may begin with
    the same one, which goes there too.  Files without a record give no rows and a column `text`."""
    from vocspark.session import materialize
    records = materialize(csv_records(spark, path))
    first = records.orderBy("file", "split", "n").select("record").first()
    if first is None:
        return spark.createDataFrame([], "text string")
    names = column_names(first["record"])
    ddl = ", ".join(f"c{i} STRING" for i in range(len(names)))
    heads = records.groupBy("file").agg(F.min(F.struct("split", "n", "record")).alias("h")) \
        .where(F.col("h.record") == F.lit(first["record"])).select("file", "h.split", "h.n")
    body = records.join(heads, ["file", "split", "n"], "left_anti")
    parsed = body.select(F.from_csv("record", ddl, RECORD_OPTIONS).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)])
