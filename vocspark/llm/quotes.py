"""Quotation linking: replies find the messages that they quote.

A line's quote level is the number of '>' before it.  Following lines of one
level are a passage.  Quoted lines, and the sentences of quoted passages, which
don't depend on where lines break, are normalised, hashed and joined to all earlier
messages of the conversation that have the same line or sentence unquoted; those
of the lowest level linked elect the parent.
Messages without their quotes, in reply order, make the threads.  All of it is
DataFrame functions; keys of the joins include the hash or the turn, so a long
conversation is not one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MARK = r"^[ \t]*(>[> \t]*)"
#: A line that introduces a quotation, dropped with it.
INTRO = r"^\s*On .{1,200} wrote:\s*$"
CHUNK_BITS = 8


def level(line: Column) -> Column:
    return F.regexp_count(F.regexp_extract(line, MARK, 1), F.lit(">"))


def normalised(line: Column) -> Column:
    """Without marks, with single spaces, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARK, ""), r"\s+", " ")))


def unquoted(text: Column) -> Column:
    """The text without quoted lines and the lines that introduce them."""
    keep = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(MARK) & ~x.rlike(INTRO))
    return F.trim(F.array_join(keep, "\n"))


def sentences(known: DataFrame) -> DataFrame:
    """(conv_id, turn, level, h, n): sentences of the passages of each level, and
    the number of lines that end in each."""
    ls = F.transform(F.split("text", "\n"), lambda x: F.struct(
        level(x).alias("level"), normalised(x).alias("norm"), x.rlike(INTRO).alias("intro")))
    each = known.select("conv_id", "turn", ls.alias("ls")) \
        .select("conv_id", "turn", "ls", F.explode(F.array_distinct(F.col("ls.level"))).alias("level"))
    # a line ends with \x01, a passage with \x02
    text = F.array_join(F.transform("ls", lambda x: F.when(
        (x["level"] == F.col("level")) & (x["norm"] != "") & ~((x["level"] == 0) & x["intro"]),
        F.concat(F.translate(x["norm"], "\x01\x02", "  "), F.lit("\x01"))).otherwise(F.lit("\x02"))), " ")
    unit = each.select("conv_id", "turn", "level",
                       F.explode(F.split(text, "\\x02|(?<=[.!?]|[.!?]\\x01) ")).alias("u"))
    return unit.select("conv_id", "turn", "level", F.regexp_count("u", F.lit("\x01")).alias("n"),
                       normalised(F.translate("u", "\x01", "")).alias("norm")).where("norm != ''") \
        .select("conv_id", "turn", "level", F.xxhash64("norm").alias("h"), "n")


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per row of (conv_id, turn, role, text): conv_id, turn, role,
    clean_text, n_quoted and n_linked (quoted lines), max_level, parent_turn,
    root_turn, depth and place (position in its thread, from 0, by turn).

    A message quotes only earlier turns; without a linked line it is the root
    of a thread.  A quoted line is linked by itself or with the sentence it ends
    in.  Ties for parent go to more lines, then the later turn.  A null
    text is empty; a message with a null conv_id or turn links with nothing and
    is its own root (place 0).  Rows of one conv_id and turn are one message in
    several rows: they share parent, root and depth, and follow each other in
    place.  Blank lines are never linked.  An empty table gives no rows; other
    columns are not read."""
    m = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role",
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = m.where("conv_id is not null and turn is not null")
    lines = known.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("conv_id", "turn", level(F.col("line")).alias("level"),
                         normalised(F.col("line")).alias("norm"), F.col("line").rlike(INTRO).alias("intro")) \
        .where("norm != '' and not (level = 0 and intro)") \
        .select("conv_id", "turn", "level", F.xxhash64("norm").alias("h"))
    lines = lines.withColumn("n", F.lit(1)).withColumn("line", F.lit(1)) \
        .unionByName(sentences(known).withColumn("line", F.lit(0))) \
        .groupBy("conv_id", "turn", "level", "h").agg(
            F.sum(F.col("n") * F.col("line")).alias("a"), F.sum(F.col("n") * (1 - F.col("line"))).alias("b"))
    said = lines.where("level = 0").select("conv_id", "h", F.col("turn").alias("origin"))
    first = said.groupBy("conv_id", "h").agg(F.min("origin").alias("first"))
    hit = lines.where("level > 0").join(said, ["conv_id", "h"]).where("origin < turn").join(first, ["conv_id", "h"])
    once = (F.col("origin") == F.col("first")).cast("int")
    votes = hit.groupBy("conv_id", "turn", "level", "origin").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"),
        F.sum(F.col("a") * once).alias("once_a"), F.sum(F.col("b") * once).alias("once_b"))
    linked = votes.groupBy("conv_id", "turn", "level").agg(
        F.min(F.struct((-F.greatest("a", "b")).alias("n"), (-F.col("origin")).alias("origin"))).alias("best"),
        F.greatest(F.sum("once_a"), F.sum("once_b")).alias("n")) \
        .groupBy("conv_id", "turn").agg(F.min(F.struct("level", "best")).alias("best"), F.sum("n").alias("n_linked")) \
        .select("conv_id", "turn", (-F.col("best.best.origin")).alias("parent_turn"), "n_linked")
    linked = materialize(linked)
    # roots: every message takes its ancestor's ancestor until that is a root
    up = linked.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("bigint").alias("depth"))
    while True:
        far = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        step = materialize(up.join(far, ["conv_id", "up"], "left").select(
            "conv_id", "turn", F.coalesce("up2", "up").alias("up"),
            (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    marks = F.filter(F.split("text", "\n"), lambda x: x.rlike(MARK))
    levels = F.transform(marks, lambda x: level(x))
    out = m.select("conv_id", "turn", "role", unquoted(F.col("text")).alias("clean_text"),
                   F.size(marks).cast("bigint").alias("n_quoted"),
                   F.coalesce(F.array_max(levels), F.lit(0)).cast("bigint").alias("max_level"))
    out = out.join(linked, ["conv_id", "turn"], "left") \
        .join(up.select("conv_id", "turn", F.col("up").alias("root"), "depth"), ["conv_id", "turn"], "left") \
        .withColumn("root_turn", F.coalesce("root", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    return _placed(out).select(
        "conv_id", "turn", "role", "clean_text", "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "max_level", "parent_turn", "root_turn", "depth", "place")


def _placed(out: DataFrame) -> DataFrame:
    """Position by turn within (conv_id, root_turn), in two levels of counts."""
    out = materialize(out.withColumn("chunk", F.shiftright("turn", CHUNK_BITS)))
    key = ["conv_id", "root_turn"]
    counts = out.where("turn is not null and conv_id is not null").groupBy(*key, "chunk").agg(F.count("*").alias("m"))
    before = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    inside = Window.partitionBy(*key, "chunk").orderBy("turn", F.xxhash64("role", "clean_text"))
    known = F.col("turn").isNotNull() & F.col("conv_id").isNotNull()
    ranked = out.where(known).withColumn("r", F.row_number().over(inside) - 1).join(counts, [*key, "chunk"]) \
        .withColumn("place", (F.col("before") + F.col("r")).cast("bigint")).drop("r", "before")
    return ranked.unionByName(out.where(~known).withColumn("place", F.lit(0).cast("bigint")))


def quoting_mails(conversations: DataFrame) -> DataFrame:
    """Conversations as mail threads that quote: turn t answers turn t-1, every
    third turn t-2; it quotes the first two lines of what it answers, and the
    first line that this one quotes in turn, one level deeper."""
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    answers = F.col("turn") - F.when((F.col("turn") % 3 == 2), 2).otherwise(1)
    heads = c.groupBy("conv_id", "turn").agg(F.min(F.struct(F.col("role"), F.col("text"))).alias("x")) \
        .select("conv_id", "turn", F.col("x.role").alias("role"),
                F.filter(F.slice(F.split("x.text", "\n"), 1, 2), lambda s: F.trim(s) != "").alias("lines"))
    first = heads.select("conv_id", F.col("turn").alias("a"), F.col("role").alias("a_role"), F.col("lines").alias("a_lines"),
                         answers.alias("b"))
    second = heads.select("conv_id", F.col("turn").alias("b"), F.slice("lines", 1, 1).alias("b_lines"))
    c = c.withColumn("a", answers).join(first, ["conv_id", "a"], "left").join(second, ["conv_id", "b"], "left")
    quote = F.concat(
        F.when(F.col("a_lines").isNotNull(), F.array(F.concat(F.lit("On turn "), F.col("a").cast("string"), F.lit(" "),
                                                             F.coalesce("a_role", F.lit("")), F.lit(" wrote:"))))
        .otherwise(F.array().cast("array<string>")),
        F.transform(F.coalesce("b_lines", F.array().cast("array<string>")), lambda s: F.concat(F.lit(">> "), s)),
        F.transform(F.coalesce("a_lines", F.array().cast("array<string>")), lambda s: F.concat(F.lit("> "), s)))
    return c.select("conv_id", "turn", "role", F.array_join(F.concat(quote, F.array("text")), "\n").alias("text"))
