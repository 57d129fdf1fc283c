"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of equal size are numbered 0, 1, ...; slot t asks for the source into
whose interval of cumulative target weights the golden-ratio point of t falls.
The rank of a slot among its source's slots names the block it takes: a source's
documents, in shuffled order and EPOCHS times over, are one long run of words cut
into equal blocks.  A source gets as many slots as its target has blocks, the last
of them cut to the words still due; what the points give beyond that is void, and
ranks that they leave open (sources far smaller than a block) stand at the end.

Ranks and block offsets are running counts.  Both are built in two levels
(counts per chunk, then within a chunk), so no task holds a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
EPOCHS = 2
MIX = 1.5
CHUNK = 1 << 14
#: Golden ratio as an odd multiplier modulo 2**31: exact in 64-bit integers.
GOLDEN = 1327217885


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, mix: float = MIX, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> adds pos, weight, target, upto (running sum of
    targets by pos) and mix_size (sum of targets).

    Weights repeat over the sources by code point, null last.  A source is full
    when the level epochs * size / weight is reached; in order of that level,
    each source sees what the fuller ones leave.  One row per source is read."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.col("pos"), F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("pos", (F.row_number().over(by_name) - 1).cast("bigint")).withColumn("weight", w) \
        .withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    everything = Window.partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(everything) * F.lit(mix))
    level = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("lambda", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after)) \
        .withColumn("full", F.col("cap") <= F.col("lambda") * F.col("weight"))
    # once a source isn't full, none after it is: all share the first such level
    t = t.withColumn("rest", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "lambda")))
                     .over(everything)["lambda"])
    t = t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("rest")))
    run = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("upto", F.sum("target").over(run)).withColumn("mix_size", F.sum("target").over(everything)) \
        .select("source", "source_size", "pos", "weight", "target", "upto", "mix_size")


def schedule(plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(pos, block, words, slot): the blocks taken of each source's run, how many
    words of each, and the place in the mix.  A source's words add up to its
    target, rounded.  `plan`: the table of targets(); sources without a target
    have no slots."""
    spark = plan.sparkSession
    plan = plan.where("target > 0")
    mix_size = plan.agg(F.max("mix_size")).first()[0] or 0.0
    slots = int(round(mix_size / block_words))
    width = 1 << 31
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + slots // 2_000_000)
    t = spark.range(0, slots, 1, tasks).withColumn("chunk", F.floor(F.col("id") / CHUNK))
    point = F.pmod(F.pmod(F.col("id"), F.lit(width)) * F.lit(GOLDEN) + F.lit(width // 2), F.lit(width)) / float(width)
    # cumulative weights as intervals, found by an equi-join on bins of the point
    bins = max(4096, 4 * plan.count())
    by_pos = Window.orderBy("pos")
    ends = plan.withColumn("hi", F.col("upto") / F.col("mix_size"))
    ends = ends.withColumn("lo", F.coalesce(F.lag("hi").over(by_pos), F.lit(0.0))) \
        .withColumn("hi", F.when(F.lead("hi").over(by_pos).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    ends = ends.select("pos", "lo", "hi", F.explode(F.sequence(F.least(F.floor(F.col("lo") * bins), F.lit(bins - 1)),
                                                               F.least(F.floor(F.col("hi") * bins), F.lit(bins - 1)))).alias("bin"))
    t = t.withColumn("u", point).withColumn("bin", F.floor(F.col("u") * bins)) \
        .join(ends, "bin").where("u >= lo and u < hi").select("id", "chunk", "pos")
    counts = materialize(t.groupBy("pos", "chunk").agg(F.count("*").alias("n")))
    before = Window.partitionBy("pos").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    upto = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("pos", "chunk").orderBy("id")
    due = plan.select("pos", F.round("target").cast("bigint").alias("due"))
    due = due.withColumn("quota", F.ceil(F.col("due") / block_words))
    ranked = t.withColumn("r", F.row_number().over(inside) - 1).join(upto, ["pos", "chunk"]).join(due, "pos") \
        .select("pos", (F.col("before") + F.col("r")).alias("block"), "due", "quota", F.col("id").alias("slot")) \
        .where("block < quota")
    given = counts.groupBy("pos").agg(F.sum("n").alias("given"))
    left = due.join(given, "pos", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < quota") \
        .select("pos", F.explode(F.sequence("given", F.col("quota") - 1)).alias("block"), "due", "quota",
                F.lit(slots).cast("bigint").alias("slot"))
    return ranked.unionByName(left).select(
        "pos", "block", F.least(F.lit(block_words), F.col("due") - F.col("block") * block_words).alias("words"), "slot")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """(doc_id, text, source) -> per row: doc_id, source, text_hash, size,
    source_size, target, taken.

    `taken` counts the words that the mix takes of a document, repeats included;
    it never exceeds EPOCHS times its size, and the words taken of a source are
    its target, rounded, whatever its size.  Null and empty texts have size 0 and
    taken 0; a null source is a source (the last one).  Repeated rows are
    documents of their own, told apart by their place in the shuffle.  An empty
    table gives no rows; other columns are not read."""
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       F.xxhash64("text").alias("text_hash"))
    base = materialize(base.withColumn("order", F.xxhash64("doc_id", "text_hash", F.lit(seed)))
                       .withColumn("bucket", F.pmod(F.col("order"), F.lit(1 << 30))))
    rows = base.count()
    buckets = max(16, rows // 2000)
    base = base.withColumn("bucket", F.floor(F.col("bucket") * F.lit(float(buckets)) / float(1 << 30)))
    plan = materialize(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))))
    keyed = base.join(plan.select("source", "source_size", "pos", "target")
                      .withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sums = keyed.groupBy("pos", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("pos").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("pos", "bucket").orderBy("order", "doc_id", "text_hash") \
        .rowsBetween(Window.unboundedPreceding, -1)
    own = keyed.withColumn("r", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["pos", "bucket"]) \
        .withColumn("at", F.col("before") + F.col("r")).drop("r", "before", "bucket", "order")
    own = materialize(own)
    b = F.lit(block_words)
    # a document stands in the run once per epoch; only what the target reaches is cut into blocks
    turns = F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("epoch")
    cut = own.where("size > 0").select("pos", "at", "size", "source_size", "target", turns) \
        .withColumn("lo", F.col("at") + F.col("epoch") * F.col("source_size")) \
        .withColumn("hi", F.least(F.col("lo") + F.col("size"), F.round("target").cast("bigint"))).where("lo < hi") \
        .select("pos", "at", "lo", "hi", F.explode(F.sequence(
            F.floor(F.col("lo") / b), F.floor((F.col("hi") - 1) / b))).alias("block"))
    first = F.col("block") * b
    cut = cut.join(schedule(plan, block_words).withColumnRenamed("words", "held"), ["pos", "block"]).withColumn(
        "words", F.least(F.col("hi"), first + F.col("held")) - F.greatest(F.col("lo"), first))
    taken = cut.groupBy("pos", "at").agg(F.sum("words").alias("got"))
    # (pos, at) names a document that has words: offsets of such rows differ
    left = own.join(taken, ["pos", "at"], "left")
    return left.select("doc_id", "source", "text_hash", "size", "source_size", "target",
                       F.when(F.col("size") > 0, F.coalesce("got", F.lit(0))).otherwise(0).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """The documents of the mix, each as often as it is taken (0, 1 or 2 times,
    its taken words over its size, rounded; documents without words once).
    Columns are those of `docs`.

    A source's run is taken from its start, so one document a source at most is
    taken in part, and the mix of whole documents differs from the targets by
    half of that document at most.  Rows alike in id, source and text are
    interchangeable: the copies of all of them are dealt evenly, rounded.  Null
    and empty texts stay once; an empty table gives no rows."""
    plan = mix(docs, block_words, seed).withColumn(
        "copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int"))
    # rows alike in id, source and text are interchangeable: their copies add up
    plan = plan.groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("h"),
                        F.col("doc_id").alias("d"), F.col("source").alias("s"))
    got = keyed.join(plan.select(F.col("doc_id").alias("pd"), F.col("source").alias("ps"),
                                 F.col("text_hash").alias("ph"), "copies", "rows"),
                     F.col("d").eqNullSafe(F.col("pd")) & F.col("s").eqNullSafe(F.col("ps"))
                     & (F.col("h") == F.col("ph")))
    per_row = F.floor(F.col("copies") / F.col("rows") + 0.5).cast("int")
    return got.select("row", F.explode(F.array_repeat(F.lit(1), per_row)).alias("n")).select("row.*")
