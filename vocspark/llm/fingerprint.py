"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (to the end of a sentence or line, of at most 160
characters), each a 64-bit digest; the distinct digests are its set.  A sketch
has three tables of cells; a digest falls into one cell of each, which keeps the
count, the xor of its digests and the xor of their checks.  Sketches of two
versions subtract cell by cell; what is left is peeled: a cell with one digest
gives it away, and its removal opens other cells.  The first sketch is small;
its counts estimate how much two versions differ, which sets the size of the
sketch that is peeled.  Where peeling sticks, it is done again with tables of
four times the size; the few that stick again are settled on the digests.

All of it is DataFrame functions.  One exchange moves the texts: by ranges of
(doc_id, hash of the text) of about equal size whatever the ids are, each with a
copy of the first document of the next, so that a document meets its successor
there.  The digests are written as a table bucketed by range in the shared folder;
all later grouping and joining is within a bucket, without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import deal_ranges, materialize, release, shared_dir

#: A sentence or line end closes a paragraph; so do 160 characters.
PARAGRAPH = r"[^.!?\n]{1,160}[.!?\n]*|[.!?\n]+"
CELLS = 8
STEPS = 15
#: Documents of a range, about; more where the number of ranges reaches its bound.
RANGE_DOCS = 128
#: Documents of one bucket (about), and buckets at most.
BUCKET_DOCS, MOST_BUCKETS = 2048, 50_000
TABLES = 3
_TABLE_SHIFT, _LOWEST = 24, -(1 << 63)


def paragraph_digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)),
                                        lambda p: F.xxhash64(F.trim(p))))


def _check(key: Column) -> Column:
    return F.hash(key).cast("bigint")


def _place(key: Column, table: int, bits: Column) -> Column:
    """The cell of a digest in one table of 2**bits cells (bits up to 20)."""
    at = F.call_function("shiftrightunsigned", key, F.lit(21 * table)).bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1)
    return at + F.lit(table << _TABLE_SHIFT)


def sketch(keys: Column, cells: int = CELLS) -> Column:
    """The first sketch: TABLES * cells structs (n, keys, checks)."""
    def xors(own):
        start = F.struct(F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("c"))
        return F.aggregate(own, start, lambda a, k: F.struct(
            a["k"].bitwiseXOR(k).alias("k"), a["c"].bitwiseXOR(_check(k)).alias("c")))

    def cell(t, j):
        own = F.filter(keys, lambda k: F.call_function("shiftrightunsigned", k, F.lit(21 * t))
                       .bitwiseAND(F.lit(cells - 1).cast("bigint")) == j)
        return F.struct(F.size(own).cast("bigint").alias("n"), xors(own).alias("x"))

    return F.array(*[cell(t, j) for t in range(TABLES) for j in range(cells)])


def as_text(cells: Column, n: Column, text_hash: Column) -> Column:
    """A sketch as a string: digests, a hash of the whole text, the cells."""
    return F.concat_ws(":", n.cast("string"), F.lower(F.hex(text_hash)), F.array_join(F.transform(
        cells, lambda c: F.concat_ws(".", c["n"].cast("string"), F.lower(F.hex(c["x"]["k"])),
                                     F.lower(F.hex(c["x"]["c"].bitwiseAND(F.lit(0xFFFFFFFF)))))), ","))


def _bits(a: Column, b: Column, na: Column, nb: Column, cells: int = CELLS) -> Column:
    """log2 of the table size to peel the difference of two sketches with: the
    squares of the cells' differing counts estimate how many digests differ."""
    d = F.zip_with(a, b, lambda x, y: (x["n"] - y["n"]) * (x["n"] - y["n"]))
    total = F.aggregate(d, F.lit(0).cast("bigint"), lambda s, x: s + x) / float(TABLES)
    gap = ((na - nb) * (na - nb)).cast("double")
    guess = F.greatest((total - gap / float(cells)) / (1 - 1 / cells), F.abs(na - nb).cast("double"), F.lit(0.0))
    most = F.least(guess * 1.5 + 8, (na + nb).cast("double"))
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(most * 0.65, F.lit(1.0)))), F.lit(3)), F.lit(20)).cast("int")


def _digests(docs: DataFrame, range_docs: int = RANGE_DOCS) -> DataFrame:
    """The table of digests, bucketed by range: rows numbered by rid in order of
    id, each range ending with a copy of the first row of the next (the last
    with the first of all); bits_e and bits_n: table sizes to peel with, and
    before_n the bits_n of the row before."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("k", F.coalesce("doc_id", F.lit(_LOWEST))).withColumn("h", F.xxhash64("text"))
    weights = materialize(base.groupBy("k").agg(F.count("*").alias("w")))
    total = weights.agg(F.sum("w")).first()[0] or 0
    dealt, _ = deal_ranges(weights, range_docs)
    release(weights)
    at = (F.col("h").cast("double") + float(1 << 63)) / float(1 << 64)
    base = dealt(base.withColumn("at", at)).drop("at").withColumn("range", F.col("range").cast("bigint"))
    # one row per range: their number is bounded
    first = base.groupBy("range").agg(F.min(F.struct("k", "h")).alias("f"))
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy()))
    first = materialize(first.select(F.col("f.k").alias("k"), F.col("f.h").alias("h"), before.alias("before")))
    rows = base.join(F.broadcast(first), ["k", "h"], "left").withColumn("keys", paragraph_digests(F.col("text")))
    place = F.when(F.col("before").isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("copy")))).otherwise(
        F.array(F.struct(F.col("range"), F.lit(False).alias("copy")),
                F.struct(F.col("before").alias("range"), F.lit(True).alias("copy"))))
    rows = rows.select("doc_id", "k", "h", "text", "keys", F.inline(place))
    order = Window.partitionBy("range").orderBy("copy", "k", "h")
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "rid": F.row_number().over(order),
                             "again": F.lag("copy").over(order) & F.col("copy")})
    # of first rows that are all alike, one copy is enough
    rows = rows.where(~F.coalesce("again", F.lit(False)))
    rows = rows.withColumn("edited", F.when(~F.col("copy"), F.concat(
        F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))))
    rows = rows.select("range", "rid", "copy", "doc_id", n.cast("bigint").alias("n_chars"), "keys",
                       F.unhex(F.sha2("edited", 256)).alias("edited_sha"), F.xxhash64("text").alias("h"),
                       F.xxhash64("edited").alias("edit_h"), paragraph_digests(F.col("edited")).alias("edit_keys"))
    rows = rows.withColumn("a", sketch(F.col("keys"))).withColumn("b", sketch(F.col("edit_keys")))
    step = Window.partitionBy("range").orderBy("rid")
    size = {c: F.size(c).cast("bigint") for c in ("keys", "edit_keys")}
    rows = rows.withColumn("next_a", F.lead("a").over(step)).withColumn("next_n", F.lead(size["keys"]).over(step))
    rows = rows.withColumn("bits_e", _bits(F.col("a"), F.col("b"), size["keys"], size["edit_keys"])) \
        .withColumn("bits_n", _bits(F.col("a"), F.col("next_a"), size["keys"], F.col("next_n")))
    rows = rows.withColumn("before_n", F.lag("bits_n").over(step)).drop("a", "b", "next_a", "next_n")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, total // BUCKET_DOCS))
    name = f"digests_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "range").sortBy("range", "rid") \
        .option("path", shared_dir(spark, "tables", name)).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and the frame reads them by their buckets
    return found


def _peel(signed: DataFrame, steps: int = STEPS) -> DataFrame:
    """signed: (range, rid, pair, sign, key), pair = 2 * bits + kind.  Gives per
    (range, rid, kind) the number of differing digests recovered and of cells
    left over.  A step empties the pure cells of one table (within a table, a
    digest has one cell, so it is removed once)."""
    keys = ["range", "rid", "pair", "cell"]
    put = [F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("c").alias("c")]
    bits = F.shiftright("pair", 1)
    cells = signed.select("range", "rid", "pair", F.col("sign").alias("n"), "key", _check(F.col("key")).alias("c"),
                          F.explode(F.array(*[_place(F.col("key"), t, bits) for t in range(TABLES)])).alias("cell"))
    cells = cells.groupBy(*keys).agg(*put).where("n != 0 or key != 0 or c != 0")
    zero = F.lit(0).cast("bigint")

    def cell(at, n, key, c):
        return F.struct(at.alias("cell"), n.alias("n"), key.alias("key"), c.alias("c"))

    for step in range(steps):
        t = step % TABLES
        pure = (F.shiftright("cell", _TABLE_SHIFT) == t) & (F.abs("n") == 1) & (_check(F.col("key")) == F.col("c"))
        gone = [cell(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint"), zero, zero)] + [
            cell(_place(F.col("key"), o, bits), -F.col("n"), F.col("key"), F.col("c")) for o in range(TABLES) if o != t]
        same = F.array(cell(F.col("cell"), F.col("n"), F.col("key"), F.col("c")))
        cells = cells.select("range", "rid", "pair", F.inline(F.when(pure, F.array(*gone)).otherwise(same))) \
            .groupBy(*keys).agg(*put).where("n != 0 or key != 0 or c != 0")
    return cells.groupBy("range", "rid", F.col("pair").bitwiseAND(F.lit(1)).alias("kind")).agg(
        F.sum(F.when(F.col("cell") == -1, F.col("n")).otherwise(0)).alias("differ"),
        F.sum(F.when(F.col("cell") == -1, 0).otherwise(1)).alias("stuck"))


def _signed(rows: DataFrame) -> DataFrame:
    """rows: range, rid, keys, edit_keys and sizes bits_e, bits_n, before_n (null:
    not to be peeled) -> one row per digest of either side of a pair.  A row's
    digests are also the second side of the pair of the row before."""
    def side(bits, kind, sign, keys, rid):
        pair = (F.col(bits) * 2 + kind).cast("bigint")
        return F.transform(F.when(F.col(bits).isNull(), F.array().cast("array<bigint>")).otherwise(
            F.coalesce(keys, F.array().cast("array<bigint>"))),
            lambda k: F.struct(rid.alias("rid"), pair.alias("pair"), F.lit(sign).cast("bigint").alias("sign"),
                               k.alias("key")))

    rid = F.col("rid")
    return rows.select("range", F.inline(F.concat(
        side("bits_e", 0, 1, "keys", rid), side("bits_e", 0, -1, "edit_keys", rid),
        side("bits_n", 1, 1, "keys", rid), side("before_n", 1, -1, "keys", rid - 1))))


def _by_range(found: DataFrame, name: str) -> DataFrame:
    """One row per range, so that the join back needs no exchange."""
    return found.groupBy("range").agg(F.map_from_entries(F.collect_list(F.struct(
        (F.col("rid") * 2 + F.col("kind")).cast("bigint").alias("at"), F.struct("differ", "stuck").alias("v")))).alias(name))


def fingerprints(docs: DataFrame, steps: int = STEPS, range_docs: int = RANGE_DOCS) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, differ_edited,
    differ_next (digests recovered) and attempts (the larger count of the two
    pairs; 3: settled on the digests).

    The edited text has its last floor(n_chars/4) code points replaced by the
    first as many (or all) of the next document by doc_id.  Likeness is the
    Jaccard similarity of the digest sets: 1 for equal texts, and for two empty
    ones.  A null text is empty.  Repeated paragraphs count once in a set, while
    a fingerprint also holds a hash of the whole text.  Rows of one doc_id, and
    of a null doc_id (sorted first), follow each other by a hash of the text; where
    they outweigh a range they are cut by that hash, and only rows alike in id and
    text stay together.
    A single document is its own successor; an empty table gives no rows; other
    columns are not read."""
    rows = _digests(docs, range_docs)
    own = ~F.col("copy")
    sizes = ["bits_e", "bits_n", "before_n"]
    slim = rows.select("range", "rid", "keys", "edit_keys", *[
        F.when(own, F.col(c)).alias(c) for c in sizes[:2]], "before_n")
    one = materialize(_by_range(_peel(_signed(slim), steps), "one"))
    two = None
    failed = one.select("range", F.explode("one").alias("at", "v")).where(F.col("v.stuck") > 0)
    if not failed.isEmpty():
        # tables of four times the size, for the pairs that stuck alone
        bad = failed.groupBy("range").agg(F.collect_set("at").alias("bad"))
        is_bad = lambda rid, kind: F.array_contains("bad", rid * 2 + kind)
        larger = lambda c: F.least(F.col(c) + 2, F.lit(20))
        again = slim.join(bad, "range").withColumns({
            "bits_e": F.when(is_bad(F.col("rid"), 0), larger("bits_e")),
            "bits_n": F.when(is_bad(F.col("rid"), 1), larger("bits_n")),
            "before_n": F.when(is_bad(F.col("rid") - 1, 1), larger("before_n"))}).drop("bad")
        two = materialize(_by_range(_peel(_signed(again), steps), "two"))
    order = Window.partitionBy("range").orderBy("rid")
    full = rows.withColumn("next_keys", F.lead("keys").over(order)).where(own).join(one, "range", "left")
    empty = F.lit(None).cast("map<bigint,struct<differ:bigint,stuck:bigint>>")
    full = full.withColumn("two", empty) if two is None else full.join(two, "range", "left")

    def outcome(kind, other):
        at = (F.col("rid") * 2 + kind).cast("bigint")
        a, b = F.try_element_at("one", at), F.try_element_at("two", at)
        plain = F.size(F.array_except("keys", other)) + F.size(F.array_except(other, "keys"))
        first, second = F.coalesce(a["stuck"], F.lit(0)) == 0, b["stuck"] == 0
        # a second try that left nothing at all found no difference
        differ = F.when(first, F.coalesce(a["differ"], F.lit(0))).when(second, b["differ"]).otherwise(plain.cast("bigint"))
        return differ, F.when(first, 1).when(second, 2).otherwise(3)

    de, te = outcome(0, "edit_keys")
    dn, tn = outcome(1, "next_keys")
    full = full.withColumns({"differ_edited": de, "differ_next": dn, "attempts": F.greatest(te, tn)})

    def likeness(differ, other):
        total = (F.size("keys") + F.size(other)).cast("double")
        return F.when(total == 0, F.lit(1.0)).otherwise((total - F.col(differ)) / (total + F.col(differ)))

    return full.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        as_text(sketch(F.col("keys")), F.size("keys"), F.col("h")).alias("fingerprint"),
        as_text(sketch(F.col("edit_keys")), F.size("edit_keys"), F.col("edit_h")).alias("edited_fingerprint"),
        likeness("differ_edited", "edit_keys").alias("near_edited"),
        likeness("differ_next", "next_keys").alias("near_next"), "differ_edited", "differ_next", "attempts")
