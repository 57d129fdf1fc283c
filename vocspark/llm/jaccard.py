"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles.  Two sets with Jaccard
similarity of at least num/den differ in at most D = (den-num)/num * min(sizes)
shingles.  Every shingle toggles one bit of a sketch that is cut into P parts;
D differing shingles touch at most D parts, so with P > D one part at least is
equal.  P depends on the size band, and a set larger than the band's lower edge
by less than den/num also joins the band below.  The stored digest of a part is
the xor of one random word per set bit, so equal digests mean equal parts.

A part that holds few shingles is equal in many documents without meaning much:
each band has spare parts, and only sets with more thin parts than spares emit
the thin ones (a pair of which either set has no more thin parts than spares
agrees on a part that isn't thin).

Equal sets are folded into classes first.  In each bucket of equal parts, the
members are verified against one centre, links are contracted, and only buckets
that still span several components are compared further, under a second parity
sketch of 512 bits whose Hamming distance bounds the difference from below.
Sets that share many buckets without a link are compared once, not per bucket.

Before the sets of a pair are brought together, a sketch as long as the larger
set rules out what the 512 bits, soon full, don't; pairs and differences are then
joined in passes, so that no more than about the sets of all classes, once more,
is on disk at a time however many pairs there are.

Wide buckets (crowds about one text, or all that hold one passage) are not
compared in pairs but by what sets each class apart from a centre, see `_apart`."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK, components, materialize, mix64, release

SKETCH = 512
BAND_RATIO = 1.35
STAR_ROUNDS = 3
#: In buckets of up to so many classes the last round compares all pairs.
WIDE = 256
#: A pass carries so many shingles at least.
PASS_SHINGLES = 1 << 24
#: The keys are dealt in so many passes, so that one pass's share is on disk at a time.
KEY_PASSES = 2


def shingles(text: str | None, k: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word k-grams of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix64(out ^ h[i:i + n]) + np.uint64(i + 1)
    return np.unique(out)


def band_edges(size: int, ratio: float = BAND_RATIO) -> tuple[int, int, int]:
    """(band, smallest size, largest size) of the band that holds `size`."""
    band = int(np.log(size) / np.log(ratio))
    low, high = int(np.ceil(ratio ** band)), int(np.ceil(ratio ** (band + 1))) - 1
    if size < low:
        return band_edges_of(band - 1, ratio)
    return band_edges_of(band + (size > high), ratio)


def band_edges_of(band: int, ratio: float) -> tuple[int, int, int]:
    return band, int(np.ceil(ratio ** band)), int(np.ceil(ratio ** (band + 1))) - 1


def part_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The bucket keys of one set: for each band it joins, one per part."""
    n, keys = len(s), []
    if n * (den - num) < num:  # no difference allowed: equal sets only
        return np.zeros(0, np.uint64)
    top = band_edges(n)[0]
    low = band_edges(max(1, -(-n * num // den)))[0]
    for band in range(low, top + 1):
        _, least, most = band_edges_of(band, BAND_RATIO)
        allowed = most * (den - num) // num
        # where parts hold few shingles anyway, only empty ones are thin
        thin = 0 if allowed < 8 or least < 5 * (allowed + 1) else 1 if allowed < 24 else 2
        spare = 1 + thin + allowed * max(2 * (least < 5 * (allowed + 1)), thin) // 20
        parts = allowed + 1 + spare
        at = ((s >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        content = np.zeros(parts, np.uint64)
        content[at[first]] = np.bitwise_xor.reduceat(mix64(s[order]), first)
        rich = np.flatnonzero(np.bincount(at, minlength=parts) > thin)
        use = rich if parts - len(rich) <= spare else np.arange(parts)
        keys.append(mix64(content[use] ^ mix64((use + (band << 40) + 1).astype(np.uint64))))
    return np.concatenate(keys)


def sketch_of(s: np.ndarray) -> np.ndarray:
    bits = (np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1)
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def long_sketch(s: np.ndarray) -> bytes:
    """A parity sketch of two bits a shingle or more, a power of two: it folds to
    any shorter one.  Empty where `sketch_of` is as long."""
    bits = 1 << max(0, 2 * len(s) - 1).bit_length()
    if bits <= SKETCH:
        return b""
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1)
                       .astype(np.uint8), bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """Two sets of these long sketches differ in so many shingles at least."""
    p, q = (np.frombuffer(v, np.uint64) for v in (x, y))
    if len(p) > len(q):
        p, q = q, p
    if not len(p):
        return 0
    return int(np.bitwise_count(np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0) ^ p).sum())


def _signature(num: int, den: int, k: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at in range(0, len(ids), 512):
                n, cls, sk, long, keys, offsets = [], [], [], [], [], [0]
                for t in texts[at:at + 512]:
                    s = shingles(t.as_py(), k)
                    n.append(len(s))
                    cls.append(xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0)
                    sk.append(sketch_of(s))
                    long.append(long_sketch(s))
                    keys.append(part_keys(s, num, den))
                    offsets.append(offsets[-1] + len(keys[-1]))
                yield pa.RecordBatch.from_arrays([
                    ids[at:at + 512], pa.array(n, pa.int64()),
                    pa.array(np.array(cls, np.uint64).view(np.int64)),
                    pa.FixedSizeListArray.from_arrays(np.concatenate(sk), SKETCH // 64)
                    .cast(pa.list_(pa.int64())),
                    pa.array(long, pa.binary()),
                    pa.ListArray.from_arrays(np.array(offsets, np.int32),
                                             np.concatenate(keys).view(np.int64))],
                    ["doc_id", "n", "cls", "sketch", "long", "keys"])
    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0),
                     pa.array([shingles(t.as_py(), k).tobytes() for t in part.column(1)], pa.binary())],
                    ["cls", "shingles"])
    return run


def _verify(num: int, den: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(den * both >= num * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])
    return run


def _near(num: int, den: int):
    """The pairs of (a, b, n, long, n2, long2) that the long sketches don't rule out."""
    def run(batches):
        for b in batches:
            x, y = b.column(3), b.column(5)
            apart = np.array([least_apart(p.as_py(), q.as_py()) for p, q in zip(x, y, strict=True)], np.int64)
            both = b.column(2).to_numpy() + b.column(4).to_numpy()
            keep = pa.array(apart * (den + num) <= both * (den - num), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in (0, 1, 2)], ["a", "b", "n"])
    return run


def _apart(num: int, den: int):
    """What sets the set x of a class apart from that of its centre z: n, the
    size d of their symmetric difference, whether they link (exact), and the
    first elements of the difference, those not in z before those in z.

    Let T be the most that linked x and y differ in.  If they share nothing of
    their differences, those have T elements at most together, and both link with
    z.  Else, unless both link with z, they share (d + d2 - T) / 2 elements: d less
    T at least, and more than d * num / (den + num) if x links with z.  So they
    meet in an element when each gives as many first ones as are left, and one."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, d, near, heads, offsets = [], [], [], [np.zeros(0, np.uint64)], [0]
                for x, z in zip(part.column(3), part.column(4), strict=True):
                    p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, z))
                    apart = np.concatenate([np.setdiff1d(p, q, assume_unique=True),
                                            np.setdiff1d(q, p, assume_unique=True)])
                    n.append(len(p))
                    d.append(len(apart))
                    near.append(len(apart) * (den + num) <= (len(p) + len(q)) * (den - num))
                    least = max(1, len(apart) - len(p) * (den - num) // num)
                    if near[-1]:
                        least = max(least, len(apart) * num // (den + num) + 1)
                    heads.append(apart[:max(0, len(apart) - least + 1)])
                    offsets.append(offsets[-1] + len(heads[-1]))
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:3], pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(near, pa.bool_()),
                    pa.ListArray.from_arrays(np.array(offsets, np.int32), np.concatenate(heads).view(np.int64))],
                    ["centre", "cls", "c", "n", "d", "near", "heads"])
    return run


def _may_link(n, sketch, n2, sketch2, num: int, den: int):
    """False where sizes or the sketches' Hamming distance rule a link out: two
    sets with a link differ in (n + n2) * (den - num) / (den + num) at most."""
    apart = sum((F.bit_count(sketch[i].bitwiseXOR(sketch2[i])) for i in range(SKETCH // 64)), F.lit(0))
    return (den * F.least(n, n2) >= num * F.greatest(n, n2)) & (apart * (den + num) <= (n + n2) * (den - num))


def _possible(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct class pairs (a, b) that sizes and sketches don't rule out."""
    info = reps.select("cls", "n", "sketch")
    return pairs.select("a", "b").distinct() \
        .join(info.toDF("a", "n1", "s1"), "a").join(info.toDF("b", "n2", "s2"), "b") \
        .where(_may_link(F.col("n1"), F.col("s1"), F.col("n2"), F.col("s2"), num, den)).select("a", "b")


def _passes(weights: DataFrame, reps: DataFrame, parts: int) -> int:
    """Passes over rows of (n), the shingles that each carries, so that one pass
    has no more of them than all classes have, divided by `parts`."""
    carried, whole = weights.toDF("n").select("n", F.lit(0).alias("all")).union(reps.select(F.lit(0), "n")) \
        .agg(F.sum("n"), F.sum("all")).first()
    return max(1, -(-(carried or 0) // max(PASS_SHINGLES, (whole or 0) // parts)))


def _share(rows: DataFrame, passes: int, i: int, *cols: str) -> DataFrame:
    """The rows of pass i: each row is in one."""
    return rows.where(F.pmod(F.xxhash64(*cols), F.lit(passes)) == i) if passes > 1 else rows


def _sets_of(need: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(cls, shingles) of the classes in `need`, from whole texts."""
    texts = need.join(reps, "cls").select("cls", F.col("rep").alias("doc_id"), "rep_hash") \
        .join(docs.withColumn("rep_hash", F.xxhash64("text")), ["doc_id", "rep_hash"]) \
        .dropDuplicates(["doc_id", "rep_hash"]).select("cls", "text")  # as joined: no exchange
    return materialize(texts.mapInArrow(_sets(k), "cls bigint, shingles binary"))


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """Verified links among possible class pairs (a, b), from whole texts: of those
    that the long sketches don't rule out, in passes that each hold a bounded
    share of the sets side by side."""
    possible = materialize(pairs)
    info = reps.select("cls", "n", "long")
    near = materialize(possible.join(info.toDF("a", "n", "long"), "a").join(info.toDF("b", "n2", "long2"), "b")
                       .select("a", "b", "n", "long", "n2", "long2")
                       .mapInArrow(_near(num, den), "a bigint, b bigint, n bigint"))
    passes = _passes(near.select("n"), reps, 2)
    sets = _sets_of(near.select(F.col("a").alias("cls")).union(near.select("b")).distinct(), reps, docs, k)

    def one(i: int) -> DataFrame:
        joined = _share(near, passes, i, "a", "b").join(sets.withColumnsRenamed({"cls": "a", "shingles": "sa"}), "a") \
            .join(sets.withColumnsRenamed({"cls": "b", "shingles": "sb"}), "b")
        return materialize(joined.select("a", "b", "sa", "sb").mapInArrow(_verify(num, den), "a bigint, b bigint"))

    links = reduce(DataFrame.unionByName, [one(i) for i in range(passes)])
    release(possible, near, sets)
    return links


def _members(sets: DataFrame, passes: int) -> DataFrame:
    """(key, cls, centre) of the keys that several classes share, the centre
    being the smallest class, from (cls, keys).  Each pass takes every key of
    one remainder, so that no key is in two passes."""
    def one(i: int) -> DataFrame:
        mine = F.filter("keys", lambda key: F.pmod(key, F.lit(passes)) == i)
        parts = sets.select("cls", F.explode(mine).alias("key"))
        shared = parts.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")) \
            .where("lo != hi").select("key", F.col("lo").alias("centre"))
        return materialize(parts.join(shared, "key").select("key", "cls", "centre").distinct())

    return reduce(DataFrame.unionByName, [one(i) for i in range(passes)])


def _families(open_: DataFrame, buckets: DataFrame) -> DataFrame:
    """(key, cls, c) with fewer pairs a key, from open buckets (key, cls, c) and
    their sizes (key, m classes, m2: squares of m by component, added up).

    Versions of a text meet in many buckets.  Buckets that share classes, directly
    or by others, are one family, and no pair reaches beyond it.  A family with
    fewer pairs than its buckets have together becomes one bucket; others stay."""
    family = components(open_.select(F.col("cls").alias("a"), F.col("key").alias("b"))) \
        .select(F.col("vertex").alias("v"), F.col("component").alias("family"))
    named = materialize(open_.select("key", "cls", "c").join(family.withColumnRenamed("v", "cls"), "cls"))
    one = named.select("family", "cls", "c").distinct()
    pairs = one.groupBy("family", "c").agg(F.count("*").alias("f")).groupBy("family").agg(
        (F.sum("f") * F.sum("f") - F.sum(F.col("f") * F.col("f"))).alias("pairs"))
    in_buckets = buckets.join(family.withColumnRenamed("v", "key"), "key").groupBy("family").agg(
        F.sum(F.col("m") * F.col("m") - F.col("m2")).alias("in_buckets"))
    fold = materialize(pairs.join(in_buckets, "family").where("pairs < in_buckets").select("family"))
    return materialize(one.join(fold, "family").select(F.col("family").alias("key"), "cls", "c").unionByName(
        named.join(fold, "family", "left_anti").select("key", "cls", "c")))


def _wide_pairs(wide: DataFrame, reps: DataFrame, docs: DataFrame, num: int, den: int,
                k: int) -> tuple[DataFrame, DataFrame]:
    """Links with centres, and further class pairs (a, b) that may link, which
    together join what links in the buckets (key, cls, c).

    A bucket's centre is the class in most of the buckets, so that those of one
    crowd have few; buckets with one centre are one group.  A class gives the
    group its first differences, and pairs that meet in one are kept where what
    is left from there on, in both, is as much as they need to share."""
    degree = wide.groupBy("cls").agg(F.count("*").alias("buckets"))
    first = F.min(F.struct((-F.col("buckets")).alias("o"), F.xxhash64("cls").alias("h"), "cls")).alias("z")
    centres = wide.join(degree, "cls").groupBy("key").agg(first).select("key", F.col("z.cls").alias("centre"))
    groups = materialize(wide.join(centres, "key").select("centre", "cls", "c").distinct())
    sets = _sets_of(groups.select("cls").distinct(), reps, docs, k)
    passes = _passes(groups.join(reps, "cls").select("n"), reps, 2)
    apart = reduce(DataFrame.unionByName, [materialize(
        _share(groups, passes, i, "centre", "cls").join(sets, "cls")
        .join(sets.withColumnsRenamed({"cls": "centre", "shingles": "z"}), "centre")
        .select("centre", "cls", "c", "shingles", "z").mapInArrow(
            _apart(num, den),
            "centre bigint, cls bigint, c bigint, n bigint, d bigint, near boolean, heads array<bigint>"))
        for i in range(passes)])
    release(groups, sets)
    star = apart.where("near and cls != centre").select(
        F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct()
    need = (F.col("d") + F.col("d2")) * (den + num) - (F.col("n") + F.col("n2")) * (den - num)
    passes = _passes(apart.select(F.size("heads") * 8), reps, 2)  # a row an element, of eight numbers

    def one(i: int) -> DataFrame:
        mine = F.filter(F.transform("heads", lambda e, at: F.struct(at.alias("at"), e.alias("e"))),
                        lambda x: F.pmod(x["e"], F.lit(passes)) == i)
        heads = apart.withColumn("heads", mine).repartition("centre", "cls") \
            .select("*", F.explode("heads").alias("h")) \
            .select("centre", "cls", "c", "n", "d", "near", "h.e", (F.col("d") - F.col("h.at")).alias("left"))
        other = heads.withColumnsRenamed({x: f"{x}2" for x in ("cls", "c", "n", "d", "near", "left")})
        pairs = heads.join(other, ["centre", "e"]).where(
            (F.col("cls") < F.col("cls2")) & (F.col("c") != F.col("c2")) & ~(F.col("near") & F.col("near2"))
            & (den * F.least("n", "n2") >= num * F.greatest("n", "n2"))
            & (need <= 2 * (den + num) * F.least("left", "left2"))) \
            .select(F.col("cls").alias("a"), F.col("cls2").alias("b"))
        return materialize(pairs.distinct()) if passes > 1 else pairs

    pairs = reduce(DataFrame.unionByName, [one(i) for i in range(passes)])
    return star, _possible(pairs, reps, num, den)


def jaccard_components(docs: DataFrame, num: int = 90, den: int = 100, k: int = 3,
                       passes: int = KEY_PASSES) -> DataFrame:
    """Near-duplicate groups of (doc_id, text): one row per input row with
    doc_id, n_shingles and component_id, the smallest doc_id reachable by links
    (Jaccard of at least num/den over word k-shingles), itself included.

    Null and empty texts have an empty set, n_shingles 0 and link with nothing.
    A text of fewer than k words has its whole sequence as its one shingle.
    Repeated rows each give a row; rows of one doc_id share its component.
    A null doc_id stays null and is never a representative.  An empty table
    gives no rows.  Extra columns are not read."""
    docs = docs.select("doc_id", "text")
    keyed = materialize(docs.withColumn("h", F.xxhash64("text")).mapInArrow(
        _with_hash(_signature(num, den, k)),
        "doc_id bigint, h bigint, n bigint, cls bigint, sketch array<bigint>, long binary, keys array<bigint>"))
    sig = materialize(keyed.select("doc_id", "n", "cls"))
    some = sig.where("n > 0 and doc_id is not null")
    reps = materialize(keyed.where("n > 0 and doc_id is not null").groupBy("cls").agg(
        F.min(F.struct("doc_id", "h", "n", "sketch", "long")).alias("r"))
        .select("cls", F.col("r.doc_id").alias("rep"), F.col("r.h").alias("rep_hash"), "r.n", "r.sketch", "r.long"))
    members = _members(keyed.where("n > 0 and doc_id is not null"), passes)
    release(keyed)  # the keys, by far the largest table, are dealt
    # a class meets one centre first, the smallest that it may link with
    star = _possible(members.where("cls != centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")),
                     reps, num, den).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _links(star, reps, docs, num, den, k)
    label, before = None, None
    for star in range(1, STAR_ROUNDS + 1):
        label = components(links)
        open_ = members.select("key", "cls").join(label.withColumnRenamed("vertex", "cls"), "cls", "left") \
            .withColumn("c", F.coalesce("component", "cls"))
        # of buckets with the same members, one is enough
        one = open_.groupBy("key", "c").agg(
            F.count("*").alias("m"), F.bit_xor("cls").alias("x"),
            F.sum(F.pmod("cls", F.lit(1 << 31))).alias("s")).groupBy("key").agg(
            F.count("*").alias("cs"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("m2"),
            F.bit_xor("x").alias("x"), F.sum("s").alias("s")).where("cs > 1") \
            .groupBy("x", "s", "m").agg(F.min(F.struct("key", "m2")).alias("o")) \
            .select("o.key", "m", "o.m2")
        one = materialize(one)
        open_ = materialize(open_.select("key", "cls", "c").join(one.select("key", "m"), "key"))
        cross, rows = one.agg(F.sum((F.col("m") * F.col("m") - F.col("m2")) / 2), F.sum("m")).first()
        if not rows:
            break
        # further centres are of use only while they join what is open
        last = cross <= 2 * rows or star == STAR_ROUNDS or (before is not None and 4 * cross > 3 * before)
        before = cross
        found = []
        if last:
            if not one.where(F.col("m") > WIDE).isEmpty():
                found = _wide_pairs(open_.where(F.col("m") > WIDE).select("key", "cls", "c"), reps, docs, num, den, k)
            open_ = _families(open_.where(F.col("m") <= WIDE), one)
        rich = open_.join(reps.select("cls", "n", "sketch"), "cls")
        if last:
            other = rich
        else:  # one centre more per bucket, by another order each round
            best = F.min(F.struct(F.xxhash64("cls", F.lit(star)).alias("o"), "cls")).alias("best")
            other = open_.groupBy("key").agg(best).select("key", F.col("best.cls").alias("cls")) \
                .join(rich, ["key", "cls"])
        other = other.select("key", *[F.col(x).alias(f"{x}2") for x in ("cls", "c", "n", "sketch")])
        cond = (F.col("c") != F.col("c2")) & _may_link(F.col("n"), F.col("sketch"), F.col("n2"), F.col("sketch2"),
                                                       num, den)
        if last:
            cond = cond & (F.col("cls") < F.col("cls2"))
        pairs = rich.alias("x").join(other, "key").where(cond).select(
            F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b"))
        if found:
            pairs, links = pairs.union(found[1]), links.union(found[0])
        more = _links(pairs.distinct(), reps, docs, num, den, k)
        links = materialize(links.union(more).distinct())
        if last:
            label = components(links)
            break
    final = reps.join(label.withColumnRenamed("vertex", "cls"), "cls", "left") \
        .withColumn("c", F.coalesce("component", "cls"))
    # several classes may hold rows of one doc_id: they are one vertex
    ids = some.select("doc_id", "cls").distinct()
    edges = ids.join(final.select("cls", "c"), "cls")
    low = edges.groupBy("c").agg(F.min("doc_id").alias("low"))
    per_doc = materialize(edges.join(low, "c").groupBy("doc_id").agg(
        F.min("low").alias("low"), F.max("low").alias("high")))
    twice = per_doc.where("low != high")
    if not twice.isEmpty():
        again = components(edges.join(low, "c").select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
        per_doc = per_doc.join(again.withColumnRenamed("vertex", "doc_id"), "doc_id", "left") \
            .select("doc_id", F.coalesce("component", "low").alias("low"))
    return sig.select("doc_id", F.col("n").alias("n_shingles")) \
        .join(per_doc.select("doc_id", "low"), "doc_id", "left") \
        .select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))


def _with_hash(f):
    def run(batches):
        for b in batches:
            at = 0
            for out in f([b.select([0, 1])]):
                h = b.column(2).slice(at, out.num_rows)
                at += out.num_rows
                yield pa.RecordBatch.from_arrays([out.column(0), h, *out.columns[1:]],
                                                 ["doc_id", "h", *out.schema.names[1:]])
    return run


def drop_near_duplicates(docs: DataFrame, num: int = 90, den: int = 100, k: int = 3,
                         passes: int = KEY_PASSES) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id, one
    row of it.  Documents without words, and rows without an id, all stay.
    Columns are those of `docs`."""
    groups = jaccard_components(docs, num, den, k, passes)
    drop = groups.where("doc_id != component_id").select("doc_id").distinct()
    left = docs.join(drop, "doc_id", "left_anti")
    twice = materialize(groups.where("n_shingles > 0 and doc_id is not null")
                        .groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return left.select(*docs.columns)
    once = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns) \
        .unionByName(once.select(*docs.columns))


__all__ = ["MASK", "jaccard_components", "drop_near_duplicates", "shingles"]
