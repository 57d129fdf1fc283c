"""Alignment of two tokenizers' tokens over the same bytes.

All A and B tokens of a batch of documents are lexsorted by start.  The running
maximum of their ends (`maximum.accumulate`) tells where a group ends: a token
that starts where the maximum stands begins a new group, tokens that overlap stay
in one.  Both tokenizers cover a document from its first byte to its last, so a
group never reaches into the next document, and a whole batch is cut at once.
Inside a group every A token links with every B token.

The documents are encoded once; a row keeps its distinct id pairs with their
multiplicities.  How many documents hold a pair is counted over all rows.  The
counts of the most frequent pairs, HEAD at most whatever the corpus, go to the
tasks as sorted arrays; the pairs beyond that are joined by shuffle.  They are
rare, each of them, so no key of that join is hot."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, worker_state

#: Characters encoded at a time, and links expanded at a time, in a task.
BATCH_CHARS = 1_000_000
BATCH_LINKS = 4_000_000
#: Most pairs whose counts are sent to the tasks (17 bytes each).
HEAD = 1 << 20
#: Words whose ids a worker keeps, and their longest form.
CACHE_WORDS, CACHED_CHARS = 300_000, 40
#: Words encoded as one text, and those of such a text that fails, in smaller ones.
JOINED_WORDS, FEWER_WORDS = 256, 16
#: Both tokenizers cut here whatever stands around, as no token of either holds a
#: space after a character that is no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
SEPARATORS = (b",", b"|", b";", b"")


class Side(NamedTuple):
    """A tokenizer: texts -> ids per text, and the bytes of each id."""

    encode: object
    pieces: list[bytes]

    def cuts_at_spaces(self) -> bool:
        return not any(re.search(r"\S ", p.decode(errors="replace")) for p in self.pieces)


def byte_level_bytes() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 characters stand for
    themselves, the other bytes for U+0100 onwards, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def byte_level(path: str) -> Side:
    """A `tokenizers` file of byte-level BPE; it reads a space before the text."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    alphabet = byte_level_bytes()
    pieces = [b""] * (max(tok.get_vocab().values()) + 1)
    for piece, i in tok.get_vocab().items():
        pieces[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    return Side(encode, pieces)


def sentence_pieces(path: str) -> Side:
    """A `sentencepiece` model; it puts the space before the text itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
              else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    return Side(lambda texts: sp.encode(texts, num_threads=1), pieces)


class Aligner:
    """Both sides and their tables, once per worker process."""

    def __init__(self, a: Side, b: Side):
        self.sides, self.cache = (a, b), ({}, {})
        self.by_words = a.cuts_at_spaces() and b.cuts_at_spaces()
        self.lengths = [np.array([len(p) for p in s.pieces], np.int64) for s in self.sides]
        self.width = len(b.pieces)
        self.rows = max(len(a.pieces), len(b.pieces))
        #: written[separator * rows + id]: the id and what follows it
        self.written = np.array([b"%d%b" % (i, s) for s in SEPARATORS for i in range(self.rows)], object)

    def encode_words(self, words: list[str], side: int) -> dict[str, bytes | None]:
        """The ids of each distinct word with the space before it, as bytes;
        None where the tokens' bytes don't join to it.  Words that both
        tokenizers part at the space between them are encoded as one text; where
        its tokens' bytes don't join to it, in smaller ones, then one by one."""
        encode, pieces = self.sides[side]
        out = {}
        plain = [w for w in words if not (w[0].isspace() or w[-1].isspace())] if self.by_words else []
        for most in (JOINED_WORDS, FEWER_WORDS):
            joined = [plain[at:at + most] for at in range(0, len(plain), most)]
            plain = []
            for part, ids in zip(joined, encode([" ".join(p) for p in joined]), strict=True):
                spaced = [b" " + w.encode() for w in part]
                ends = np.cumsum(self.lengths[side][ids])
                goal = np.cumsum([len(w) for w in spaced])
                upto = np.searchsorted(ends, goal, "right")  # tokens so far
                if len(ends) and upto.min() and (ends[upto - 1] == goal).all() \
                        and b"".join(map(pieces.__getitem__, ids)) == b"".join(spaced):
                    b, at = np.array(ids, "<u4").tobytes(), 0
                    for w, to in zip(part, (upto * 4).tolist(), strict=True):
                        out[w] = b[at:to]
                        at = to
                else:
                    plain += part
        rest = [w for w in words if w not in out]
        for w, ids in zip(rest, encode(rest), strict=True):
            same = b"".join(map(pieces.__getitem__, ids)) == b" " + w.encode()
            out[w] = np.array(ids, "<u4").tobytes() if same else None
        return out

    def tokens(self, texts: list[str | None]) -> list[list[bytes]]:
        """Per side the ids of each text, as bytes; none where a text is null,
        empty or not what its tokens' bytes join to."""
        if len(self.cache[0]) > CACHE_WORDS:
            for c in self.cache:
                c.clear()
        words = [(CUT.split(t) if self.by_words else [t]) if t else [] for t in texts]
        new = list(set().union(*words).difference(self.cache[0]))
        for at in range(0, len(new), 4096):
            for side, kept in enumerate(self.cache):
                kept.update(self.encode_words(new[at:at + 4096], side))
        out = [[], []]
        for w in words:
            ids = [list(map(k.__getitem__, w)) for k in self.cache]
            whole = not any(None in x for x in ids)
            for x, o in zip(ids, out, strict=True):
                o.append(b"".join(x) if whole else b"")
        for w in new:
            if len(w) > CACHED_CHARS:
                for c in self.cache:
                    del c[w]
        return out

    def align(self, texts: list[str | None]) -> dict:
        """Per text: n_a, n_b, n_groups, n_links, groups_sha256 and its distinct
        id pairs (a * width + b, ascending) with multiplicities."""
        n, encoded = len(texts), self.tokens(texts)
        counts = [np.array([len(x) // 4 for x in ids], np.int64) for ids in encoded]
        flat = [np.frombuffer(b"".join(ids), "<u4").astype(np.int64) for ids in encoded]
        # both sides hold the same bytes of the same texts: offsets in the joined batch agree
        ends = [np.cumsum(t[x]) for t, x in zip(self.lengths, flat, strict=True)]
        starts = [e - t[x] for e, t, x in zip(ends, self.lengths, flat, strict=True)]
        side = np.repeat(np.array([0, 1], np.int8), [len(x) for x in flat])
        ids, start, end = np.concatenate(flat), np.concatenate(starts), np.concatenate(ends)
        doc = np.concatenate([np.repeat(np.arange(n), c) for c in counts])
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order])
        first = np.ones(len(order), bool)
        first[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(first) - 1
        n_groups = int(first.sum())
        sizes = [np.bincount(group[side == s], minlength=n_groups) for s in (0, 1)]
        group_doc = doc[order][first]
        cuts = np.searchsorted(group_doc, np.arange(n + 1))
        links = np.concatenate([[0], np.cumsum(sizes[0] * sizes[1])])[cuts]
        pairs, times, per_doc = self.pairs(flat, group[side == 0], sizes, group_doc, n)
        return {
            "n_a": counts[0], "n_b": counts[1],
            "n_groups": np.diff(cuts), "n_links": np.diff(links),
            "groups_sha256": self.digests(ids, side, group, doc, n),
            "pairs": pairs, "times": times, "per_doc": per_doc,
        }

    def digests(self, ids, side, group, doc, n: int) -> list[str]:
        """Digest of the written groups per document ('' without tokens)."""
        by = np.lexsort((side, group))  # stable: tokens of a side stay in order
        ids, side, group, doc = ids[by], side[by], group[by], doc[by]
        follow = np.full(len(by), 3)
        if len(by) > 1:
            follow[:-1] = np.where(doc[1:] != doc[:-1], 3, np.where(
                group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)))
        written = self.written[follow * self.rows + ids]
        cuts = np.searchsorted(doc, np.arange(n + 1))
        return [hashlib.sha256(b"".join(written[a:b].tolist())).hexdigest() if b > a else ""
                for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def pairs(self, flat, group_a, sizes, group_doc, n: int):
        """Distinct (document, pair) with multiplicities, from links expanded a
        bounded number at a time."""
        first_b = np.cumsum(sizes[1]) - sizes[1]
        space = len(self.sides[0].pieces) * self.width
        fan = sizes[1][group_a]  # links of each A token
        total = np.cumsum(fan)
        keys, times = np.empty(0, np.int64), np.empty(0, np.int64)
        at = 0
        while at < len(fan):
            done = total[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(total, done + BATCH_LINKS, "right")))
            f, g = fan[at:upto], group_a[at:upto]
            inside = np.arange(int(f.sum())) - np.repeat(np.cumsum(f) - f, f)
            b = flat[1][np.repeat(first_b[g], f) + inside]
            key = np.repeat(group_doc[g] * space + flat[0][at:upto] * self.width, f) + b
            k, c = np.unique(key, return_counts=True)
            if len(keys):
                keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
                times = np.bincount(back, weights=np.concatenate([times, c])).astype(np.int64)
            else:
                keys, times = k, c
            at = upto
        per_doc = np.bincount(keys // space, minlength=n) if len(keys) else np.zeros(n, np.int64)
        return keys % space, times, per_doc


def aligner(a_path: str, b_path: str) -> Aligner:
    state = worker_state()
    if ("aligner", a_path, b_path) not in state:
        state["aligner", a_path, b_path] = Aligner(byte_level(a_path), sentence_pieces(b_path))
    return state["aligner", a_path, b_path]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
           "pairs array<bigint>, times array<bigint>")


def _lists(values: np.ndarray, per_row: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _align(a_path: str, b_path: str, chars: int):
    def run(batches):
        al = aligner(a_path, b_path)
        for b in batches:
            texts, at = b.column("text"), 0
            lengths = np.array([len(x) if x else 0 for x in texts.to_pylist()], np.int64)
            while at < len(texts):
                upto = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), chars, "right")))
                r = al.align(texts.slice(at, upto - at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, upto - at), *[pa.array(r[x], pa.int64()) for x in NUMBERS],
                     pa.array(r["groups_sha256"], pa.string()), _lists(r["pairs"], r["per_doc"]),
                     _lists(r["times"], r["per_doc"])],
                    ["doc_id", *NUMBERS, "groups_sha256", "pairs", "times"])
                at = upto
    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, chars: int = BATCH_CHARS) -> DataFrame:
    """(doc_id, text) -> per row its numbers of tokens, groups and links, the
    digest of its groups, and its distinct id pairs with their multiplicities.

    Null and empty texts, and those that a tokenizer does not give back byte for
    byte, have no tokens: zeros, '' and empty lists."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_align(a_path, b_path, chars), ALIGNED)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n_docs, best): how many rows hold a pair, and whether no pair of
    the same A id is held by more.  The highest counts have a row per A id, the
    vocabulary's size at most."""
    counts = materialize(rows.select(F.explode("pairs").alias("pair")).groupBy("pair")
                         .agg(F.count(F.lit(1)).alias("n_docs")))
    a = F.expr(f"pair div {width}").alias("a")
    top = counts.groupBy(a).agg(F.max("n_docs").alias("top"))
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select(
        "pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def head_of(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent pairs, `most` at most: those at or above a bound that a
    histogram of at most 1,000 steps gives."""
    step = F.floor(F.log2("n_docs") * 16)
    hist = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    kept, bound = 0, None
    for s, n in hist:
        if kept + n > most:
            break
        kept, bound = kept + n, s
    return counts.where(step >= bound) if bound is not None else counts.limit(0)


SUMMED = ("row_id bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
          "n_best bigint, count_sum bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>")


def _sums(head):
    """Sums over the head's pairs; the other pairs of a row stay with it."""
    def run(batches):
        known, counts, best = head.value
        for b in batches:
            lists = b.column("pairs")
            offsets = lists.offsets.to_numpy()
            pairs = lists.values.to_numpy()[offsets[0]:offsets[-1]]
            other = b.column("times")
            times = other.values.to_numpy()[other.offsets[0].as_py():other.offsets[-1].as_py()]
            offsets = offsets - offsets[0]
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)

            def per_row(values, offsets=offsets):
                run = np.concatenate([[0], np.cumsum(values)])
                return run[offsets[1:]] - run[offsets[:-1]]

            n = np.where(hit, counts[at] if len(known) else 0, 0)
            top = np.where(hit, best[at] if len(known) else False, False)
            left = per_row((~hit).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(x) for x in ("row_id", "doc_id", *NUMBERS)],
                 pa.array(per_row(times * top), pa.int64()), pa.array(per_row(times * n), pa.int64()),
                 b.column("groups_sha256"), _lists(pairs[~hit], left), _lists(times[~hit], left)],
                [x.split()[0] for x in SUMMED.split(", ")])
    return run


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, head: int = HEAD,
                     chars: int = BATCH_CHARS) -> DataFrame:
    """(doc_id, text) -> per row n_a, n_b, n_groups, n_links, n_best (links whose
    pair is in as many documents as any pair of its A id), count_sum (documents
    of the pair, over links) and groups_sha256.

    Every row counts as a document, repeated rows and null ids too.  Null and
    empty texts, and those that a tokenizer does not give back byte for byte,
    have zeros and an empty string.  An empty table gives no rows; other columns
    are not read.  Ties for an A id's highest count are all best.  Each table in
    between is written to the shared folder once, so a lost executor never costs
    the encoding again."""
    spark = docs.sparkSession
    width = len(sentence_pieces(b_path).pieces)
    rows = materialize(aligned(docs, a_path, b_path, chars).withColumn("row_id", F.monotonically_increasing_id()))
    counts = materialize(pair_counts(rows, width))
    top = head_of(counts, head).toArrow()
    known = top.column("pair").to_numpy()
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast(tuple(
        x[order] for x in (known, top.column("n_docs").to_numpy(), top.column("best").to_numpy())))
    summed = materialize(rows.mapInArrow(_sums(shared), SUMMED))
    release(rows)
    rare = summed.select("row_id", F.explode(F.arrays_zip("pairs", "times")).alias("x")) \
        .select("row_id", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")) \
        .join(counts, "pair").groupBy("row_id").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_rare"),
            F.sum(F.col("times") * F.col("n_docs")).alias("sum_rare"))

    def plus(a: str, b: str):
        return (F.col(a) + F.coalesce(b, F.lit(0))).cast("bigint").alias(a)

    return summed.join(rare, "row_id", "left").select(
        "doc_id", *NUMBERS, plus("n_best", "best_rare"), plus("count_sum", "sum_rare"), "groups_sha256")
