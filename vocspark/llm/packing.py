"""Cost-balanced packing of tokenized documents into sequences.

Every document is tokenized once.  Its full windows of `capacity` ids are whole
sequences already; the rest (less than a window) is dealt to shards by hash and
packed there: documents in descending order of attention cost (length + its
square over `capacity`) go to the sequence of lowest cost that still has room,
and what fits nowhere whole is cut over the rooms that are left.  A shard opens
just as many places as it has ids, so all its sequences are full but one.  A
shard holds a bounded number of ids, so its one sequence with padding is a small
part of it, and a task never holds more than a shard."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, worker_state

CAPACITY = 4096
END_ID = 2
#: Characters of text per shard, about; and distinct words that a worker keeps.
SHARD_CHARS = 2_000_000
CACHE_WORDS = 900_000
CACHED_BYTES = 48


def _tokenizer(name: str):
    """The tokenizer, its cache of words and the bytes of each id, once per
    worker process."""
    state = worker_state()
    if ("tokenizer", name) not in state:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(name)
        vocab = tok.get_vocab()
        size = np.zeros(max(vocab.values()) + 1, np.int64)
        size[list(vocab.values())] = [len(piece.removesuffix("</w>")) for piece in vocab]
        state["tokenizer", name] = (tok, {}, size)
    return state["tokenizer", name]


#: A comma or full stop between a letter or digit and white space: the
#: tokenizer parts it from the word in any case.
_STOPS = ((re.compile(rb"\.(?<=[0-9A-Za-z]\.)(?=[ \n])"), b" ."), (re.compile(rb",(?<=[0-9A-Za-z],)(?=[ \n])"), b" ,"))
#: Marks that compose with a letter before them; composing minds the case.
_COMPOSES = re.compile(rb"\xcc|\xcd[\x80-\xaf]")


def words_of(text: str) -> list[bytes]:
    """A text's words for the cache, with fewer spellings: what the tokenizer
    lower-cases and parts anyway is lower-cased and parted here."""
    b = text.encode()
    if b"<|" not in b and not _COMPOSES.search(b):
        for stop, parted in _STOPS:
            b = stop.sub(parted, b)
        b = b.lower()
    return b.split()


#: Words of these characters keep their bytes' number in the tokenizer's
#: normal form: printable ASCII and U+00C0 to U+017F but U+0130.  A text of
#: such words, parted by spaces, is known as a whole.
_PLAIN = re.compile(rb"[ -~\xc3-\xc5\x80-\xbf]+")


def plain(b: bytes) -> bool:
    return _PLAIN.fullmatch(b) is not None and b"\xc4\xb0" not in b and b"<|" not in b


#: Words encoded as one text.
JOINED_WORDS = 256


def encode_words(words: list[bytes], tok, size: np.ndarray) -> dict[bytes, bytes]:
    """Ids of distinct words, as bytes.  Words whose bytes can be counted off in
    the tokens are encoded as one text, as no token reaches over white space;
    others, and those of a text that doesn't count up, one by one."""
    parts = []
    for at in range(0, len(words), JOINED_WORDS):
        part = words[at:at + JOINED_WORDS]
        if not plain(b := b" ".join(part)):
            part = [w for w in part if plain(w)]
            b = b" ".join(part)
        parts.append((part, b.decode()))
    out = {}
    for (part, _), e in zip(parts, tok.encode_batch_fast([t for _, t in parts], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, "<u4")
        ends, goal = np.cumsum(size[ids]), np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
        upto = np.searchsorted(ends, goal, "right")  # tokens so far
        if len(ends) and len(goal) and upto.min() and ends[-1] == goal[-1] and (ends[upto - 1] == goal).all():
            b, at = ids.tobytes(), 0
            for w, to in zip(part, (upto * 4).tolist(), strict=True):
                out[w] = b[at:to]
                at = to
    rest = [w for w in words if w not in out]
    for w, e in zip(rest, tok.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
        out[w] = np.array(e.ids, "<u4").tobytes()
    return out


def gaps_of(ids: list) -> list[int]:
    """Places of None."""
    places, at = [], -1
    for _ in range(ids.count(None)):
        at = ids.index(None, at + 1)
        places.append(at)
    return places


def encode(texts: list[str], path: str, cache_words: int = CACHE_WORDS) -> list[np.ndarray]:
    """Ids of whole texts.  The tokenizer drops white space between words and
    never looks across it, so a text's ids are those of its words (split at
    ASCII white space); frequent words are looked up.  The cache has two halves
    of about cache_words / 2: when the younger is full it becomes the older, and
    a word found there goes into the younger again."""
    tok, cache, size = _tokenizer(path)
    state = worker_state()
    if 2 * len(cache) > cache_words:
        state["older words", path] = dict(cache)
        cache.clear()
    older = state.get(("older words", path), {})
    split = [words_of(t) for t in texts]
    # one look-up a word; what the cache lacks is None, and its places are filled in later
    found = [list(map(cache.get, words)) for words in split]
    gaps = [gaps_of(ids) for ids in found]
    missing = {words[at] for words, places in zip(split, gaps, strict=True) for at in places}
    cache.update((w, older[w]) for w in missing if w in older)
    new = list(missing.difference(older))
    for at in range(0, len(new), 4096):
        cache.update(encode_words(new[at:at + 4096], tok, size))
    for words, ids, places in zip(split, found, gaps, strict=True):
        for at in places:
            ids[at] = cache[words[at]]
    out = [np.frombuffer(b"".join(ids), "<u4") for ids in found]
    for w in new:
        if len(w) > CACHED_BYTES:
            del cache[w]
    return out


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def _pieces(path: str, capacity: int, end_id: int, cache_words: int = CACHE_WORDS):
    """One row per full window (no ids) and one for the rest (its ids)."""
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        # in two bytes where all ids fit
        width = 2 if max(len(_tokenizer(path)[2]) - 1, end_id) < 65536 else 4
        for b in batches:
            at, docs = 0, b.column("doc_id").to_pylist()
            texts = [t or "" for t in b.column("text").to_pylist()]
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and size < 1_500_000:
                    size += len(texts[upto])
                    upto += 1
                doc, start, length, crcs, total, ids = [], [], [], [], [], []
                for i, e in enumerate(encode(texts[at:upto], path, cache_words), at):
                    every = e.tobytes() + end
                    for s in range(0, len(e) + 1, capacity):
                        piece = every[4 * s:4 * (s + capacity)]
                        doc.append(docs[i])
                        start.append(s)
                        length.append(len(piece) // 4)
                        total.append(len(e) + 1)
                        crcs.append(zlib.crc32(piece))
                        ids.append(None if len(piece) == 4 * capacity else
                                   bytes([width]) + np.frombuffer(piece, "<u4").astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crcs, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
                at = upto
    return run


def place(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """For each item (descending cost expected) its pieces: (from, length,
    sequence, offset).  Sequences 0.. are full; the last one holds the rest."""
    total = sum(lengths)
    room = np.full(-(-total // capacity), capacity, np.int64)
    if total % capacity:
        room[-1] = total % capacity
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    left = []

    def put(item: int, start: int, n: int, seq: int) -> None:
        out[item].append((start, n, seq, int(used[seq])))
        used[seq] += n
        room[seq] -= n
        cost[seq] += n + n * n / capacity

    for item, n in enumerate(lengths):
        fits = np.flatnonzero(room >= n)
        if len(fits):
            put(item, 0, n, int(fits[cost[fits].argmin()]))
        else:
            left.append(item)
    for item in left:
        start, n = 0, lengths[item]
        while n:
            seq = int(room.argmax())
            part = min(n, int(room[seq]))
            put(item, start, part, seq)
            start, n = start + part, n - part
    return out


RESULT = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


def _pack(capacity: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        base = int(key[0]) << 32
        full = rows[rows["ids"].isnull()].sort_values(["doc_id", "start", "ids_crc32"], na_position="first")
        rest = rows[rows["ids"].notnull()].sort_values(
            ["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], na_position="first")
        out = []
        for n, r in enumerate(full.itertuples(index=False)):
            out.append((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, base + n, 0))
        seq0 = base + len(full)
        items = list(rest.itertuples(index=False))
        for r, pieces in zip(items, place([int(r.length) for r in items], capacity), strict=True):
            ids = np.frombuffer(r.ids[1:], f"<u{r.ids[0]}")
            for at, n, seq, offset in pieces:
                out.append((r.doc_id, r.start + at, n, crc(ids[at:at + n]), r.doc_tokens, seq0 + seq, offset))
        names = [x.split()[0] for x in RESULT.split(", ")]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         shard_chars: int = SHARD_CHARS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    Null and empty texts are one id, the end id.  Repeated rows are packed as
    often as they come; a null doc_id stays null.  Equal lengths are placed in
    order of doc_id.  An empty table gives no rows; other columns are not read.
    Rerun on the same rows, the result is the same, whatever cache_words is."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 + chars // shard_chars
    pieces = docs.mapInArrow(_pieces(tokenizer_path, capacity, end_id, cache_words),
                             "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, "
                             "doc_tokens bigint, ids binary")
    return pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards))) \
        .groupBy("shard").applyInPandas(_pack(capacity), RESULT)


__all__ = ["pack", "place", "encode", "materialize"]
