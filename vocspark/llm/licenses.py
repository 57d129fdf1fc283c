"""Fuzzy search for short licence notices.

Texts are reduced to lower-case words.  A notice that may carry k edits is split
into k+1 seeds: one of them stands unchanged in every match (pigeonhole).  Exact
seed hits give windows, in which the regex library's bounded-error matching
verifies the notice: the leftmost place is found, then the best one that overlaps
it, whose span and edits are reported, and the search goes on after it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted exactly, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices found with errors: label, words, edits allowed.
NOTICES = (
    ("gpl", "gnu general public license", 3),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("apache", "licensed under the apache license", 3),
    ("apache", "apache license version 2", 2),
    ("mit", "released under the mit license", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("bsd", "bsd 3 clause license", 2),
    ("mpl", "mozilla public license", 2),
    ("epl", "eclipse public license", 2),
    ("cc-by", "licensed under cc by", 2),
    ("cc-by", "creative commons attribution", 3),
    ("cc-by-nc", "licensed under cc by nc", 1),
    ("cc-by-sa", "licensed under cc by sa", 1),
    ("cc0", "cc0 1 0 universal", 1),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5),
    ("reserved", "all rights reserved", 2),
)

#: Short base phrases: label, what stands before unchanged, what carries edits, what stands after, edits allowed.
SHORT = (
    ("apache", "apache ", "license", "", 2),
    ("mit", "mit ", "license", "", 2),
    ("cc-by", "cc", " ", "by", 1),
)

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))


def words_of(text: str | None) -> bytes:
    """The words of a whole text, lower-cased in ASCII, one space around each."""
    return b" " + b" ".join((text or "").encode().translate(_WORDS).split()) + b" "


def count_words(norm: bytes) -> int:
    return norm.count(b" ") - 1 if len(norm) > 2 else 0


def places(norm: bytes, phrase: bytes) -> list[int]:
    """Starts (byte offset of the first word) where the phrase's words stand."""
    out, at, needle = [], 0, b" " + phrase + b" "
    while (at := norm.find(needle, at)) >= 0:
        out.append(at + 1)
        at += 1
    return out


class Notice:
    def __init__(self, label: str, words: str, edits: int):
        self.label, self.words, self.edits = label, words.encode(), edits
        n, k = len(self.words), edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        self.seeds = [(self.words[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        pattern = rb"(?<= )(?:%b){e<=%d}(?= )" % (regex.escape(self.words, special_only=True), edits)
        self.pattern, self.best = regex.compile(pattern), regex.compile(rb"(?b)" + pattern)


class ShortNotice(Notice):
    """A notice of which only the middle carries edits, one of them a letter too
    many or too few at most; what stands before is the seed."""

    def __init__(self, label: str, before: str, middle: str, after: str, edits: int):
        self.label, self.words, self.edits = label, (before + middle + after).encode(), edits
        self.seeds = [(b" " + before.encode(), -1)]
        pattern = rb"(?<= )%b(?:%b){i<=1,d<=1,s<=%d,e<=%d}%b(?= )" % tuple(
            x if isinstance(x, int) else regex.escape(x.encode(), special_only=True)
            for x in (before, middle, edits, edits, after))
        self.pattern, self.best = regex.compile(pattern), regex.compile(rb"(?b)" + pattern)


def notices() -> list[Notice]:
    return [Notice(*x) for x in NOTICES] + [ShortNotice(*x) for x in SHORT]


def fuzzy(norm: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the notice's verified places, apart from each other."""
    windows, slack, n = [], notice.edits + 1, len(notice.words)
    for seed, offset in notice.seeds:
        at = norm.find(seed)
        while at >= 0:
            windows.append((max(0, at - offset - slack), min(len(norm), at - offset + n + slack)))
            at = norm.find(seed, at + 1)
    if not windows:
        return []
    windows.sort()
    merged = [list(windows[0])]
    for a, b in windows[1:]:
        if a <= merged[-1][1] - 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out = []
    for a, b in merged:
        if b - a < n - notice.edits:
            continue
        a, b = max(0, a - 1), min(len(norm), b + 1)
        while m := notice.pattern.search(norm, a, b):
            # no other place fits into what is searched again
            m = notice.best.search(norm, m.start(), min(b, m.end() + slack)) or m
            out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            a = m.end()
    return out


def scan(text: str | None, found: list[Notice]) -> dict:
    norm = words_of(text)
    starts, labels = [], set()
    for phrase, label in BASE.items():
        at = places(norm, phrase.encode())
        starts += at
        if at:
            labels.add(label)
    spans, best = [], 1.0 if starts else 0.0
    hits = [(x, *hit) for x in found for hit in fuzzy(norm, x)]
    # places of all words once: a look-up per span
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32) if hits or starts else np.empty(0, np.int64)

    def word(at: int) -> int:
        return int(np.searchsorted(spaces, at)) - 1

    for x, a, b, e in hits:
        spans.append({"label": x.label, "first_word": word(a), "last_word": word(b), "edits": e,
                      "text": norm[a:b].decode(errors="replace")})
        best = max(best, 1 - e / len(x.words))
    at = [word(s) for s in ((min(starts), max(starts)) if starts else ())]
    return {"n_words": count_words(norm), "n_base": len(starts), "first_word": at[0] if at else None,
            "last_word": at[1] if at else None, "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {s["label"] for s in spans})), "score": float(best),
            "spans": spans}


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                            ("edits", pa.int64()), ("text", pa.string())]))
SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,"
          "edits:bigint,text:string>>")


def _scan(batches):
    found = notices()
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPANS]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    for b in batches:
        rows = [scan(t.as_py(), found) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *[pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)]],
            ["doc_id", *names])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): counts and places of the base phrases,
    labels, score (1 less edits per character of the best place) and all fuzzy
    spans (words from first_word to last_word, both included).

    Null and empty texts have no words and no labels; an empty table gives no
    rows; repeated rows each give a row; other columns are not read."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scan, SCHEMA)
