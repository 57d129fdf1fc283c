"""Secrets in texts: named patterns, and strings that look random.

Candidate strings are maximal runs of key characters.  In each, a window slides
over every run of one character class, and the Shannon entropy of the window is
kept by incremental counts: a step takes one character out and one in, and
corrects the sum of c * log2(c) by two table look-ups.  The sums are integers
(scaled logarithms), so a window's entropy does not depend on the way to it.
Windows at or above the class's bound join to spans.  An allow-list of harmless
forms (UUIDs, paths and slugs of plain words, counting and repeating strings,
placeholders) suppresses spans of this kind; pattern spans always stay."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from functools import cache
from itertools import accumulate
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Named patterns: kind, pattern, group whose length counts, least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
#: No assignment without one of these (looked up in the lower-cased text).
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: What a random-looking string consists of, and how long it is at least.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")


class CharClass(NamedTuple):
    """A character class: its runs, the window over them, the least entropy of a
    window in bits a character, and what a window has to hold besides."""

    kind: str
    run: re.Pattern
    window: int
    bits: float
    needs: tuple[str, ...]


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Narrow classes first: what they report is not reported again by wider ones.
CLASSES = (
    CharClass("random_hex", re.compile(r"[0-9a-f]{24,}|[0-9A-F]{24,}"), 24, 3.0, (DIGITS, "abcdefABCDEF")),
    CharClass("random_base32", re.compile(r"[A-Z0-9]{20,}|[a-z0-9]{20,}"), 20, 3.6, (DIGITS, LOWER + UPPER)),
    CharClass("random_base64", re.compile(r"[A-Za-z0-9+/]{20,}={0,2}"), 20, 3.8, (DIGITS, LOWER, UPPER)),
    CharClass("random_url", re.compile(r"[A-Za-z0-9_-]{20,}"), 20, 3.8, (DIGITS, LOWER, UPPER)),
)
KINDS = [x[0] for x in BASE] + [c.kind for c in CLASSES]

#: Harmless forms of a whole candidate string.
ALLOWED = (
    re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I),
    re.compile(r"[+/_=-]*(([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})([+/_=-]+|$))+"),
)
#: A candidate that holds one of these (lower-cased) is a placeholder.
PLACEHOLDERS = ("example", "placeholder", "changeme", "your_", "your-", "xxxxxx", "dummy", "redacted")

SCALE, PERIOD = 1 << 40, 64


@cache
def scaled_logs(window: int) -> list[int]:
    """c * log2(c), scaled to integers, for the counts 0 to `window` + 1 (a
    character comes in before one goes out)."""
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 2)]


def dense_windows(run: str, c: CharClass) -> list[tuple[int, int, float]]:
    """(start, end, highest entropy) of the joined windows of a run that reach
    the class's bound.  One pass; each step changes two counts."""
    w, logs = c.window, scaled_logs(c.window)
    need = [frozenset(x) for x in c.needs]
    bound = round((math.log2(w) - c.bits) * w * SCALE)  # entropy >= bits, where the sum is at most this
    count: dict[str, int] = {}
    held, total, out = [0] * len(need), 0, []
    for at, ch in enumerate(run):
        n = count.get(ch, 0)
        total += logs[n + 1] - logs[n]
        count[ch] = n + 1
        for i, x in enumerate(need):
            held[i] += ch in x
        if at >= w:
            gone = run[at - w]
            n = count[gone]
            total += logs[n - 1] - logs[n]
            count[gone] = n - 1
            for i, x in enumerate(need):
                held[i] -= gone in x
        if at >= w - 1 and total <= bound and all(held):
            bits = math.log2(w) - total / SCALE / w
            if out and at - w + 1 <= out[-1][1]:
                out[-1] = (out[-1][0], at + 1, max(out[-1][2], bits))
            else:
                out.append((at - w + 1, at + 1, bits))
    return out


def counts_up(s: str) -> bool:
    """Whether most characters follow the one before (abc..., 012...) or the
    string repeats a part of at most PERIOD characters of itself."""
    steps = sum(ord(b) - ord(a) in (0, 1, -1) for a, b in zip(s, s[1:]))
    return 2 * steps >= len(s) or any(s.startswith(s[p:]) for p in range(1, min(PERIOD, len(s) // 3) + 1))


def allowed(candidate: str) -> bool:
    low = candidate.lower()
    return any(p.fullmatch(candidate) for p in ALLOWED) or any(x in low for x in PLACEHOLDERS)


def find_secrets(text: str | None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, entropy) of a whole text, in code points, end
    exclusive, by start, then in the order of KINDS."""
    text = text or ""
    found: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    random = []
    for cand in CANDIDATE.finditer(text):
        # runs of the two other patterns lie inside candidates
        s, at = cand.group(), cand.start()
        for kind, pattern, _, least in BASE[1:]:
            found += [(kind, at + m.start(), at + m.end(), None)
                      for m in pattern.finditer(s) if m.end() - m.start() >= least]
        if len(s) < 20 or not any(map(str.isdigit, s)) or allowed(s):
            continue
        for c in CLASSES:
            for m in c.run.finditer(s):
                for a, b, bits in dense_windows(m.group(), c):
                    if not counts_up(m.group()[a:b]):
                        random.append((c.kind, at + m.start() + a, at + m.start() + b, bits))
    for order in range(len(CLASSES)):
        # a span lies inside another one if the furthest end among those that start no later covers it
        found.sort(key=itemgetter(1))
        starts, ends = [f[1] for f in found], list(accumulate((f[2] for f in found), max))
        for r in random:
            at = bisect_right(starts, r[1])
            if r[0] == CLASSES[order].kind and not (at and ends[at - 1] >= r[2]):
                found.append(r)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                            ("entropy", pa.float64()), ("text", pa.string())]))
SCHEMA = ("doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,entropy:double,text:string>>")


def _scan(batches):
    for b in batches:
        rows = []
        for t in b.column(1):
            t = t.as_py()
            rows.append([{"kind": k, "start": s, "end": e, "entropy": h, "text": t[s:e]}
                         for k, s, e, h in find_secrets(t)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, SPANS)], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): all spans, by start and kind, with
    kind, start and end in code points, the entropy of random-looking spans
    (null for patterns) and the text itself.

    A random-looking span inside another span is not reported again.  Null and
    empty texts have no spans; an empty table gives no rows; repeated rows each
    give a row, null ids too; other columns are not read."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_scan, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts per pattern, the digest of the pattern spans and all spans as
    text, from what `scan_secrets` found."""
    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    kinds = [k for k, *_ in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in kinds],
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
