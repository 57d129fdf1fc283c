"""Language identification in two steps: a linear machine per language family
(one against the rest) picks the family; within it, one machine per pair of
languages votes.  Features are hashed letter n-grams (bytes in runs of 1 to 4 of
the lower-cased text, non-letters of ASCII as spaces), square roots of counts in
unit length, so a text's length and its junk symbols matter little."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import blocks, bounded_sample, char_grams, dual_descent, packed

BITS = 14
#: Labelled rows of each language that the fit reads at most (about).
MAX_PER_LANG = 1500
#: Words in the snippets that are learned beside each whole text.
SNIPPET = 6
UNKNOWN = "und"

#: Families of ISO 639-1 codes; a code that isn't listed is a family by itself.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ne pa gu ur",
    "semitic": "ar he mt am",
}

_SPACES = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A letter by its Unicode category: number signs such as Ⅷ or ½ are none.
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if base in codes.split()), lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def gram_counts(text: str) -> np.ndarray:
    b = b" " + text.lower().encode().translate(_SPACES) + b" "
    b = re.sub(rb" {2,}", b" ", b)
    out = np.zeros(1 << BITS, np.float64)
    for part in blocks(b, 3):
        for n in range(1, 5):
            out += np.bincount(char_grams(part, n, BITS), minlength=1 << BITS)
    return out


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = gram_counts(text)
    ids = np.flatnonzero(counts)
    v = np.sqrt(counts[ids])
    return ids, v / np.sqrt(counts.sum())


class Model:
    """families: names; family_w: a column of weights each (bias last row);
    inside: family -> (languages, pairs, a column of weights per pair)."""

    def __init__(self, families, family_w, inside):
        self.families, self.family_w, self.inside = families, family_w, inside

    def predict(self, text: str) -> tuple[str, float]:
        ids, v = vector(text)
        sure = 1.0
        at = 0
        if len(self.families) > 1:
            m = v @ self.family_w[ids] + self.family_w[-1]
            p = np.exp(3 * (m - m.max()))
            at = int(m.argmax())
            sure = float(p[at] / p.sum())
        langs, pairs, w = self.inside[self.families[at]]
        if len(langs) == 1:
            return langs[0], sure
        m = v @ w[ids] + w[-1]
        votes, power = np.zeros(len(langs)), np.zeros(len(langs))
        for (i, j), x in zip(pairs, m, strict=True):
            votes[i if x >= 0 else j] += 1
            power[i] += x
            power[j] -= x
        best = max(range(len(langs)), key=lambda i: (votes[i], power[i], -i))
        p = np.exp(3 * (power - power.max()) / max(len(langs) - 1, 1))
        return langs[best], sure * float(p[best] / p.sum())


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Model | None:
    if not rows:
        return None
    dim = 1 << BITS
    names = sorted(set(langs))
    groups: dict[str, list[str]] = {}
    for x in names:
        groups.setdefault(family_of(x), []).append(x)
    families = sorted(groups)
    lang = np.array(langs, object)
    fam = np.array([family_of(x) for x in langs], object)
    two = len(families) == 2  # one machine serves both sides
    cols = [dual_descent(rows, np.where(fam == f, 1.0, -1.0), dim) for f in (families[:1] if two else families)] \
        if len(families) > 1 else []
    if two:
        cols.append(-cols[0])
    inside = {}
    for f in families:
        own = groups[f]
        pairs = list(combinations(range(len(own)), 2))
        w = []
        for i, j in pairs:
            at = np.flatnonzero((lang == own[i]) | (lang == own[j]))
            w.append(dual_descent([rows[k] for k in at], np.where(lang[at] == own[i], 1.0, -1.0), dim))
        inside[f] = (own, pairs, np.array(w).T.copy() if w else None)
    return Model(families, np.array(cols).T.copy() if cols else None, inside)


def _features(batches):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            langs, ids, vals = [], [], []
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                if not has_letter(text):
                    continue
                words = text.split()
                pieces = [text]
                if len(words) > SNIPPET:
                    mid = len(words) * (sum(map(ord, words[0])) % 97) // 97
                    pieces.append(" ".join(words[min(mid, len(words) - SNIPPET):][:SNIPPET]))
                for x in pieces:
                    i, v = vector(x)
                    langs.append(lang)
                    ids.append(i.astype(np.uint16))
                    vals.append(v.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), packed(ids), packed(vals)],
                                             ["lang", "ids", "vals"])


def fit(docs: DataFrame, max_per_lang: int = MAX_PER_LANG) -> Model | None:
    """docs (doc_id, text, lang): rows to learn from.  The sample is bounded by
    about max_per_lang rows of each language, each a whole text and a snippet."""
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    rows = bounded_sample(rows, "lang", max_per_lang, F.xxhash64("doc_id"))
    got = rows.mapInArrow(_features, "lang string, ids binary, vals binary").toArrow()
    order = sorted(zip(*(got.column(c).to_pylist() for c in ("lang", "ids", "vals")), strict=True))
    del got  # the sample stays once, as bytes that the rows look into
    return fit_rows([(np.frombuffer(i, np.uint16), np.frombuffer(v, np.float32)) for _, i, v in order],
                    [x for x, _, _ in order])


def _predict(model: Model | None):
    def run(batches):
        for b in batches:
            lang, score = [], []
            for t in b.column("text"):
                text = t.as_py()
                x, s = model.predict(text) if model is not None and has_letter(text) else (UNKNOWN, 0.0)
                lang.append(x)
                score.append(s)
            rest = [b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             [*b.schema.names, "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score from the whole of `text` alone; columns of these
    names that were there are replaced.  Null texts, texts without a letter and,
    without a model, all texts are `und` with score 0.  Repeated rows are
    treated alike, an empty table stays empty, other columns pass through."""
    docs = docs.drop("lang_pred", "score")
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(_predict(model), schema)
