"""Lexicon rules as Column expressions: hits, argmax with declared-order ties,
intensity, risk, driver, CSAT, bands.  No UDF: every rule is a native
expression, so it runs inside whole-stage codegen on batch and streams.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.functions.text import col


def present_words(tokens, *lexicons) -> Column:
    """Distinct tokens that are words of any category of `lexicons`: one
    hash-set test per token (usually leaves a handful of words)."""
    every = sorted({w for lexicon in lexicons for _, words in lexicon for w in words})
    return F.array_distinct(F.filter(col(tokens), lambda w: w.isin(*every)))


def category_hits(present, lexicon) -> list[Column]:
    """Per category: number of distinct lexicon words present.  `present` is
    the output of `present_words` (stage it as a column: it is read once per
    category), so each test runs on the few matched words, not all tokens.
    General form (categories may share words); see `category_codes` for the
    faster form used when they do not."""
    p = col(present)
    return [F.size(F.filter(p, lambda w: w.isin(*words))) for _, words in lexicon]


def disjoint(lexicon) -> bool:
    """True when no word belongs to two categories of the lexicon."""
    seen: set = set()
    for _, words in lexicon:
        if seen & set(words):
            return False
        seen |= set(words)
    return True


def category_codes(present, lexicon) -> Column:
    """Category index of every present word (categories must be disjoint).
    One lambda pass per row; stage the result as a column and count each
    category with `hits_from_codes` (native array functions, no lambda)."""
    def code(w):
        pick = None
        for i, (_, words) in enumerate(lexicon):
            pick = F.when(w.isin(*words), F.lit(i)) if pick is None else pick.when(w.isin(*words), F.lit(i))
        return pick
    return F.transform(col(present), code)


def hits_from_codes(codes, n: int) -> list[Column]:
    """Occurrences of each category index 0..n-1 in a codes array."""
    c = col(codes)
    return [F.size(c) - F.size(F.array_remove(c, F.lit(i))) for i in range(n)]


def argmax_first(names, hits, default) -> tuple[Column, Column]:
    """(name of the first category holding the largest count, largest count);
    `default` when the largest count is 0."""
    hits = [col(h) for h in hits]
    top = F.greatest(*hits) if len(hits) > 1 else hits[0]
    pick = F.when(top == 0, F.lit(default))
    for name, h in zip(names, hits):
        pick = pick.when(h == top, F.lit(name))
    return pick, top


def emotion_and_top_hits(sentiment, hit_cols: dict) -> tuple[Column, Column]:
    """Dominant emotion among the sentiment's candidates, and its hit count.

    hit_cols maps emotion name -> hit Column (all five emotions)."""
    s = col(sentiment)
    defaults = dict(lx.DEFAULT_EMOTION)
    neg = [n for n, _ in lx.EMOTION_LEXICON if n in lx.NEGATIVE_EMOTIONS]
    pos = [n for n, _ in lx.EMOTION_LEXICON if n in lx.POSITIVE_EMOTIONS]
    every = [n for n, _ in lx.EMOTION_LEXICON]
    neg_e, neg_t = argmax_first(neg, [hit_cols[n] for n in neg], defaults["Negative"])
    pos_e, pos_t = argmax_first(pos, [hit_cols[n] for n in pos], defaults["Positive"])
    all_e, all_t = argmax_first(every, [hit_cols[n] for n in every],
                                lx.NEUTRAL_DEFAULT_EMOTION)
    emotion = (F.when(s == "Negative", neg_e).when(s == "Positive", pos_e)
               .otherwise(all_e))
    top = F.when(s == "Negative", neg_t).when(s == "Positive", pos_t).otherwise(all_t)
    return emotion, top


def emotion_intensity(sentiment, confidence, top_hits, intensifiers, exclaims,
                      caps) -> Column:
    """int(min(100, base + 14*hits + 8*intensifiers + 6*'!' + 6*caps)); the
    sum is built left to right as the reference does, so doubles agree."""
    s, c = col(sentiment), col(confidence)
    base = F.when(s.eqNullSafe("Neutral"), F.lit(lx.INTENSITY_BASE_NEUTRAL) * c) \
        .otherwise(F.lit(lx.INTENSITY_BASE) * c)
    raw = (base + F.lit(lx.INTENSITY_PER_HIT) * col(top_hits)
           + F.lit(lx.INTENSITY_PER_INTENSIFIER) * col(intensifiers)
           + F.lit(lx.INTENSITY_PER_EXCLAIM) * col(exclaims)
           + F.lit(lx.INTENSITY_PER_CAPS) * col(caps))
    return F.least(F.lit(float(lx.INTENSITY_MAX)), raw).cast("int")


def risk_level(sentiment, intensity, confidence) -> Column:
    s = col(sentiment)
    high = (s == "Negative") & ((col(intensity) >= lx.RISK_INTENSITY)
                                | (col(confidence) >= F.lit(lx.RISK_CONFIDENCE)))
    return (F.when(high, "High").when(s == "Negative", "Medium")
            .when(s == "Neutral", "Low").otherwise("None"))


def category_driver(aspect_hit_cols) -> Column:
    names = [n for n, _ in lx.ASPECTS]
    pick, _ = argmax_first(names, aspect_hit_cols, lx.DEFAULT_DRIVER)
    return pick


def matched_aspects(aspect_hit_cols, aspects=lx.ASPECTS) -> Column:
    """Names of every aspect with at least one hit, in declared order."""
    flagged = F.array(*[F.when(col(h) > 0, F.lit(name))
                        for (name, _), h in zip(aspects, aspect_hit_cols)])
    return F.filter(flagged, lambda x: x.isNotNull())


def item_topic(aspects_col) -> Column:
    return F.coalesce(F.lower(F.get(col(aspects_col), 0)), F.lit(lx.DEFAULT_TOPIC))


def csat_equivalent(sentiment, confidence) -> Column:
    """Positive round(4+c, 2), Negative round(2-c, 2), else 3.0, through
    DECIMAL so the rounding is exact half-up in every engine."""
    s = col(sentiment)
    c = F.try_cast(col(confidence), "decimal(5,4)") if hasattr(F, "try_cast") \
        else col(confidence).cast("decimal(5,4)")
    pos = F.round(F.lit(4).cast("decimal(1,0)") + c, 2).cast("double")
    neg = F.round(F.lit(2).cast("decimal(1,0)") - c, 2).cast("double")
    return F.when(s == "Positive", pos).when(s == "Negative", neg).otherwise(F.lit(3.0))


def confidence_band(confidence) -> tuple[Column, Column]:
    c = col(confidence)
    band = None
    note = None
    for threshold, name, text in lx.CONFIDENCE_BANDS[:-1]:
        cond = c >= F.lit(threshold)
        band = F.when(cond, name) if band is None else band.when(cond, name)
        note = F.when(cond, text) if note is None else note.when(cond, text)
    _, low_name, low_text = lx.CONFIDENCE_BANDS[-1]
    return band.otherwise(low_name), note.otherwise(low_text)


def lookup(key, pairs) -> Column:
    """Value for key from a small fixed (key, value) list; null when absent."""
    expr = None
    for k, v in pairs:
        expr = F.when(col(key) == k, v) if expr is None else expr.when(col(key) == k, v)
    return expr
