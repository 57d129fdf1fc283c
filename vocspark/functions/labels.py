"""Label and score columns: normalisation, argmax over a score map, the
deterministic rule scorer, corpus label rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.functions.text import col, str_array


def _map_literal(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def normalize_label(raw) -> Column:
    """Raw model label (any case) -> Negative/Neutral/Positive, else null."""
    return F.try_element_at(_map_literal(lx.LABEL_MAP), F.lower(col(raw)))


def class_index(label) -> Column:
    """0/1/2 for Negative/Neutral/Positive, null otherwise."""
    pos = F.array_position(str_array(lx.CLASSES), col(label))
    return F.when(pos > 0, (pos - 1).cast("int"))


def class_name(index) -> Column:
    return F.get(str_array(lx.CLASSES), col(index).cast("int"))


def argmax_scores(scores) -> tuple[Column, Column]:
    """(label, confidence) = key and value of the largest score, values rounded
    to 4 places; ties go to the earlier class in CLASSES order."""
    ranks = str_array(lx.CLASSES)
    best = F.array_max(F.transform(
        F.map_entries(col(scores)),
        lambda e: F.struct(F.round(e["value"], 4).alias("v"),
                           (-F.array_position(ranks, e["key"])).alias("r"),
                           e["key"].alias("k"))))
    return best["k"], best["v"]


def round_scores(scores) -> Column:
    return F.transform_values(col(scores), lambda k, v: F.round(v, 4))


def normalize_scores(raw_scores) -> Column:
    """Model output map (raw label -> score) to class map, unknown labels dropped,
    scores rounded to 4 places."""
    entries = F.transform(F.map_entries(col(raw_scores)),
                          lambda e: F.struct(normalize_label(e["key"]).alias("key"),
                                             F.round(e["value"], 4).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull()))


def _rest(top: float) -> float:
    return round((1.0 - top) / 2, 4)


def _any_contains(low: Column, words) -> Column:
    out = None
    for w in words:
        t = low.contains(w)
        out = t if out is None else (out | t)
    return out


def rule_label_lowered(low) -> Column:
    """Rule sentiment of an already lower-cased (cleaned) text.  For use
    inside higher-order functions, where Spark does not share common
    subexpressions: the caller lower-cases and cleans each element once."""
    low = col(low)
    return (F.when(_any_contains(low, lx.RULE_POSITIVE_WORDS), "Positive")
            .when(_any_contains(low, lx.RULE_NEGATIVE_WORDS), "Negative").otherwise("Neutral"))


def rule_scores(text) -> tuple[Column, Column, Column]:
    """Deterministic scorer on the (cleaned) text by substring tests:
    returns (scores map, sentiment, confidence)."""
    low = F.lower(col(text))
    is_pos = _any_contains(low, lx.RULE_POSITIVE_WORDS)
    is_neg = _any_contains(low, lx.RULE_NEGATIVE_WORDS)
    p, n, u = lx.RULE_POSITIVE_SCORE, lx.RULE_NEGATIVE_SCORE, lx.RULE_NEUTRAL_SCORE
    neg_s = F.when(is_pos, _rest(p)).when(is_neg, round(n, 4)).otherwise(_rest(u))
    neu_s = F.when(is_pos, _rest(p)).when(is_neg, _rest(n)).otherwise(round(u, 4))
    pos_s = F.when(is_pos, round(p, 4)).when(is_neg, _rest(n)).otherwise(_rest(u))
    scores = F.create_map(F.lit("Negative"), neg_s, F.lit("Neutral"), neu_s,
                          F.lit("Positive"), pos_s)
    sentiment = F.when(is_pos, "Positive").when(is_neg, "Negative").otherwise("Neutral")
    confidence = F.when(is_pos, round(p, 4)).when(is_neg, round(n, 4)).otherwise(round(u, 4))
    return scores, sentiment, confidence


def stars_to_label(stars) -> Column:
    """Five-star label (stars - 1, 0..4) -> 0/1/2."""
    s = col(stars)
    return F.when(s <= 1, 0).when(s == 2, 1).when(s <= 4, 2).cast("int")


def binary_to_label(label) -> Column:
    """Binary corpus: 0 -> 0 (Negative), anything else -> 2 (Positive)."""
    return F.when(col(label) == 0, 0).otherwise(2).cast("int")


def parse_text_label(raw) -> Column:
    """Strip, title-case, keep one of the three names; returns its index."""
    from vocspark.functions.text import title_case, ws_trim
    return class_index(title_case(ws_trim(raw)))


def flag_to_label(flag) -> Column:
    return F.when(col(flag) == 1, "Yes").when(col(flag) == 0, "No")
