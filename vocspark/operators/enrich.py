"""Per-row enrichment operators (DataFrame -> DataFrame).

All are stateless projections, so they run unchanged on streaming frames.
Tokens are computed once in their own projection; Catalyst keeps that
projection (it does not inline a costly expression used many times).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.functions import lexical as lex
from vocspark.functions import text as tx

TOKENS = "_tokens"
PRESENT = "_present"


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def with_tokens(df: DataFrame, text: str = "text", name: str = TOKENS) -> DataFrame:
    return df.withColumn(name, tx.word_tokens(text))


def _with_hits(df: DataFrame, parts, tokens: str = TOKENS) -> DataFrame:
    """Adds one hit-count column per category (distinct lexicon words among
    the tokens) for each (lexicon, column names) in `parts`.  The tokens are
    narrowed once to the words of all the lexicons; a disjoint lexicon then
    takes one lambda pass (each matched word -> its category index) and
    native counts.  Lambda-bearing projections leave whole-stage codegen, so
    all lexicons share them: two such projections in all."""
    lexicons = [lexicon for lexicon, _ in parts]
    d = df.withColumn(PRESENT, lex.present_words(tokens, *lexicons))
    staged, counts = {}, {}
    for i, (lexicon, names) in enumerate(parts):
        if lex.disjoint(lexicon):
            staged[f"_codes{i}"] = lex.category_codes(PRESENT, lexicon)
            counts.update(zip(names, lex.hits_from_codes(f"_codes{i}", len(lexicon))))
        else:
            counts.update(zip(names, lex.category_hits(PRESENT, lexicon)))
    d = d.withColumns(staged) if staged else d
    return d.withColumns(counts).drop(PRESENT, *staged)


def lexicon_hits(df: DataFrame, text: str = "text", lexicon=lx.EMOTION_LEXICON,
                 prefix: str = "hits_") -> DataFrame:
    """One column per category: distinct lexicon words present in the text."""
    t = _with_hits(with_tokens(df, text), [(lexicon, [f"{prefix}{slug(n)}" for n, _ in lexicon])])
    return t.drop(TOKENS)


def _signals(df: DataFrame, text: str) -> tuple[DataFrame, list[str], list[str]]:
    emo = [f"_e_{slug(n)}" for n, _ in lx.EMOTION_LEXICON]
    asp = [f"_a_{slug(n)}" for n, _ in lx.ASPECTS]
    t = _with_hits(with_tokens(df, text), [(lx.EMOTION_LEXICON, emo), (lx.ASPECTS, asp)])
    cols = {"_intens": tx.intensifier_count(TOKENS)}
    cols["_exclaim"] = tx.exclamation_count(text)
    cols["_caps"] = tx.shout_count(text)
    return t.withColumns(cols), emo, asp


def enrich_feedback(df: DataFrame, text: str = "text", sentiment: str = "sentiment",
                    confidence: str = "confidence", keep_aspects: bool = False) -> DataFrame:
    """Adds emotion, intensity, risk, driver and csat (and, with
    `keep_aspects`, the `aspects` list and `topic` from the same token pass)."""
    s, emo, asp = _signals(df, text)
    hit_map = {n: F.col(c) for (n, _), c in zip(lx.EMOTION_LEXICON, emo)}
    emotion, top = lex.emotion_and_top_hits(sentiment, hit_map)
    s = s.withColumns({"emotion": emotion, "_top": top})
    s = s.withColumn("intensity", lex.emotion_intensity(
        sentiment, confidence, "_top", "_intens", "_exclaim", "_caps"))
    s = s.withColumns({
        "risk": lex.risk_level(sentiment, "intensity", confidence),
        "driver": lex.category_driver(asp),
        "csat": lex.csat_equivalent(sentiment, confidence),
    })
    if keep_aspects:
        s = s.withColumn("aspects", lex.matched_aspects(asp))
        s = s.withColumn("topic", lex.item_topic("aspects"))
    return s.drop(TOKENS, *emo, *asp, "_intens", "_exclaim", "_caps", "_top")


def emotion_signals(df: DataFrame, text: str = "text") -> DataFrame:
    """Intensifier, exclamation and shouting counts (B6-B8 inputs to intensity)."""
    t = with_tokens(df, text)
    return t.withColumns({
        "intensifiers": tx.intensifier_count(TOKENS),
        "exclamations": tx.exclamation_count(text),
        "caps_words": tx.shout_count(text),
    }).drop(TOKENS)


def with_aspects(df: DataFrame, text: str = "text", name: str = "aspects") -> DataFrame:
    """Every aspect with at least one token hit, declared order, and the topic."""
    t = with_tokens(df, text)
    asp = [f"_a_{slug(n)}" for n, _ in lx.ASPECTS]
    t = _with_hits(t, [(lx.ASPECTS, asp)])
    t = t.withColumn(name, lex.matched_aspects(asp))
    return t.withColumn("topic", lex.item_topic(name)).drop(TOKENS, *asp)


def with_confidence_band(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    band, note = lex.confidence_band(confidence)
    return df.withColumns({"band": band, "band_note": note})


def text_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """Words, characters, sentences (min 1) and exclamation marks."""
    return df.withColumns({
        "words": tx.word_count(text),
        "characters": tx.char_count(text),
        "sentences": tx.sentence_count(text),
        "exclamations": tx.exclamation_count(text),
    })


def reply_draft(df: DataFrame, text: str = "text", sentiment: str = "sentiment",
                customer_name: str = lx.DEFAULT_CUSTOMER_NAME) -> DataFrame:
    """Meaning, recommended action and a filled reply template per item.
    The three templates are literal CASE branches, so no join is needed."""
    t = with_aspects(df, text, "_aspects")
    tmpl = lex.lookup(sentiment, lx.RESPONSE_TEMPLATES)
    reply = F.replace(F.replace(tmpl, F.lit("{name}"), F.lit(customer_name)),
                      F.lit("{topic}"), F.col("topic"))
    return t.withColumns({
        "meaning": lex.lookup(sentiment, lx.WHAT_IT_MEANS),
        "action": lex.lookup(sentiment, lx.RECOMMENDED_ACTION),
        "reply": reply,
    }).drop("_aspects", "topic")


def tag_sentiment_words(df: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """One row per token run: (id, pos, token, tag)."""
    return df.select(id_col, F.posexplode(tx.tag_tokens(text)).alias("pos", "t")) \
        .select(id_col, "pos", F.col("t.token").alias("token"), F.col("t.tag").alias("tag"))


def lexicon_match_join(df: DataFrame, lexicon_df: DataFrame, text: str = "text",
                       id_col: str = "id") -> DataFrame:
    """Hit counts for a lexicon too large for literal arrays: distinct tokens
    per row joined to the lexicon rows.  The lexicon is broadcast after a
    bounded size check (the token side streams, no shuffle for the join);
    a lexicon past the bound is joined by shuffling both sides on the word.
    All tokens of a row stay in one partition, so the partial aggregate is
    already final per (row, category) and one row per pair is shuffled."""
    from vocspark.operators.joins import broadcast_if_small
    toks = df.select(id_col, F.explode(F.array_distinct(tx.word_tokens(text))).alias("word"))
    lex_rows = broadcast_if_small(lexicon_df.select("category", "cat_rank", "word"))
    return (toks.join(lex_rows, "word")
            .groupBy(id_col, "category", "cat_rank")
            .agg(F.count("*").alias("hits")))
