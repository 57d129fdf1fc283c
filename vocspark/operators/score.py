"""Scoring operators: rule scorer, model hook, sentence scoring, classify-and-store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.functions import labels as lb
from vocspark.functions import text as tx


def score_rules(df: DataFrame, text: str = "text", clean: bool = True) -> DataFrame:
    """Deterministic rule scorer (on the cleaned text): adds scores, sentiment,
    confidence and model."""
    src = tx.clean_text(text) if clean else F.col(text)
    d = df.withColumn("_scored_text", src)
    scores, sentiment, confidence = lb.rule_scores("_scored_text")
    return d.withColumns({"scores": scores, "sentiment": sentiment,
                          "confidence": confidence,
                          "model": F.lit(lx.RULE_MODEL_NAME)}).drop("_scored_text")


def argmax_scores(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Label and confidence from a class -> score map (rounded to 4)."""
    label, conf = lb.argmax_scores(scores)
    return df.withColumns({"scores": lb.round_scores(scores),
                           "sentiment": label, "confidence": conf})


def explode_scores(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per (class, probability); a missing map becomes (sentiment, confidence)."""
    m = F.coalesce(F.col("scores"), F.create_map(F.col("sentiment"), F.col("confidence")))
    return df.select(id_col, F.explode(m).alias("class", "probability"))


# Arrow hook ------------------------------------------------------------------

ModelLoader = Callable[[], Callable[[list], list]]

#: Models that one Python worker process keeps (workers are reused).
MODELS_KEPT = 4


def _model_key(loader) -> str:
    """Digest of the loader with all that it closes over: loaders of one factory
    differ."""
    import hashlib

    from pyspark import cloudpickle
    return hashlib.sha256(cloudpickle.dumps(loader)).hexdigest()


def score_with_model(df: DataFrame, loader: ModelLoader, text: str = "text",
                     model_name: str = "model", batch_size: int = 64, salts: int = 1) -> DataFrame:
    """Score with a user model through one Arrow hop (mapInPandas).

    `loader()` returns `predict(texts) -> list of {raw label: score}`; it is
    called once per Python worker, never on the driver with data.  Only the
    distinct cleaned texts and their digests enter Python: equal texts are scored
    once and the scores joined back by digest, so no other column crosses.
    Cleaning, label mapping, rounding and argmax stay native Spark expressions.
    Rows whose output maps to no class get null scores and are kept; a null text
    is one text, which the model sees as None.  A text that very many rows share
    is one join key: AQE splits it, and where that is off `salts` deals its rows
    over so many keys."""
    digest = F.coalesce(F.sha2(F.col("_clean").cast("binary"), 256), F.lit(""))
    cleaned = df.withColumn("_clean", tx.clean_text(text)).withColumn("_digest", digest)
    texts = cleaned.select("_digest", "_clean").dropDuplicates(["_digest"])
    key, most = _model_key(loader), MODELS_KEPT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sys
        import types
        # kept beside the worker's modules: executors need not have this package
        name = "_models_of_worker"
        kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("kept", {})
        predict = kept.get(key)
        if predict is None:
            while len(kept) >= most:
                kept.pop(next(iter(kept)))
            predict = kept[key] = loader()
        for pdf in batches:
            out = []
            texts = pdf["_clean"].tolist()
            for start in range(0, len(texts), batch_size):
                out.extend(predict(texts[start:start + batch_size]))
            yield pd.DataFrame({"_digest": pdf["_digest"], "_raw_scores": [dict(o) if o else None for o in out]})

    found = texts.mapInPandas(run, "_digest string, _raw_scores map<string, double>")
    on = ["_digest"]
    rows = cleaned.drop("_clean")
    if salts > 1:
        found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("_salt", F.floor(F.rand(7) * salts).cast("int"))
        on = ["_digest", "_salt"]
    scored = rows.join(found, on, "left").select(*[F.col(f"`{c}`") for c in df.columns], "_raw_scores")
    scores = lb.normalize_scores("_raw_scores")
    scored = scored.withColumn("scores", F.when(F.size(scores) > 0, scores)).drop("_raw_scores")
    label, conf = lb.argmax_scores("scores")
    return scored.withColumns({"sentiment": label, "confidence": conf,
                               "model": F.lit(model_name)})


def rule_model_loader() -> Callable[[list], list]:
    """The deterministic scorer in model form (for tests of the hook)."""
    pos, neg = lx.RULE_POSITIVE_WORDS, lx.RULE_NEGATIVE_WORDS

    def predict(texts: list) -> list:
        res = []
        for t in texts:
            low = (t or "").lower()
            if any(w in low for w in pos):
                top = ("positive", lx.RULE_POSITIVE_SCORE)
            elif any(w in low for w in neg):
                top = ("negative", lx.RULE_NEGATIVE_SCORE)
            else:
                top = ("neutral", lx.RULE_NEUTRAL_SCORE)
            rest = (1.0 - top[1]) / 2
            d = {lab: rest for lab in ("negative", "neutral", "positive")}
            d[top[0]] = top[1]
            res.append(d)
        return res

    return predict


# Sentences -------------------------------------------------------------------

def score_sentences(df: DataFrame, text: str = "text", id_col: str = "id",
                    max_sentences: int | None = None, min_sentences: int = 2) -> DataFrame:
    """Documents with >= 2 sentences: each sentence scored (the first
    `max_sentences` where that is given)."""
    sents = tx.split_sentences(text)
    d = df.select(id_col, sents.alias("_s")).where(F.size("_s") >= min_sentences)
    kept = F.col("_s") if max_sentences is None else F.slice("_s", 1, max_sentences)
    d = d.select(id_col, F.posexplode(kept).alias("pos", "sentence"))
    d = score_rules(d, "sentence")
    return d.select(id_col, "pos", "sentence", "sentiment", "confidence")


def mixed_sentiment(sentence_scores: DataFrame, id_col: str = "id") -> DataFrame:
    """Per document: Positive and Negative sentence counts and the mixed flag."""
    agg = sentence_scores.groupBy(id_col).agg(
        F.count_if(F.col("sentiment") == "Positive").alias("positive_sentences"),
        F.count_if(F.col("sentiment") == "Negative").alias("negative_sentences"))
    return agg.withColumn("mixed", (F.col("positive_sentences") > 0)
                          & (F.col("negative_sentences") > 0))


# Classify and store ------------------------------------------------------------

def classify_and_store(df: DataFrame, path: str | None = None, persist: bool = True,
                       scorer: Callable[[DataFrame], DataFrame] | None = None,
                       now=None, rejects_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """validate -> clean -> score -> round -> append.  Returns (stored rows,
    rejects).  The stored text is the raw text; scoring sees the cleaned one.
    Rows to store are written once before the append, so that the model scores
    them once.  With a `rejects_path`, rows that break the table's rules after
    scoring (no mappable label) go there and the others are stored; without it
    such a row ends the append."""
    from vocspark.session import materialize
    from vocspark.sources.ingest import append_feedback, validate_request

    valid, rejects = validate_request(df)
    scored = (scorer or score_rules)(valid)
    out = scored.withColumn("confidence", F.round("confidence", 4))
    if persist and path:
        out = materialize(out)
        append_feedback(out.select("id", "text", "sentiment", "confidence", "source",
                                   *[c for c in ("created_at",) if c in out.columns]),
                        path, now=now, rejects_path=rejects_path)
    return out, rejects
