"""Model evaluation, corpora and the TF-IDF + logistic-regression baseline.

Reports are computed from the (label, pred) count table, which has at most
classes^2 rows per test set, so everything after the first aggregation is
tiny regardless of the input size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.functions import text as tx
from vocspark.operators import rank


def _keys(group):
    return [group] if group else []


def per_class_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                      group: str | None = None) -> DataFrame:
    """Per (group, class): support, predicted, tp, precision, recall, f1
    (0 where the divisor is 0)."""
    keys = _keys(group)
    pairs = df.groupBy(*keys, label, pred).agg(F.count(F.lit(1)).alias("n"))
    roles = F.array(
        F.struct(F.col(label).cast("string").alias("cls"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col(label).eqNullSafe(F.col(pred)), F.col("n"))
                 .otherwise(F.lit(0).cast("long")).alias("tp")),
        F.struct(F.col(pred).cast("string").alias("cls"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))
    r = pairs.select(*keys, F.inline(roles))
    per = r.groupBy(*keys, "cls").agg(F.sum("support").alias("support"),
                                      F.sum("predicted").alias("predicted"),
                                      F.sum("tp").alias("tp"))
    z = F.lit(0.0)
    return per.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), z),
        "recall": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), z),
        "f1": F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"),
                                      F.col("support") + F.col("predicted")), z),
    })


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred",
                          group: str | None = None, digits: int = 6) -> DataFrame:
    """Rows per class plus 'accuracy', 'macro avg' and 'weighted avg'
    (accuracy row: all three metrics = accuracy, support = n)."""
    keys = _keys(group)
    per = per_class_metrics(df, label, pred, group)
    classes = per.where(F.col("support") + F.col("predicted") > 0)
    tot = classes.groupBy(*keys).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = F.col("tp") / F.col("n")
    summary = tot.select(*keys, F.inline(F.array(
        F.struct(F.lit("accuracy").alias("cls"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("cls"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("cls"), (F.col("wp") / F.col("n")).alias("precision"),
                 (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1"),
                 F.col("n").alias("support")))))
    rows = classes.select(*keys, "cls", "precision", "recall", "f1", "support").unionByName(summary)
    return rows.select(*keys, "cls", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                       "support")


def model_figures(spark, paths: Sequence[str]) -> DataFrame:
    """The landing figures (accuracy, test_size as text) from the first stored
    evaluation of `paths`, or the fixed ones where there is none or it has no
    accuracy."""
    from vocspark.sources.ingest import read_metric_rows
    default = [F.lit(lx.DEFAULT_MODEL_FIGURES[c]).alias(c) for c in ("accuracy", "test_size")]
    rows = read_metric_rows(spark, list(paths))
    if rows is None:
        return spark.range(1).select(*default)
    s = metrics_summary(rows)
    known = F.col("accuracy_label").isNotNull()
    return s.select(*[F.when(known, F.col(f"{c}_label")).otherwise(d).alias(c)
                      for c, d in zip(("accuracy", "test_size"), default, strict=True)])


def metrics_summary(rows: DataFrame, preferred: Sequence[str] = ("documents_test", "feedback_test"),
                    test_set: str = "test_set") -> DataFrame:
    """Landing-page model figures from stored evaluation rows (see
    `classification_report(..., group=test_set)`): the accuracy of the first
    test set in `preferred` that is present, and the test rows summed over
    every test set.  One row; the input has classes + 3 rows per test set."""
    from vocspark.operators.report import fmt0, fmt_int
    acc = rows.where(F.col("cls") == "accuracy")
    rank_ = F.array_position(tx.str_array(preferred), F.col(test_set))
    s = acc.agg(F.min_by("precision", F.when(rank_ > 0, rank_)).alias("accuracy"),
                F.sum("support").alias("test_size"))
    return s.select("accuracy",
                    F.concat(fmt0(F.col("accuracy") * F.lit(100.0)), F.lit("%")).alias("accuracy_label"),
                    "test_size", fmt_int(F.col("test_size")).alias("test_size_label"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred",
                     digits: int = 6) -> DataFrame:
    """Counts per (label, pred) and the share of the true class."""
    pairs = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("count"))
    # the window runs on the classes^2-row count table, not on the input
    out = pairs.withColumn("_t", F.sum("count").over(Window.partitionBy(label)))
    return out.select(label, pred, "count",
                      F.round(F.col("count") / F.col("_t"), digits).alias("share"))


def error_rate(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    wrong = ~F.col(label).eqNullSafe(F.col(pred))
    c = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("errors"))
    return c.select("n", "errors", F.coalesce(F.try_divide(F.col("errors").cast("double"), F.col("n")),
                                              F.lit(0.0)).alias("error_share"))


def combine_corpora(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union of labelled sources (text, label) with an `origin` column."""
    out = None
    for name, d in sources:
        d = d.select("text", F.col("label").cast("int").alias("label"),
                     F.lit(name).alias("origin"))
        out = d if out is None else out.unionByName(d)
    return out


def sample_errors(df: DataFrame, n: int = 10, seed: int = 42, label: str = "label",
                  pred: str = "pred", id_col: str = "id") -> DataFrame:
    wrong = df.where(~F.col(label).eqNullSafe(F.col(pred)))
    return rank.sample_n(wrong, n, seed, id_col)


def baseline_estimator(n_rows: int | None = None, vocab: int = 20000, max_iter: int = 1000,
                       c: float = 1.0):
    """TF-IDF over unigrams + bigrams (English stop words removed, 2+ char
    tokens, vocabulary capped by frequency) + multinomial logistic regression
    with L2 strength 1/(C*n), all Spark ML stages."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import (IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer,
                                    SQLTransformer, StopWordsRemover)
    stages = [
        RegexTokenizer(inputCol="clean_text", outputCol="tok", pattern=r"(?U)\w\w+", gaps=False,
                       toLowercase=True),
        StopWordsRemover(inputCol="tok", outputCol="uni"),
        NGram(n=2, inputCol="uni", outputCol="bi"),
        SQLTransformer(statement="SELECT *, concat(uni, bi) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocab),
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="features", p=2.0),
        LogisticRegression(featuresCol="features", labelCol="label", predictionCol="prediction",
                           maxIter=max_iter, regParam=1.0 / (c * max(n_rows or 1, 1)),
                           elasticNetParam=0.0, family="multinomial"),
    ]
    return Pipeline(stages=stages)


def train_baseline(train: DataFrame, max_iter: int = 100):
    """Fit the baseline on (text, label int); returns the fitted model."""
    d = train.withColumn("clean_text", tx.clean_text("text")) \
        .withColumn("label", F.col("label").cast("double"))
    n = d.count()
    return baseline_estimator(n, max_iter=max_iter).fit(d)


def predict_baseline(model, df: DataFrame) -> DataFrame:
    d = df.withColumn("clean_text", tx.clean_text("text"))
    out = model.transform(d)
    return out.withColumn("pred", F.col("prediction").cast("int")).drop(
        "clean_text", "tok", "uni", "bi", "terms", "tf", "tfidf", "features",
        "rawPrediction", "probability", "prediction")
