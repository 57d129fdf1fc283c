"""Filters and predicates.  Plain `where` clauses on stored columns, so Catalyst
pushes them into the Parquet scan (and onto the `date` partition column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark import lexicon as lx
from vocspark.functions import text as tx


def history_filter(df: DataFrame, sentiments: Sequence[str] | None = None,
                   sources: Sequence[str] | None = None, date_from=None, date_to=None,
                   ts: str = "created_at") -> DataFrame:
    """sentiment IN .. AND source IN .. AND date BETWEEN (only with both ends)."""
    out = df
    if sentiments is not None:
        out = out.where(F.col("sentiment").isin(list(sentiments)))
    if sources is not None:
        out = out.where(F.col("source").isin(list(sources)))
    if date_from is not None and date_to is not None:
        # compare on the timestamp itself so the bound is a pushable range
        lo = F.to_timestamp_ntz(F.lit(str(date_from)))
        hi = F.to_timestamp_ntz(F.lit(str(date_to))) + F.expr("INTERVAL 1 DAY")
        out = out.where((F.col(ts) >= lo) & (F.col(ts) < hi))
        if "date" in df.columns:  # the partition column of stored feedback
            out = out.where(F.col("date").between(F.to_date(lo), F.to_date(F.lit(str(date_to)))))
    return out


def text_search(df: DataFrame, query: str | None, text: str = "text") -> DataFrame:
    """Literal, case-blind substring search; blank query = no filter."""
    if query is None or not query.strip():
        return df
    return df.where(F.lower(F.col(text)).contains(query.strip().lower()))


def table_filter(df: DataFrame, sentiments: Sequence[str] = lx.CLASSES,
                 risks: Sequence[str] | None = None, search: str | None = None) -> DataFrame:
    out = df.where(F.col("sentiment").isin(list(sentiments)))
    if risks:
        out = out.where(F.col("risk").isin(list(risks)))
    return text_search(out, search)


def needs_review(df: DataFrame, threshold: float = lx.REVIEW_THRESHOLD) -> DataFrame:
    if not 0.50 <= threshold <= 0.95:
        raise ValueError("threshold must be within 0.50..0.95")
    return df.where(F.col("confidence") < F.lit(threshold))


def high_risk(df: DataFrame) -> DataFrame:
    """Only Negative items have High risk: that part reaches the scan, so the
    others are not enriched."""
    high = F.col("risk") == "High"
    return df.where((F.col("sentiment") == "Negative") & high if "sentiment" in df.columns else high)


def urgent_negative(df: DataFrame, threshold: float = lx.URGENT_CONFIDENCE) -> DataFrame:
    return df.where((F.col("sentiment") == "Negative") & (F.col("confidence") >= F.lit(threshold)))


def with_timestamp(df: DataFrame, ts: str = "created_at") -> DataFrame:
    return df.where(F.col(ts).isNotNull())


def misclassified(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.where(~F.col(label).eqNullSafe(F.col(pred)))


def project_available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order (no job)."""
    return df.select(*[c for c in wanted if c in df.columns])


def remove_stopwords_exploded(df: DataFrame, stop_df: DataFrame, text: str = "text",
                              id_col: str = "id") -> DataFrame:
    """Anti-join form of stop-word removal for word lists too large for a
    literal array: exploded words left-anti-joined to the stop list.  The
    stop list is usually small (a word list), the word side is not: the list
    is broadcast after a bounded size check, else both sides shuffle."""
    from vocspark.operators.joins import broadcast_if_small
    words = df.select(id_col, F.posexplode(
        F.regexp_extract_all(F.lower(F.col(text)), F.lit(tx.CONTENT_WORD_PATTERN), 0))
        .alias("pos", "word"))
    return words.join(broadcast_if_small(stop_df.select("word")), "word", "left_anti")
