"""Registry of named queries: each is (spark, sf_dir) -> DataFrame, optionally
paired with DuckDB SQL that computes the same rows from the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
OPERATOR_IDS: dict[str, str] = {}


DATE_FMT = "yyyy-MM-dd"
TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
# DuckDB spellings of the same formats, for the oracle SQL.
SQL_DATE_FMT = "%Y-%m-%d"
SQL_TS_FMT = "%Y-%m-%d %H:%M:%S.%f"


def temporal_as_text(df: DataFrame) -> DataFrame:
    """Dates and timestamps as fixed-format text, so both engines hand the
    checker the same values (schema-only step, no job)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            out.append(F.date_format(F.col(f.name), DATE_FMT).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            out.append(F.date_format(F.col(f.name), TS_FMT).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def query(name: str, op_id: str, sql: str | None = None):
    """Register a query under `name` for SURVEY operator `op_id`."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf: temporal_as_text(fn(spark, sf))
        OPERATOR_IDS[name] = op_id
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco
