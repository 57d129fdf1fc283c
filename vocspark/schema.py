"""Canonical schemas of the stored and derived frames."""

from pyspark.sql import types as T

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

ENRICHED_COLUMNS = ("emotion", "intensity", "risk", "driver", "csat")

SCORED_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("sentiment", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("model", T.StringType()),
])

LABELLED_SCHEMA = "text string, label int"

# FIXED VALUES: fields read as missing in uploaded CSV files (the default list of
# pandas), matched as they stand.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
