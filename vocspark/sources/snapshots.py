"""Tables that are replaced as a whole, atomically.

A table has a few slots.  A new version is written to the slot after the current
one's, and only when that is complete a one-row marker names it; readers take the
version of the highest marker.  A write that ends midway leaves no marker, so the
table stays as it was, and the next publication overwrites what it left.  Readers
of a version may go on while the next ones are published, up to SLOTS - 2 of them.
One writer at a time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SLOTS = 3
MARKER = "version long, slot int"


def if_there(read):
    """What `read` gives, or None where its path does not exist.  Other failures
    are raised: a store that can't be read is not an empty one."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The table's version and its folder; (0, None) before the first one."""
    marks = if_there(lambda: spark.read.schema(MARKER).json(f"{path}/_commits/*"))
    rows = marks.where("version is not null").orderBy("version", ascending=False).limit(1).collect() if marks else []
    return (rows[0]["version"], f"{path}/_slots/s{rows[0]['slot']}") if rows else (0, None)


def mark(spark: SparkSession, path: str, version: int) -> None:
    """Names a complete version; the marker is one file, so it is there or not."""
    spark.createDataFrame([(version, version % SLOTS)], MARKER).coalesce(1) \
        .write.mode("overwrite").json(f"{path}/_commits/c{version % SLOTS}")


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Makes `df` the table's content and gives its version.  `df` may be read
    from the current version: that slot is not the one written."""
    spark = df.sparkSession
    version = current(spark, path)[0] + 1
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/_slots/s{version % SLOTS}")
    mark(spark, path, version)
    return version


def read_published(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The last complete version; None before the first one."""
    folder = current(spark, path)[1]
    if folder is None:
        return None
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(folder)


def delete_folders(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders whose content has been published elsewhere."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
