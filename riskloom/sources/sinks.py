"""Writing results.

A Spark job publishes its files when all its tasks have finished, so each append or
snapshot below appears whole or not at all.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Add rows to a table."""
    if partition:
        _gathered(df, partition).write.mode("append").partitionBy(partition).parquet(path)
    else:
        df.write.mode("append").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in `df`."""
    rows = _gathered(df, partition)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _gathered(df: DataFrame, partition: str) -> DataFrame:
    """Few files per partition value, while adaptive execution splits a value that holds many rows."""
    return df.hint("rebalance", partition)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or nothing where none has been written yet, or only a partitioned one without rows."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def publish_snapshot(df: DataFrame, path: str, version: int) -> None:
    """A new full version of a table; readers keep the old one until this one is complete.

    Publishing a version again, after a failure, replaces it.
    """
    df.write.mode("overwrite").parquet(f"{path}/version={version:012d}")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; only its files are read."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).drop("version")
