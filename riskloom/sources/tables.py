"""Typed scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    schema: StructType | None = None,
    upper: bool = False,
) -> DataFrame:
    """Read only the named columns; optionally upper-case their names."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path).select(*columns)
    return df.toDF(*[c.upper() for c in columns]) if upper else df


def load_jdbc(
    spark: SparkSession,
    url: str,
    relation: str,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A database relation, read in parallel ranges of one column."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=relation,
            partitionColumn=partition_column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=str(partitions),
            **options,
        )
        .load()
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df
