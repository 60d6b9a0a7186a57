"""Small tables of constants."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW_TYPES = {
    "string": pa.string(),
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
}


def literal_rows(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A frame of constants held in the plan; its size is known, so Spark broadcasts it on its own."""
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(list(c), type=ARROW_TYPES[kind]) for c, (_, kind) in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=[name for name, _ in fields]))
