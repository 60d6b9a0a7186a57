"""What the operators share: words, bound values in expressions, tables in the shared folder."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import shared_folder

#: Rows up to which a side may be broadcast; its rows are narrow, so this is a few megabytes.
BROADCAST_ROWS = 50_000


def ship(*modules: str) -> None:
    """Send the functions of these modules to the executors by value, so that they need no copy of the package."""
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once for `body`, however often `body` names it.

    Spark inlines columns into lambda bodies and would evaluate them again for each element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for an empty or null one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call, in the place that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: computed once, and not again when an executor is lost."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame) -> DataFrame:
    """Offer a stored side for broadcast if a count shows that it is small; otherwise Spark shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
