"""Joins in which a null key meets a null key, as windows and groups have it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null; the keys are those of the left side."""
    there = {k: f"__right_{k}" for k in keys}
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(r)) for k, r in there.items()))
    return left.join(right.withColumnsRenamed(there), same, how).drop(*there.values())
