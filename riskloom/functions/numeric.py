"""Null-safe arithmetic and target transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
MIN_TARGET = 1e-6


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is 0."""
    return num / F.nullif(den, F.lit(0))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num.cast("double"), den.cast("double")), F.lit(0.0))


def smoothed_ratio(num: Column, den: Column) -> Column:
    return num / (den + F.lit(EPS))


def floor_target(y: Column) -> Column:
    """Lift small targets to 1e-6; null stays null (greatest() would not keep it)."""
    return F.when(y < MIN_TARGET, F.lit(MIN_TARGET)).otherwise(y)


def no_nan(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def mean_of_present(*values: Column) -> Column:
    """Row mean over the non-null values, null when there are none."""
    total, count = F.lit(0.0), F.lit(0)
    for value in values:
        total = total + F.coalesce(value, F.lit(0.0))
        count = count + value.isNotNull().cast("int")
    return ratio(total, count)


def cents(value: Column) -> Column:
    """A money amount in whole cents."""
    return F.rint(value * 100).cast("long")


def wide(value: Column) -> Column:
    """An amount as a decimal of eight places; sums of decimals do not depend on the order of the rows."""
    return no_nan(value.cast("double")).try_cast("decimal(28,8)")


def exact_sum(value: Column) -> Column:
    """Sum of amounts that does not depend on the order of the rows, as double."""
    return F.sum(wide(value)).cast("double")
