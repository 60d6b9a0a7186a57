"""Positions and running totals over a global order, spread over many tasks.

An unpartitioned window sends every row to one task.  Here the order is cut into
blocks: rows are numbered or summed inside their block, block totals (bounded by
the number of blocks) are summed on their own, and the two parts are added.
Block limits come from an approximate quantile sketch and are fixed as literals
before the plan is built, so a recomputed task sees the same blocks; the results
do not depend on where the limits fall.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.numeric import no_nan

BLOCK_ROWS = 1_000_000
MAX_BLOCKS = 4096
NULL_BLOCK = -1


def cut_points(df: DataFrame, column: str, block_rows: int = BLOCK_ROWS) -> list[float]:
    """Ascending limits that split `column` into about rows/block_rows equal parts.

    A value frequent enough to fill a block gets one of its own: it appears as a
    limit together with its successor.
    """
    rows = df.count()
    blocks = min(max(1, math.ceil(rows / block_rows)), MAX_BLOCKS)
    if blocks == 1:
        return []
    grid = [i / blocks for i in range(1, blocks)]
    value = no_nan(F.col(column).cast("double"))
    found = df.agg(F.percentile_approx(value, grid, 20 * blocks).alias("q")).first()["q"] or []
    limits = set()
    for value, following in zip(found, found[1:] + [None]):
        limits.add(value)
        if value == following:
            limits.add(math.nextafter(value, math.inf))
    return sorted(limits)


def with_block(df: DataFrame, column: str, limits: Sequence[float], out: str) -> DataFrame:
    """Number the block of each row; order-preserving in `column`.  Nulls sort first and have block -1, NaN sorts last."""
    if not limits:
        return df.withColumn(out, F.lit(0))
    edges = [-math.inf, *limits, math.inf]
    keyed = df.withColumn("__key", F.col(column).cast("double"))
    cut = Bucketizer(splits=edges, inputCol="__key", outputCol=out, handleInvalid="keep").transform(keyed)
    number = F.when(F.col("__key").isNull(), F.lit(NULL_BLOCK)).otherwise(F.col(out).cast("int"))
    return cut.withColumn(out, number).drop("__key")


def single_value_blocks(limits: Sequence[float]) -> list[int]:
    """Blocks that hold one value only, i.e. a hot one."""
    return [i + 1 for i, (lo, hi) in enumerate(zip(limits, limits[1:])) if hi == math.nextafter(lo, math.inf)]


def running_total(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    limits: Sequence[float],
) -> DataFrame:
    """Add, for each value of `order`, the sums over all smaller values and, as <column>_all, over all values.

    `df` holds one row per value of `order`; `sums` maps column -> output column;
    `limits` are cut points of `order`.
    """
    if not limits:  # counted: one block holds all rows
        smaller = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        every = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        below = {name: F.coalesce(F.sum(c).over(smaller), F.lit(0)) for c, name in sums.items()}
        return df.withColumns({**below, **{f"{c}_all": F.sum(c).over(every) for c in sums}})
    blocked = with_block(df, order, limits, "__block")
    totals = blocked.groupBy("__block").agg(*[F.sum(c).alias(c) for c in sums])
    before = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)  # at most MAX_BLOCKS rows
    whole = W.orderBy("__block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "__block",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__off_{c}") for c in sums],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in sums],
    )
    inside = W.partitionBy("__block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = blocked.join(F.broadcast(offsets), "__block")  # bounded: one row per block
    for column, name in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(column).over(inside), F.lit(0)) + F.col(f"__off_{column}"))
    return out.drop("__block", *[f"__off_{c}" for c in sums])


def global_position(
    df: DataFrame,
    order: Sequence[str],
    out: str = "position",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """0-based row number over a total order; the first two columns are numeric or dates.

    Blocks follow the first column.  A value that fills a whole block is split
    again by the second column, so a hot key is numbered by many tasks; so are the
    rows without a first value and those where it is NaN.
    """
    first, second = order[0], order[1] if len(order) > 1 else None
    keyed = df.withColumn("__k1", as_number(df, first))
    limits = cut_points(keyed, "__k1", block_rows)
    if not limits:  # counted: one block holds all rows
        return df.withColumn(out, F.row_number().over(W.orderBy(*order)).cast("long") - 1)
    blocked = with_block(keyed, "__k1", limits, "__b1")
    hot = single_value_blocks(limits)
    if second and not blocked.where(F.col("__k1").isNull() | F.isnan("__k1")).isEmpty():
        hot = [NULL_BLOCK, *hot, len(limits) + 1]
    if hot and second:
        in_hot = F.col("__b1").isin(hot)
        blocked = blocked.withColumn("__k2", F.when(in_hot, as_number(df, second)))
        finer = cut_points(blocked.where(in_hot), "__k2", block_rows)
        blocked = with_block(blocked, "__k2", finer, "__b2").withColumn(
            "__b2", F.when(in_hot, F.col("__b2")).otherwise(F.lit(0))
        )
    else:
        blocked = blocked.withColumn("__b2", F.lit(0))
    counts = blocked.groupBy("__b1", "__b2").agg(F.count(F.lit(1)).alias("__n"))
    first_totals = counts.groupBy("__b1").agg(F.sum("__n").alias("__n"))
    before = W.orderBy("__b1").rowsBetween(W.unboundedPreceding, -1)  # at most 2 x MAX_BLOCKS rows
    starts = first_totals.select("__b1", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = W.partitionBy("__b1").orderBy("__b2").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__in", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(
        F.broadcast(starts), "__b1"  # bounded: one row per block of the first column
    )
    offsets = offsets.select("__b1", "__b2", (F.col("__start") + F.col("__in")).alias("__off"))
    inside = W.partitionBy("__b1", "__b2").orderBy(*order)
    return (
        blocked.join(offsets, ["__b1", "__b2"])
        .withColumn(out, F.col("__off") + F.row_number().over(inside) - 1)
        .drop("__b1", "__b2", "__k1", "__k2", "__off")
    )


def as_number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column)).cast("double")
    if kind == "timestamp":
        return F.unix_micros(column).cast("double")
    return F.col(column).cast("double")
