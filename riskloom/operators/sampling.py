"""Balancing, splitting and oversampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.scans import days_before_latest
from riskloom.plans.cuts import HashOrder
from riskloom.plans.ordered import BLOCK_ROWS, as_number, cut_points, global_position, running_total


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class; a label has few values."""
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}


def undersample(df: DataFrame, label: str, id_col: str, ratio: int = 4, seed: int = 42) -> DataFrame:
    """All positives and min(positives x ratio, negatives) random negatives.

    The choice is a filter on a hash of the id: one scan, no sort, no union.  Where `df` is a join, it is made once for labels
    and ids alone; the filter needs only these, so Spark applies it before the join when the chosen rows are read.
    """
    order = HashOrder(df, id_col, label, seed, store=True)
    positives = order.counts.get(1, 0)
    if positives == 0:
        raise ValueError("no positives in the period")
    (keep,) = order.first({0: min(positives * ratio, order.counts.get(0, 0))})
    return df.where((F.col(label) == 1) | keep)


def stratified_split(
    df: DataFrame, label: str, id_col: str, fractions: Sequence[tuple[str, float]], seed: int = 42
) -> DataFrame:
    """Add a `split` column; each class gives round(n x fraction) rows to each named part, the rest to `train`."""
    order = HashOrder(df, id_col, label, seed)
    upto, targets = dict.fromkeys(order.counts, 0), []
    for _, fraction in fractions:
        upto = {c: upto[c] + round(n * fraction) for c, n in order.counts.items()}
        targets.append(upto)
    marks = zip([name for name, _ in fractions], order.first(*targets))
    split = F.lit("train")
    for name, inside in reversed(list(marks)):
        split = F.when(inside, F.lit(name)).otherwise(split)
    return df.withColumn("split", split)


def temporal_split(df: DataFrame, date_col: str, test_days: int = 60, val_days: int = 15) -> DataFrame:
    """The last days are the test part, the last days before them the validation part."""
    test_from = days_before_latest(df, date_col, test_days)
    before_test = df.where(F.col(date_col) <= test_from)
    val_from = days_before_latest(before_test, date_col, val_days)
    day = F.col(date_col)
    return df.withColumn("split", F.when(day > test_from, "test").when(day > val_from, "val").otherwise("train"))


def time_series_folds(
    df: DataFrame, order: Sequence[str], k: int = 5, block_rows: int = BLOCK_ROWS, position: bool = True
) -> DataFrame:
    """Number rows in time order and add the fold each row is validated in (0: training only).

    Fold i trains on all rows before its validation rows; every fold validates n // (k + 1) rows.  Without `position` rows
    get the same folds by comparison with the first row of each, so none is moved; only where rows that are equal in all order columns
    lie on both sides of such a limit are they numbered.
    """
    limits = None if position else _fold_limits(df, order, k, block_rows)
    if limits is not None:
        own = F.struct(*order)
        return df.withColumn("fold", sum(((own >= limit).cast("int") for limit in limits), F.lit(0)))
    numbered = global_position(df, order, "position", block_rows)
    n = df.select(F.count(F.lit(1))).scalar()
    size = F.floor(n / (k + 1))
    from_end = F.floor((n - 1 - F.col("position")) / F.nullif(size, F.lit(0)))
    fold = F.when(from_end < k, k - from_end).otherwise(F.lit(0))
    folded = numbered.withColumn("fold", F.coalesce(fold, F.lit(0)).cast("int"))
    return folded if position else folded.drop("position")


def _fold_limits(df: DataFrame, order: Sequence[str], k: int, block_rows: int) -> list[Column] | None:
    """The order columns of the row each fold begins with, or None if an equal row lies before one of them."""
    first, *rest = order
    n = df.count()
    size = n // (k + 1)
    starts = [n - i * size for i in range(k, 0, -1)] if size else []
    counted = df.groupBy(first).agg(F.count(F.lit(1)).alias("__n"))
    values = counted.withColumn("__key", as_number(counted, first))
    running = running_total(values, "__key", {"__n": "__before"}, cut_points(values, "__key", block_rows))
    holds = [(F.col("__before") <= s) & (F.col("__before") + F.col("__n") > s) for s in starts]
    held = running.where(reduce(Column.__or__, holds, F.lit(False))).collect()  # one row a fold at most
    limits = []
    for start in starts:
        (row,) = [r for r in held if r["__before"] <= start < r["__before"] + r["__n"]]
        place, found = start - row["__before"], {}
        if rest:
            same = global_position(df.where(F.col(first).eqNullSafe(F.lit(row[first]))).select(*rest), rest, "__place", block_rows)
            found = {r["__place"]: tuple(r[c] for c in rest) for r in same.where(F.col("__place").between(place - 1, place)).collect()}
        if place and found.get(place - 1) == found.get(place):
            return None
        limit = zip(order, (row[first], *found.get(place, ())))
        limits.append(F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in limit]))
    return limits


def allocate_ids(df: DataFrame, existing: DataFrame, id_col: str, order: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Consecutive ids after the largest existing one, in row order."""
    start = existing.select(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    return global_position(df, order, "new_id", block_rows).withColumn("new_id", F.col("new_id") + start + 1)
