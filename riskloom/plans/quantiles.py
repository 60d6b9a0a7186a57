"""Exact linear-interpolated quantiles of whole columns.

Few rows: Spark's `percentile`, which keeps every distinct value in one buffer.
Many rows: values are counted in buckets of equal width on a fixed logarithmic scale, the buckets that hold a wanted rank
are counted in finer ones, and those that still hold one value by value.  All columns go through each of these three
passes together.  Both ways are exact; the second never holds more than one fine bucket in a task.  What returns to the
driver is columns x probabilities numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.rows import literal_rows

DIRECT_ROWS = 1_000_000
#: Rows of a bucket up to which its values are looked at without finer buckets.
RANGE_ROWS = 1_000_000
DECILES = [i / 10 for i in range(11)]

#: Buckets for each doubling of a value, and into how many finer ones an opened bucket is cut.
STEPS = 32
FINER = 4096
#: Values nearer to zero share one bucket; larger exponents than any double has share the last one.
SMALLEST = 2.0**-40
MOST_DOUBLINGS = 1100.0


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], direct_rows: int = DIRECT_ROWS, range_rows: int = RANGE_ROWS
) -> dict[str, list[float] | None]:
    """Quantiles of each column over its non-null rows; None for an empty column."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counts = wide.agg(*[F.count(c).alias(c) for c in columns]).first()
    if max(counts) <= direct_rows:
        row = wide.agg(*[F.percentile(c, F.array(*[F.lit(float(p)) for p in probs])).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
    values = wide.select(F.inline(entries)).where(F.col("value").isNotNull()).withColumn("bucket", log_bucket(F.col("value")))
    counted = values.groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return quantiles_of_buckets(counted, values, {c: counts[c] for c in columns}, columns, probs, range_rows)


def log_bucket(value: Column, steps: int = STEPS) -> Column:
    """The number of a value's bucket; it never falls as the value grows, and NaN has the last one."""
    size = F.abs(value)
    step = F.floor(F.least(F.log2(size / SMALLEST), F.lit(MOST_DOUBLINGS)) * steps).cast("long") + 1
    signed = F.when(value < 0, -step).otherwise(step)
    return F.when(F.isnan(value), F.lit(2**62)).when(size < SMALLEST, F.lit(0).cast("long")).when(value.isNotNull(), signed)


def any_of(pairs: dict[str, Sequence[int]], bucket: Column) -> Column:
    """Whether (feature, bucket) is one of a few; literals, so that it reaches the scan."""
    if not pairs:
        return F.lit(False)
    return reduce(Column.__or__, ((F.col("feature") == f) & bucket.isin(list(b)) for f, b in pairs.items()))


def _located(counted: DataFrame, within: list[str], wanted: list[tuple], at: str) -> list[tuple]:
    """(feature, rank, `at`, rows before it, its rows) of each wanted rank; `wanted` has (feature, rank, rows before its part of `counted`).

    `counted` has feature, `within` and `at` with their counts n; parts are those buckets that the rank was located in before.
    """
    order = W.partitionBy("feature", *within).orderBy(at)  # buckets, or the values of a fine one
    upto = counted.withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    schema = "feature string, rank long, before long" + "".join(f", {c} long" for c in within)
    ranks = literal_rows(counted.sparkSession, wanted, schema)
    place = F.col("rank") - F.col("before")
    held = upto.join(F.broadcast(ranks), ["feature", *within]).where((place >= F.col("upto") - F.col("n")) & (place < F.col("upto")))
    return [tuple(r) for r in held.select("feature", "rank", at, F.col("before") + F.col("upto") - F.col("n"), "n").collect()]  # one for each rank


def _grouped(located: list[tuple]) -> dict[str, list[int]]:
    out: dict[str, set[int]] = {}
    for f, _, bucket, *_ in located:
        out.setdefault(f, set()).add(bucket)
    return {f: sorted(b) for f, b in out.items()}


def quantiles_of_buckets(
    counted: DataFrame, values: DataFrame, totals: dict[str, int], features: Sequence[str], probs: Sequence[float], range_rows: int = RANGE_ROWS
) -> dict[str, list[float] | None]:
    """Exact quantiles from bucket counts (feature, bucket, n), opening only buckets of `values` (feature, value, bucket) that hold a rank."""
    ranks = {f: sorted({g(p * (totals[f] - 1)) for p in probs for g in (floor, ceil)}) for f in features if totals.get(f)}
    if not ranks:
        return dict.fromkeys(features)
    coarse = _located(counted, [], [(f, k, 0) for f, ks in ranks.items() for k in ks], "bucket")
    opened, held, by = values.where(any_of(_grouped(coarse), F.col("bucket"))), coarse, "bucket"
    if max(size for *_, size in coarse) > range_rows:
        opened, by = opened.withColumn("fine", log_bucket(F.col("value"), STEPS * FINER)), "fine"
        fine_counts = opened.groupBy("feature", "bucket", "fine").agg(F.count(F.lit(1)).alias("n"))
        held = _located(fine_counts, ["bucket"], [(f, k, before, b) for f, k, b, before, _ in coarse], "fine")
        opened = opened.where(any_of(_grouped(held), F.col("fine")))
    exact = opened.groupBy("feature", by, "value").agg(F.count(F.lit(1)).alias("n"))
    found = _located(exact, [by], [(f, k, before, b) for f, k, b, before, _ in held], "value")
    at = {(f, k): value for f, k, value, *_ in found}
    out: dict[str, list[float] | None] = {}
    for f in features:
        out[f] = None
        if f in ranks:
            places = [p * (totals[f] - 1) for p in probs]
            pairs = [(at[f, floor(x)], at[f, ceil(x)], x) for x in places]
            out[f] = [lo if floor(x) == ceil(x) or lo == hi else (ceil(x) - x) * lo + (x - floor(x)) * hi for lo, hi, x in pairs]
    return out
