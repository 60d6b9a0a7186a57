"""Histograms of features per day, which add up to those of any window of days.

Values are counted in buckets of equal width on a logarithmic scale that is fixed once for all, so days need not agree on
anything to be merged.  Deciles of a window are found in the merged counts; only buckets that hold a decile, or an edge
of the bins that others are compared with, are opened, first into finer buckets, then value by value.  Results
are exact.  Tables are partitioned by day: a window reads its own days, and of values only the opened buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.numeric import no_nan
from riskloom.functions.rows import literal_rows
from riskloom.operators.distributions import bucket_of, edges_of, open_baseline, psi_of_counts, usable_edges
from riskloom.plans.quantiles import DECILES, any_of, log_bucket, quantiles_of_buckets
from riskloom.sources.sinks import overwrite_partitions, read_if_there

def store_days(features: DataFrame, day: str, names: Sequence[str], folder: str) -> None:
    """Values and bucket counts of the features of some days, each in place of what was stored of these days.

    NaN counts as null; nulls are kept as such.  A row is complete if none of its features is null.
    """
    rows = features.select(F.col(day).alias("day"), *[no_nan(F.col(f).cast("double")).alias(f) for f in names]).persist()
    complete = reduce(Column.__and__, (F.col(f).isNotNull() for f in names))
    entries = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in names]))
    values = rows.select("day", complete.alias("complete"), entries).withColumn("bucket", log_bucket(F.col("value")))
    overwrite_partitions(values, f"{folder}/values", "day")
    squares = F.coalesce(F.var_pop("value") * F.count("value"), F.lit(0.0))
    counts = values.groupBy("day", "feature", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("complete").alias("n_complete"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), squares.alias("squares")
    )
    overwrite_partitions(counts, f"{folder}/counts", "day")
    rows.unpersist()


VALUES = "complete boolean, feature string, value double, bucket long, day date"
COUNTS = "feature string, bucket long, n long, n_complete long, mean double, squares double, day date"


@dataclass(frozen=True)
class DayWindow:
    """Values and bucket counts of some days; of complete rows only, if so wanted."""

    values: DataFrame
    buckets: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.values.sparkSession


class DayStore:
    """The stored days of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.there = read_if_there(spark, f"{folder}/counts") is not None
        if self.there:
            self.values = spark.read.schema(VALUES).parquet(f"{folder}/values")
            self.counts = spark.read.schema(COUNTS).parquet(f"{folder}/counts")
        self.newest: date | None = self.counts.agg(F.max("day")).first()[0] if self.there else None

    def window(self, days: int, complete: bool = False) -> DayWindow:
        """The newest day and those at most `days` before it; the limit is a literal, so that partitions are pruned."""
        since = F.col("day") >= F.lit(self.newest - timedelta(days=days))
        values, counts = self.values.where(since), self.counts.where(since)
        if complete:
            values, counts = values.where("complete"), counts.withColumn("n", F.col("n_complete")).where("n > 0")
        return DayWindow(values.drop("complete"), counts.drop("n_complete"))


def window_quantiles(window: DayWindow, features: Sequence[str], probs: Sequence[float] = DECILES) -> dict[str, list[float] | None]:
    """Exact quantiles, linear between neighbours; None for a feature without values."""
    counted = window.buckets.where(F.col("bucket").isNotNull()).groupBy("feature", "bucket").agg(F.sum("n").alias("n")).persist()
    totals = {r["feature"]: r["n"] for r in counted.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    out = quantiles_of_buckets(counted, window.values, totals, features, probs)
    counted.unpersist()
    return out


def _by_feature(cases: dict[str, Column]) -> Column:
    result = F.lit(None).cast("int")
    for f, value in cases.items():
        result = F.when(F.col("feature") == f, value).otherwise(result)
    return result


def window_counts(window: DayWindow, edges: dict[str, Sequence[float]]) -> DataFrame:
    """Rows per (feature, bin) of open-ended bins; the null bin holds nulls.  Only buckets with an inner edge are opened."""
    inner = {f: list(e[1:-1]) for f, e in edges.items()}
    listed = literal_rows(window.spark, [(f, float(x)) for f, xs in inner.items() for x in xs], "feature string, edge double")
    codes: dict[str, list[int]] = {f: [] for f in edges}
    for r in listed.select("feature", log_bucket(F.col("edge")).alias("code")).collect():
        codes[r["feature"]].append(r["code"])
    wanted = F.col("feature").isin(list(edges))
    cut = any_of({f: sorted(set(c)) for f, c in codes.items() if c}, F.col("bucket"))
    below = {f: sum(((F.col("bucket") > code).cast("int") for code in c), F.lit(0)) for f, c in codes.items()}
    whole = window.buckets.where(wanted & (F.col("bucket").isNull() | ~cut)).select("feature", F.when(F.col("bucket").isNotNull(), _by_feature(below)).alias("bucket"), "n")
    own = _by_feature({f: bucket_of(F.col("value"), e, closed=False) for f, e in edges.items()})
    opened = window.values.where(wanted & cut).select("feature", own.alias("bucket"), F.lit(1).cast("long").alias("n"))
    return whole.unionByName(opened).groupBy("feature", "bucket").agg(F.sum("n").alias("n"))


def window_statistics(window: DayWindow, medians: dict[str, float | None]) -> dict[str, tuple]:
    """Per feature: n, mean, deviation, median, share of nulls; of all rows, from the moments of days and buckets."""
    known = F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(F.lit(0))
    feature = W.partitionBy("feature")  # days x buckets
    merged = (
        window.buckets.withColumn("known", known)
        .withColumn("all", F.sum(F.col("known") * F.col("mean")).over(feature) / F.nullif(F.sum("known").over(feature), F.lit(0)))
        .groupBy("feature")
        .agg(
            F.sum("n").alias("rows"),
            F.sum("known").alias("n"),
            F.first("all").alias("mean"),
            F.sum(F.col("squares") + F.col("known") * F.pow(F.col("mean") - F.col("all"), F.lit(2))).alias("squares"),
        )
    )
    return {
        r["feature"]: (r["n"], r["mean"], (r["squares"] / (r["n"] - 1)) ** 0.5 if r["n"] > 1 else None, medians.get(r["feature"]), 1 - r["n"] / r["rows"])
        for r in merged.collect()
    }


def window_baseline(window: DayWindow, features: Sequence[str]) -> DataFrame:
    """The baseline that `baseline_deciles_open` makes of the window's rows."""
    found = window_quantiles(window, features)

    def counted(edges: dict[str, Sequence[float]]) -> dict[tuple, int]:
        return {(r["feature"], r["bucket"]): r["n"] for r in window_counts(window, edges).collect()}

    nothing = (0, None, None, None, None)
    stats = window_statistics(window, {f: q[5] if q else None for f, q in found.items()})
    return open_baseline(window.spark, features, found, counted, {f: stats.get(f, nothing) for f in features})


def window_psi(baseline: DataFrame, window: DayWindow, warn: float, critical: float, order: Sequence[str]) -> DataFrame:
    """The index that `psi_fraction` gives for the window's rows."""
    edges = {f: usable_edges(e, closed=False) for f, e in edges_of(baseline).items() if f in order}
    return psi_of_counts(baseline, window_counts(window, edges), edges, order, set(order), warn, critical)

