"""Readable profiles of clustered high-risk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.plans.quantiles import DIRECT_ROWS, column_quantiles

# The features, hour bands, distance bands and label words of cluster reports.
CLUSTER_FEATURES = ["amt", "hour", "age", "distance_km", "city_pop"]
NIGHT_FROM, NIGHT_UNTIL, NOON = 20, 6, 12
FAR_KM, NEAR_KM = 200, 20


def cluster_label(amount: Column, hour: Column, distance: Column, high_amount: float) -> Column:
    parts = F.concat_ws(
        ", ",
        F.when(amount >= high_amount, "alto monto").otherwise("bajo monto"),
        F.when((hour >= NIGHT_FROM) | (hour < NIGHT_UNTIL), "nocturno").when(hour < NOON, "matutino").otherwise("diurno"),
        F.when(distance > FAR_KM, "distancia lejana").when(distance < NEAR_KM, "distancia cercana"),
    )
    return F.concat(F.lit("Fraude "), parts)


def cluster_profile(assigned: DataFrame, total: int | None = None, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """One row per cluster, largest first.

    `total` counts all analysed rows, those dropped for nulls included.
    """
    whole = F.lit(total) if total is not None else assigned.select(F.count(F.lit(1))).scalar()
    high_amount = column_quantiles(assigned, ["amt"], [0.75], direct_rows)["amt"][0]
    means = assigned.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("fraud_count"),
        *[F.avg(f).alias(f"avg_{f}") for f in CLUSTER_FEATURES],
    )
    profile = means.withColumn(
        "label", cluster_label(F.col("avg_amt"), F.col("avg_hour"), F.col("avg_distance_km"), high_amount)
    )
    for column, name in (("category", "top_category"), ("state", "top_state")):
        profile = profile.join(_most_common(assigned, column, name), "cluster_id", "left")
    return profile.select(
        "cluster_id",
        "label",
        "fraud_count",
        F.round(F.col("fraud_count") / whole * 100, 2).alias("pct_of_total"),
        F.round("avg_amt", 2).alias("avg_amount"),
        F.round("avg_hour", 1).alias("avg_hour"),
        F.round("avg_age", 1).alias("avg_age"),
        F.round("avg_distance_km", 2).alias("avg_distance_km"),
        F.round("avg_city_pop", 0).alias("avg_city_pop"),
        "top_category",
        "top_state",
    ).orderBy(F.desc("fraud_count"), "cluster_id")


def _most_common(df: DataFrame, column: str, name: str) -> DataFrame:
    """The most frequent non-null value per cluster, the smallest on ties; values are counted before they meet."""
    counts = df.where(F.col(column).isNotNull()).groupBy("cluster_id", column).count()
    top = counts.groupBy("cluster_id").agg(F.max("count").alias("count"))
    return counts.join(top, ["cluster_id", "count"]).groupBy("cluster_id").agg(F.min(column).alias(name))
