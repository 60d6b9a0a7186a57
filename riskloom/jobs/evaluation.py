"""Shared last steps of training jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.rows import literal_rows
from riskloom.operators.metrics import confusion, ks_statistic, optimal_threshold, roc_auc


def classifier_metrics(
    scored: DataFrame, label: str, score: str = "score", weight: str | None = None, search_threshold: bool = False
) -> dict[str, float]:
    """Metrics of a scored test set, at the likelier class or at the best threshold that keeps recall 0.95."""
    scored = scored.select(*dict.fromkeys(c for c in (label, score, weight) if c)).persist()  # read by three passes
    if search_threshold:
        threshold = optimal_threshold(scored, label, score).first()["threshold"]
        said = (F.col(score) >= threshold).cast("int")
    else:
        threshold = 0.5
        said = (F.col(score) > threshold).cast("int")
    rates = confusion(scored, F.col(label), said, F.col(weight) if weight else None).first()
    area = roc_auc(scored, label, score, weight).first()["auc"]
    scored.unpersist()
    return {
        "auc_roc": area,
        "threshold": threshold,
        **{c: rates[c] for c in ("accuracy", "precision", "recall", "f1_score")},
    }


def separation(scored: DataFrame, label: str, score: str) -> dict[str, float]:
    row = ks_statistic(scored, label, score).first()
    return {"ks": row["ks"], "gini": row["gini"]}


def split_sizes(df: DataFrame) -> dict[str, int]:
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def result_row(df: DataFrame, values: dict) -> DataFrame:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(f"{name} {kinds.get(type(v), 'double')}" for name, v in values.items())
    return literal_rows(df.sparkSession, [tuple(values.values())], schema)
