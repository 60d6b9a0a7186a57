"""Champion and challenger history as append-only events.

Nothing is updated in place: each step appends an event, and the current state is
the latest event.  "Latest" is a pre-aggregated maximum, not a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.plans.ordered import BLOCK_ROWS, global_position

# Promotion rules of the four domains.
MIN_COMPOSITE_GAIN = 0.005
MAX_RECALL_LOSS, MIN_F1_GAIN = -0.01, 0.005
MAPE_TOLERANCE = 0.05
MIN_AUC_GAIN = 0.015


def latest_event(events: DataFrame, key: str | None, order: Sequence[str]) -> DataFrame:
    """The newest event of each key (or of the whole table)."""
    rest = [c for c in events.columns if c not in order and c != key]
    packed = F.max(F.struct(*order, *rest)).alias("last")
    grouped = events.groupBy(key).agg(packed) if key else events.agg(packed).where(F.col("last").isNotNull())
    return grouped.select(*([key] if key else []), "last.*")


def latest_audit_per_model(audits: DataFrame, model: str, start: str, tie: str) -> DataFrame:
    return latest_event(audits, model, [start, tie])


def recent_audits(audits: DataFrame, start: str, tie: str, n: int = 10) -> DataFrame:
    return audits.orderBy(F.col(start).desc(), F.col(tie).desc()).limit(n)


def champion_timeline(promotions: DataFrame, model: str, at: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Validity interval of every champion, its predecessor and status."""
    line = global_position(promotions.select(model, at), [at, model], "turn", block_rows)
    before = line.select((F.col("turn") + 1).alias("turn"), F.col(model).alias("predecessor"))
    after = line.select((F.col("turn") - 1).alias("turn"), F.col(at).alias("valid_to"))
    current = F.col("valid_to").isNull()
    return (
        line.join(before, "turn", "left")
        .join(after, "turn", "left")
        .select(
            model,
            "predecessor",
            F.col(at).alias("valid_from"),
            "valid_to",
            F.when(current, "CHAMPION").otherwise("RETIRED").alias("promotion_status"),
            current.alias("is_active"),
        )
    )


def current_champion(promotions: DataFrame, model: str, at: str) -> DataFrame:
    return latest_event(promotions, None, [at, model]).withColumns(
        {"promotion_status": F.lit("CHAMPION"), "is_active": F.lit(True)}
    )


def fraud_rule(f1: Column, recall: Column, champion_f1: Column, champion_recall: Column) -> Column:
    """Both not worse, or a better f1 that pays for a slightly lower recall; no champion means promote."""
    d_f1, d_recall = f1 - champion_f1, recall - champion_recall
    better = ((d_recall >= 0) & (d_f1 >= 0)) | ((d_recall >= MAX_RECALL_LOSS) & (d_f1 > MIN_F1_GAIN))
    return F.when(champion_f1.isNull(), True).otherwise(better)


# Fixed values of the composite score: weights, and the metrics that show a champion's AUC was never recorded.
SCORE_WEIGHTS = {"auc": 0.4, "f1": 0.3, "recall": 0.3}
SCORE_WEIGHTS_WITHOUT_AUC = {"f1": 0.5, "recall": 0.5}
BROKEN_AUC, BROKEN_F1 = 0.01, 0.3


def churn_score_gain(metrics: dict[str, Column], champion: dict[str, Column]) -> Column:
    """Difference of composite scores; without AUC if the champion's AUC cannot be trusted."""

    def composite(m: dict[str, Column]) -> Column:
        return sum((w * m[name] for name, w in SCORE_WEIGHTS.items()), F.lit(0.0))

    def halves(m: dict[str, Column]) -> Column:
        return sum((w * m[name] for name, w in SCORE_WEIGHTS_WITHOUT_AUC.items()), F.lit(0.0))

    broken = (champion["auc"] < BROKEN_AUC) & (champion["f1"] > BROKEN_F1)
    return F.when(broken, halves(metrics) - halves(champion)).otherwise(composite(metrics) - composite(champion))


def churn_rule(metrics: dict[str, Column], champion: dict[str, Column]) -> Column:
    gain = churn_score_gain(metrics, champion)
    return F.when(champion["f1"].isNull(), True).otherwise(gain >= MIN_COMPOSITE_GAIN)


def atm_rule(mape: Column, champion_mape: Column, tolerance: float = MAPE_TOLERANCE) -> Column:
    return F.when(champion_mape.isNull(), True).otherwise(mape < champion_mape * (1 - tolerance))


def delinquency_rule(auc: Column, champion_auc: Column) -> Column:
    return F.when(champion_auc.isNull(), True).otherwise(auc - champion_auc > MIN_AUC_GAIN)


def promotion_rules(challengers: DataFrame, champion: DataFrame) -> DataFrame:
    """Every challenger judged against the champion by all four rules.

    `champion` has at most one row; its metrics enter as a scalar.
    """
    best = champion.agg(
        F.first(F.struct("f1_score", "recall_score", "auc_roc", "mape"))
    ).scalar()
    theirs = {"f1": best["f1_score"], "recall": best["recall_score"], "auc": best["auc_roc"]}
    own = {"f1": F.col("f1_score"), "recall": F.col("recall_score"), "auc": F.col("auc_roc")}

    def status(promoted: Column) -> Column:
        return F.when(promoted, "PROMOTED").otherwise("REJECTED")

    return challengers.select(
        "id_model",
        (own["f1"] - theirs["f1"]).alias("f1_diff"),
        (own["recall"] - theirs["recall"]).alias("recall_diff"),
        (own["auc"] - theirs["auc"]).alias("auc_diff"),
        churn_score_gain(own, theirs).alias("composite_diff"),
        ((best["mape"] - F.col("mape")) / F.nullif(best["mape"], F.lit(0.0))).alias("mape_margin"),
        status(fraud_rule(own["f1"], own["recall"], theirs["f1"], theirs["recall"])).alias("fraud_status"),
        status(churn_rule(own, theirs)).alias("churn_status"),
        status(atm_rule(F.col("mape"), best["mape"])).alias("atm_status"),
        status(delinquency_rule(own["auc"], theirs["auc"])).alias("delinquency_status"),
    )


def audit_events(audits: DataFrame, started: Column, finished: Column, success: Column, error: Column) -> DataFrame:
    """Two events per training: PENDING when it starts, its result when it ends."""

    def event(phase: int, status: Column, at: Column, message: Column) -> Column:
        return F.struct(F.lit(phase).alias("phase"), status.alias("status"), at.alias("at"), message.alias("error"))

    nothing = F.lit(None).cast("string")
    pending = event(0, F.lit("PENDING"), F.col("__start"), nothing)
    result = event(1, F.when(success, F.lit("SUCCESS")).otherwise(F.lit("ERROR")), finished, F.when(~success, error))
    return audits.withColumn("__start", started).select("*", F.inline(F.array(pending, result))).drop("__start")


def audit_history(events: DataFrame, model: str) -> DataFrame:
    """One row per training: its latest event and the seconds since it started."""
    start = F.min("at").alias("start_training")
    last = F.max(F.struct("phase", "status", "at", "error")).alias("last")
    return events.groupBy(model).agg(start, last).select(
        model,
        "start_training",
        F.when(F.col("last.phase") == 1, F.col("last.at")).alias("end_training"),
        F.col("last.status").alias("status"),
        F.col("last.error").alias("error_message"),
        F.when(F.col("last.phase") == 1, F.timestamp_diff("SECOND", "start_training", F.col("last.at"))).alias(
            "training_duration_seconds"
        ),
    )


def registry_violations(models: DataFrame, key: str, start: str, end: str, version: str, parent: str) -> DataFrame:
    """Rows that break the registry's constraints, with the broken rule."""
    text = F.col(key).cast("string").alias("key")
    ranges = models.where(F.col(end) < F.col(start)).select(F.lit("end_before_start").alias("rule"), text)
    nulls = models.where(F.col(version).isNull()).select(F.lit("version_missing").alias("rule"), text)
    repeated = (
        models.where(F.col(version).isNotNull())
        .groupBy(version)
        .count()
        .where("count > 1")
        .select(F.lit("version_repeated").alias("rule"), F.col(version).alias("key"))
    )
    orphans = (
        models.where(F.col(parent).isNotNull())
        .join(models.select(F.col(key).alias("__known")), F.col(parent) == F.col("__known"), "left_anti")
        .select(F.lit("parent_unknown").alias("rule"), text)
    )
    return ranges.unionByName(nulls).unionByName(repeated).unionByName(orphans)
