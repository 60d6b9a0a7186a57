"""Card fraud: training set, training, drift and clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.dates import decay_rate, timestamp_ntz
from riskloom.jobs.evaluation import classifier_metrics, result_row, split_sizes
from riskloom.jobs.records import champion_table, record_training
from riskloom.jobs.records import champion as current_champion
from riskloom.operators.clusters import CLUSTER_FEATURES, cluster_profile
from riskloom.operators.distributions import baseline_deciles_pct, drift_report
from riskloom.operators.features import fraud_features, label_codes, label_encode, robust_scaler, scale
from riskloom.operators.isolation import fit_isolation_forest
from riskloom.operators.joins import fraud_star, high_risk, with_decay
from riskloom.operators.metrics import dataset_profile
from riskloom.operators.models import FRAUD_SPACE, batch_score, best_trial, fit_booster, fit_clusters, halving_search
from riskloom.operators.registry import fraud_rule
from riskloom.operators.sampling import stratified_split, undersample
from riskloom.operators.scans import between_dates, date_range_gate, trailing_months
from riskloom.session import cut_lineage
from riskloom.sources.sinks import append

# The columns that deployed models were trained with.
CATEGORIES = ["category", "gender", "job"]
SCALED = ["amt", "city_pop", "age", "distance_km", "hour"]
MODEL_FEATURES = ["amt", "city_pop", "category", "gender", "job", "age", "hour", "distance_km"]


@dataclass(frozen=True)
class FraudTables:
    tx: DataFrame
    cards: DataFrame
    people: DataFrame
    places: DataFrame
    genders: DataFrame
    categories: DataFrame

    def star(self, tx: DataFrame) -> DataFrame:
        return fraud_star(tx, self.cards, self.people, self.places, self.genders, self.categories)


def raw_transactions(tables: FraudTables, start: str, end: str) -> DataFrame:
    return tables.star(between_dates(tables.tx, "trans_date_time", end, start))


def extract(
    tables: FraudTables, end: str, start: str | None = None, half_life_days: int = 180, max_history_days: int = 730
) -> DataFrame:
    """All transactions of the period with their time-decay weight."""
    date_range_gate(start, end)
    period = between_dates(tables.tx, "trans_date_time", end, start, max_history_days)
    return with_decay(tables.star(period), timestamp_ntz(end), decay_rate(half_life_days))


def balanced_rows(extracted: DataFrame, ratio: int = 4, seed: int = 42) -> DataFrame:
    return fraud_features(undersample(extracted, "is_fraud", "id_transaction", ratio, seed))


def training_set(balanced: DataFrame, recent_months: int = 6, seed: int = 42) -> DataFrame:
    """Encoded, split, scaled rows with an anomaly score from the recent period.

    Codes are fitted before the split, the scaler on the training part only.  The
    balanced rows are few next to the extract; they are stored once and read by every step.
    """
    balanced = cut_lineage(balanced)
    coded = label_encode(balanced, label_codes(balanced, CATEGORIES))
    parts = stratified_split(coded, "is_fraud", "id_transaction", [("test", 0.2)], seed)
    scaler = robust_scaler(parts.where(F.col("split") == "train"), SCALED)
    recent = scale(trailing_months(coded, "trans_date_trans_time", recent_months), scaler)
    forest = fit_isolation_forest(recent, MODEL_FEATURES, "id_transaction", seed=seed)
    return (
        scale(parts, scaler)
        .withColumn("anomaly_score", forest.score())
        .select("id_transaction", *MODEL_FEATURES, "anomaly_score", "is_fraud", "sample_weight", "split")
    )


def train(
    tables: FraudTables,
    end: str,
    start: str | None = None,
    champion: dict[str, float] | None = None,
    trials: int = 30,
    space: dict | None = None,
    half_life_days: int = 180,
    max_history_days: int = 730,
    ratio: int = 4,
    seed: int = 42,
) -> DataFrame:
    """Search on F1, final fit, best threshold at recall 0.95, weighted metrics and the promotion decision."""
    balanced = balanced_rows(extract(tables, end, start, half_life_days, max_history_days), ratio, seed)
    rows = training_set(balanced, seed=seed).persist()
    features = [*MODEL_FEATURES, "anomaly_score"]
    fit_rows, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")

    def f1(params: dict) -> float:
        scored = batch_score(fit_booster(fit_rows, features, "is_fraud", params, "sample_weight", seed=seed), test)
        return classifier_metrics(scored, "is_fraud")["f1_score"]

    results = halving_search(space or FRAUD_SPACE, f1, trials, seed)
    number, params, best = best_trial(results)
    model = fit_booster(fit_rows, features, "is_fraud", params, "sample_weight", seed=seed)
    metrics = classifier_metrics(batch_score(model, test), "is_fraud", weight="sample_weight", search_threshold=True)
    sizes = split_sizes(rows)
    out = result_row(
        rows,
        {
            **{k: round(v, 4) for k, v in metrics.items()},
            "best_trial": number,
            "best_f1": float(best),
            "total_samples": sum(sizes.values()),
            "train_samples": sizes["train"],
            "test_samples": sizes["test"],
            "trials": trials,
            "champion_f1": champion["f1_score"] if champion else None,
            "champion_recall": champion["recall"] if champion else None,
        },
    )
    promoted = fraud_rule(F.col("f1_score"), F.col("recall"), F.col("champion_f1"), F.col("champion_recall"))
    rows.unpersist()
    return out.withColumn("promotion_status", F.when(promoted, "PROMOTED").otherwise("REJECTED"))


def train_and_record(tables: FraudTables, end: str, folder: str, id_audit: str, start: str | None = None, max_history_days: int = 730, **settings) -> DataFrame:
    """A recorded training against the champion of the registry; it leaves the deciles of its features for the drift job."""
    spark = tables.tx.sparkSession
    held = current_champion(spark, folder)
    rows = fraud_features(extract(tables, end, start, max_history_days=max_history_days))
    return record_training(
        spark, folder, id_audit,
        lambda: train(tables, end, start, held[1] if held else None, max_history_days=max_history_days, **settings),
        lambda: baseline_deciles_pct(rows, SCALED),
        lambda: dataset_profile(rows, "is_fraud", "trans_date_trans_time"),
    )


def drift_and_record(tables: FraudTables, folder: str, start: str, end: str) -> DataFrame:
    """Drift of a period from the champion's baseline, appended to the table of drift rows."""
    baseline = champion_table(tables.tx.sparkSession, folder, "baselines")
    if baseline is None:
        raise ValueError("no model has been promoted, so there is no baseline")
    found = cut_lineage(drift(tables, baseline, start, end).withColumns({"period_start": F.lit(start), "period_end": F.lit(end)}))
    append(found, f"{folder}/feature_drift")
    return found


def drift(tables: FraudTables, baseline: DataFrame, start: str, end: str) -> DataFrame:
    return drift_report(baseline, fraud_features(raw_transactions(tables, start, end)))


def clusters(
    predictions: DataFrame, tables: FraudTables, k: int = 5, min_samples: int = 50, since=None, seed: int = 42
) -> DataFrame | None:
    """Profiles of high-risk clusters; None when there are too few rows."""
    rows = cut_lineage(high_risk(predictions, tables.tx, tables.cards, tables.people, tables.places, tables.categories, since))
    found = fit_clusters(rows, CLUSTER_FEATURES, k, min_samples, seed)
    return cluster_profile(cut_lineage(found[0]), found[1]) if found else None
