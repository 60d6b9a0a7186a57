"""Account churn: training and monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.dates import days_before
from riskloom.jobs.evaluation import classifier_metrics, result_row, split_sizes
from riskloom.jobs.records import champion as current_champion
from riskloom.jobs.records import record_training
from riskloom.operators.features import CHURN_FEATURES, GEOGRAPHIES, churn_features, scale, standard_scaler
from riskloom.operators.joins import matured_feedback
from riskloom.operators.metrics import dataset_profile, feedback_monitor
from riskloom.operators.models import CHURN_SPACE, batch_score, best_trial, fit_booster, halving_search, in_few_parts
from riskloom.operators.neighbours import smote_oversample
from riskloom.operators.registry import churn_rule, churn_score_gain
from riskloom.operators.sampling import stratified_split
from riskloom.sources.sinks import append


def feature_names(vocabulary: tuple[str, ...] = GEOGRAPHIES) -> list[str]:
    return [f for f in CHURN_FEATURES if not f.startswith("Geography_")] + [f"Geography_{v}" for v in vocabulary]


def train(
    extract: DataFrame,
    champion: dict[str, float] | None = None,
    trials: int = 20,
    space: dict | None = None,
    vocabulary: tuple[str, ...] = GEOGRAPHIES,
    seed: int = 42,
) -> DataFrame:
    """Split, standardise, oversample the training part, search on AUC, judge against the champion; one row."""
    names = feature_names(vocabulary)
    split = stratified_split(churn_features(extract, vocabulary), "Exited", "id_customer", [("test", 0.2)], seed)
    fitted = standard_scaler(split.where(F.col("split") == "train"), names)
    stored = scale(split, fitted).persist()
    scaled = in_few_parts(stored)
    test = scaled.where(F.col("split") == "test")
    oversampled = smote_oversample(scaled.where(F.col("split") == "train"), names, "Exited", "id_customer", seed=seed).persist()
    balanced = in_few_parts(oversampled)

    def auc(params: dict) -> float:
        scored = batch_score(fit_booster(balanced, names, "Exited", params, seed=seed), test)
        return classifier_metrics(scored, "Exited")["auc_roc"]

    _, params, best = best_trial(halving_search(space or CHURN_SPACE, auc, trials, seed))
    metrics = classifier_metrics(batch_score(fit_booster(balanced, names, "Exited", params, seed=seed), test), "Exited")
    sizes = split_sizes(scaled)
    champion = champion or {}
    out = result_row(
        scaled,
        {
            **metrics,
            "best_auc": float(best),
            "train_samples": sizes["train"],
            "test_samples": sizes["test"],
            "oversampled": balanced.count(),
            **{f"champion_{c}": champion.get(c) for c in ("auc", "f1", "recall")},
        },
    )
    oversampled.unpersist()
    stored.unpersist()
    own = {"auc": F.col("auc_roc"), "f1": F.col("f1_score"), "recall": F.col("recall")}
    theirs = {c: F.col(f"champion_{c}") for c in ("auc", "f1", "recall")}
    return out.withColumns(
        {
            "score_gain": churn_score_gain(own, theirs),
            "promotion_status": F.when(churn_rule(own, theirs), "PROMOTED").otherwise("REJECTED"),
        }
    )


def train_and_record(extract: DataFrame, folder: str, id_audit: str, **settings) -> DataFrame:
    """A recorded training against the metrics of the registry's champion, with the balance of its rows."""
    spark = extract.sparkSession
    held = current_champion(spark, folder)
    theirs = {"auc": held[1]["auc_roc"], "f1": held[1]["f1_score"], "recall": held[1]["recall"]} if held else None
    return record_training(
        spark, folder, id_audit, lambda: train(extract, theirs, **settings), dataset=lambda: dataset_profile(extract, "Exited", None)
    )


def monitor(
    predictions: DataFrame,
    accounts: DataFrame,
    today: Column,
    maturation_days: int = 1,
    min_recall: float = 0.70,
    min_samples: int = 10,
    folder: str | None = None,
) -> DataFrame:
    """Judge the model in production by its matured predictions; with a folder, a real verdict is recorded."""
    feedback = matured_feedback(predictions, accounts, days_before(today, maturation_days))
    verdict = feedback_monitor(feedback, min_recall, min_samples)
    if folder:
        append(verdict.where(F.col("status") != "insufficient_data"), f"{folder}/churn_training_history")
    return verdict
