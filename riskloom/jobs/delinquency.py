"""Loan delinquency: training of a three-model vote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.jobs.evaluation import classifier_metrics, result_row, separation, split_sizes
from riskloom.jobs.records import champion, record_training
from riskloom.operators.distributions import baseline_mixed
from riskloom.operators.metrics import dataset_profile
from riskloom.operators.models import (
    DELINQUENCY_LEAF_SPACE,
    DELINQUENCY_SPACE,
    batch_score,
    best_trial,
    fit_booster,
    fit_forest,
    halving_search,
    save_model,
    soft_vote,
)
from riskloom.operators.registry import delinquency_rule
from riskloom.operators.sampling import class_counts, stratified_split
from riskloom.operators.scans import column_catalog, dataset_start, latest


VOTERS = ("booster_a", "booster_b", "forest")


def vote(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """Each model's probability and the weighted vote."""
    for name in VOTERS:
        rows = batch_score(models[name], rows, name)
    return soft_vote(rows, VOTERS)


def train(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    weight: str,
    id_col: str,
    champion_folder: str | None = None,
    trials: int = 30,
    spaces: tuple[dict, dict] = (DELINQUENCY_SPACE, DELINQUENCY_LEAF_SPACE),
    forest_trees: int = 80,
    seed: int = 42,
    save_to: str | None = None,
) -> DataFrame:
    """Half the trials per booster, both stopped early; then boosters and a forest vote 2:1:1; one row.

    The stored champion, if any, is scored on the same test rows.
    """
    split = stratified_split(rows, label, id_col, [("test", 0.2), ("val", 0.2)], seed).persist()
    known, test = split.where(F.col("split") != "test"), split.where(F.col("split") == "test")
    counts = class_counts(known, label)
    balance = counts.get(0, 0) / max(counts.get(1, 0), 1)
    marked = known.withColumn("is_val", F.col("split") == "val")

    def search(space: dict, n: int):
        def auc(params: dict) -> float:
            drawn = {**params, "scale_pos_weight": balance}
            scored = batch_score(fit_booster(marked, features, label, drawn, validation="is_val", seed=seed), test)
            return classifier_metrics(scored, label, weight=weight)["auc_roc"]

        _, params, best = best_trial(halving_search(space, auc, n, seed))
        return {**params, "scale_pos_weight": balance}, best

    first_trials = max(trials // 2, 2)
    first, first_auc = search(spaces[0], first_trials)
    second, second_auc = search(spaces[1], max(trials - first_trials, 2))
    models = {
        "booster_a": fit_booster(known, features, label, first, seed=seed),
        "booster_b": fit_booster(known, features, label, second, seed=seed),
        "forest": fit_forest(known, features, label, forest_trees, seed=seed),
    }
    if save_to:
        for name, model in models.items():
            save_model(model, f"{save_to}/{name}")
    voted = vote(models, test).persist()
    champion_auc = None
    if champion_folder:
        theirs = vote({name: PipelineModel.load(f"{champion_folder}/{name}") for name in VOTERS}, test)
        champion_auc = classifier_metrics(theirs, label, "probability", weight)["auc_roc"]
    metrics = classifier_metrics(voted, label, "probability", weight)
    metrics |= {**separation(voted, label, "probability"), "gini": 2 * metrics["auc_roc"] - 1}  # weighted, as the area is
    sizes = split_sizes(split)
    out = result_row(
        split,
        {
            **{k: round(v, 4) for k, v in metrics.items()},
            "booster_a_auc": float(first_auc),
            "booster_b_auc": float(second_auc),
            "train_samples": sizes["train"] + sizes["val"],
            "test_samples": sizes["test"],
            "champion_auc": champion_auc,
        },
    )
    voted.unpersist()
    split.unpersist()
    promoted = delinquency_rule(F.col("auc_roc"), F.col("champion_auc"))
    return out.withColumn("deployment_status", F.when(promoted, "NEW_CHAMPION").otherwise("KEEP_CHAMPION"))


def train_and_record(
    rows: DataFrame, features: Sequence[str], label: str, weight: str, id_col: str, period: str, folder: str, id_audit: str,
    categorical: Sequence[str], **settings,
) -> DataFrame:
    """A recorded training; the champion's stored models are scored on the same rows.

    It leaves shares of the categorical and bins of the other features, the profile of its columns, and the data record
    with the earliest period of the last three years.
    """
    spark = rows.sparkSession
    held = champion(spark, folder)
    used = rows.select(*features, label, weight)
    continuous = [f for f in features if f not in categorical]

    def dataset() -> DataFrame:
        start = dataset_start(rows, period, latest(rows, period)).scalar()
        return dataset_profile(rows, label, period).withColumn("dataset_start", start)

    return record_training(
        spark, folder, id_audit,
        lambda: train(rows, features, label, weight, id_col, f"{folder}/models/{held[0]}" if held else None, save_to=f"{folder}/models/{id_audit}", **settings),
        lambda: baseline_mixed(rows, categorical, continuous),
        dataset,
        {"columns": lambda: column_catalog(used, label, weight)},
    )
