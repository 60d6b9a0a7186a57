"""ATM withdrawals: batch sync, monitoring cycle and training."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.bands import mape_verdict, must_retrain
from riskloom.functions.rows import literal_rows
from riskloom.jobs.evaluation import result_row, split_sizes
from riskloom.jobs.records import champion, record_training
from riskloom.operators.atm_series import atm_features, features_around
from riskloom.operators.balances import RELOAD, balance_replay
from riskloom.operators.day_histograms import DayStore, store_days
from riskloom.operators.distributions import baseline_deciles_open, drift_decision, psi_fraction
from riskloom.operators.features import pack_features, unpack_features
from riskloom.operators.joins import actual_vs_prediction, fill_missing, model_inputs, prediction_bounds, scoring_inputs
from riskloom.operators.metrics import monitor_error, regression_metrics, residual_interval
from riskloom.operators.models import (
    ATM_SPACE,
    SEARCH_PATIENCE,
    asymmetric_boosting,
    batch_score,
    best_trial,
    feature_importance,
    fit_regressor,
    fold_mape,
    halving_search,
    load_and_score,
    per_row,
    save_model,
)
from riskloom.operators.registry import atm_rule
from riskloom.operators.sampling import allocate_ids, temporal_split, time_series_folds
from riskloom.operators.scans import active_withdrawals, batch_lookback, drop_incomplete, latest_batch, trailing_days, weather_by_date
from riskloom.session import cut_lineage, let_go, written
from riskloom.sources.sinks import append, overwrite_partitions, publish_snapshot, read_if_there
from riskloom.streaming.batches import daily_atm_history, entity_status_rollup, status_merge

# The columns that deployed models and their monitors were trained with.
MONITORED = [
    "lag1", "lag5", "lag11", "tendencia_lags", "ratio_finde_vs_semana", "retiros_finde_anterior",
    "retiros_domingo_anterior",
]
MODEL_FEATURES = [
    "dia_semana", "ubicacion", "lag_1", "lag_5", "lag_11", "tendencia_lags", "ratio_finde_vs_semana",
    "retiros_finde_anterior", "retiros_domingo_anterior", "domingo_bajo", "caida_reciente", "ambiente",
]


#: Trials of a search run two at a time up to so many rows; beyond, one keeps all cores busy, and the disk holds the rows of one.
TOGETHER_ROWS = 2_000_000

#: Columns of the modelling table under the names that monitors know them by.
MONITORED_AS = {"lag1": "lag_1", "lag5": "lag_5", "lag11": "lag_11"}


@dataclass(frozen=True)
class DriftLimits:
    """No defaults: each deployment sets its own."""

    warn: float
    critical: float
    critical_share: float
    warning_share: float


@dataclass(frozen=True)
class SyncResult:
    rows: DataFrame
    state: DataFrame
    summary: DataFrame


def sync(
    incoming: DataFrame,
    existing: DataFrame,
    state: DataFrame,
    id_sync: int,
    reload: float = RELOAD,
    seed: int = 42,
    folder: str | None = None,
) -> SyncResult:
    """Take in one batch: weather, balances, ids, new ATM state and the batch's counts.

    The ids of the batch are replaced by new ones after the largest known.  With a folder, rows are appended, the daily totals of
    the touched days are made again from the stored rows of these days, and the state is published as a new snapshot.  Of
    the store only partitions of days in the batch are read; the largest id is kept beside it and reserved before rows
    are written.  A batch that is stored already is not appended again, so a failed sync can be repeated.
    """
    spark = incoming.sparkSession
    if folder:
        table = f"{folder}/daily_atm_transactions"
        days = touched_days(incoming)
        before = read_if_there(spark, table)
        if before is None or of_days(before, days).where(F.col("id_sync") == id_sync).isEmpty():
            known = reserved_ids(existing, incoming, before, id_sync, f"{folder}/reserved_ids")
            append(_numbered(incoming, state, known, id_sync, reload, seed), table, "transaction_date")
        stored = of_days(spark.read.parquet(table), days)
        rows = stored.where(F.col("id_sync") == id_sync)
        overwrite_partitions(daily_atm_history(stored), f"{folder}/historical_daily_atm", "transaction_date")
    else:
        rows = cut_lineage(_numbered(incoming, state, existing.select("id_transaction"), id_sync, reload, seed))
    merged = status_merge(state, entity_status_rollup(rows), id_sync)
    if folder:
        publish_snapshot(merged.drop("updated"), f"{folder}/atm_current_status", id_sync)
    counted = rows.agg(
        F.count(F.lit(1)).alias("records_inserted"),
        F.count_if("reload_flag").alias("recargas"),
    )
    updated = merged.where("updated").select(F.count(F.lit(1))).scalar()
    summary = counted.select(
        F.lit(id_sync).cast("long").alias("id_sync"),
        "records_inserted",
        updated.alias("records_updated"),
        (F.col("records_inserted") + updated).alias("records_processed"),
        "recargas",
    )
    return SyncResult(rows, merged, summary)


def _numbered(incoming: DataFrame, state: DataFrame, known: DataFrame, id_sync: int, reload: float, seed: int) -> DataFrame:
    """The batch with weather, balances and ids of its own."""
    replayed = weather_by_date(balance_replay(incoming, state, reload), "transaction_date", seed)
    numbered = allocate_ids(replayed, known, "id_transaction", ["id_atm", "transaction_date", "id_transaction"])
    numbered = numbered.drop("id_transaction").withColumnRenamed("new_id", "id_transaction")
    return numbered.withColumn("id_sync", F.lit(id_sync).cast("long"))


#: Days of a batch up to which they are literals of a filter; a batch of more days is joined with the store.
LITERAL_DAYS = 3_660


def touched_days(incoming: DataFrame, limit: int = LITERAL_DAYS) -> list | DataFrame:
    """The days of a batch: a list, or a frame where there are more than the limit."""
    days = incoming.select("transaction_date").distinct()
    found = days.limit(limit + 1).collect()
    return days if len(found) > limit else [r["transaction_date"] for r in found]


def of_days(stored: DataFrame, days: list | DataFrame) -> DataFrame:
    """Rows of these days; either way Spark lists and reads only their partitions."""
    if isinstance(days, list):
        dated = [d for d in days if d is not None]
        wanted = F.col("transaction_date").isin(dated) if dated else F.lit(False)
        return stored.where(wanted | F.col("transaction_date").isNull() if None in days else wanted)
    undated = stored.where(F.col("transaction_date").isNull())
    dated = stored.join(F.broadcast(days.where(F.col("transaction_date").isNotNull())), "transaction_date", "left_semi")  # days since there are calendars: thousands
    return dated.unionByName(undated) if not days.where(F.col("transaction_date").isNull()).isEmpty() else dated


def reserved_ids(existing: DataFrame, incoming: DataFrame, before: DataFrame | None, id_sync: int, path: str) -> DataFrame:
    """The largest id given so far, as a frame of one row; the ids of this batch are reserved after it.

    The reservation is a small row of its own, so later syncs need not look for the largest id in the store.
    A sync that dies afterwards leaves a gap, never an id that is given twice.
    """
    spark = existing.sparkSession
    largest = existing.agg(F.max("id_transaction")).first()[0] or 0
    kept = read_if_there(spark, path)
    if kept is not None:
        largest = max(largest, kept.agg(F.max("last_id")).first()[0])
    elif before is not None:
        largest = max(largest, before.agg(F.max("id_transaction")).first()[0] or 0)
    row = literal_rows(spark, [(id_sync, largest + incoming.count())], "id_sync long, last_id long")
    append(row.coalesce(1), path)
    return literal_rows(spark, [(largest,)], "id_transaction long")


def gap_inputs(tx: DataFrame, predictions: DataFrame, model_id: int, atms: DataFrame, weathers: DataFrame) -> DataFrame:
    """Model inputs of the withdrawals that lack a prediction of the model; row-order windows are computed around them only."""
    judged = predictions.where(F.col("id_withdrawal_model") == model_id).groupBy("id_atm", F.col("prediction_date").alias("transaction_date"))
    known = judged.agg(F.bool_and(F.col("predicted_value").isNotNull()).alias("known"))
    withdrawals = tx.where(F.col("transaction_type") == "WITHDRAWAL").select("id_transaction", "id_atm", "transaction_date", "amount", "id_weather")
    gap = ~F.coalesce("known", F.lit(False))
    rows = cut_lineage(withdrawals.join(known, ["id_atm", "transaction_date"], "left").withColumn("gap", gap).drop("known"))
    found = features_around(rows, F.col("gap")).withColumnRenamed("dia_semana", "day_of_week")
    return model_inputs(found.withColumnsRenamed({column: name for name, column in MONITORED_AS.items()}), atms, weathers)


def refresh_monitored_days(tx: DataFrame, folder: str, days: int = 60) -> None:
    """Store the monitored features of the newest `days` days, by day; features are computed for rows of these days only.

    Windows of drift end with the newest day that has features, which lies before that of the withdrawals where
    all ATMs of the last days lack a history.
    """
    newest = tx.agg(F.max("transaction_date")).first()[0]
    names = {MONITORED_AS.get(f, f): f for f in MONITORED}
    while newest is not None:
        since = newest - timedelta(days=days)
        found = features_around(tx, F.col("transaction_date") >= F.lit(since))
        store_days(found.select("transaction_date", *(F.col(c).alias(f) for c, f in names.items())), "transaction_date", MONITORED, folder)
        reached = DayStore(tx.sparkSession, folder).newest
        if reached == newest:
            return
        if reached is None:  # no features in these days: go back to the day before them
            newest = tx.where(F.col("transaction_date") < F.lit(since)).agg(F.max("transaction_date")).first()[0]
        else:
            newest = reached


def missing_predictions(
    pairs: DataFrame, stored: DataFrame, tx: DataFrame, atms: DataFrame, weathers: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Inputs of the pairs without a prediction, scored; (id_atm, transaction_date, new_value)."""
    missing = pairs.where(F.col("predicted_value").isNull())
    scored = scorer(scoring_inputs(unpack_features(stored), tx, atms, weathers, missing))
    return scored.select(F.col("atm").alias("id_atm"), F.col("prediction_date").alias("transaction_date"), "new_value")


def monitor_cycle(
    tx: DataFrame,
    atms: DataFrame,
    logs: DataFrame,
    weathers: DataFrame,
    predictions: DataFrame,
    stored: DataFrame,
    baseline: DataFrame,
    model_id: int,
    margin: float,
    scorer: Callable[[DataFrame], DataFrame],
    limits: DriftLimits,
    folder: str | None = None,
) -> DataFrame:
    """Features of the new batch, missing predictions, error, drift and the verdict; one row."""
    fresh = pack_features(atm_features(active_withdrawals(tx, atms, batch_lookback(tx, logs))))
    documents = stored.unionByName(fresh)
    pairs = actual_vs_prediction(latest_batch(tx, logs), predictions, model_id)
    new = missing_predictions(pairs, documents, tx, atms, weathers, scorer)
    if folder:
        append(fresh, f"{folder}/atm_features", "reference_date")
        append(prediction_bounds(new, "new_value", margin), f"{folder}/daily_withdrawal_prediction")
    error = monitor_error(fill_missing(pairs, new), "amount", "predicted_value")
    current = unpack_features(trailing_days(documents, "reference_date", 30)).dropna(subset=MONITORED)
    psi = psi_fraction(baseline, current, limits.warn, limits.critical, MONITORED)
    drift = drift_decision(psi, limits.warn, limits.critical, limits.critical_share, limits.warning_share)
    both = drift.withColumn("__error", error.select(F.struct("mae", "rmse", "mape", "n")).scalar()).select(
        "*", "__error.mae", "__error.rmse", "__error.mape", F.col("__error.n").alias("compared")
    )
    verdict = mape_verdict(F.col("mape"))
    result = (
        both.drop("__error")
        .withColumn("error_verdict", verdict)
        .withColumn("need_selftraining", must_retrain(F.col("decision"), verdict))
        .withColumn("id_withdrawal_model", F.lit(model_id).cast("long"))
    )
    if folder:
        append(result, f"{folder}/performance_monitor_model_atm")
    return result


def training_rows(tx: DataFrame, atms: DataFrame, weathers: DataFrame) -> DataFrame:
    """The modelling table: features, location and weather of every withdrawal that has a history."""
    # weather is looked up while rows are narrow; an id that comes twice still meets all its weathers
    weather = tx.where(F.col("id_transaction").isNotNull()).groupBy(F.col("id_transaction").alias("id")).agg(F.collect_list("id_weather").alias("weathers"))
    withdrawals = tx.where(F.col("transaction_type") == "WITHDRAWAL").select("id_transaction", "id_atm", "transaction_date", "amount")
    known = atm_features(withdrawals.join(weather, F.col("id_transaction") == F.col("id"), "left").drop("id"))
    return (
        known.withColumn("id_weather", F.explode("weathers"))
        .join(atms.select("id_atm", F.col("id_location_type").alias("ubicacion")), "id_atm")
        .join(weathers.withColumnRenamed("impact", "ambiente"), "id_weather")
        .select("id_transaction", "id_atm", "transaction_date", F.col("amount").alias("retiro"), *MODEL_FEATURES)
    )


def train(
    rows: DataFrame,
    champion_path: str | None = None,
    trials: int = 50,
    space: dict | None = None,
    test_days: int = 60,
    val_days: int = 15,
    folds: int = 5,
    seed: int = 42,
    save_to: str | None = None,
) -> DataFrame:
    """Search over time folds, final fit with early stopping, error in real scale and the promotion decision; one row.

    As in the trained service, the search uses the asymmetric loss and the final fit squared error.
    The stored champion, if any, is scored on the same test rows.
    """
    clean = written(drop_incomplete(rows, ["retiro", *MODEL_FEATURES]), "atm-clean")
    split = temporal_split(clean, "transaction_date", test_days, val_days)
    test = written(split.where(F.col("split") == "test"), "atm-test")
    known = split.where(F.col("split") != "test")
    known = written(time_series_folds(known, ["transaction_date", "id_atm", "id_transaction"], folds, position=False), "atm-known")
    let_go(clean)
    sizes = split_sizes(known.select("split").unionByName(test.select("split")))

    def cv_mape(params: dict) -> float:
        def fit(part: DataFrame):
            last, n = part.agg(F.max("transaction_date"), F.count(F.lit(1))).first()
            held = part.withColumn("is_val", F.col("transaction_date") > F.date_sub(F.lit(last).cast("date"), val_days))
            _, predict = asymmetric_boosting(
                held, MODEL_FEATURES, "retiro", int(params["n_estimators"]), params["learning_rate"], int(params["max_depth"]),
                seed=seed, params=per_row(params, n), validation="is_val", patience=SEARCH_PATIENCE,
            )
            return _Predictor(predict)

        return fold_mape(known, MODEL_FEATURES, "retiro", params, "fold", folds, fit)

    together = 2 if sizes["train"] + sizes.get("val", 0) <= TOGETHER_ROWS else 1
    _, params, best = best_trial(halving_search(space or ATM_SPACE, cv_mape, trials, seed, maximise=False, parallelism=together), maximise=False)
    marked = known.withColumn("is_val", F.col("split") == "val")
    model = fit_regressor(marked, MODEL_FEATURES, "retiro", per_row(params, sizes["train"]), "is_val", seed)
    scored = batch_score(model, test, "predicted_log").withColumn("predicted", F.expm1("predicted_log"))
    errors = regression_metrics(scored, "retiro", "predicted_log").first()
    if save_to:
        save_model(model, save_to)
    champion_mape = None
    if champion_path:
        theirs = load_and_score(champion_path, test, "predicted_log")
        champion_mape = regression_metrics(theirs, "retiro", "predicted_log").first()["mape"]
    interval = residual_interval(scored, "retiro", "predicted").first()
    out = result_row(
        test,
        {
            "mae": errors["mae"],
            "mape": errors["mape"],
            "rmse": errors["rmse"],
            "cv_mape": float(best),
            "sigma": interval["sigma"],
            "margin_error": interval["margin_error"],
            "t_crit": interval["t_crit"],
            "lower_bound": interval["lower_bound"],
            "upper_bound": interval["upper_bound"],
            "feature_importance": json.dumps({r["feature"]: round(r["porcentaje"], 4) for r in feature_importance(model, MODEL_FEATURES, test).collect()}),
            "train_samples": sizes["train"] + sizes.get("val", 0),
            "test_samples": sizes["test"],
            "total_samples": sum(sizes.values()),
            "champion_mape": champion_mape,
        },
    )
    let_go(known)
    let_go(test)
    better = atm_rule(F.col("mape"), F.col("champion_mape"))
    return out.withColumns(
        {
            "margin_improvement": (F.col("champion_mape") - F.col("mape")) / F.nullif(F.col("champion_mape"), F.lit(0.0)),
            "deployment_status": F.when(better, "NEW_CHAMPION").otherwise("KEEP_CHAMPION"),
        }
    )


def train_and_record(rows: DataFrame, folder: str, id_audit: str, baseline_days: int = 60, **settings) -> DataFrame:
    """A recorded training against the champion of the registry, whose stored model is scored on the same rows.

    It leaves the deciles of the monitored features over the last days, which drift is measured from, and what it was trained on.
    """
    spark = rows.sparkSession
    held = champion(spark, folder)
    monitored = rows.select("transaction_date", *(F.col(MONITORED_AS.get(f, f)).alias(f) for f in MONITORED))

    def dataset() -> DataFrame:
        return rows.agg(
            F.min("transaction_date").alias("start_date"),
            F.max("transaction_date").alias("end_date"),
            F.count(F.lit(1)).alias("count_total"),
            F.lit(",".join(MODEL_FEATURES)).alias("features"),
            F.lit("retiro").alias("target"),
        )

    return record_training(
        spark, folder, id_audit,
        lambda: train(rows, f"{folder}/models/{held[0]}" if held else None, save_to=f"{folder}/models/{id_audit}", **settings),
        lambda: baseline_deciles_open(trailing_days(monitored, "transaction_date", baseline_days), MONITORED),
        dataset,
    )


class _Predictor:
    """Gives a prediction function the transform() of a fitted model."""

    def __init__(self, predict: Callable[[DataFrame], DataFrame]):
        self.transform = predict
