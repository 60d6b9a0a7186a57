"""ATM withdrawal queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.catalog.base import bins_sql, counts_sql, frames, query, rounded, values_sql
from riskloom.functions.hashes import text_hash_sql
from riskloom.functions.numeric import floor_target
from riskloom.jobs import atm
from riskloom.operators.atm_series import (
    atm_features,
    atm_lags,
    prev_week_lookup,
    prev_weekday_amount,
    recent_drop,
    weekend_moving_avg,
    withdrawal_series,
)
from riskloom.operators.balances import balance_replay
from riskloom.operators.day_histograms import DayStore, window_baseline, window_psi
from riskloom.operators.distributions import baseline_deciles_open, drift_decision, psi_fraction
from riskloom.operators.features import calendar_features, pack_features, unpack_features
from riskloom.operators.joins import actual_vs_prediction, fill_missing, prediction_bounds
from riskloom.operators.metrics import asymmetric_loss, monitor_error, regression_metrics, residual_interval
from riskloom.operators.sampling import allocate_ids, temporal_split, time_series_folds
from riskloom.operators.scans import active_withdrawals, batch_lookback, drop_incomplete, latest_batch, trailing_days, weather_by_date
from riskloom.session import shared_folder
from riskloom.sources.sinks import append
from riskloom.streaming.batches import (
    batch_run_summary,
    daily_atm_history,
    empty_status,
    entity_status_rollup,
    status_merge,
)

RELOAD = 500_000.0
LIMITS = atm.DriftLimits(warn=0.10, critical=0.25, critical_share=0.30, warning_share=0.50)
MODEL = 1
STORED_SCHEMA = (
    "id_transaction long, day_of_month int, day_of_week int, month int, reference_date date, "
    "withdrawal_amount_day double, dynamic_features string"
)


def withdrawals(spark, folder):
    (tx,) = frames(spark, folder, "atm_tx")
    return tx.where(F.col("transaction_type") == "WITHDRAWAL").select("id_transaction", "id_atm", "transaction_date", "amount")


def documents(spark, folder):
    return pack_features(atm_features(withdrawals(spark, folder)))


WEEK = "({d} + CAST((8 - isodow({d})) % 7 AS INT))"
W = "w AS (SELECT id_transaction, id_atm, transaction_date, amount FROM atm_tx WHERE transaction_type = 'WITHDRAWAL')"
ORDER = "PARTITION BY id_atm ORDER BY transaction_date, id_transaction"
WEEKLY = f"""weekly AS (
        SELECT id_atm, {WEEK.format(d="transaction_date")} AS semana,
               CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS media_finde
        FROM w WHERE isodow(transaction_date) IN (6, 7) GROUP BY 1, 2),
    moving AS (SELECT id_atm, semana, media_finde,
        ({" + ".join(f"coalesce(lag(media_finde, {k}) OVER o, 0)" for k in range(6, 0, -1))} + media_finde)
            / least(row_number() OVER o, 7) AS media_movil_7_semanas
        FROM weekly WINDOW o AS (PARTITION BY id_atm ORDER BY semana))"""
MEAN = "CAST(sum(CAST(amount AS DECIMAL(18,2))) OVER (PARTITION BY w.id_atm) AS DOUBLE) / count(*) OVER (PARTITION BY w.id_atm)"
LAST_ON = "last_value(CASE WHEN isodow(transaction_date) = {n} THEN amount END IGNORE NULLS) OVER (" + ORDER + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
FEATURES = f"""{W}, {WEEKLY},
    l AS (SELECT *, {", ".join(f"lag(amount, {k}) OVER ({ORDER}) AS l{k}" for k in (1, 2, 3, 4, 5, 11))},
                 {LAST_ON.format(n=5)} AS sat, {LAST_ON.format(n=6)} AS sun FROM w),
    looked AS (SELECT w.id_transaction, coalesce(m.media_movil_7_semanas, {MEAN}) AS retiros_finde_anterior
               FROM w LEFT JOIN moving m ON m.id_atm = w.id_atm AND m.semana = {WEEK.format(d="(w.transaction_date - 7)")}),
    five AS (SELECT *, (coalesce(l5, 0) + coalesce(l4, 0) + coalesce(l3, 0) + coalesce(l2, 0) + coalesce(l1, 0))
                    / nullif((l5 IS NOT NULL)::INT + (l4 IS NOT NULL)::INT + (l3 IS NOT NULL)::INT + (l2 IS NOT NULL)::INT + (l1 IS NOT NULL)::INT, 0) AS week_mean,
                    (coalesce(sat, 0) + coalesce(sun, 0)) / nullif((sat IS NOT NULL)::INT + (sun IS NOT NULL)::INT, 0) AS weekend_mean FROM l),
    feats AS (SELECT f.id_transaction, id_atm, transaction_date, amount,
        CAST(day(transaction_date) AS INT) AS dia_mes, CAST(month(transaction_date) AS INT) AS mes,
        CAST(isodow(transaction_date) AS INT) AS dia_semana, CAST(isodow(transaction_date) IN (6, 7) AS INT) AS es_findesemana,
        {WEEK.format(d="transaction_date")} AS semana, l1 AS lag_1, l5 AS lag_5, l11 AS lag_11,
        CAST(coalesce(amount < l1 * 0.6, false) AS INT) AS caida_reciente, 0 AS domingo_bajo,
        sat AS retiros_sabado_anterior, sun AS retiros_domingo_anterior, g.retiros_finde_anterior,
        coalesce(weekend_mean / nullif(week_mean, 0), 0) AS ratio_finde_vs_semana,
        coalesce(l1 - nullif(l11, 0), 0) AS tendencia_lags
        FROM five f JOIN looked g ON f.id_transaction = g.id_transaction WHERE l11 IS NOT NULL)"""


@query("atm_lags", f"WITH {W} SELECT id_transaction, {', '.join(f'lag(amount, {k}) OVER ({ORDER}) AS lag_{k}' for k in (1, 5, 11))} FROM w")
def lags_query(spark, folder):
    return atm_lags(withdrawal_series(withdrawals(spark, folder))).rows().select("id_transaction", "lag_1", "lag_5", "lag_11")


@query(
    "recent_drop",
    f"WITH {W} SELECT id_transaction, CAST(coalesce(amount < lag(amount) OVER ({ORDER}) * 0.6, false) AS INT) AS caida_reciente FROM w",
)
def drop_query(spark, folder):
    return recent_drop(withdrawal_series(withdrawals(spark, folder))).rows().select("id_transaction", "caida_reciente")


@query("weekend_moving_avg", f"WITH {W}, {WEEKLY} SELECT * FROM moving")
def moving_query(spark, folder):
    return weekend_moving_avg(withdrawals(spark, folder))


@query(
    "prev_week_lookup",
    f"""WITH {W}, {WEEKLY} SELECT w.id_transaction, coalesce(m.media_movil_7_semanas, {MEAN}) AS retiros_finde_anterior
        FROM w LEFT JOIN moving m ON m.id_atm = w.id_atm AND m.semana = {WEEK.format(d="(w.transaction_date - 7)")}""",
)
def lookup_query(spark, folder):
    tx = withdrawals(spark, folder)
    found = prev_week_lookup(withdrawal_series(tx), weekend_moving_avg(tx), tx)
    return found.rows().select("id_transaction", "retiros_finde_anterior")


@query(
    "prev_weekday_amount",
    f"WITH {W} SELECT id_transaction, {LAST_ON.format(n=5)} AS retiros_sabado_anterior, {LAST_ON.format(n=6)} AS retiros_domingo_anterior FROM w",
)
def weekday_query(spark, folder):
    series = prev_weekday_amount(withdrawal_series(withdrawals(spark, folder)))
    return series.rows().select("id_transaction", "retiros_sabado_anterior", "retiros_domingo_anterior")


@query("atm_features", f"WITH {FEATURES} SELECT * FROM feats")
def features_query(spark, folder):
    return atm_features(withdrawals(spark, folder))


@query(
    "calendar_features",
    f"""SELECT id_transaction, transaction_date, CAST(day(transaction_date) AS INT) AS dia_mes, CAST(month(transaction_date) AS INT) AS mes,
        CAST(isodow(transaction_date) AS INT) AS dia_semana, CAST(isodow(transaction_date) IN (6, 7) AS INT) AS es_findesemana,
        {WEEK.format(d="transaction_date")} AS semana FROM atm_tx""",
)
def calendar_query(spark, folder):
    (tx,) = frames(spark, folder, "atm_tx")
    return calendar_features(tx.select("id_transaction", "transaction_date"), "transaction_date")


@query(
    "pack_features",
    f"""WITH {FEATURES} SELECT id_transaction, dia_mes AS day_of_month, dia_semana AS day_of_week, mes AS month,
        transaction_date AS reference_date, amount AS withdrawal_amount_day, lag_1 AS lag1,
        'lag1,lag5,lag11,domingo_bajo,caida_reciente,tendencia_lags,ratio_finde_vs_semana,retiros_finde_anterior,retiros_domingo_anterior' AS keys
        FROM feats""",
)
def pack_query(spark, folder):
    """The document is shown by its keys and one value; number texts differ between engines."""
    packed = documents(spark, folder)
    return packed.withColumns(
        {
            "lag1": F.get_json_object("dynamic_features", "$.lag1").cast("double"),
            "keys": F.array_join(F.json_object_keys("dynamic_features"), ","),
        }
    ).drop("dynamic_features")


UNPACKED = """unpacked AS (SELECT id_transaction, dia_mes AS day_of_month, dia_semana AS day_of_week, mes AS month,
        transaction_date AS reference_date, amount AS withdrawal_amount_day, lag_1 AS lag1, lag_5 AS lag5, lag_11 AS lag11,
        domingo_bajo, caida_reciente, tendencia_lags, ratio_finde_vs_semana, retiros_finde_anterior, retiros_domingo_anterior
        FROM feats)"""


@query("unpack_features", f"WITH {FEATURES}, {UNPACKED} SELECT * FROM unpacked")
def unpack_query(spark, folder):
    return unpack_features(documents(spark, folder))


@query(
    "trailing_window_slice",
    "SELECT * FROM atm_tx WHERE transaction_date >= (SELECT max(transaction_date) FROM atm_tx) - INTERVAL 30 DAY",
)
def trailing_query(spark, folder):
    (tx,) = frames(spark, folder, "atm_tx")
    return trailing_days(tx, "transaction_date", 30)


SINCE = "(SELECT min(transaction_date) - 11 FROM atm_tx WHERE id_sync = (SELECT max(id_sync) FROM atm_tx))"


@query(
    "latest_batch_lookback",
    f"""SELECT t.id_transaction, t.transaction_date, t.id_atm, t.amount FROM atm_tx t JOIN atms a ON t.id_atm = a.id_atm
        WHERE a.active AND transaction_type = 'WITHDRAWAL' AND transaction_date >= {SINCE}""",
)
def lookback_query(spark, folder):
    tx, atms = frames(spark, folder, "atm_tx", "atms")
    return active_withdrawals(tx, atms, batch_lookback(tx, tx))


@query(
    "active_withdrawals",
    """SELECT t.id_transaction, t.transaction_date, t.id_atm, t.amount FROM atm_tx t JOIN atms a ON t.id_atm = a.id_atm
       WHERE a.active AND transaction_type = 'WITHDRAWAL'""",
)
def active_query(spark, folder):
    tx, atms = frames(spark, folder, "atm_tx", "atms")
    return active_withdrawals(tx, atms)


PAIRS = f"""pairs AS (SELECT t.id_atm, t.id_transaction, t.transaction_date, t.amount, p.predicted_value
    FROM atm_tx t LEFT JOIN withdrawal_prediction p ON p.id_atm = t.id_atm AND p.prediction_date = t.transaction_date
        AND p.id_withdrawal_model = {MODEL} WHERE t.transaction_type = 'WITHDRAWAL')"""


def pairs(spark, folder):
    tx, predictions = frames(spark, folder, "atm_tx", "withdrawal_prediction")
    return actual_vs_prediction(tx, predictions, MODEL)


@query("actual_vs_prediction", f"WITH {PAIRS} SELECT * FROM pairs")
def pairs_query(spark, folder):
    return pairs(spark, folder)


INPUTS = f"""{FEATURES}, {UNPACKED}, {PAIRS},
    inputs AS (SELECT t.id_atm AS atm, u.id_transaction, t.transaction_date AS prediction_date, u.day_of_week AS "diaSemana",
        a.id_location_type AS ubicacion, lag1, lag5, lag11, tendencia_lags, ratio_finde_vs_semana, retiros_finde_anterior,
        retiros_domingo_anterior, domingo_bajo, caida_reciente, impact AS ambiente
        FROM unpacked u JOIN atm_tx t ON u.id_transaction = t.id_transaction JOIN atms a ON t.id_atm = a.id_atm
        JOIN weathers wt ON t.id_weather = wt.id_weather
        WHERE u.id_transaction IN (SELECT id_transaction FROM pairs WHERE predicted_value IS NULL))"""


@query("scoring_inputs", f"WITH {INPUTS} SELECT * FROM inputs")
def scoring_query(spark, folder):
    tx, atms, weathers, predictions = frames(spark, folder, "atm_tx", "atms", "weathers", "withdrawal_prediction")
    return atm.gap_inputs(tx, predictions, MODEL, atms, weathers)


def formula_scorer(inputs):
    """A stand-in model: the mean of three lags."""
    return inputs.withColumn("new_value", F.round((F.col("lag1") + F.col("lag5") + F.col("lag11")) / 3, 2))


FILLED = f"""{INPUTS}, filled AS (SELECT p.id_atm, p.id_transaction, p.transaction_date, p.amount,
        coalesce(p.predicted_value, round((lag1 + lag5 + lag11) / 3, 2)) AS predicted_value
    FROM pairs p LEFT JOIN inputs i ON p.id_atm = i.atm AND p.transaction_date = i.prediction_date)"""


def filled(spark, folder):
    tx, atms, weathers, predictions = frames(spark, folder, "atm_tx", "atms", "weathers", "withdrawal_prediction")
    scored = formula_scorer(atm.gap_inputs(tx, predictions, MODEL, atms, weathers))
    new = scored.select(F.col("atm").alias("id_atm"), F.col("prediction_date").alias("transaction_date"), "new_value")
    return fill_missing(actual_vs_prediction(tx, predictions, MODEL), new)


@query("fill_missing_predictions", f"WITH {FILLED} SELECT * FROM filled")
def fill_query(spark, folder):
    return filled(spark, folder)


@query(
    "prediction_bounds",
    "SELECT *, predicted_value - 1500.0 AS lower_bound, predicted_value + 1500.0 AS upper_bound FROM withdrawal_prediction",
)
def bounds_query(spark, folder):
    (predictions,) = frames(spark, folder, "withdrawal_prediction")
    return prediction_bounds(predictions, "predicted_value", 1500.0)


@query(
    "log_target",
    f"""WITH {PAIRS} SELECT id_transaction, round(ln(1 + amount), 9) AS amount_log, round(amount, 2) AS restored,
        CASE WHEN amount < 1e-6 THEN 1e-6 ELSE amount END AS floored FROM pairs""",
)
def log_query(spark, folder):
    return pairs(spark, folder).select(
        "id_transaction",
        F.round(F.log1p("amount"), 9).alias("amount_log"),
        F.round(F.expm1(F.log1p("amount")), 2).alias("restored"),
        floor_target(F.col("amount")).alias("floored"),
    )


MONITOR_SQL = f"""WITH {PAIRS} SELECT round(avg(abs(amount - predicted_value)), 4) AS mae,
    round(sqrt(avg((amount - predicted_value) ** 2)), 4) AS rmse,
    round(avg(abs((amount - predicted_value) / (amount + 1e-9))) * 100, 6) AS mape, count(*) AS n
    FROM pairs WHERE predicted_value IS NOT NULL AND amount IS NOT NULL"""


@query("monitor_error", MONITOR_SQL)
def error_query(spark, folder):
    error = monitor_error(pairs(spark, folder), "amount", "predicted_value")
    return rounded(rounded(error, 4, "mae", "rmse"), 6, "mape")


@query(
    "regression_metrics",
    f"""WITH {PAIRS} SELECT round(avg(abs(amount - predicted_value)), 4) AS mae,
        round(avg(abs(amount - predicted_value) / amount), 6) AS mape,
        round(sqrt(avg((amount - predicted_value) ** 2)), 4) AS rmse FROM pairs WHERE predicted_value IS NOT NULL""",
)
def regression_query(spark, folder):
    scored = pairs(spark, folder).withColumn("predicted_log", F.log1p("predicted_value"))
    metrics = regression_metrics(scored, "amount", "predicted_log")
    return rounded(rounded(metrics, 4, "mae", "rmse"), 6, "mape")


T_QUANTILE = """(1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / (4 * v)
    + (5 * pow(1.959963984540054, 5) + 16 * pow(1.959963984540054, 3) + 3 * 1.959963984540054) / (96 * v * v))"""


@query(
    "residual_interval",
    f"""WITH {PAIRS}, r AS (SELECT amount - predicted_value AS r FROM pairs WHERE predicted_value IS NOT NULL),
        f AS (SELECT avg(r) AS m, stddev_samp(r) AS s, count(*) - 1.0::DOUBLE AS v FROM r)
        SELECT round(m - {T_QUANTILE} * s, 4) AS lower_bound, round(m + {T_QUANTILE} * s, 4) AS upper_bound,
               round(m, 4) AS media_residuos, round(s, 4) AS sigma, round({T_QUANTILE} * s, 4) AS margin_error,
               95.0::DOUBLE AS confidence_level, round({T_QUANTILE}, 8) AS t_crit FROM f""",
)
def interval_query(spark, folder):
    """The check uses a series for the t quantile that is exact to many digits at this sample size."""
    found = residual_interval(pairs(spark, folder), "amount", "predicted_value")
    return rounded(rounded(found, 8, "t_crit"), 4, "lower_bound", "upper_bound", "media_residuos", "sigma", "margin_error")


@query(
    "asymmetric_loss",
    f"""WITH {PAIRS}, r AS (SELECT amount - predicted_value AS r FROM pairs WHERE predicted_value IS NOT NULL)
        SELECT round(avg(CASE WHEN r < 0 THEN r * r ELSE r * r / 4 END), 2) AS loss FROM r""",
)
def loss_query(spark, folder):
    return rounded(asymmetric_loss(pairs(spark, folder), "amount", "predicted_value"), 2)


@query("weather_by_date", f"SELECT DISTINCT transaction_date, CAST({text_hash_sql(42, 'transaction_date')} % 3 + 1 AS INT) AS id_weather FROM atm_tx")
def weather_query(spark, folder):
    (tx,) = frames(spark, folder, "atm_tx")
    return weather_by_date(tx.drop("id_weather"), "transaction_date").select("transaction_date", "id_weather").distinct()


REPLAY = f"""WITH RECURSIVE ordered AS (
        SELECT t.*, s.current_balance AS opening,
               row_number() OVER (PARTITION BY t.id_atm ORDER BY transaction_date, transaction_type, id_transaction) AS rn
        FROM atm_tx t LEFT JOIN atm_state s ON t.id_atm = s.id_atm),
    replay AS (
        SELECT id_transaction, id_atm, rn, transaction_date, transaction_type, amount, id_sync,
               CASE WHEN transaction_type = 'WITHDRAWAL' AND (opening IS NULL OR opening <= amount) THEN CAST({RELOAD} AS DECIMAL(18,2))
                    WHEN transaction_type = 'WITHDRAWAL' THEN CAST(opening AS DECIMAL(18,2)) - CAST(amount AS DECIMAL(18,2))
                    WHEN opening IS NULL THEN NULL
                    ELSE least(CAST(opening AS DECIMAL(18,2)) + CAST(amount AS DECIMAL(18,2)), CAST({RELOAD} AS DECIMAL(18,2))) END AS b,
               transaction_type = 'WITHDRAWAL' AND (opening IS NULL OR opening <= amount) AS reload_flag
        FROM ordered WHERE rn = 1
        UNION ALL
        SELECT o.id_transaction, o.id_atm, o.rn, o.transaction_date, o.transaction_type, o.amount, o.id_sync,
               CASE WHEN o.transaction_type = 'WITHDRAWAL' AND (r.b IS NULL OR r.b <= CAST(o.amount AS DECIMAL(18,2))) THEN CAST({RELOAD} AS DECIMAL(18,2))
                    WHEN o.transaction_type = 'WITHDRAWAL' THEN r.b - CAST(o.amount AS DECIMAL(18,2))
                    WHEN r.b IS NULL THEN NULL
                    ELSE least(r.b + CAST(o.amount AS DECIMAL(18,2)), CAST({RELOAD} AS DECIMAL(18,2))) END,
               o.transaction_type = 'WITHDRAWAL' AND (r.b IS NULL OR r.b <= CAST(o.amount AS DECIMAL(18,2)))
        FROM replay r JOIN ordered o ON o.id_atm = r.id_atm AND o.rn = r.rn + 1),
    replayed AS (SELECT id_transaction, id_atm, transaction_date, transaction_type, amount, CAST(b AS DOUBLE) AS balance_after, reload_flag, id_sync FROM replay)"""


def replayed(spark, folder):
    tx, state = frames(spark, folder, "atm_tx", "atm_state")
    return balance_replay(tx, state, RELOAD)


@query("balance_replay", f"{REPLAY} SELECT * EXCLUDE (id_sync) FROM replayed")
def replay_query(spark, folder):
    return replayed(spark, folder)


ROLLUP = """SELECT id_atm, arg_max(balance_after, (transaction_date, transaction_type, id_transaction)) AS current_balance,
    max(transaction_date) AS last_transaction_date,
    max(CASE WHEN transaction_type = 'DEPOSIT' THEN transaction_date END) AS last_deposit_date,
    max(CASE WHEN reload_flag THEN transaction_date END) AS last_reload_date,
    max(CASE WHEN transaction_type = 'WITHDRAWAL' THEN transaction_date END) AS last_withdrawal_date
    FROM replayed GROUP BY id_atm"""


@query("entity_status_rollup", f"{REPLAY} {ROLLUP}")
def rollup_query(spark, folder):
    return entity_status_rollup(replayed(spark, folder))


@query(
    "status_merge",
    f"""{REPLAY}, latest AS (SELECT * FROM replayed WHERE id_sync = (SELECT max(id_sync) FROM atm_tx)),
        rolled AS ({ROLLUP.replace("FROM replayed", "FROM latest")})
        SELECT s.id_atm, CASE WHEN r.id_atm IS NOT NULL THEN r.current_balance ELSE s.current_balance END AS current_balance,
               r.last_transaction_date, r.last_deposit_date, r.last_reload_date, r.last_withdrawal_date,
               CASE WHEN r.id_atm IS NOT NULL THEN CAST(99 AS BIGINT) END AS last_sync_id, r.id_atm IS NOT NULL AS updated
        FROM atm_state s LEFT JOIN rolled r ON s.id_atm = r.id_atm""",
)
def merge_query(spark, folder):
    tx, state = frames(spark, folder, "atm_tx", "atm_state")
    rows = latest_batch(balance_replay(tx, state, RELOAD, keep=["id_sync"]), tx)
    return status_merge(empty_status(state), entity_status_rollup(rows), 99)


@query(
    "batch_run_summary",
    f"""{REPLAY} SELECT id_sync, count(*) AS records_inserted, count(DISTINCT r.id_atm) FILTER (s.id_atm IS NOT NULL) AS records_updated,
        count(*) + count(DISTINCT r.id_atm) FILTER (s.id_atm IS NOT NULL) AS records_processed,
        count(DISTINCT r.id_atm) AS atms, CAST(count(*) FILTER (reload_flag) AS BIGINT) AS recargas
        FROM replayed r LEFT JOIN atm_state s ON r.id_atm = s.id_atm GROUP BY id_sync""",
)
def summary_query(spark, folder):
    tx, state = frames(spark, folder, "atm_tx", "atm_state")
    return batch_run_summary(balance_replay(tx, state, RELOAD, keep=["id_sync"]), state)


@query(
    "daily_atm_history",
    """SELECT id_atm, transaction_date,
        coalesce(CAST(sum(CASE WHEN transaction_type = 'WITHDRAWAL' THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS withdrawn,
        coalesce(CAST(sum(CASE WHEN transaction_type = 'DEPOSIT' THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS deposited,
        count(*) AS movements FROM atm_tx GROUP BY 1, 2""",
)
def history_query(spark, folder):
    (tx,) = frames(spark, folder, "atm_tx")
    return daily_atm_history(tx)


@query(
    "allocate_ids",
    """SELECT id_transaction, (SELECT max(id_transaction) FROM atm_tx)
        + row_number() OVER (ORDER BY id_atm, transaction_date, id_transaction) AS new_id FROM atm_tx""",
)
def ids_query(spark, folder):
    (tx,) = frames(spark, folder, "atm_tx")
    return allocate_ids(tx, tx, "id_transaction", ["id_atm", "transaction_date", "id_transaction"]).select("id_transaction", "new_id")


@query(
    "temporal_split",
    f"""WITH {W}, c AS (SELECT CAST(max(transaction_date) - INTERVAL 60 DAY AS DATE) AS t FROM w),
        d AS (SELECT t, (SELECT CAST(max(transaction_date) - INTERVAL 15 DAY AS DATE) FROM w WHERE transaction_date <= t) AS v FROM c)
        SELECT id_transaction, CASE WHEN transaction_date > t THEN 'test' WHEN transaction_date > v THEN 'val' ELSE 'train' END AS split FROM w, d""",
)
def split_query(spark, folder):
    return temporal_split(withdrawals(spark, folder), "transaction_date").select("id_transaction", "split")


@query(
    "time_series_folds",
    f"""WITH {W}, p AS (SELECT id_transaction, row_number() OVER (ORDER BY transaction_date, id_atm, id_transaction) - 1 AS position, count(*) OVER () AS n FROM w)
        SELECT id_transaction, position, CAST(CASE WHEN (n - 1 - position) // (n // 6) < 5 THEN 5 - (n - 1 - position) // (n // 6) ELSE 0 END AS INT) AS fold FROM p""",
)
def folds_query(spark, folder):
    folded = time_series_folds(withdrawals(spark, folder), ["transaction_date", "id_atm", "id_transaction"])
    return folded.select("id_transaction", "position", "fold")


RECENT = "SELECT * FROM unpacked WHERE reference_date >= (SELECT max(reference_date) FROM unpacked) - INTERVAL {n} DAY"
BASELINE = f"""{FEATURES}, {UNPACKED}, last60 AS ({RECENT.format(n=60)}), last30 AS ({RECENT.format(n=30)}),
    {bins_sql("last60", atm.MONITORED)}, counted AS ({counts_sql(values_sql("last60", atm.MONITORED), closed=False)}),
    baseline AS (SELECT *, n / sum(n) OVER (PARTITION BY feature) AS share FROM counted)"""


def stored_documents(spark, folder):
    """Feature documents as monitoring finds them: rows of a stored table."""
    path = f"{shared_folder(spark)}/atm_features-{uuid.uuid4().hex}"
    append(documents(spark, folder), path)
    return spark.read.schema(STORED_SCHEMA).parquet(path)


def stored_parts(spark, folder):
    fields = unpack_features(stored_documents(spark, folder))
    return trailing_days(fields, "reference_date", 60), trailing_days(fields, "reference_date", 30)


def monitored_windows(spark, folder):
    """The last 60 days, and the complete rows of the last 30, of a store of features by day."""
    root = f"{shared_folder(spark)}/monitored-{uuid.uuid4().hex}"
    atm.refresh_monitored_days(withdrawals(spark, folder), root)
    stored = DayStore(spark, root)
    return stored.window(60), stored.window(30, complete=True)


OPEN_BASELINE = (
    f"""WITH {BASELINE}, stats AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n, round(avg({f}), 4) AS mean, round(stddev_samp({f}), 4) AS sd, round(median({f}), 4) AS median, round(1 - count({f}) / count(*), 6) AS null_pct FROM last60" for f in atm.MONITORED)})
        SELECT s.feature, s.n, mean, sd, median, null_pct, CAST(b.bucket AS INT) AS bucket,
               CASE WHEN b.bucket > 0 THEN round(b.lo, 4) END AS lo, CASE WHEN b.bucket < b.k - 1 THEN round(b.hi, 4) END AS hi,
               round(b.share, 6) AS share, CASE WHEN b.bucket IS NULL THEN 'insufficient variance' END AS warning
        FROM stats s LEFT JOIN baseline b ON s.feature = b.feature AND b.k >= 2"""
)


@query("baseline_deciles_open", OPEN_BASELINE)
def open_query(spark, folder):
    found = baseline_deciles_open(stored_parts(spark, folder)[0], atm.MONITORED)
    return rounded(rounded(found, 4, "mean", "sd", "median", "lo", "hi"), 6, "null_pct", "share")


@query("baseline_by_days", OPEN_BASELINE)
def days_baseline_query(spark, folder):
    """The same from histograms of days; features are computed for the last 60 days only."""
    found = window_baseline(monitored_windows(spark, folder)[0], atm.MONITORED)
    return rounded(rounded(found, 4, "mean", "sd", "median", "lo", "hi"), 6, "null_pct", "share")


PSI = f"""{BASELINE},
    now AS (SELECT b.feature, b.bucket, b.share AS base, count(v.v) AS n FROM baseline b LEFT JOIN ({values_sql("last30", atm.MONITORED)}) v
            ON v.feature = b.feature AND (v.v >= b.lo OR b.bucket = 0) AND (v.v < b.hi OR b.bucket = b.k - 1) GROUP BY ALL),
    shares AS (SELECT *, n / sum(n) OVER (PARTITION BY feature) AS share, CAST(sum(n) OVER (PARTITION BY feature) AS BIGINT) AS total FROM now),
    psi AS (SELECT feature, sum((share - base) * ln((share + 1e-4) / (base + 1e-4))) AS raw, max(total) AS prod_samples FROM shares GROUP BY feature)"""
ALERT = f"CASE WHEN raw < {LIMITS.warn} THEN 'OK' WHEN raw < {LIMITS.critical} THEN 'WARNING' ELSE 'CRITICAL' END"


def psi_rows(spark, folder):
    last60, last30 = stored_parts(spark, folder)
    current = last30.dropna(subset=atm.MONITORED)
    return psi_fraction(baseline_deciles_open(last60, atm.MONITORED), current, LIMITS.warn, LIMITS.critical, atm.MONITORED)


PSI_ROWS = f"WITH {PSI} SELECT feature, round(raw, 4) AS psi, {ALERT} AS alert, prod_samples, 0.0::DOUBLE AS prod_null_pct FROM psi"


@query("psi_fraction", PSI_ROWS)
def psi_query(spark, folder):
    return psi_rows(spark, folder).select("feature", "psi", "alert", "prod_samples", "prod_null_pct")


@query("psi_by_days", PSI_ROWS)
def days_psi_query(spark, folder):
    """The same from merged histograms of days; of the values only buckets with a decile or an edge are read."""
    last60, last30 = monitored_windows(spark, folder)
    found = window_psi(window_baseline(last60, atm.MONITORED), last30, LIMITS.warn, LIMITS.critical, atm.MONITORED)
    return found.select("feature", "psi", "alert", "prod_samples", "prod_null_pct")


DECISION = f"""{PSI},
    facts AS (SELECT count(*) AS total_features, count(*) FILTER (round(raw, 4) >= {LIMITS.critical}) AS n_critical,
        count(*) FILTER (round(raw, 4) >= {LIMITS.warn} AND round(raw, 4) < {LIMITS.critical}) AS n_warning,
        count(*) FILTER (round(raw, 4) < {LIMITS.warn}) AS n_ok, max(round(raw, 4)) AS worst_psi FROM psi),
    decided AS (SELECT *, round(n_critical / total_features, 4) AS pct_critical, round((n_critical + n_warning) / total_features, 4) AS pct_warning_plus,
        CASE WHEN total_features = 0 THEN 'INSUFICIENTE'
             WHEN n_critical / total_features >= {LIMITS.critical_share} OR worst_psi >= 0.35 THEN 'REENTRENAMIENTO_OBLIGATORIO'
             WHEN (n_critical + n_warning) / total_features >= {LIMITS.warning_share} OR n_critical > 0 THEN 'ALARMA' ELSE 'OK' END AS decision
        FROM facts)"""
POSITIONS = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(atm.MONITORED))


def decision(spark, folder):
    return drift_decision(psi_rows(spark, folder), LIMITS.warn, LIMITS.critical, LIMITS.critical_share, LIMITS.warning_share)


@query(
    "drift_decision",
    f"""WITH {DECISION} SELECT *, CAST(0 AS BIGINT) AS n_skipped,
        (SELECT feature FROM psi ORDER BY round(raw, 4) DESC, CASE feature {POSITIONS} END LIMIT 1) AS worst_feature FROM decided""",
)
def decision_query(spark, folder):
    return decision(spark, folder).drop("action")


VERDICT = "CASE WHEN {m} <= 10 THEN 'OK' WHEN {m} <= 25 THEN 'ALERTA' ELSE 'CRITICO' END"
MAPE_PCT = "(CASE WHEN mape < 1 THEN mape * 100 ELSE mape END)"


@query(
    "retrain_verdict",
    f"""WITH {DECISION}, {PAIRS}, e AS (SELECT avg(abs((amount - predicted_value) / (amount + 1e-9))) * 100 AS mape FROM pairs WHERE predicted_value IS NOT NULL),
        v AS (SELECT decision, {VERDICT.format(m=MAPE_PCT)} AS error_verdict FROM decided, e)
        SELECT *, decision = 'REENTRENAMIENTO_OBLIGATORIO' OR error_verdict = 'CRITICO' OR (decision = 'ALARMA' AND error_verdict = 'ALERTA') AS need_retrain FROM v""",
)
def verdict_query(spark, folder):
    from riskloom.functions.bands import mape_verdict, must_retrain

    mape = monitor_error(pairs(spark, folder), "amount", "predicted_value").select("mape").scalar()
    judged = decision(spark, folder).select("decision", mape_verdict(mape).alias("error_verdict"))
    return judged.withColumn("need_retrain", must_retrain(F.col("decision"), F.col("error_verdict")))


@query(
    "metric_bands",
    f"""WITH {PAIRS}, e AS (SELECT id_transaction, abs((amount - predicted_value) / (amount + 1e-9)) * 100 AS mape FROM pairs)
        SELECT id_transaction, CASE WHEN mape IS NULL THEN NULL WHEN {MAPE_PCT} <= 10 THEN 'OK' WHEN {MAPE_PCT} <= 25 THEN 'ALERTA' ELSE 'CRITICO' END AS error_band,
            CASE WHEN mape / 100 < 0.10 THEN 'LOW' WHEN mape / 100 < 0.25 THEN 'MODERATE' WHEN mape IS NOT NULL THEN 'HIGH' END AS psi_band,
            CASE WHEN mape IS NULL THEN 'skipped' WHEN mape / 100 < {LIMITS.warn} THEN 'OK' WHEN mape / 100 < {LIMITS.critical} THEN 'WARNING' ELSE 'CRITICAL' END AS alert,
            CASE WHEN mape / 100 >= 0.7 THEN 'healthy' ELSE 'degraded' END AS recall_band FROM e""",
)
def bands_query(spark, folder):
    """All verdict bands over the error of every pair."""
    from riskloom.functions import bands

    mape = F.abs((F.col("amount") - F.col("predicted_value")) / (F.col("amount") + 1e-9)) * 100
    return pairs(spark, folder).select(
        "id_transaction",
        bands.mape_verdict(mape).alias("error_band"),
        bands.psi_category(mape / 100).alias("psi_band"),
        bands.psi_alert(mape / 100, LIMITS.warn, LIMITS.critical).alias("alert"),
        bands.recall_status(mape / 100, 0.7).alias("recall_band"),
    )


@query(
    "drop_incomplete",
    f"WITH {PAIRS} SELECT * FROM pairs WHERE predicted_value IS NOT NULL",
)
def incomplete_query(spark, folder):
    return drop_incomplete(pairs(spark, folder), 5)


NEWEST = REPLAY.replace("FROM atm_tx t", "FROM (SELECT * FROM atm_tx WHERE id_sync = (SELECT max(id_sync) FROM atm_tx)) t")


@query(
    "atm_sync",
    f"""{NEWEST}, f AS (SELECT count(*) AS i, count(*) FILTER (reload_flag) AS r,
            (SELECT count(*) FROM atm_state WHERE id_atm IN (SELECT id_atm FROM replayed)) AS u FROM replayed)
        SELECT CAST(99 AS BIGINT) AS id_sync, i AS records_inserted, u AS records_updated, i + u AS records_processed, r AS recargas FROM f""",
)
def sync_query(spark, folder):
    """The newest batch taken in on top of all batches before it."""
    tx, state = frames(spark, folder, "atm_tx", "atm_state")
    newest = latest_batch(tx, tx).drop("id_sync", "id_weather")
    earlier = tx.join(newest.select("id_transaction"), "id_transaction", "left_anti")
    return atm.sync(newest, earlier, empty_status(state), 99, RELOAD).summary


NEWEST_ROWS = "(SELECT * FROM atm_tx WHERE id_sync = (SELECT max(id_sync) FROM atm_tx))"


@query(
    "atm_sync_shared_days",
    f"""SELECT id_atm, transaction_date, coalesce(CAST(sum(CASE WHEN transaction_type = 'WITHDRAWAL' THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS withdrawn,
        coalesce(CAST(sum(CASE WHEN transaction_type = 'DEPOSIT' THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS deposited, count(*) AS movements,
        (SELECT count(*) FROM {NEWEST_ROWS} n) AS stored_rows,
        (SELECT max(id_transaction) FROM atm_tx WHERE id_sync < (SELECT max(id_sync) FROM atm_tx)) + (SELECT count(*) FROM {NEWEST_ROWS} n) AS last_id
        FROM {NEWEST_ROWS} t GROUP BY 1, 2""",
)
def shared_days_query(spark, folder):
    """The newest batch taken in by two syncs that share its days, the second one repeated; the stored daily totals."""
    tx, state = frames(spark, folder, "atm_tx", "atm_state")
    newest = latest_batch(tx, tx)
    earlier = tx.where(F.col("id_sync") < newest.agg(F.max("id_sync")).scalar())
    root, balances = f"{shared_folder(spark)}/sync-{uuid.uuid4().hex}", empty_status(state)
    for id_sync, part in ((1, 0), (2, 1), (2, 1)):
        batch = newest.where(F.pmod("id_atm", F.lit(2)) == part).drop("id_sync", "id_weather")
        atm.sync(batch, earlier, balances, id_sync, RELOAD, folder=root)
    stored = spark.read.parquet(f"{root}/daily_atm_transactions").agg(F.count(F.lit(1)).alias("stored_rows"), F.max("id_transaction").alias("last_id"))
    totals = spark.read.parquet(f"{root}/historical_daily_atm")
    return totals.select("id_atm", "transaction_date", "withdrawn", "deposited", "movements", stored.select("stored_rows").scalar().alias("stored_rows"), stored.select("last_id").scalar().alias("last_id"))


@query("atm_monitor_cycle")
def cycle_query(spark, folder):
    """The monitoring cycle of the newest batch; features of earlier days are the stored ones."""
    tx, atms, weathers, predictions = frames(spark, folder, "atm_tx", "atms", "weathers", "withdrawal_prediction")
    history = stored_documents(spark, folder)
    stored = history.where(F.col("reference_date") < batch_lookback(tx, tx))
    last60 = trailing_days(unpack_features(history), "reference_date", 60)
    baseline = baseline_deciles_open(last60, atm.MONITORED)
    return atm.monitor_cycle(tx, atms, tx, weathers, predictions, stored, baseline, MODEL, 1500.0, formula_scorer, LIMITS)
