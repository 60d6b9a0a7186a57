"""Hand-worked cases for expressions, bands, drift and promotion rules."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions import bands
from riskloom.functions.dates import completed_years, completed_years_strict, week_ending_monday, whole_days
from riskloom.functions.geo import haversine_km
from riskloom.functions.numeric import floor_target, mean_of_present, ratio_or_zero
from riskloom.functions.student import t_quantile
from riskloom.operators.distributions import (
    baseline_deciles_open,
    baseline_deciles_pct,
    baseline_mixed,
    baseline_of_champion,
    drift_decision,
    edge_histogram,
    pack_baseline,
    psi_fraction,
    psi_percent,
)
from riskloom.operators.features import pack_features, unpack_features
from riskloom.operators.metrics import confusion, feedback_monitor, optimal_threshold, residual_interval
from riskloom.operators.registry import atm_rule, churn_rule, delinquency_rule, fraud_rule

D = datetime.date


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "born,at,loose,strict",
    [
        ("2000-02-29", "2001-02-28", 1, 0),
        ("2000-02-29", "2001-03-01", 1, 1),
        ("2000-02-29", "2004-02-28", 3, 3),
        ("2000-02-29", "2004-02-29", 4, 4),
        ("1990-06-15", "2020-06-14 23:59:59", 29, 29),
        ("1990-06-15", "2020-06-15", 30, 30),
        ("1999-02-28", "2000-02-28", 1, 1),
    ],
)
def test_ages(spark, born, at, loose, strict):
    b = F.lit(born).cast("date")
    assert value(spark, completed_years(b, ntz(at))) == loose
    assert value(spark, completed_years_strict(b, ntz(at))) == strict


def test_whole_days_are_24_hours(spark):
    assert value(spark, whole_days(ntz("2024-01-01 12:00:00"), ntz("2024-01-03 02:00:00"))) == 1


@pytest.mark.parametrize("day,monday", [("2024-01-01", D(2024, 1, 1)), ("2024-01-02", D(2024, 1, 8)), ("2024-01-07", D(2024, 1, 8))])
def test_week_key(spark, day, monday):
    assert value(spark, week_ending_monday(F.lit(day).cast("date"))) == monday


def test_distance(spark):
    lit = F.lit
    assert value(spark, haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) == pytest.approx(6371 * math.pi / 180)
    assert value(spark, haversine_km(lit(0.0), lit(0.0), lit(180.0), lit(0.0))) == pytest.approx(6371 * math.pi)
    assert value(spark, haversine_km(lit(None).cast("double"), lit(0.0), lit(0.0), lit(1.0))) is None


def test_null_safe_numbers(spark):
    none = F.lit(None).cast("double")
    assert value(spark, ratio_or_zero(F.lit(3.0), F.lit(0.0))) == 0.0
    assert value(spark, floor_target(none)) is None
    assert value(spark, floor_target(F.lit(0.0))) == 1e-6
    assert value(spark, mean_of_present(none, F.lit(4.0))) == 4.0
    assert value(spark, mean_of_present(none, none)) is None


def test_bands(spark):
    assert value(spark, bands.mape_verdict(F.lit(0.5))) == "CRITICO"  # read as a fraction
    assert value(spark, bands.mape_verdict(F.lit(10.0))) == "OK"
    assert value(spark, bands.mape_verdict(F.lit(25.5))) == "CRITICO"
    assert value(spark, bands.psi_category(F.lit(0.25))) == "HIGH"
    assert value(spark, bands.must_retrain(F.lit("ALARMA"), F.lit("ALERTA"))) is True
    assert value(spark, bands.must_retrain(F.lit("ALARMA"), F.lit("OK"))) is False


@pytest.mark.parametrize("p,df,want", [(0.975, 1, 12.7062047364), (0.975, 10, 2.22813885), (0.95, 30, 1.69726089), (0.975, 10**7, 1.95996416)])
def test_t_quantile(p, df, want):
    assert t_quantile(p, df) == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize(
    "f1,recall,promoted",
    [(0.8, 0.9, True), (0.81, 0.8901, True), (0.806, 0.8905, True), (0.804, 0.895, False), (0.9, 0.88, False), (0.79, 0.95, False)],
)
def test_fraud_rule(spark, f1, recall, promoted):
    assert value(spark, fraud_rule(F.lit(f1), F.lit(recall), F.lit(0.8), F.lit(0.9))) is promoted


def test_other_rules(spark):
    none = F.lit(None).cast("double")

    def m(auc, f1, recall):
        return {"auc": F.lit(auc), "f1": F.lit(f1), "recall": F.lit(recall)}

    assert value(spark, fraud_rule(F.lit(0.1), F.lit(0.1), none, none)) is True
    assert value(spark, churn_rule(m(0.8, 0.6, 0.6), m(0.78, 0.6, 0.6))) is True
    assert value(spark, churn_rule(m(0.8, 0.6, 0.6), m(0.79, 0.6, 0.6))) is False
    assert value(spark, churn_rule(m(0.0, 0.6, 0.62), m(0.001, 0.6, 0.6))) is True  # champion's area is not trusted
    assert value(spark, atm_rule(F.lit(0.094), F.lit(0.1))) is True
    assert value(spark, atm_rule(F.lit(0.096), F.lit(0.1))) is False
    assert value(spark, delinquency_rule(F.lit(0.72), F.lit(0.7))) is True
    assert value(spark, delinquency_rule(F.lit(0.71), F.lit(0.7))) is False


def column(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def test_closed_bins(spark):
    base = baseline_deciles_pct(column(spark, [float(i) for i in range(1, 101)]), ["x"])
    assert base.count() == 10 and base.agg(F.sum("share")).first()[0] == pytest.approx(100)
    found = edge_histogram(column(spark, [0.0, 1.0, 100.0, 101.0, None]), base).collect()
    assert {r["bucket"]: r["n"] for r in found if r["n"]} == {0: 1, 9: 1}


def test_constant_column_has_one_closed_bin(spark):
    base = baseline_deciles_pct(column(spark, [4.0] * 9), ["x"])
    row = base.first()
    assert (row["lo"], row["hi"], row["share"], row["n"]) == (4.0, 4.0, 100.0, 9)
    assert psi_percent(base, column(spark, [4.0, 5.0])).first()["psi"] == 0.0


def test_open_bins_take_everything(spark):
    base = baseline_deciles_open(column(spark, [float(i) for i in range(100)] + [None]), ["x"])
    rows = sorted(base.collect(), key=lambda r: r["bucket"])
    assert rows[0]["lo"] is None and rows[-1]["hi"] is None and rows[0]["null_pct"] == pytest.approx(1 / 101)
    psi = psi_fraction(base, column(spark, [-5.0, 500.0]), 0.1, 0.25).first()
    assert psi["prod_samples"] == 2 and psi["alert"] == "CRITICAL"
    share, terms = [0.5] + [0.0] * 8 + [0.5], [r["share"] for r in rows]
    want = sum((a - e) * math.log((a + 1e-4) / (e + 1e-4)) for a, e in zip(share, terms))
    assert psi["psi"] == pytest.approx(want, abs=1e-4)
    assert psi["actual_pct"] == share


def test_skipped_features(spark):
    data = spark.createDataFrame([(1.0, float(i), float(i)) for i in range(50)], "flat double, x double, gone double")
    base = baseline_deciles_open(data, ["flat", "x", "gone"])
    now = spark.createDataFrame([(1.0, None)], "flat double, x double")
    rows = {r["feature"]: r for r in psi_fraction(base, now, 0.1, 0.25, ["flat", "x", "gone"]).collect()}
    assert rows["flat"]["reason"] == "insufficient variance" and rows["flat"]["alert"] == "skipped"
    assert rows["gone"]["reason"] == "missing in production"
    assert rows["x"]["reason"] == "no valid rows" and rows["x"]["psi"] is None


def test_equal_data_has_no_drift(spark):
    same = column(spark, [float(i % 37) for i in range(500)])
    assert psi_percent(baseline_deciles_pct(same, ["x"]), same).first()["psi"] == pytest.approx(0, abs=1e-6)


def psi_table(spark, values):
    return spark.createDataFrame([(f"f{i}", i, v) for i, v in enumerate(values)], "feature string, position int, psi double")


@pytest.mark.parametrize(
    "values,decision,worst",
    [
        ([None, None], "INSUFICIENTE", None),
        ([0.3, 0.05, 0.3], "REENTRENAMIENTO_OBLIGATORIO", "f0"),
        ([0.36, 0.0, 0.0, 0.0, 0.0], "REENTRENAMIENTO_OBLIGATORIO", "f0"),
        ([0.15, 0.12, 0.0], "ALARMA", "f0"),
        ([0.0, 0.3, 0.0, 0.0, 0.0], "ALARMA", "f1"),
        ([0.01, 0.05, 0.05, None], "OK", "f1"),
    ],
)
def test_drift_decision(spark, values, decision, worst):
    row = drift_decision(psi_table(spark, values), 0.1, 0.25, 0.3, 0.5).first()
    assert (row["decision"], row["worst_feature"]) == (decision, worst)


def test_mixed_baseline(spark):
    df = spark.createDataFrame([(i % 3, float(i), 5.0) for i in range(30)], "pay_0 int, x double, flat double")
    rows = baseline_mixed(df, ["pay_0"], ["x", "flat"]).collect()
    assert [r["share"] for r in rows if r["feature"] == "pay_0"] == pytest.approx([1 / 3] * 3)
    flat = [r for r in rows if r["feature"] == "flat"]
    assert (min(r["lo"] for r in flat), max(r["hi"] for r in flat), sum(r["n"] for r in flat)) == (4.5, 5.5, 30)


def test_baseline_document_round_trip(spark):
    base = baseline_deciles_open(column(spark, [math.sqrt(i) for i in range(200)]), ["x"])
    audits = pack_baseline(base).withColumn("is_production", F.lit(True))
    columns = ["feature", "bucket", "lo", "hi", "share"]
    assert sorted(baseline_of_champion(audits).select(columns).collect(), key=lambda r: r["bucket"]) == sorted(
        base.select(columns).collect(), key=lambda r: r["bucket"]
    )
    assert baseline_of_champion(audits.withColumn("is_production", F.lit(False))).count() == 0


def test_undefined_rates_are_zero(spark):
    df = spark.createDataFrame([(0, 0)] * 3, "a int, p int")
    row = confusion(df, F.col("a"), F.col("p")).first()
    assert (row["tn"], row["recall"], row["precision"], row["f1_score"], row["accuracy"]) == (3, 0.0, 0.0, 0.0, 1.0)


def test_threshold_defaults_and_ties(spark):
    none = spark.createDataFrame([(0, 0.1), (0, 0.9)], "y int, s double")
    assert optimal_threshold(none, "y", "s").first()["threshold"] == 0.5
    tie = spark.createDataFrame([(1, 0.4), (1, 0.6), (0, 0.1), (1, 0.4)], "y int, s double")
    assert optimal_threshold(tie, "y", "s").first()["threshold"] == 0.4


def test_monitor_needs_samples(spark):
    schema = "actual int, predicted int, probability double"
    few = feedback_monitor(spark.createDataFrame([(1, 1, 0.9)] * 4, schema)).first()
    assert few["status"] == "insufficient_data" and few["evaluated_samples"] == 4
    bad = feedback_monitor(spark.createDataFrame([(1, 0, 0.1)] * 10 + [(0, 0, 0.2)] * 5, schema)).first()
    assert bad["status"] == "degraded" and bad["auc_roc"] == 0.0


def test_residual_interval(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)], "y double, p double")
    row = residual_interval(df, "y", "p").first()
    assert (row["media_residuos"], row["sigma"]) == (2.0, 1.0)
    assert row["margin_error"] == pytest.approx(4.30265273)


def test_feature_document_keeps_nulls(spark):
    schema = (
        "id_transaction long, dia_mes int, dia_semana int, mes int, transaction_date date, amount double, lag_1 double, lag_5 double, "
        "lag_11 double, domingo_bajo int, caida_reciente int, tendencia_lags double, ratio_finde_vs_semana double, "
        "retiros_finde_anterior double, retiros_domingo_anterior double"
    )
    row = (1, 2, 3, 4, D(2024, 1, 1), 5.5, 1.25, 2.5, 3.75, 0, 1, -0.1, 0.3, 7.0, None)
    packed = pack_features(spark.createDataFrame([row], schema))
    assert '"retiros_domingo_anterior":null' in packed.first()["dynamic_features"]
    back = unpack_features(packed).first()
    assert (back["lag11"], back["caida_reciente"], back["retiros_domingo_anterior"]) == (3.75, 1, None)


def test_nan_is_no_value(spark):
    from riskloom.operators.metrics import monitor_error, regression_metrics
    from riskloom.operators.scans import coerce_numeric, null_profile

    nan = float("nan")
    clean = [(float(i % 20), float(i % 20) + 1) for i in range(100)]
    df, dirty = (spark.createDataFrame(rows, "a double, b double") for rows in (clean, [*clean, *[(nan, 1.0)] * 25, *[(1.0, nan)] * 25]))
    same = ["feature", "bucket", "lo", "hi", "share", "n", "mean", "median"]
    base = baseline_deciles_open(df, ["a"])
    spoilt = spark.createDataFrame([*clean, *[(nan, 0.0)] * 50], "a double, b double")
    assert sorted(base.select(same).collect()) == sorted(baseline_deciles_open(spoilt, ["a"]).select(same).collect())
    assert baseline_deciles_open(spoilt, ["a"]).first()["null_pct"] == pytest.approx(1 / 3)
    assert sorted(baseline_deciles_pct(df, ["a"]).collect()) == sorted(baseline_deciles_pct(spoilt, ["a"]).collect())
    assert sorted(baseline_mixed(df, ["b"], ["a"]).collect()) == sorted(baseline_mixed(spoilt.where("b != 0"), ["b"], ["a"]).collect())
    drift = psi_fraction(base, spoilt, 0.1, 0.25).first()
    assert (drift["psi"], drift["prod_null_pct"]) == (0.0, pytest.approx(1 / 3))
    for measure in (monitor_error, regression_metrics):
        assert tuple(measure(dirty, "a", "b").first()) == pytest.approx(tuple(measure(df, "a", "b").first()))
    assert null_profile(spoilt, ["a"]).first()["null_pct"] == pytest.approx(1 / 3)
    text = spark.createDataFrame([("1",), ("NaN",), ("x",)], "a string")
    assert [r["a"] for r in coerce_numeric(text, ["a"]).collect()] == [1.0, None, None]


def test_hash_is_the_digest_of_seed_and_value(spark):
    from hashlib import md5

    from riskloom.functions.hashes import text_hash

    rows = [(0,), (7,), (-12,), (10**15,), (None,)]
    found = {r["i"]: r["h"] for r in spark.createDataFrame(rows, "i long").select("i", text_hash(42, F.col("i")).alias("h")).collect()}
    assert found == {i: int(md5(("42" if i is None else f"42:{i}").encode()).hexdigest()[:15], 16) for (i,) in rows}
