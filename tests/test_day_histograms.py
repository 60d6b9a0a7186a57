"""Histograms of days give what the rows of a window give."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators.day_histograms import DayStore, log_bucket, store_days, window_baseline, window_counts, window_psi, window_quantiles
from riskloom.operators.distributions import baseline_deciles_open, bucket_counts, psi_fraction
from riskloom.plans.quantiles import column_quantiles

NAMES = ["wide", "hot", "whole", "flat", "gone"]
LAST = datetime.date(2024, 3, 31)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(3000):
        day = LAST - datetime.timedelta(days=rng.choice([0, 0, *range(80)]))
        wide = rng.choice([None, math.nan, 0.0, rng.gauss(0, 1) * 10 ** rng.randint(-14, 12)])
        hot = 5.0 if rng.random() < 0.4 else 5.0 + rng.random() / 1e6
        out.append((day, wide, hot, rng.randint(-3, 40), 7.0, None))
    return spark.createDataFrame(out, "at date, wide double, hot double, whole int, flat double, gone double").persist()


@pytest.fixture(scope="module")
def store(spark, rows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("days"))
    assert not DayStore(spark, root).there
    store_days(rows, "at", NAMES, root)
    store_days(rows.where(F.col("at") > "2024-03-10"), "at", NAMES, root)  # again, in place of the first
    return DayStore(spark, root)


def last(rows, days):
    return rows.where(F.col("at") >= F.lit(LAST - datetime.timedelta(days=days)))


def test_buckets_follow_values(spark):
    values = sorted({s * m * 2.0**e for s in (-1, 1) for m in (1.0, 1.01, 1.5, 1.99) for e in range(-60, 60, 3)} | {0.0, -0.0, math.inf, -math.inf, 1.7e308})
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", log_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert [r["b"] for r in found] == sorted(r["b"] for r in found)


@pytest.mark.parametrize("days", [0, 7, 60])
def test_quantiles_are_exact(rows, store, days):
    direct = last(rows, days).select(*[F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")).alias(n) for n in NAMES])
    expected = column_quantiles(direct, NAMES, [i / 10 for i in range(11)])
    found = window_quantiles(store.window(days), NAMES)
    for n in NAMES:
        assert found[n] == (None if expected[n] is None else pytest.approx(expected[n], rel=1e-12, abs=0))


def test_baseline_and_drift_equal_those_of_the_rows(rows, store):
    expected, found = baseline_deciles_open(last(rows, 60), NAMES), window_baseline(store.window(60), NAMES)
    assert found.schema == expected.schema
    for a, b in zip(expected.collect(), found.collect(), strict=True):
        for c in expected.columns:
            assert b[c] == (pytest.approx(a[c], rel=1e-9) if isinstance(a[c], float) else a[c]), (c, a, b)
    for complete, names in ((False, NAMES), (True, NAMES[:4])):
        current = last(rows, 30).select("at", *(F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")).alias(n) for n in NAMES))
        current = current.dropna(subset=NAMES) if complete else current
        expected = psi_fraction(baseline_deciles_open(last(rows, 60), names), current, 0.1, 0.25, names).collect()
        found = window_psi(window_baseline(store.window(60), names), store.window(30, complete), 0.1, 0.25, names).collect()
        key = lambda r: r["feature"]
        for a, b in zip(sorted(expected, key=key), sorted(found, key=key), strict=True):
            assert (a["feature"], a["alert"], a["reason"], a["prod_samples"]) == (b["feature"], b["alert"], b["reason"], b["prod_samples"])
            assert a["psi"] == b["psi"] and a["prod_null_pct"] == (None if a["prod_null_pct"] is None else pytest.approx(b["prod_null_pct"]))


def test_counts_of_any_edges(rows, store):
    edges = {"wide": [-1e9, -3.0, 0.0, 1e-13, 2.5, 1e9], "whole": [0.0, 5.0, 5.0000001, 12.0, 40.0], "hot": [5.0, 5.0000005, 6.0]}
    clean = last(rows, 60)
    expected = {(r["feature"], r["bucket"]): r["n"] for r in bucket_counts(clean, edges, closed=False).collect()}
    assert {(r["feature"], r["bucket"]): r["n"] for r in window_counts(store.window(60), edges).collect()} == expected


def test_a_window_reads_its_days_and_opened_buckets(store):
    window = store.window(5)
    plan = window.values.where("feature = 'hot' AND bucket IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "In(bucket, [1,2])" in plan and "EqualTo(feature,hot)" in plan


def test_features_of_days_without_history_go_further_back(spark, tmp_path):
    """The newest days hold only an ATM without eleven rows before: the window ends where features end."""
    from riskloom.jobs import atm

    day = datetime.date(2024, 1, 1)
    rows = [(i, 1, day + datetime.timedelta(days=i), float(i * i)) for i in range(40)] + [(900 + i, 2, day + datetime.timedelta(days=300 + i), 1.0) for i in range(3)]
    tx = spark.createDataFrame(rows, "id_transaction long, id_atm long, transaction_date date, amount double")
    atm.refresh_monitored_days(tx, str(tmp_path), 10)
    store = DayStore(spark, str(tmp_path))
    assert store.newest == day + datetime.timedelta(days=39)
    assert store.window(10).values.where("feature = 'lag1'").count() == 11
