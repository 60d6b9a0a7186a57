"""Blocked series give what unblocked ones give, and both what a look back through a list gives."""

import datetime
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators.atm_series import atm_features, atm_lags, weekend_moving_avg, withdrawal_series
from riskloom.operators.balances import Transfer, balance_replay


@pytest.fixture(scope="module")
def tx(spark):
    """Three ATMs; one of them has most of the rows, several a day."""
    rng = np.random.default_rng(5)
    rows, day0 = [], datetime.date(2024, 1, 1)
    for atm, n, per_day in ((1, 40, 1), (2, 400, 4), (3, 8, 1)):
        for i in range(n):
            day = day0 + datetime.timedelta(days=int(i // per_day) + (i % 11 == 0 and per_day == 1))
            rows.append((atm * 10_000 + i, atm, day, float(rng.integers(100, 90_000)) / 100))
    pdf = pd.DataFrame(rows, columns=["id_transaction", "id_atm", "transaction_date", "amount"])
    return pdf, spark.createDataFrame(pdf, "id_transaction long, id_atm long, transaction_date date, amount double")


def days_until_monday(day):
    return (7 - day.weekday()) % 7


def expected_features(rows, fix):
    """Per id the features by hand: one ATM at a time, looking back through a list."""
    first, second = (6, 7) if fix else (5, 6)
    out = {}
    for atm in {r[1] for r in rows}:
        mine = sorted((day, i, amount) for i, a, day, amount in rows if a == atm)
        amounts = [amount for _, _, amount in mine]
        weekends = {}
        for day, _, amount in mine:
            if day.isoweekday() >= 6:
                weekends.setdefault(day + datetime.timedelta(days=days_until_monday(day)), []).append(amount)
        ends = sorted(weekends)
        moving = {}
        for k, end in enumerate(ends):
            recent = [statistics.fmean(weekends[e]) for e in ends[max(0, k - 6) : k + 1]]
            moving[end] = statistics.fmean(recent)
        for k in range(11, len(mine)):
            day, i, _ = mine[k]
            latest = {}
            for earlier, _, amount in mine[:k]:
                latest[earlier.isoweekday()] = amount
            a_week_ago = day - datetime.timedelta(days=7)
            seen = [latest[d] for d in (first, second) if d in latest]
            out[i] = {
                "lag_1": amounts[k - 1], "lag_5": amounts[k - 5], "lag_11": amounts[k - 11], "tendencia_lags": amounts[k - 1] - amounts[k - 11],
                "retiros_finde_anterior": moving.get(a_week_ago + datetime.timedelta(days=days_until_monday(a_week_ago)), statistics.fmean(amounts)),
                "retiros_sabado_anterior": latest.get(first), "retiros_domingo_anterior": latest.get(second),
                "ratio_finde_vs_semana": statistics.fmean(seen) / statistics.fmean(amounts[k - 5 : k]) if seen else 0.0,
                "domingo_bajo": int(fix and day.isoweekday() == 1 and amounts[k - 1] < statistics.median(amounts)),
            }
    return out


@pytest.mark.parametrize("series_rows,block", [(10**6, None), (50, 64), (50, 12)])
@pytest.mark.parametrize("fix", [False, True])
def test_features(tx, series_rows, block, fix):
    pdf, df = tx
    want = expected_features(list(pdf.itertuples(index=False, name=None)), fix)
    got = {r["id_transaction"]: r for r in atm_features(df, fix, series_rows, block).collect()}
    assert got.keys() == want.keys()
    for i, features in want.items():
        for name, value in features.items():
            assert got[i][name] == (None if value is None else pytest.approx(value, rel=1e-9)), (i, name)


def replay(rows, opening, cap):
    """The rule, one row at a time."""
    out, balance = [], opening
    for kind, amount in rows:
        flag = False
        if kind == "WITHDRAWAL":
            flag = balance is None or balance <= amount
            balance = cap if flag else balance - amount
        elif balance is not None:
            balance = min(balance + amount, cap)
        out.append((balance, flag))
    return out


@pytest.mark.parametrize("series_rows,block", [(10**6, None), (10, 25), (10, 3)])
def test_balances(spark, series_rows, block):
    rng = np.random.default_rng(9)
    rows, state, want = [], [], {}
    for atm, opening in ((1, 700), (2, None), (3, 5000), (4, -3)):
        series = []
        for day in range(60):
            for kind in ("DEPOSIT", "WITHDRAWAL"):
                if rng.random() < 0.8:
                    amount = int(rng.integers(0, 400)) if rng.random() < 0.9 else 1000
                    rows.append((atm * 1000 + len(series), atm, datetime.date(2024, 1, 1) + datetime.timedelta(days=day), kind, float(amount)))
                    series.append((kind, amount))
        for i, result in enumerate(replay(series, opening, 1000)):
            want[atm * 1000 + i] = result
        state.append((atm, None if opening is None else float(opening)))
    tx = spark.createDataFrame(rows, "id_transaction long, id_atm long, transaction_date date, transaction_type string, amount double")
    balances = spark.createDataFrame(state, "id_atm long, current_balance double")
    got = balance_replay(tx, balances, 1000.0, series_rows, block).collect()
    assert {r["id_transaction"]: (r["balance_after"], r["reload_flag"]) for r in got} == want


def test_transfer_function_stays_small():
    rng = np.random.default_rng(2)
    transfer = Transfer(100_000)
    for _ in range(5000):
        transfer.step("WITHDRAWAL" if rng.random() < 0.6 else "DEPOSIT", int(rng.integers(1, 20_000)))
    assert len(transfer.known) < 200 and len(transfer.limits) < 200


def test_blocks_agree_on_many_rows(spark):
    """A hot ATM with a third of the rows; enough rows for adaptive execution to change the joins."""
    n = 300_000
    atm = F.when(F.col("id") % 3 == 0, F.lit(7).cast("long")).otherwise(F.pmod(F.xxhash64("id"), F.lit(40)))
    day = F.date_add(F.lit("2015-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(2000)).cast("int"))
    tx = spark.range(n).select(
        F.col("id").alias("id_transaction"),
        atm.alias("id_atm"),
        day.alias("transaction_date"),
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(9_000_000)) / 100).alias("amount"),
        F.when(F.col("id") % 4 == 1, "DEPOSIT").otherwise("WITHDRAWAL").alias("transaction_type"),
    )
    state = spark.range(40).select(F.col("id").alias("id_atm"), F.lit(60_000.0).alias("current_balance"))

    def digest(df):
        columns = [F.round(c, 6) if kind == "double" else F.col(c) for c, kind in sorted(df.dtypes)]
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))).first())

    whole, blocks = (digest(balance_replay(tx, state, 500_000.0, rows)) for rows in (10**9, 12_000))
    assert whole == blocks
    rows = tx.drop("transaction_type")
    assert digest(atm_features(rows, series_rows=10**9)) == digest(atm_features(rows, series_rows=12_000))


def test_missing_keys_are_kept_in_blocks(spark):
    """Rows without an ATM or a day come first and are the same rows with and without blocks."""
    day = datetime.date(2024, 1, 1)
    rows = [
        (i, None if i % 7 == 0 else i % 2, None if i % 5 == 0 else day + datetime.timedelta(days=i // 6), None if i % 11 == 0 else float(i % 13), ("DEPOSIT", "WITHDRAWAL", None)[i % 3])
        for i in range(240)
    ]
    tx = spark.createDataFrame(rows, "id_transaction long, id_atm long, transaction_date date, amount double, transaction_type string")
    state = spark.createDataFrame([(0, 20.0), (1, None)], "id_atm long, current_balance double")

    def both(made):
        whole, blocks = (sorted(map(tuple, made(n, b).collect()), key=repr) for n, b in ((10**6, None), (20, 25)))
        assert whole == blocks and made(20, 25).schema == made(10**6, None).schema
        return whole

    assert len(both(lambda n, b: balance_replay(tx, state, 30.0, n, b))) == 240
    assert len(both(lambda n, b: atm_lags(withdrawal_series(tx, n, b)).rows())) == 240
    for fix in (False, True):
        both(lambda n, b, fix=fix: atm_features(tx, fix, n, b))


def test_amounts_below_a_cent_count(spark):
    rows = [(1, 1, datetime.date(2024, 1, 6), 1.004), (2, 1, datetime.date(2024, 1, 7), 1.004)]
    tx = spark.createDataFrame(rows, "id_transaction long, id_atm long, transaction_date date, amount double")
    assert weekend_moving_avg(tx).first()["media_finde"] == 1.004


@pytest.mark.parametrize("series_rows, block", [(2_000_000, None), (50, 20)])
def test_features_around_wanted_rows_are_those_of_all_rows(spark, tx, series_rows, block):
    """Rows after long pauses, of days without a date and of ATMs without an id; wanted are single rows and runs of them."""
    from riskloom.operators.atm_series import features_around

    pdf, _ = tx
    rng = np.random.default_rng(8)
    rows = [tuple(r) for r in pdf.itertuples(index=False)]
    day = datetime.date(2023, 1, 2)
    for i in range(120):  # an ATM with pauses of many weeks
        day += datetime.timedelta(days=int(rng.choice([1, 2, 9, 60])))
        rows.append((50_000 + i, 5, day, None if i % 17 == 0 else float(rng.integers(100, 9000))))
    rows += [(60_000 + i, None, datetime.date(2024, 2, 1) + datetime.timedelta(days=i // 2), float(i)) for i in range(40)]
    rows += [(70_000 + i, 2, None, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "id_transaction long, id_atm long, transaction_date date, amount double")
    wanted = (F.col("id_transaction") % 13 == 0) | F.col("id_transaction").between(20_200, 20_215) | F.col("id_transaction").between(50_060, 50_064)
    columns = sorted(atm_features(df).columns)
    every = {r["id_transaction"]: r for r in atm_features(df).select(*columns).collect()}
    found = features_around(df, wanted, series_rows, block).select(*columns).collect()
    expected = [every[r["id_transaction"]] for r in df.where(wanted).collect() if r["id_transaction"] in every]
    assert sorted(map(repr, found)) == sorted(map(repr, expected)) and len(found) > 40


def test_only_weeks_around_wanted_rows_are_looked_at(spark, tx):
    from riskloom.operators.atm_series import weekly_facts, weeks_around

    _, df = tx
    near = weeks_around(weekly_facts(df, F.col("id_transaction") == 10_030)).collect()
    assert {r["id_atm"] for r in near} == {1} and 2 <= len(near) <= 4
