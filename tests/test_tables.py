"""Registry events, batch state, sinks and scans."""

import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.operators.joins import fill_missing, matured_feedback
from riskloom.operators.registry import audit_events, audit_history, champion_timeline, registry_violations
from riskloom.operators.scans import between_dates, coerce_numeric, dataset_gate, date_range_gate, next_version
from riskloom.session import shared_folder
from riskloom.sources.sinks import append, overwrite_partitions, publish_snapshot, read_snapshot
from riskloom.streaming.batches import empty_status, entity_status_rollup, status_merge

D = datetime.date


def test_end_is_midnight(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-10 00:00:00' AS ts UNION ALL SELECT timestamp_ntz'2024-01-10 00:00:01'")
    assert between_dates(df, "ts", "2024-01-10").count() == 1


def test_date_gate():
    date_range_gate("2024-01-01", "2024-02-01")
    for start, end in (("2024-02-01", "2024-01-01"), (None, "01/02/2024")):
        with pytest.raises(ValueError):
            date_range_gate(start, end)


def test_numbers_and_gate(spark):
    df = spark.createDataFrame([("1.5", "1"), ("x", "y")], "a string, y string")
    rows = coerce_numeric(df, ["a", "y"], {"y": 0.0})
    assert [tuple(r) for r in rows.collect()] == [(1.5, 1.0), (None, 0.0)]
    passed = {r["check"]: r["passed"] for r in dataset_gate(rows, "y").collect()}
    assert passed == {"not_empty": True, "enough_rows": False, "has_positives": True}


def test_versions(spark):
    df = spark.createDataFrame([("XGBRegressor_v1",), ("xgbregressor_v2",), ("other",)], "name string")
    assert next_version(df, "name", "XGBRegressor").first()["version"] == 3


def test_fill_keeps_known(spark):
    pairs = spark.createDataFrame([(1, 10, D(2024, 1, 1), 5.0, 4.0), (1, 11, D(2024, 1, 2), 5.0, None), (2, 12, D(2024, 1, 2), 5.0, None)],
                                  "id_atm long, id_transaction long, transaction_date date, amount double, predicted_value double")
    new = spark.createDataFrame([(1, D(2024, 1, 1), 9.0), (1, D(2024, 1, 2), 8.0)], "id_atm long, transaction_date date, new_value double")
    got = {r["id_transaction"]: r["predicted_value"] for r in fill_missing(pairs, new).collect()}
    assert got == {10: 4.0, 11: 8.0, 12: None}


def test_feedback_takes_the_newest_and_fans_out(spark):
    schema = "id_churn_prediction long, id_customer long, prediction_date timestamp_ntz, is_churn boolean, churn_probability double"
    t = datetime.datetime
    predictions = spark.createDataFrame(
        [(1, 7, t(2024, 1, 1), False, 0.1), (2, 7, t(2024, 1, 2), True, 0.8), (3, 7, t(2024, 1, 3), None, 0.5), (4, 7, t(2024, 2, 1), False, 0.2)], schema
    )
    accounts = spark.createDataFrame([(7, True), (7, False), (7, None), (8, True)], "id_customer long, exited boolean")
    rows = matured_feedback(predictions, accounts, F.lit("2024-01-15").cast("timestamp_ntz")).collect()
    assert sorted((r["predicted"], r["actual"], r["probability"]) for r in rows) == [(1, 0, 0.8), (1, 1, 0.8)]


def test_timeline_in_blocks(spark):
    df = spark.createDataFrame([(i, 100 + i * 3) for i in range(50)], "id long, day long").repartition(4)
    for rows in (10**6, 7):
        line = sorted(champion_timeline(df, "id", "day", rows).collect(), key=lambda r: r["valid_from"])
        assert [r["predecessor"] for r in line] == [None, *range(49)]
        assert [r["valid_to"] for r in line] == [100 + i * 3 for i in range(1, 50)] + [None]
        assert [r["is_active"] for r in line] == [False] * 49 + [True]


def test_audit_phases(spark):
    t = datetime.datetime
    audits = spark.createDataFrame([(1, t(2024, 1, 1), t(2024, 1, 1, 0, 2), True, "m"), (2, t(2024, 1, 1), t(2024, 1, 1, 0, 1), False, "broken")],
                                   "id long, a timestamp_ntz, b timestamp_ntz, good boolean, why string")
    events = audit_events(audits, F.col("a"), F.col("b"), F.col("good"), F.col("why"))
    done = {r["id"]: r for r in audit_history(events, "id").collect()}
    assert (done[1]["status"], done[1]["training_duration_seconds"], done[1]["error_message"]) == ("SUCCESS", 120, None)
    assert (done[2]["status"], done[2]["error_message"]) == ("ERROR", "broken")
    open_ones = audit_history(events.where("phase = 0"), "id").first()
    assert open_ones["status"] == "PENDING" and open_ones["end_training"] is None


def test_constraints(spark):
    models = spark.createDataFrame([(1, 5, 4, "a", None), (2, 5, 6, "a", 1), (3, 5, 6, None, 9)], "id long, s int, e int, v string, p long")
    found = {(r["rule"], r["key"]) for r in registry_violations(models, "id", "s", "e", "v", "p").collect()}
    assert found == {("end_before_start", "1"), ("version_repeated", "a"), ("version_missing", "3"), ("parent_unknown", "3")}


def test_status_merge(spark):
    schema = "id_transaction long, id_atm long, transaction_date date, transaction_type string, balance_after double, reload_flag boolean"
    rows = spark.createDataFrame([(1, 1, D(2024, 1, 1), "DEPOSIT", 50.0, False), (2, 1, D(2024, 1, 2), "DEPOSIT", 70.0, False), (3, 9, D(2024, 1, 2), "WITHDRAWAL", 7.0, True)], schema)
    state = empty_status(spark.createDataFrame([(1, 10.0), (2, 20.0)], "id_atm long, current_balance double"))
    state = state.withColumn("last_withdrawal_date", F.lit("2023-12-31").cast("date"))
    merged = {r["id_atm"]: r for r in status_merge(state, entity_status_rollup(rows), 5).collect()}
    assert set(merged) == {1, 2}
    one = merged[1]
    assert (one["current_balance"], one["last_deposit_date"], one["last_sync_id"], one["updated"]) == (70.0, D(2024, 1, 2), 5, True)
    assert one["last_withdrawal_date"] == D(2023, 12, 31) and one["last_reload_date"] is None
    assert merged[2]["current_balance"] == 20.0 and not merged[2]["updated"]


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(10).withColumn("day", F.col("id") % 2)
    append(df, f"{root}/t", "day")
    append(df, f"{root}/t", "day")
    assert spark.read.parquet(f"{root}/t").count() == 20
    overwrite_partitions(df.where("day = 0").limit(1), f"{root}/t", "day")
    assert spark.read.parquet(f"{root}/t").count() == 11
    publish_snapshot(df, f"{root}/s", 9)
    publish_snapshot(df.limit(3), f"{root}/s", 10)
    assert read_snapshot(spark, f"{root}/s").count() == 3


def test_shared_folder_is_stable(spark):
    assert shared_folder(spark) == shared_folder(spark)
