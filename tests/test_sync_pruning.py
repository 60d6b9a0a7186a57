"""A sync reads only the days it touches."""

import datetime

from pyspark.sql import functions as F

from riskloom.jobs import atm
from riskloom.sources.sinks import append
from riskloom.streaming.batches import empty_status

SCHEMA = "id_transaction long, id_atm long, transaction_date date, transaction_type string, amount double"
DAYS = [datetime.date(2024, 1, d) for d in range(1, 9)]


def store(spark, root):
    rows = [(i, i % 3, DAYS[i % 8] if i % 9 else None, "WITHDRAWAL", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id_sync", F.lit(1).cast("long"))
    append(df, f"{root}/t", "transaction_date")
    return spark.read.parquet(f"{root}/t"), rows


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_become_partition_filters(spark, tmp_path):
    stored, rows = store(spark, str(tmp_path))
    for wanted in ([DAYS[2]], [DAYS[0], None], [None], []):
        found = atm.of_days(stored, wanted)
        assert found.count() == sum(r[2] in wanted for r in rows)
        if wanted and None not in wanted:
            plan = plan_of(found)
            assert "PartitionFilters: [transaction_date" in plan or "PartitionFilters: [isnotnull(transaction_date" in plan


def test_many_days_are_pruned_by_the_join(spark, tmp_path):
    stored, rows = store(spark, str(tmp_path))
    batch = spark.createDataFrame([(1, 1, d, "WITHDRAWAL", 1.0) for d in (DAYS[1], DAYS[5], None)], SCHEMA)
    few, many = atm.touched_days(batch), atm.touched_days(batch, limit=2)
    assert set(few) == {DAYS[1], DAYS[5], None} and not isinstance(many, list)
    same = [sorted(r["id_transaction"] for r in atm.of_days(stored, d).collect()) for d in (few, many)]
    assert same[0] == same[1] == sorted(r[0] for r in rows if r[2] in few)


def test_ids_are_reserved_before_rows_are_written(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    state = empty_status(spark.createDataFrame([(1, 100.0)], "id_atm long, current_balance double"))
    known = spark.createDataFrame([(50, 1, DAYS[0], "WITHDRAWAL", 1.0)], SCHEMA)
    batch = spark.createDataFrame([(1, 1, DAYS[0], "WITHDRAWAL", 1.0), (2, 1, DAYS[1], "WITHDRAWAL", 1.0)], SCHEMA)

    class Killed(BaseException):
        pass

    def killed(*_):
        raise Killed

    with monkeypatch.context() as patch:
        patch.setattr(atm, "overwrite_partitions", killed)
        try:
            atm.sync(batch, known, state, 1, folder=root)
        except Killed:
            pass
    atm.sync(batch, known, state, 1, folder=root)  # repeated: its rows are there already
    atm.sync(batch, known, state, 2, folder=root)
    ids = sorted(r["id_transaction"] for r in spark.read.parquet(f"{root}/daily_atm_transactions").collect())
    assert ids == [51, 52, 53, 54]
    totals = spark.read.parquet(f"{root}/historical_daily_atm").collect()
    assert {(r["transaction_date"], r["movements"]) for r in totals} == {(DAYS[0], 2), (DAYS[1], 2)}
