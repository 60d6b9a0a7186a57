"""Training records: events of a training, its drift baseline and data, and the promotions they lead to.

All tables only grow, and what a training leaves in several of them is one commit: its baseline, its data record, its SUCCESS
event and its promotion become visible together.  Whoever finds a promoted model also finds what is needed
to monitor it; a training that dies between two writes leaves only its start.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.registry import audit_history, current_champion
from riskloom.sources.commits import Commit, committed

EVENTS = "id_audit string, phase int, status string, at timestamp_ntz, error string, triggered_by string, result string"


def _event(spark: SparkSession, row: tuple) -> DataFrame:
    return spark.createDataFrame([row], EVENTS).coalesce(1)


def _write(spark: SparkSession, folder: str, name: str, row: tuple) -> None:
    commit = Commit(spark, folder, name)
    if not commit.there():
        commit.add("audit_events", _event(spark, row))
        commit.publish(row[3])


def log_start(spark: SparkSession, folder: str, id_audit: str, at: datetime, triggered_by: str = "manual") -> None:
    """The first start of a training counts; a repeated one is not recorded again."""
    _write(spark, folder, f"{id_audit}.start", (id_audit, 0, "PENDING", at, None, triggered_by, None))


def _success(result: DataFrame, id_audit: str, at: datetime, triggered_by: str) -> DataFrame:
    """`result` is the one row a training job returns; it is kept as a JSON text."""
    text = result.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]
    return _event(result.sparkSession, (id_audit, 1, "SUCCESS", at, None, triggered_by, text))


def log_result(result: DataFrame, folder: str, id_audit: str, at: datetime, triggered_by: str = "manual") -> None:
    commit = Commit(result.sparkSession, folder, id_audit)
    if not commit.there():
        commit.add("audit_events", _success(result, id_audit, at, triggered_by))
        commit.publish(at)


def log_failure(spark: SparkSession, folder: str, id_audit: str, at: datetime, error: str, triggered_by: str = "manual") -> None:
    _write(spark, folder, f"{id_audit}.error", (id_audit, 1, "ERROR", at, error, triggered_by, None))


def trainings(spark: SparkSession, folder: str) -> DataFrame:
    """Status, duration and error of every training."""
    events = committed(spark, folder, "audit_events")
    return audit_history(spark.createDataFrame([], EVENTS) if events is None else events, "id_audit")


def recorded_result(spark: SparkSession, folder: str, id_audit: str) -> str | None:
    """The recorded result of a training that has succeeded, as JSON."""
    events = committed(spark, folder, "audit_events")
    if events is None:
        return None
    row = events.where((F.col("id_audit") == id_audit) & (F.col("status") == "SUCCESS")).select("result").first()
    return row["result"] if row else None


#: What the verdict columns of the training jobs say of a new champion.
PROMOTED = {"promotion_status": "PROMOTED", "deployment_status": "NEW_CHAMPION"}


def record_training(
    spark: SparkSession,
    folder: str,
    id_audit: str,
    job: Callable[[], DataFrame],
    baseline: Callable[[], DataFrame] | None = None,
    dataset: Callable[[], DataFrame] | None = None,
    more: dict[str, Callable[[], DataFrame]] | None = None,
    triggered_by: str = "manual",
    clock: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None),
) -> DataFrame:
    """Run a training job and keep its events, baseline, data record and, if it wins, its promotion; returns its row.

    `more` names further tables and how to make their rows.

    An error is recorded and raised again.  A training that has succeeded is not run again: its recorded row is
    returned.  One that has died or failed may be repeated under its id; what it left unseen is replaced.
    """
    known = recorded_result(spark, folder, id_audit)
    if known is not None:
        return spark.range(1).select(F.from_json(F.lit(known), F.schema_of_json(F.lit(known))).alias("r")).select("r.*")
    log_start(spark, folder, id_audit, clock(), triggered_by)
    commit = Commit(spark, folder, id_audit)
    try:
        result = job()
        row = result.first().asDict()
        for table, make in {"baselines": baseline, "datasets": dataset, **(more or {})}.items():
            if make:
                commit.add(table, make().withColumn("id_audit", F.lit(id_audit)))
        at = clock()
        commit.add("audit_events", _success(result, id_audit, at, triggered_by))
        if any(row.get(column) == said for column, said in PROMOTED.items()):
            commit.add("promotions", spark.createDataFrame([(id_audit, at)], "id_audit string, at timestamp_ntz").coalesce(1))
        commit.publish(at)
    except Exception as error:
        log_failure(spark, folder, id_audit, clock(), str(error)[:1000], triggered_by)
        raise
    return result


def champion(spark: SparkSession, folder: str) -> tuple[str, dict] | None:
    """The audit id and the recorded result of the model promoted last; none before the first promotion."""
    promotions = committed(spark, folder, "promotions")
    newest = current_champion(promotions, "id_audit", "at").first() if promotions is not None else None
    if newest is None:
        return None
    return newest["id_audit"], json.loads(recorded_result(spark, folder, newest["id_audit"]))


def champion_table(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """The champion's rows of `baselines` or `datasets`."""
    held = champion(spark, folder)
    rows = committed(spark, folder, table) if held else None
    return rows.where(F.col("id_audit") == held[0]).drop("id_audit") if rows is not None else None
