"""Champion, audit and constraint queries, and the writing of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.catalog.base import frames, query, rounded
from riskloom.operators.registry import (
    audit_events,
    audit_history,
    champion_timeline,
    current_champion,
    latest_audit_per_model,
    promotion_rules,
    recent_audits,
    registry_violations,
)
from riskloom.operators.scans import next_version
from riskloom.session import shared_folder
from riskloom.sources.sinks import append, overwrite_partitions, publish_snapshot, read_snapshot


def audits(spark, folder):
    return frames(spark, folder, "audits")[0]


def promotions(spark, folder):
    return audits(spark, folder).where("promoted_flag")


@query(
    "current_champion",
    """SELECT id_model, start_day, f1_score, recall_score, auc_roc, mape, promoted_flag, 'CHAMPION' AS promotion_status, true AS is_active
       FROM audits WHERE promoted_flag ORDER BY start_day DESC, id_model DESC LIMIT 1""",
)
def champion_query(spark, folder):
    return current_champion(promotions(spark, folder), "id_model", "start_day")


@query(
    "champion_timeline",
    """SELECT id_model, lag(id_model) OVER o AS predecessor, start_day AS valid_from, lead(start_day) OVER o AS valid_to,
       CASE WHEN lead(start_day) OVER o IS NULL THEN 'CHAMPION' ELSE 'RETIRED' END AS promotion_status, lead(start_day) OVER o IS NULL AS is_active
       FROM audits WHERE promoted_flag WINDOW o AS (ORDER BY start_day, id_model)""",
)
def timeline_query(spark, folder):
    return champion_timeline(promotions(spark, folder), "id_model", "start_day")


MODEL_OF_EVENT = "SELECT event_type AS model_name, event_id AS id_audit, ts AS start_training, value AS f1_score FROM events"


@query(
    "latest_audit_per_model",
    f"""WITH a AS ({MODEL_OF_EVENT}) SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER
        (PARTITION BY model_name ORDER BY start_training DESC, id_audit DESC) AS r FROM a) x WHERE r = 1""",
)
def latest_query(spark, folder):
    """Every event is read as an audit of the model named by its type."""
    return latest_audit_per_model(event_audits(spark, folder), "model_name", "start_training", "id_audit")


def event_audits(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select(
        F.col("event_type").alias("model_name"),
        F.col("event_id").alias("id_audit"),
        F.col("ts").alias("start_training"),
        F.col("value").alias("f1_score"),
    )


@query("recent_audits", f"WITH a AS ({MODEL_OF_EVENT}) SELECT * FROM a ORDER BY start_training DESC, id_audit DESC LIMIT 10")
def recent_query(spark, folder):
    return recent_audits(event_audits(spark, folder), "start_training", "id_audit", 10)


@query("next_version", "SELECT count(*) + 1 AS version FROM events WHERE event_type ILIKE '%CLI%'")
def version_query(spark, folder):
    return next_version(event_audits(spark, folder), "model_name", "CLI")


@query(
    "audit_history",
    """SELECT event_id AS id_audit, ts AS start_training, CASE WHEN event_type <> 'view' THEN ts + INTERVAL 1 SECOND * CAST(floor(value * 10) AS INT) END AS end_training,
       CASE WHEN event_type = 'view' THEN 'PENDING' WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status,
       CASE WHEN event_type = 'error' THEN props END AS error_message,
       CASE WHEN event_type <> 'view' THEN CAST(floor(value * 10) AS BIGINT) END AS training_duration_seconds FROM events""",
)
def history_query(spark, folder):
    """Trainings of type `view` are still running: only their first event exists."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    trainings = events.withColumnRenamed("event_id", "id_audit")
    seconds = F.floor(F.col("value") * 10)
    finished = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    logged = audit_events(trainings, F.col("ts"), finished, F.col("event_type") != "error", F.col("props"))
    logged = logged.where(~((F.col("event_type") == "view") & (F.col("phase") == 1)))
    return audit_history(logged, "id_audit")


CHAMPION = "b AS (SELECT * FROM audits WHERE promoted_flag ORDER BY start_day DESC, id_model DESC LIMIT 1)"


@query(
    "promotion_rules",
    f"""WITH {CHAMPION}, d AS (SELECT a.id_model, a.f1_score - b.f1_score AS f1, a.recall_score - b.recall_score AS rec, a.auc_roc - b.auc_roc AS auc,
            CASE WHEN b.auc_roc < 0.01 AND b.f1_score > 0.3 THEN (0.5 * a.f1_score + 0.5 * a.recall_score) - (0.5 * b.f1_score + 0.5 * b.recall_score)
                 ELSE (CAST(0.4 AS DOUBLE) * a.auc_roc + CAST(0.3 AS DOUBLE) * a.f1_score + CAST(0.3 AS DOUBLE) * a.recall_score)
                    - (CAST(0.4 AS DOUBLE) * b.auc_roc + CAST(0.3 AS DOUBLE) * b.f1_score + CAST(0.3 AS DOUBLE) * b.recall_score) END AS comp,
            a.mape, b.mape AS champion_mape FROM audits a, b WHERE NOT a.promoted_flag)
        SELECT id_model, round(f1, 9) AS f1_diff, round(rec, 9) AS recall_diff, round(auc, 9) AS auc_diff, round(comp, 9) AS composite_diff,
            round((champion_mape - mape) / champion_mape, 9) AS mape_margin,
            CASE WHEN (rec >= 0 AND f1 >= 0) OR (rec >= CAST(-0.01 AS DOUBLE) AND f1 > CAST(0.005 AS DOUBLE)) THEN 'PROMOTED' ELSE 'REJECTED' END AS fraud_status,
            CASE WHEN comp >= CAST(0.005 AS DOUBLE) THEN 'PROMOTED' ELSE 'REJECTED' END AS churn_status,
            CASE WHEN mape < champion_mape * (1 - CAST(0.05 AS DOUBLE)) THEN 'PROMOTED' ELSE 'REJECTED' END AS atm_status,
            CASE WHEN auc > CAST(0.015 AS DOUBLE) THEN 'PROMOTED' ELSE 'REJECTED' END AS delinquency_status FROM d""",
)
def rules_query(spark, folder):
    champion = current_champion(promotions(spark, folder), "id_model", "start_day")
    return rounded(promotion_rules(audits(spark, folder).where(~F.col("promoted_flag")), champion), 9)


MODELS = """m AS (SELECT o_orderkey AS id_model, CAST(o_orderdate AS DATE) AS start_day, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 13 - 1 AS INT) AS end_day,
    CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE 'v' || CAST(o_orderkey * 7 % 14000 AS VARCHAR) END AS version, o_custkey * 11 AS parent FROM orders)"""


@query(
    "registry_violations",
    f"""WITH {MODELS} SELECT 'end_before_start' AS rule, CAST(id_model AS VARCHAR) AS key FROM m WHERE end_day < start_day
        UNION ALL SELECT 'version_missing', CAST(id_model AS VARCHAR) FROM m WHERE version IS NULL
        UNION ALL SELECT 'version_repeated', version FROM m WHERE version IS NOT NULL GROUP BY version HAVING count(*) > 1
        UNION ALL SELECT 'parent_unknown', CAST(id_model AS VARCHAR) FROM m WHERE parent IS NOT NULL AND parent NOT IN (SELECT id_model FROM m)""",
)
def violations_query(spark, folder):
    """Orders read as models: some end before they start, versions repeat, some parents do not exist."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    nameless = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    start = F.to_date("o_orderdate")
    models = orders.select(
        F.col("o_orderkey").alias("id_model"),
        start.alias("start_day"),
        F.date_add(start, (F.col("o_orderkey") % 13 - 1).cast("int")).alias("end_day"),
        F.when(~nameless, F.concat(F.lit("v"), (F.col("o_orderkey") * 7 % 14000).cast("string"))).alias("version"),
        (F.col("o_custkey") * 11).alias("parent"),
    )
    return registry_violations(models, "id_model", "start_day", "end_day", "version", "parent")


@query("append_roundtrip", "SELECT * FROM atm_tx")
def roundtrip_query(spark, folder):
    """Batches appended in two steps, one day range replaced, a snapshot published; read back."""
    (tx,) = frames(spark, folder, "atm_tx")
    root = f"{shared_folder(spark)}/roundtrip-{uuid.uuid4().hex}"
    early = F.col("id_sync") < 42
    append(tx.where(early), f"{root}/tx", "id_sync")
    append(tx.where(~early), f"{root}/tx", "id_sync")
    overwrite_partitions(tx.where(F.col("id_sync").between(10, 20)), f"{root}/tx", "id_sync")
    stored = spark.read.schema(tx.schema).parquet(f"{root}/tx").select(*tx.columns)
    publish_snapshot(stored.where(early), f"{root}/snapshots", 1)
    publish_snapshot(stored, f"{root}/snapshots", 2)
    return read_snapshot(spark, f"{root}/snapshots")
