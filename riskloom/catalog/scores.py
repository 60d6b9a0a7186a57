"""Ranking and classification metrics over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.base import frames, query, rounded
from riskloom.operators.clusters import CLUSTER_FEATURES, cluster_profile
from riskloom.operators.joins import high_risk
from riskloom.operators.metrics import class_report, confusion, ks_statistic, optimal_threshold, pr_curve, roc_auc
from riskloom.operators.models import soft_vote

THRESHOLD = 0.2


def scored(spark, folder):
    return frames(spark, folder, "scored")[0].withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


RATES = """coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
    (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy"""


def _confusion(cell: str) -> str:
    cells = ", ".join(
        cell.format(cond=f"score {'>=' if p else '<'} {THRESHOLD} AND label = {a}") + f" AS {n}"
        for n, p, a in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))
    )
    return f"""WITH c AS (SELECT {cells} FROM scored), r AS (SELECT *, {RATES} FROM c)
        SELECT {{cells}}, round(recall, 9) AS recall, round(precision, 9) AS precision, round(accuracy, 9) AS accuracy,
        round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1_score FROM r"""


@query("confusion_metrics", _confusion("count(*) FILTER ({cond})").format(cells="tp, fp, fn, tn"))
def confusion_query(spark, folder):
    return rounded(confusion(scored(spark, folder), F.col("label"), F.col("predicted")), 9)


@query(
    "weighted_confusion",
    _confusion("coalesce(sum(weight) FILTER ({cond}), 0)").format(cells=", ".join(f"round({c}, 6) AS {c}" for c in ("tp", "fp", "fn", "tn"))),
)
def weighted_query(spark, folder):
    found = confusion(scored(spark, folder), F.col("label"), F.col("predicted"), F.col("weight"))
    return rounded(rounded(found, 6, "tp", "fp", "fn", "tn"), 9, "recall", "precision", "accuracy", "f1_score")


@query(
    "class_report",
    f"""WITH s AS (SELECT label, CAST(score >= {THRESHOLD} AS INT) AS p FROM scored), k AS (SELECT DISTINCT label FROM s),
        r AS (SELECT k.label, (SELECT count(*) FROM s WHERE s.label = k.label) AS support, (SELECT count(*) FROM s WHERE p = k.label) AS said,
              (SELECT count(*) FROM s WHERE p = k.label AND s.label = k.label) AS hits FROM k)
        SELECT label, round(coalesce(hits / nullif(said, 0), 0), 9) AS precision, round(coalesce(hits / nullif(support, 0), 0), 9) AS recall,
            round(coalesce(2 * (hits / nullif(said, 0)) * (hits / nullif(support, 0)) / nullif(hits / nullif(said, 0) + hits / nullif(support, 0), 0), 0), 9) AS f1_score, support FROM r""",
)
def report_query(spark, folder):
    return rounded(class_report(scored(spark, folder), "label", "predicted"), 9)


BELOW = "OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
PER_SCORE = f"""g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
    b AS (SELECT *, coalesce(sum(pos) {BELOW}, 0) AS pos_below, coalesce(sum(neg) {BELOW}, 0) AS neg_below, sum(pos) OVER () AS p, sum(neg) OVER () AS q FROM g)"""
AUC = "sum(CAST(pos AS DOUBLE) * (2 * neg_below + neg)) / (2 * CAST(max(p) AS DOUBLE) * max(q))"


@query("roc_auc", f"WITH {PER_SCORE} SELECT round({AUC}, 12) AS auc, CAST(max(p) + max(q) AS BIGINT) AS n FROM b")
def auc_query(spark, folder):
    return rounded(roc_auc(scored(spark, folder), "label", "score"), 12)


@query(
    "roc_auc_weighted",
    f"""WITH g AS (SELECT score, sum(label * weight) AS pos, sum((1 - label) * weight) AS neg, count(*) AS n FROM scored GROUP BY score),
        b AS (SELECT *, coalesce(sum(neg) {BELOW}, 0) AS neg_below FROM g)
        SELECT round(sum(pos * (neg_below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc, CAST(sum(n) AS BIGINT) AS n FROM b""",
)
def weighted_auc_query(spark, folder):
    return rounded(roc_auc(scored(spark, folder), "label", "score", "weight"), 9)


@query(
    "ks_statistic",
    f"WITH {PER_SCORE} SELECT round(max(abs((pos_below + pos) / p - (neg_below + neg) / q)), 12) AS ks, round(2 * {AUC} - 1, 12) AS gini FROM b",
)
def ks_query(spark, folder):
    return rounded(ks_statistic(scored(spark, folder), "label", "score"), 12)


CURVE = f"""{PER_SCORE}, c AS (SELECT score AS threshold, (p - pos_below) / (p - pos_below + q - neg_below) AS precision,
    (p - pos_below) / p AS recall FROM b)"""


@query("pr_curve", f"WITH {CURVE} SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM c")
def curve_query(spark, folder):
    return rounded(pr_curve(scored(spark, folder), "label", "score"), 9, "precision", "recall")


@query(
    "optimal_threshold",
    f"""WITH {CURVE} SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM c
        WHERE recall >= 0.95 ORDER BY c.precision DESC, threshold LIMIT 1""",
)
def threshold_query(spark, folder):
    return rounded(optimal_threshold(scored(spark, folder), "label", "score"), 9, "precision", "recall")


@query(
    "soft_vote",
    """SELECT id_row, round((2 * score + weight / 2 + (score + weight) / 3) / 4, 9) AS probability,
       CAST((2 * score + weight / 2 + (score + weight) / 3) / 4 > 0.5 AS INT) AS prediction FROM scored""",
)
def vote_query(spark, folder):
    rows = scored(spark, folder).select(
        "id_row",
        F.col("score").alias("a"),
        (F.col("weight") / 2).alias("b"),
        ((F.col("score") + F.col("weight")) / 3).alias("c"),
    )
    return rounded(soft_vote(rows, ["a", "b", "c"]).drop("a", "b", "c"), 9)


def assigned(spark, folder):
    """High-risk rows with clusters given by the hour: night, morning and the rest."""
    from riskloom.catalog.fraud import tables

    t = tables(spark, folder)
    (predictions,) = frames(spark, folder, "fraud_predictions")
    rows = high_risk(predictions, t.tx, t.cards, t.people, t.places, t.categories).dropna(subset=CLUSTER_FEATURES)
    return rows.withColumn("cluster_id", F.when(F.col("hour") < 6, 0).when(F.col("hour") < 12, 1).otherwise(2))


def _profile_sql() -> str:
    from riskloom.catalog.fraud import KM, STAR, STRICT_AGE

    age = STRICT_AGE.format(t="trans_date_trans_time", b="dob")
    top = "(SELECT {c} FROM a x WHERE x.cluster_id = g.cluster_id AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {n}"
    return f"""WITH {STAR},
        r AS (SELECT s.*, CAST(hour(trans_date_trans_time) AS INT) AS hour, {age} AS age, {KM} AS distance_km
              FROM star s JOIN fraud_predictions p ON s.id_transaction = p.id_transaction WHERE veredicto = 'ALTO RIESGO'),
        a AS (SELECT *, CASE WHEN hour < 6 THEN 0 WHEN hour < 12 THEN 1 ELSE 2 END AS cluster_id FROM r),
        g AS (SELECT cluster_id, count(*) AS fraud_count, avg(amt) AS m, avg(hour) AS h, avg(age) AS y, avg(distance_km) AS d, avg(city_pop) AS c FROM a GROUP BY 1)
        SELECT cluster_id, 'Fraude ' || CASE WHEN m >= (SELECT quantile_cont(amt, 0.75) FROM a) THEN 'alto monto' ELSE 'bajo monto' END || ', '
            || CASE WHEN h >= 20 OR h < 6 THEN 'nocturno' WHEN h < 12 THEN 'matutino' ELSE 'diurno' END
            || CASE WHEN d > 200 THEN ', distancia lejana' WHEN d < 20 THEN ', distancia cercana' ELSE '' END AS label,
            fraud_count, round(fraud_count / (SELECT count(*) FROM a) * 100, 2) AS pct_of_total, round(m, 2) AS avg_amount, round(h, 1) AS avg_hour,
            round(y, 1) AS avg_age, round(d, 2) AS avg_distance_km, round(c, 0) AS avg_city_pop,
            {top.format(c="category", n="top_category")}, {top.format(c="state", n="top_state")} FROM g"""


@query("cluster_profile", _profile_sql())
def profile_query(spark, folder):
    return cluster_profile(assigned(spark, folder))
