"""Churn and delinquency data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.base import bins_sql, counts_sql, frames, query, rounded, values_sql
from riskloom.functions.dates import timestamp_ntz
from riskloom.jobs import churn
from riskloom.operators.distributions import baseline_deciles_open, baseline_mixed, baseline_of_champion, pack_baseline
from riskloom.operators.features import churn_features, scale, standard_scaler
from riskloom.operators.joins import churn_extract, matured_feedback
from riskloom.operators.metrics import dataset_profile, weight_summary
from riskloom.operators.scans import (
    coerce_numeric,
    column_catalog,
    dataset_gate,
    dataset_start,
    latest,
    null_profile,
    trailing_months,
)
from riskloom.sources.tables import load, table

VOCABULARY = ("NATION_1", "NATION_2")
LABEL = "default_payment_next_month"
CUTOFF = "2024-01-25"


def extract(spark, folder):
    return churn_extract(*frames(spark, folder, "churn_accounts", "countries", "churn_genders"))


EXTRACT = """x AS (SELECT id_customer, credit_score AS "CreditScore", country_description AS "Geography", gender_description AS "Gender",
    age AS "Age", tenure AS "Tenure", balance AS "Balance", num_of_products AS "NumOfProducts",
    CASE WHEN has_cr_card THEN 1 ELSE 0 END AS "HasCrCard", CASE WHEN is_active_member THEN 1 ELSE 0 END AS "IsActiveMember",
    estimated_salary AS "EstimatedSalary", CASE WHEN exited THEN 1 ELSE 0 END AS "Exited"
    FROM churn_accounts a JOIN countries c ON a.id_country = c.id_country JOIN churn_genders g ON a.id_gender = g.id_gender)"""


@query("churn_extract", f"WITH {EXTRACT} SELECT * FROM x")
def extract_query(spark, folder):
    return extract(spark, folder)


CODED = f"""{EXTRACT}, coded AS (SELECT * EXCLUDE ("Gender", "Geography"),
    CASE lower(trim("Gender")) WHEN 'male' THEN 1 WHEN 'hombre' THEN 1 ELSE 0 END AS "Gender",
    CAST("Geography" = 'NATION_1' AS INT) AS "Geography_NATION_1", CAST("Geography" = 'NATION_2' AS INT) AS "Geography_NATION_2",
    "Tenure" / ("Age" + 1e-9::DOUBLE) AS "TenureByAge", "Balance" / ("EstimatedSalary" + 1e-9::DOUBLE) AS "BalanceSalaryRatio",
    "CreditScore" / ("Age" + 1e-9::DOUBLE) AS "CreditScoreGivenAge" FROM x)"""
RATIOS = ("TenureByAge", "BalanceSalaryRatio", "CreditScoreGivenAge")


@query(
    "churn_features",
    f"""WITH {CODED} SELECT * EXCLUDE ({", ".join(f'"{r}"' for r in RATIOS)}), {", ".join(f'round("{r}", 9) AS "{r}"' for r in RATIOS)} FROM coded""",
)
def features_query(spark, folder):
    return rounded(churn_features(extract(spark, folder), VOCABULARY), 9, *RATIOS)


SCALED = ("CreditScore", "Age", "Balance", "Gender", "HasCrCard")


@query(
    "standard_scale",
    f"""WITH {CODED}, fit AS (SELECT {", ".join(f'avg("{c}") AS m_{c}, CASE WHEN stddev_pop("{c}") = 0 THEN 1 ELSE stddev_pop("{c}") END AS s_{c}' for c in SCALED)} FROM coded)
        SELECT id_customer, {", ".join(f'round(("{c}" - m_{c}) / s_{c}, 6) AS "{c}"' for c in SCALED)} FROM coded, fit""",
)
def scale_query(spark, folder):
    rows = churn_features(extract(spark, folder), VOCABULARY).select("id_customer", *SCALED)
    return rounded(scale(rows, standard_scaler(rows, SCALED)))


@query(
    "scan_project",
    'SELECT o_orderkey AS "O_ORDERKEY", o_custkey AS "O_CUSTKEY", o_totalprice AS "O_TOTALPRICE", o_orderdate AS "O_ORDERDATE" FROM orders',
)
def scan_query(spark, folder):
    return load(spark, f"{folder}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"], upper=True)


@query(
    "coerce_numeric",
    """SELECT o_orderkey, TRY_CAST(t AS DOUBLE) AS price, coalesce(TRY_CAST(t AS DOUBLE), 0) AS label
       FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS t FROM orders) x""",
)
def coerce_query(spark, folder):
    orders = table(spark, folder, "orders")
    text = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(
        F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    )
    raw = orders.select("o_orderkey", text.alias("price"), text.alias("label"))
    return coerce_numeric(raw, ["price", "label"], {"label": 0.0})


@query(
    "recent_months_slice",
    "SELECT * FROM delinquency WHERE monthly_period >= (SELECT max(monthly_period) FROM delinquency) - INTERVAL 6 MONTH",
)
def months_query(spark, folder):
    (rows,) = frames(spark, folder, "delinquency")
    return trailing_months(rows, "monthly_period", 6)


@query(
    "dataset_start_date",
    """SELECT CAST(min(monthly_period) AS DATE) AS dataset_start FROM delinquency
       WHERE monthly_period >= (SELECT max(monthly_period) FROM delinquency) - INTERVAL 3 YEAR""",
)
def start_query(spark, folder):
    """Today is taken to be the newest period."""
    (rows,) = frames(spark, folder, "delinquency")
    return dataset_start(rows, "monthly_period", latest(rows, "monthly_period"))


@query(
    "dataset_gate",
    f"""WITH f AS (SELECT count(*) AS n, CAST(sum({LABEL}) AS BIGINT) AS p FROM delinquency)
        SELECT 'not_empty' AS "check", n, n > 0 AS passed FROM f UNION ALL SELECT 'enough_rows', n, n >= 100 FROM f
        UNION ALL SELECT 'has_positives', p, p >= 1 FROM f""",
)
def gate_query(spark, folder):
    (rows,) = frames(spark, folder, "delinquency")
    return dataset_gate(rows, LABEL)


@query(
    "null_profile",
    """SELECT 'is_churn' AS feature, round(1 - count(is_churn) / count(*), 9) AS null_pct, count(is_churn) AS n FROM churn_predictions
       UNION ALL SELECT 'churn_probability', round(1 - count(churn_probability) / count(*), 9), count(churn_probability) FROM churn_predictions
       UNION ALL SELECT 'id_customer', round(1 - count(id_customer) / count(*), 9), count(id_customer) FROM churn_predictions""",
)
def null_query(spark, folder):
    (rows,) = frames(spark, folder, "churn_predictions")
    return rounded(null_profile(rows, ["is_churn", "churn_probability", "id_customer"]), 9)


CATALOG = {
    "limit_bal": "DOUBLE", "age": "INT", "pay_0": "INT", "pay_2": "INT", "pay_3": "INT", "bill_amt1": "DOUBLE",
    "utilization_rate": "DOUBLE", LABEL: "INT",
}


@query(
    "column_catalog",
    " UNION ALL ".join(
        f"SELECT '{c.upper()}' AS name, '{t}' AS data_type, '{'TARGET' if c == LABEL else 'FEATURE'}' AS rol, count(*) > count({c}) AS is_nullable FROM delinquency"
        for c, t in CATALOG.items()
    )
    + " UNION ALL SELECT 'SAMPLE_WEIGHT', 'DOUBLE', 'WEIGHT', false",
)
def catalog_query(spark, folder):
    (rows,) = frames(spark, folder, "delinquency")
    return column_catalog(rows.drop("id_row", "monthly_period").withColumn("sample_weight", F.lit(1.0)), LABEL, "sample_weight")


@query(
    "dataset_profile",
    f"""SELECT count(*) AS total_samples, CAST(min(monthly_period) AS DATE) AS start_date, CAST(max(monthly_period) AS DATE) AS end_date,
        count(*) FILTER ({LABEL} = 1) AS positives, count(*) FILTER ({LABEL} = 0) AS negatives, round(avg({LABEL}), 9) AS positive_ratio FROM delinquency""",
)
def profile_query(spark, folder):
    (rows,) = frames(spark, folder, "delinquency")
    return rounded(dataset_profile(rows, LABEL, "monthly_period"), 9)


@query(
    "weight_summary",
    """SELECT count(*) AS total_samples, count(*) FILTER (label = 1) AS positives, round(avg(label), 9) AS positive_ratio,
       min(weight) AS weight_min, round(avg(weight), 9) AS weight_mean, max(weight) AS weight_max FROM scored""",
)
def weight_query(spark, folder):
    (rows,) = frames(spark, folder, "scored")
    return rounded(weight_summary(rows, "weight", "label"), 9, "positive_ratio", "weight_mean")


NEWEST = f"""f AS (SELECT p.id_customer, CAST(is_churn AS INT) AS predicted, CAST(exited AS INT) AS actual, churn_probability AS probability
    FROM churn_predictions p JOIN churn_accounts a ON p.id_customer = a.id_customer
    WHERE id_churn_prediction IN (SELECT max(id_churn_prediction) FROM churn_predictions
        WHERE prediction_date <= TIMESTAMP '{CUTOFF}' AND is_churn IS NOT NULL GROUP BY id_customer) AND exited IS NOT NULL)"""


def feedback(spark, folder):
    predictions, accounts = frames(spark, folder, "churn_predictions", "churn_accounts")
    return matured_feedback(predictions, accounts, timestamp_ntz(CUTOFF))


@query("matured_feedback", f"WITH {NEWEST} SELECT * FROM f")
def feedback_query(spark, folder):
    return feedback(spark, folder)


@query(
    "feedback_monitor",
    f"""WITH {NEWEST}, c AS (SELECT count(*) FILTER (predicted = 1 AND actual = 1) AS tp, count(*) FILTER (predicted = 1 AND actual = 0) AS fp,
            count(*) FILTER (predicted = 0 AND actual = 1) AS fn, count(*) FILTER (predicted = 0 AND actual = 0) AS tn, count(*) AS evaluated_samples FROM f),
        m AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(tp / nullif(tp + fp, 0), 0) AS p, (tp + tn) / evaluated_samples AS a FROM c),
        s AS (SELECT probability, sum(actual) AS pos, sum(1 - actual) AS neg FROM f WHERE probability IS NOT NULL GROUP BY 1),
        b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
        SELECT tp, fp, fn, tn, round(r, 4) AS recall, round(p, 4) AS precision, round(a, 4) AS accuracy,
            round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1_score, evaluated_samples,
            (SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 4) FROM b) AS auc_roc,
            CASE WHEN r >= 0.70 THEN 'healthy' ELSE 'degraded' END AS status FROM m""",
)
def monitor_query(spark, folder):
    predictions, accounts = frames(spark, folder, "churn_predictions", "churn_accounts")
    return churn.monitor(predictions, accounts, timestamp_ntz("2024-01-26"))


CONTINUOUS = ["limit_bal", "bill_amt1", "utilization_rate"]
CATEGORICAL = ["pay_0", "pay_2", "pay_3"]
_LIMITS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, min({c}) AS mn, max({c}) AS mx, (max({c}) - min({c})) / 10 AS step, count({c}) AS total FROM delinquency" for c in CONTINUOUS
)


@query(
    "baseline_mixed",
    f"""WITH lim AS ({_LIMITS}),
        bins AS (SELECT feature, CAST(i AS INT) AS bucket, mn + step * i AS lo, CASE WHEN i = 9 THEN mx ELSE mn + step * (i + 1) END AS hi, 10 AS k, total FROM lim, range(10) r(i)),
        cnt AS ({counts_sql(values_sql("delinquency", CONTINUOUS), closed=True)})
        SELECT c.feature, 'continuous' AS type, c.bucket, round(lo, 6) AS lo, round(hi, 6) AS hi, round(n / total, 9) AS share, n FROM cnt c JOIN lim USING (feature)
        UNION ALL
        SELECT feature, 'categorical', CAST(row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS INT), v, v, round(count(*) / sum(count(*)) OVER (PARTITION BY feature), 9), count(*)
        FROM ({values_sql("delinquency", CATEGORICAL)}) x GROUP BY feature, v""",
)
def mixed_query(spark, folder):
    (rows,) = frames(spark, folder, "delinquency")
    return rounded(rounded(baseline_mixed(rows, CATEGORICAL, CONTINUOUS), 9, "share"), 6, "lo", "hi")


CHAMPION_FEATURES = ["limit_bal", "age", "bill_amt1", "utilization_rate"]


@query(
    "champion_baseline",
    f"""WITH base AS (SELECT * FROM delinquency),
        {bins_sql("base", CHAMPION_FEATURES)}, counted AS ({counts_sql(values_sql("base", CHAMPION_FEATURES), closed=False)})
        SELECT feature, CAST(bucket AS INT) AS bucket, CASE WHEN bucket > 0 THEN round(lo, 6) END AS lo,
            CASE WHEN bucket < k - 1 THEN round(hi, 6) END AS hi, round(n / sum(n) OVER (PARTITION BY feature), 9) AS share
        FROM counted WHERE EXISTS (SELECT 1 FROM audits WHERE promoted_flag)""",
)
def champion_query(spark, folder):
    """The baseline is packed into the audit row of the newest promoted model, then read back."""
    rows, audits = frames(spark, folder, "delinquency", "audits")
    fitted = baseline_deciles_open(rows, CHAMPION_FEATURES)
    newest = audits.where("promoted_flag").select(F.max("id_model")).scalar()
    stored = audits.withColumn("is_production", F.col("id_model") == newest).withColumn(
        "psi_baseline", F.when(F.col("is_production"), pack_baseline(fitted).scalar())
    )
    return rounded(rounded(baseline_of_champion(stored), 9, "share"), 6, "lo", "hi")
