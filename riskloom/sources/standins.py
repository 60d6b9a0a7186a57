"""Input relations derived from the test tables (FIXTURES.md, part B).

Each entry is one SELECT over the tables it names in braces.  The Spark side and
the checking side share these texts, so both start from the same input rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from riskloom.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")

STAND_INS = {
    "atm_tx": """
        SELECT l_suppkey * 100000 + (UNIX_DATE(d) - 9131) * 2 + CASE WHEN t = 'DEPOSIT' THEN 1 ELSE 0 END AS id_transaction,
               l_suppkey AS id_atm, d AS transaction_date, t AS transaction_type, CAST(a AS DOUBLE) / 100 AS amount,
               CAST(floor((UNIX_DATE(d) - 9131) / 30.0) AS BIGINT) AS id_sync,
               CAST(1 + (UNIX_DATE(d) - 9131) % 3 AS INT) AS id_weather
        FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d,
                     CASE WHEN l_returnflag = 'R' THEN 'DEPOSIT' ELSE 'WITHDRAWAL' END AS t,
                     SUM(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS a
              FROM {lineitem} GROUP BY 1, 2, 3) x""",
    "atms": """
        SELECT s_suppkey AS id_atm, (s_suppkey % 10) <> 0 AS active, CAST(1 + s_nationkey % 3 AS INT) AS id_location_type
        FROM {supplier}""",
    "weathers": """
        SELECT id_weather, CAST(id_weather * 10 AS INT) AS impact FROM {atm_tx} GROUP BY id_weather""",
    "atm_state": """
        SELECT s_suppkey AS id_atm,
               CASE WHEN s_suppkey % 25 = 24 THEN NULL ELSE CAST(50000 + (s_suppkey * 7919) % 50000 AS DOUBLE) END AS current_balance
        FROM {supplier}""",
    "withdrawal_prediction": """
        SELECT id_atm, transaction_date AS prediction_date,
               CAST(CASE WHEN id_transaction % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS id_withdrawal_model,
               round(amount * (0.8 + CAST(id_transaction % 41 AS DOUBLE) / 100), 4) AS predicted_value
        FROM {atm_tx} WHERE transaction_type = 'WITHDRAWAL' AND (id_transaction / 2) % 10 <> 0""",
    "fraud_tx": """
        SELECT event_id AS id_transaction, ts AS trans_date_time, value AS amt, user_id AS cc_num, event_type AS category,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fraud,
               CAST(event_id * 37 % 12000 AS DOUBLE) / 100 - 60 AS merch_lat,
               CAST(event_id * 53 % 36000 AS DOUBLE) / 100 - 180 AS merch_long
        FROM {events}""",
    "fraud_customer": """
        SELECT c_custkey AS id_customer, c_nationkey AS id_localization,
               UNIX_DATE(DATE '1950-01-01') + c_custkey * 137 % 18000 AS dob_days,
               c_mktsegment AS job, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               CAST(c_custkey * 71 % 12000 AS DOUBLE) / 100 - 60 AS lat, CAST(c_custkey * 29 % 36000 AS DOUBLE) / 100 - 180 AS long,
               1000 + c_nationkey * 5000 AS city_pop, r_name AS state
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "fraud_cards": """
        SELECT c_custkey AS cc_num, c_custkey AS id_customer FROM {customer}""",
    "fraud_people": """
        SELECT c_custkey AS id_customer, c_custkey AS id_localization, c_custkey % 2 AS id_gender, c_mktsegment AS job,
               UNIX_DATE(DATE '1950-01-01') + c_custkey * 137 % 18000 AS dob_days
        FROM {customer}""",
    "fraud_places": """
        SELECT c_custkey AS id_localization, CAST(c_custkey * 71 % 12000 AS DOUBLE) / 100 - 60 AS customer_lat,
               CAST(c_custkey * 29 % 36000 AS DOUBLE) / 100 - 180 AS customer_long,
               1000 + c_nationkey * 5000 AS city_pop, r_name AS state
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "fraud_genders": """
        SELECT DISTINCT c_custkey % 2 AS id_gender, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender_description
        FROM {customer}""",
    "fraud_categories": """
        SELECT DISTINCT event_type AS id_category, event_type AS category_name FROM {events}""",
    "fraud_predictions": """
        SELECT event_id AS id_transaction, ts AS prediction_date,
               CASE WHEN value >= 100 THEN 'ALTO RIESGO' ELSE 'BAJO RIESGO' END AS veredicto
        FROM {events}""",
    "churn_accounts": """
        SELECT c_custkey AS id_customer, c_nationkey AS id_country, CAST(300 + c_custkey * 7 % 550 AS INT) AS credit_score,
               CAST(18 + c_custkey * 13 % 60 AS INT) AS age, CAST(c_custkey % 11 AS INT) AS tenure, c_acctbal AS balance,
               CAST(1 + c_custkey % 4 AS INT) AS num_of_products, c_custkey % 3 = 0 AS has_cr_card, c_custkey % 2 = 0 AS is_active_member,
               CAST(20000 + c_custkey * 997 % 130000 AS DOUBLE) AS estimated_salary, c_acctbal < 1000 AS exited, CAST(c_custkey % 3 AS INT) AS id_gender
        FROM {customer}""",
    "countries": """
        SELECT n_nationkey AS id_country, n_name AS country_description FROM {nation}""",
    "churn_genders": """
        SELECT DISTINCT CAST(c_custkey % 3 AS INT) AS id_gender,
               CASE WHEN c_custkey % 3 = 0 THEN ' Male' WHEN c_custkey % 3 = 1 THEN 'MUJER' ELSE 'other' END AS gender_description
        FROM {customer}""",
    "churn_predictions": """
        SELECT event_id AS id_churn_prediction, user_id AS id_customer, ts AS prediction_date,
               CASE WHEN event_type = 'signup' THEN NULL ELSE value >= 60 END AS is_churn,
               CASE WHEN event_id % 20 = 0 THEN NULL ELSE value / 500 END AS churn_probability
        FROM {events}""",
    "delinquency": """
        SELECT o_orderkey AS id_row, CAST(10000 + o_orderkey * 7919 % 490000 AS DOUBLE) AS limit_bal, CAST(21 + o_orderkey * 13 % 50 AS INT) AS age,
               CAST(o_orderkey * 7 % 11 - 2 AS INT) AS pay_0, CAST(o_orderkey * 5 % 11 - 2 AS INT) AS pay_2, CAST(o_orderkey * 3 % 11 - 2 AS INT) AS pay_3,
               o_totalprice AS bill_amt1, o_totalprice / CAST(10000 + o_orderkey * 7919 % 490000 AS DOUBLE) AS utilization_rate,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS default_payment_next_month, o_orderdate AS monthly_period
        FROM {orders}""",
    "scored": """
        SELECT event_id AS id_row, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, value / 500 AS score,
               CAST(1 + event_id % 5 AS DOUBLE) / 5 AS weight
        FROM {events}""",
    "audits": """
        SELECT s_suppkey AS id_model, UNIX_DATE(DATE '2024-01-01') + s_suppkey AS start_day,
               CAST(600 + s_suppkey * 37 % 300 AS DOUBLE) / 1000 AS f1_score,
               CAST(550 + s_suppkey * 53 % 350 AS DOUBLE) / 1000 AS recall_score, CAST(700 + s_suppkey * 29 % 250 AS DOUBLE) / 1000 AS auc_roc,
               CAST(50 + s_suppkey * 17 % 200 AS DOUBLE) / 1000 AS mape, s_suppkey % 7 = 0 AS promoted_flag
        FROM {supplier}""",
}


def stand_in(spark: SparkSession, folder: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """`made` has stand-ins that are there already, for those that read them."""
    text, made = STAND_INS[name], made or {}
    inputs = {}
    for ref in set(re.findall(r"{(\w+)}", text)):
        inputs[ref] = made[ref] if ref in made else table(spark, folder, ref) if ref in TABLES else stand_in(spark, folder, ref, made)
    return spark.sql(text, **inputs)


def duckdb_text(name: str) -> str:
    """The same SELECT in DuckDB's dialect, as a parenthesised subquery."""
    text = STAND_INS[name]
    for ref in set(re.findall(r"{(\w+)}", text)):
        text = text.replace("{" + ref + "}", ref if ref in TABLES else f"{duckdb_text(ref)} {ref}")
    text = re.sub(r"UNIX_DATE\((DATE '[\d-]+'|\w+)\)", r"(\1 - DATE '1970-01-01')", text)
    return f"({text})"
