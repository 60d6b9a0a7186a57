"""Relations put together.

No join is hinted: Spark broadcasts a side only after checking its size and
otherwise shuffles, with adaptive execution splitting skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.dates import completed_years_strict, decay_weight
from riskloom.functions.geo import haversine_km


def fraud_star(
    tx: DataFrame, cards: DataFrame, people: DataFrame, places: DataFrame, genders: DataFrame, categories: DataFrame
) -> DataFrame:
    """Transactions with their card holder, locality, gender and category; all must exist."""
    return (
        tx.join(cards, "cc_num")
        .join(people, "id_customer")
        .join(places, "id_localization")
        .join(genders, "id_gender")
        .join(categories, "id_category")
        .select(
            "id_transaction",
            "amt",
            "city_pop",
            F.col("category_name").alias("category"),
            F.col("gender_description").alias("gender"),
            "job",
            F.col("customer_lat").alias("lat"),
            F.col("customer_long").alias("long"),
            "merch_lat",
            "merch_long",
            F.col("trans_date_time").alias("trans_date_trans_time"),
            "dob",
            "is_fraud",
        )
    )


def with_decay(star: DataFrame, end: Column, lam: float) -> DataFrame:
    return star.withColumn("sample_weight", decay_weight(F.col("trans_date_trans_time"), end, lam))


def high_risk(
    predictions: DataFrame,
    tx: DataFrame,
    cards: DataFrame,
    people: DataFrame,
    places: DataFrame,
    categories: DataFrame,
    since: Column | None = None,
    verdict: str = "ALTO RIESGO",
) -> DataFrame:
    """Rows judged high risk, with what clustering needs; an unknown category is kept as null."""
    flagged = predictions.where(F.col("veredicto") == verdict)
    if since is not None:
        flagged = flagged.where(F.col("prediction_date") >= since)
    return (
        flagged.select("id_transaction")
        .join(tx.where(F.col("merch_lat").isNotNull()), "id_transaction")
        .join(cards, "cc_num")
        .join(people.where(F.col("dob").isNotNull()), "id_customer")
        .join(places, "id_localization")
        .join(categories, "id_category", "left")
        .select(
            "id_transaction",
            "amt",
            F.hour("trans_date_time").alias("hour"),
            completed_years_strict(F.col("dob"), F.to_date("trans_date_time")).alias("age"),
            haversine_km(
                F.col("customer_long"), F.col("customer_lat"), F.col("merch_long"), F.col("merch_lat")
            ).alias("distance_km"),
            "city_pop",
            F.col("category_name").alias("category"),
            "state",
        )
    )


def churn_extract(accounts: DataFrame, countries: DataFrame, genders: DataFrame) -> DataFrame:
    """One training row per account; a null flag counts as 0."""

    def flag(name: str) -> Column:
        return F.when(F.col(name), 1).otherwise(0)

    return (
        accounts.join(countries, "id_country")
        .join(genders, "id_gender")
        .select(
            "id_customer",
            F.col("credit_score").alias("CreditScore"),
            F.col("country_description").alias("Geography"),
            F.col("gender_description").alias("Gender"),
            F.col("age").alias("Age"),
            F.col("tenure").alias("Tenure"),
            F.col("balance").alias("Balance"),
            F.col("num_of_products").alias("NumOfProducts"),
            flag("has_cr_card").alias("HasCrCard"),
            flag("is_active_member").alias("IsActiveMember"),
            F.col("estimated_salary").alias("EstimatedSalary"),
            flag("exited").alias("Exited"),
        )
    )


def actual_vs_prediction(tx: DataFrame, predictions: DataFrame, model_id: int) -> DataFrame:
    """Every withdrawal with the prediction of one model, null where it has none."""
    of_model = predictions.where(F.col("id_withdrawal_model") == model_id).select(
        "id_atm", F.col("prediction_date").alias("transaction_date"), "predicted_value"
    )
    return (
        tx.where(F.col("transaction_type") == "WITHDRAWAL")
        .join(of_model, ["id_atm", "transaction_date"], "left")
        .select("id_atm", "id_transaction", "transaction_date", "amount", "predicted_value")
    )


def scoring_inputs(features: DataFrame, tx: DataFrame, atms: DataFrame, weathers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Model inputs for the wanted transactions."""
    days = tx.select("id_transaction", "id_atm", "transaction_date", "id_weather")
    return model_inputs(features.join(wanted.select("id_transaction"), "id_transaction", "left_semi").join(days, "id_transaction"), atms, weathers)


def model_inputs(features: DataFrame, atms: DataFrame, weathers: DataFrame) -> DataFrame:
    """Features of transactions beside the place of their ATM and the weather of their day."""
    return (
        features.join(atms.select("id_atm", "id_location_type"), "id_atm")
        .join(weathers, "id_weather")
        .select(
            F.col("id_atm").alias("atm"),
            "id_transaction",
            F.col("transaction_date").alias("prediction_date"),
            F.col("day_of_week").alias("diaSemana"),
            F.col("id_location_type").alias("ubicacion"),
            "lag1",
            "lag5",
            "lag11",
            "tendencia_lags",
            "ratio_finde_vs_semana",
            "retiros_finde_anterior",
            "retiros_domingo_anterior",
            "domingo_bajo",
            "caida_reciente",
            F.col("impact").alias("ambiente"),
        )
    )


def prediction_bounds(predictions: DataFrame, value: str, margin: float) -> DataFrame:
    return predictions.withColumns({"lower_bound": F.col(value) - margin, "upper_bound": F.col(value) + margin})


def fill_missing(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """Fill null predictions from (id_atm, transaction_date, new_value) in one join; known ones stay."""
    new = scored.select(F.col("id_atm").alias("__atm"), F.col("transaction_date").alias("__day"), "new_value")
    gap = F.col("predicted_value").isNull() & (F.col("id_atm") == F.col("__atm")) & (F.col("transaction_date") == F.col("__day"))
    filled = pairs.join(new, gap, "left").withColumn("predicted_value", F.coalesce("predicted_value", "new_value"))
    return filled.select(*pairs.columns)


def matured_feedback(predictions: DataFrame, accounts: DataFrame, cutoff: Column) -> DataFrame:
    """The newest judged prediction of each customer, beside what the customer did.

    One pre-aggregated shuffle finds the newest row, by hash as its parts are plain numbers; accounts are not
    made unique, so a customer with two accounts counts twice.
    """
    last = lambda c: F.max_by(c, "id_churn_prediction").alias(c)
    newest = (
        predictions.where((F.col("prediction_date") <= cutoff) & F.col("is_churn").isNotNull())
        .groupBy("id_customer")
        .agg(last("is_churn"), last("churn_probability"))
    )
    return (
        newest.join(accounts.where(F.col("exited").isNotNull()).select("id_customer", "exited"), "id_customer")
        .select(
            "id_customer",
            F.col("is_churn").cast("int").alias("predicted"),
            F.col("exited").cast("int").alias("actual"),
            F.col("churn_probability").alias("probability"),
        )
    )
