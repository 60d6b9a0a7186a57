"""Row-wise features, documents and encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.dates import completed_years, iso_weekday, week_ending_monday
from riskloom.functions.geo import haversine_km
from riskloom.functions.numeric import smoothed_ratio
from riskloom.functions.rows import literal_rows
from riskloom.plans.ordered import BLOCK_ROWS, global_position
from riskloom.plans.quantiles import column_quantiles

LOCAL_CODES = 1_000

# Spellings of the binary gender column, and the kept geography vocabulary.
GENDER_CODES = {"male": 1, "hombre": 1, "female": 0, "mujer": 0}
GEOGRAPHIES = ("Germany", "Spain")
CHURN_FEATURES = [
    "CreditScore", "Gender", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember",
    "EstimatedSalary", "TenureByAge", "BalanceSalaryRatio", "CreditScoreGivenAge", "Geography_Germany",
    "Geography_Spain",
]
DOCUMENT_SCHEMA = (
    "lag1 double, lag5 double, lag11 double, domingo_bajo int, caida_reciente int, tendencia_lags double, "
    "ratio_finde_vs_semana double, retiros_finde_anterior double, retiros_domingo_anterior double"
)


def fraud_features(star: DataFrame) -> DataFrame:
    """Age, hour and distance between home and merchant."""
    return star.withColumns(
        {
            "age": completed_years(F.col("dob"), F.col("trans_date_trans_time")),
            "hour": F.hour("trans_date_trans_time"),
            "distance_km": haversine_km(F.col("long"), F.col("lat"), F.col("merch_long"), F.col("merch_lat")),
        }
    )


def calendar_features(df: DataFrame, date_col: str) -> DataFrame:
    day = F.col(date_col)
    return df.withColumns(
        {
            "dia_mes": F.dayofmonth(day),
            "mes": F.month(day),
            "dia_semana": iso_weekday(day),
            "es_findesemana": iso_weekday(day).isin(6, 7).cast("int"),
            "semana": week_ending_monday(day),
        }
    )


def binary_gender(gender: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in GENDER_CODES.items() for x in pair])
    return F.coalesce(codes[F.lower(F.trim(gender))], F.lit(0))


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """0/1 columns for a fixed vocabulary; any other value is 0 in all of them."""
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values})


def churn_features(extract: DataFrame, vocabulary: Sequence[str] = GEOGRAPHIES) -> DataFrame:
    coded = one_hot(extract, "Geography", vocabulary).withColumns(
        {
            "TenureByAge": smoothed_ratio(F.col("Tenure"), F.col("Age")),
            "BalanceSalaryRatio": smoothed_ratio(F.col("Balance"), F.col("EstimatedSalary")),
            "CreditScoreGivenAge": smoothed_ratio(F.col("CreditScore"), F.col("Age")),
            "Gender": binary_gender(F.col("Gender")),
        }
    )
    return coded.drop("Geography")


def pack_features(features: DataFrame) -> DataFrame:
    """The stored form of ATM features: date parts, amount and one JSON document; nulls stay visible."""
    document = F.struct(
        F.col("lag_1").alias("lag1"),
        F.col("lag_5").alias("lag5"),
        F.col("lag_11").alias("lag11"),
        "domingo_bajo",
        "caida_reciente",
        "tendencia_lags",
        "ratio_finde_vs_semana",
        "retiros_finde_anterior",
        "retiros_domingo_anterior",
    )
    return features.select(
        "id_transaction",
        F.col("dia_mes").alias("day_of_month"),
        F.col("dia_semana").alias("day_of_week"),
        F.col("mes").alias("month"),
        F.col("transaction_date").alias("reference_date"),
        F.col("amount").alias("withdrawal_amount_day"),
        F.to_json(document, {"ignoreNullFields": "false"}).alias("dynamic_features"),
    )


def unpack_features(stored: DataFrame, schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """Parse the document once; its fields become columns."""
    parsed = stored.withColumn("__doc", F.from_json("dynamic_features", schema))
    return parsed.select(*[c for c in stored.columns if c != "dynamic_features"], "__doc.*")


def label_codes(df: DataFrame, columns: Sequence[str], local_limit: int = LOCAL_CODES, block_rows: int = BLOCK_ROWS) -> dict[str, DataFrame]:
    """Alphabetical codes 0.. of each column's distinct texts, as (value, code) tables.

    A column with few values gets a table of constants; the values of a wide one are numbered in
    blocks of their order, which follows the bytes of the text.  Codes are long either way.
    """
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
    values = df.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull()).distinct()
    sizes = {r["feature"]: r["n"] for r in values.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    narrow = [c for c in columns if sizes.get(c, 0) <= local_limit]
    found = values.where(F.col("feature").isin(narrow)).collect() if narrow else []  # bounded for each column
    codes = {}
    for c in columns:
        if c in narrow:
            numbered = list(enumerate(sorted(r["value"] for r in found if r["feature"] == c)))
            codes[c] = literal_rows(df.sparkSession, numbered, f"{c}_code long, {c} string")
        else:
            mine = values.where(F.col("feature") == c).select(F.col("value").alias(c), *(_prefix(F.col("value"), k).alias(f"__p{k}") for k in (0, 1)))
            codes[c] = global_position(mine, ["__p0", "__p1", c], f"{c}_code", block_rows).select(c, f"{c}_code")
    return codes


def _prefix(text: Column, k: int) -> Column:
    """Six bytes of a text from byte 6 k on as a number that sorts as they do."""
    part = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 6 * k + 1, 6)), 12, "0")
    return F.conv(part, 16, 10).cast("double")


def label_encode(df: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """Replace texts by codes; a value not seen in fitting gets code 0."""
    for c, table in codes.items():
        df = (
            df.withColumn(c, F.col(c).cast("string"))
            .join(table, c, "left")
            .withColumn(c, F.coalesce(F.col(f"{c}_code"), F.lit(0).cast("long")))
            .drop(f"{c}_code")
        )
    return df


def robust_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range per column; a zero range scales by 1."""
    found = column_quantiles(train, columns, [0.25, 0.5, 0.75])
    return {c: (q[1], (q[2] - q[0]) or 1.0) for c, q in found.items() if q}


def standard_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a zero deviation scales by 1."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns if row[f"m_{c}"] is not None}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - centre) / width for c, (centre, width) in fitted.items()})
