"""Slices, gates and cleaning of input relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.dates import days_before, months_before, timestamp_ntz
from riskloom.functions.hashes import text_hash
from riskloom.functions.numeric import no_nan


def between_dates(df: DataFrame, ts_col: str, end: str, start: str | None = None, max_history_days: int = 730) -> DataFrame:
    """Both limits count; the end is midnight of the end date.  Without a start, reach back `max_history_days`."""
    upper = timestamp_ntz(end)
    lower = timestamp_ntz(start) if start else days_before(upper, max_history_days)
    return df.where(F.col(ts_col).between(lower, upper))


def latest(df: DataFrame, column: str) -> Column:
    """The largest value, as a scalar subquery."""
    return df.select(F.max(column)).scalar()


def days_before_latest(df: DataFrame, date_col: str, days: int) -> Column:
    """As a date for a date column, so that the comparison reaches the scan."""
    newest = latest(df, date_col)
    is_date = df.schema[date_col].dataType.typeName() == "date"
    return F.date_sub(newest, days) if is_date else days_before(newest, days)


def trailing_days(df: DataFrame, date_col: str, days: int) -> DataFrame:
    return df.where(F.col(date_col) >= days_before_latest(df, date_col, days))


def trailing_months(df: DataFrame, ts_col: str, months: int) -> DataFrame:
    return df.where(F.col(ts_col) >= months_before(latest(df, ts_col), months))


def latest_batch(tx: DataFrame, logs: DataFrame) -> DataFrame:
    return tx.where(F.col("id_sync") == latest(logs, "id_sync"))


def batch_lookback(tx: DataFrame, logs: DataFrame, days: int = 11) -> Column:
    """First day of the latest batch, minus the look-back, as a scalar."""
    return latest_batch(tx, logs).select(F.date_sub(F.min("transaction_date"), days)).scalar()


def active_withdrawals(tx: DataFrame, atms: DataFrame, since: Column | None = None) -> DataFrame:
    rows = tx.where(F.col("transaction_type") == "WITHDRAWAL")
    if since is not None:
        rows = rows.where(F.col("transaction_date") >= since)
    running = atms.where("active").select("id_atm")
    return rows.join(running, "id_atm").select("id_transaction", "transaction_date", "id_atm", "amount")


def dataset_start(df: DataFrame, period_col: str, today: Column, years: int = 3) -> DataFrame:
    recent = df.where(F.col(period_col) >= months_before(today, 12 * years))
    return recent.agg(F.min(period_col).cast("date").alias("dataset_start"))


def coerce_numeric(df: DataFrame, columns: Sequence[str], fill: dict[str, float] | None = None) -> DataFrame:
    """Text to double; what is not a number, the text NaN included, becomes null, or its fill value."""
    fill = fill or {}
    parsed = {c: no_nan(F.col(c).try_cast("double")) for c in columns}
    return df.withColumns({c: F.coalesce(v, F.lit(fill[c])) if c in fill else v for c, v in parsed.items()})


def drop_incomplete(df: DataFrame, columns: Sequence[str] | int) -> DataFrame:
    """Drop rows with a null or NaN in the named, or the first n, columns."""
    return df.dropna(subset=df.columns[:columns] if isinstance(columns, int) else list(columns))


def dataset_gate(df: DataFrame, label: str, min_rows: int = 100) -> DataFrame:
    """One row per check: how many rows it saw and whether the data may be used."""
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("positives"))
    def check(name: str, n: str, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), F.col(n).alias("n"), passed.alias("passed"))

    checks = F.array(
        check("not_empty", "rows", F.col("rows") > 0),
        check("enough_rows", "rows", F.col("rows") >= min_rows),
        check("has_positives", "positives", F.col("positives") >= 1),
    )
    return facts.select(F.inline(checks))


def date_range_gate(start: str | None, end: str) -> None:
    """Reject a training range that is malformed or empty."""
    from datetime import date

    end_day = date.fromisoformat(end)
    if start and date.fromisoformat(start) >= end_day:
        raise ValueError("start must lie before end")


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: share of nulls and count of values, in one pass; NaN counts as null."""
    fractions = {n for n, kind in df.dtypes if kind in ("double", "float")}
    facts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(no_nan(F.col(c)) if c in fractions else c).alias(c) for c in columns],
    )
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            (1 - F.col(c) / F.nullif(F.col("__rows"), F.lit(0))).alias("null_pct"),
            F.col(c).alias("n"),
        )
        for c in columns
    ]
    return facts.select(F.inline(F.array(*entries)))


def column_catalog(df: DataFrame, target: str, weight: str) -> DataFrame:
    """Name, type, role and observed nullability of every column."""
    roles = {target: "TARGET", weight: "WEIGHT"}
    facts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = [
        F.struct(
            F.lit(f.name.upper()).alias("name"),
            F.lit(f.dataType.simpleString().upper()).alias("data_type"),
            F.lit(roles.get(f.name, "FEATURE")).alias("rol"),
            (F.col(f.name) > 0).alias("is_nullable"),
        )
        for f in df.schema.fields
    ]
    return facts.select(F.inline(F.array(*entries)))


def next_version(audits: DataFrame, name_col: str, pattern: str) -> DataFrame:
    """1 + the number of audits whose name contains the pattern, in any case."""
    return audits.where(F.col(name_col).ilike(f"%{pattern}%")).agg((F.count(name_col) + 1).alias("version"))


def weather_by_date(df: DataFrame, date_col: str, seed: int = 42) -> DataFrame:
    """A weather id 1..3, random but equal for all rows of a day."""
    return df.withColumn("id_weather", (F.pmod(text_hash(seed, F.col(date_col)), F.lit(3)) + 1).cast("int"))
