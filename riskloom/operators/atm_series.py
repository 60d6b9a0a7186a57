"""Features of daily withdrawal series.

All row-order features look back at most eleven rows, except the last amount on a
given weekday, which `last_before` carries across blocks.  Weekly figures are
aggregated first, so their windows see weeks, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.dates import iso_weekday, week_ending_monday
from riskloom.functions.numeric import exact_sum, mean_of_present, ratio_or_zero, wide
from riskloom.operators.features import calendar_features
from riskloom.plans.joins import join_null_safe
from riskloom.plans.series import SERIES_ROWS, Series, as_series, last_before
from riskloom.session import cut_lineage

# Row lags, drop limit, and the weekday numbers the deployed models were trained with.
LAGS = (1, 5, 11)
DROP_BELOW = 0.6
WEEKEND = (6, 7)
AVERAGED_WEEKS = 7
PREVIOUS_DAYS = {"retiros_sabado_anterior": 5, "retiros_domingo_anterior": 6}
PREVIOUS_DAYS_FIXED = {"retiros_sabado_anterior": 6, "retiros_domingo_anterior": 7}
LOW_SUNDAY_DAY, LOW_SUNDAY_DAY_FIXED = 0, 1


def withdrawal_series(tx: DataFrame, series_rows: int = SERIES_ROWS, block: int | None = None, largest: int | None = None) -> Series:
    return as_series(tx, "id_atm", "transaction_date", "id_transaction", max(LAGS), series_rows, block, largest)


def atm_lags(series: Series) -> Series:
    return series.with_columns({f"lag_{k}": F.lag("amount", k).over(series.window) for k in LAGS})


def recent_drop(series: Series) -> Series:
    """1 where the amount fell under 60 % of the row before."""
    fell = F.col("amount") < F.lag("amount", 1).over(series.window) * DROP_BELOW
    return series.with_columns({"caida_reciente": F.coalesce(fell, F.lit(False)).cast("int")})


def weekend_moving_avg(tx: DataFrame) -> DataFrame:
    """Per ATM and week: mean weekend amount and its mean over the last seven weeks that have one."""
    weekly = (
        tx.where(iso_weekday(F.col("transaction_date")).isin(*WEEKEND))
        .groupBy("id_atm", week_ending_monday(F.col("transaction_date")).alias("semana"))
        .agg((exact_sum(F.col("amount")) / F.count("amount")).alias("media_finde"))
    )
    recent = W.partitionBy("id_atm").orderBy("semana").rowsBetween(1 - AVERAGED_WEEKS, 0)  # weeks only
    return weekly.withColumn("media_movil_7_semanas", F.avg("media_finde").over(recent))


def prev_week_lookup(series: Series, weekly: DataFrame, tx: DataFrame) -> Series:
    """The moving average of the week before; without one, the mean of the ATM."""
    last_week = week_ending_monday(F.date_sub("transaction_date", 7))
    found = weekly.select(
        "id_atm", F.col("semana").alias("__week"), F.col("media_movil_7_semanas").alias("retiros_finde_anterior")
    )
    mean = exact_sum(F.col("amount")) / F.count("amount")
    if series.blocked:
        # an ATM may hold most rows: attach both figures to its days and join on (ATM, day)
        means = tx.groupBy("id_atm").agg(mean.alias("__mean"))
        days = tx.select("id_atm", "transaction_date").distinct().withColumn("__week", last_week)
        days = join_null_safe(days.join(found, ["id_atm", "__week"], "left"), means, ["id_atm"]).drop("__week")
        df = join_null_safe(series.df, days, ["id_atm", "transaction_date"])
    else:
        df = (
            series.df.withColumn("__week", last_week)
            .withColumn("__mean", _window_mean())
            .join(found, ["id_atm", "__week"], "left")
            .drop("__week")
        )
    filled = F.coalesce("retiros_finde_anterior", "__mean")
    return Series(df.withColumn("retiros_finde_anterior", filled).drop("__mean"), series.key, series.order, series.blocked)


def _window_mean() -> Column:
    whole = W.partitionBy("id_atm")
    return F.sum(wide(F.col("amount"))).over(whole).cast("double") / F.count("amount").over(whole)


def prev_weekday_amount(series: Series, iso_weekday_fix: bool = False) -> Series:
    """Last amount on each of two weekdays, strictly before the row."""
    days = PREVIOUS_DAYS_FIXED if iso_weekday_fix else PREVIOUS_DAYS
    weekday = iso_weekday(F.col("transaction_date"))
    return last_before(series, {name: F.when(weekday == day, F.col("amount")) for name, day in days.items()})


def low_sunday(series: Series, tx: DataFrame, iso_weekday_fix: bool = False) -> Series:
    """Flag rows on the day after Sunday whose previous amount is under the ATM's median.

    Deployed models compare the ISO weekday with 0, which never occurs; the flag
    is then 0 everywhere and no median is needed.
    """
    if not iso_weekday_fix:
        return series.with_columns({"domingo_bajo": F.lit(0)})
    medians = _medians(tx, series.blocked)
    df = series.df.join(medians, "id_atm", "left")
    low = (iso_weekday(F.col("transaction_date")) == LOW_SUNDAY_DAY_FIXED) & (F.col("lag_1") < F.col("__median"))
    df = df.withColumn("domingo_bajo", F.coalesce(low, F.lit(False)).cast("int")).drop("__median")
    return Series(df, series.key, series.order, series.blocked)


def _medians(tx: DataFrame, large: bool) -> DataFrame:
    if not large:
        return tx.groupBy("id_atm").agg(F.median("amount").alias("__median"))
    # rank by counting values, cent by cent, in amount ranges: no task holds all amounts of one ATM
    values = tx.where(F.col("amount").isNotNull()).groupBy("id_atm", "amount").count().withColumn("__range", F.floor(F.col("amount") / 1000))
    per_range = values.groupBy("id_atm", "__range").agg(F.sum("count").alias("__n"))
    ranges = W.partitionBy("id_atm").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        "id_atm",
        "__range",
        F.coalesce(F.sum("__n").over(ranges), F.lit(0)).alias("__off"),
        F.sum("__n").over(W.partitionBy("id_atm")).alias("__all"),
    )
    inside = W.partitionBy("id_atm", "__range").orderBy("amount").rowsBetween(W.unboundedPreceding, 0)
    ranked = join_null_safe(values, offsets, ["id_atm", "__range"]).withColumn("__upto", F.col("__off") + F.sum("count").over(inside))
    lower, upper = F.floor((F.col("__all") - 1) / 2), F.ceil((F.col("__all") - 1) / 2)
    first, last = F.col("__upto") - F.col("count"), F.col("__upto") - 1
    return (
        ranked.where((lower.between(first, last)) | (upper.between(first, last)))
        .groupBy("id_atm")
        .agg(((F.min("amount") + F.max("amount")) / 2).alias("__median"))
    )


def atm_features(
    tx: DataFrame, iso_weekday_fix: bool = False, series_rows: int = SERIES_ROWS, block: int | None = None
) -> DataFrame:
    """The full feature set; rows without eleven predecessors are dropped."""
    series = _looking_back(tx, iso_weekday_fix, series_rows, block)
    series = low_sunday(series, tx, iso_weekday_fix)
    series = prev_week_lookup(series, weekend_moving_avg(tx), tx)
    return _finished(series, tx.columns)


def _looking_back(tx: DataFrame, iso_weekday_fix: bool, series_rows: int, block: int | None, largest: int | None = None) -> Series:
    """What the rows before each row say."""
    series = atm_lags(recent_drop(withdrawal_series(tx, series_rows, block, largest)))
    before_five = series.window.rowsBetween(-5, -1)
    series = series.with_columns({"__week_mean": F.avg("amount").over(before_five)})
    return prev_weekday_amount(series, iso_weekday_fix)


def _finished(series: Series, own: list[str]) -> DataFrame:
    weekend_mean = mean_of_present(F.col("retiros_sabado_anterior"), F.col("retiros_domingo_anterior"))
    out = series.rows().withColumns(
        {
            "ratio_finde_vs_semana": ratio_or_zero(weekend_mean, F.col("__week_mean")),
            "tendencia_lags": F.coalesce(F.col("lag_1") - F.nullif(F.col("lag_11"), F.lit(0.0)), F.lit(0.0)),
        }
    )
    out = calendar_features(out.where(F.col("lag_11").isNotNull()).drop("__week_mean"), "transaction_date")
    return out.select(*own, *(c for c in out.columns if c not in own))  # joins move their keys


def features_around(tx: DataFrame, wanted: Column, series_rows: int = SERIES_ROWS, block: int | None = None) -> DataFrame:
    """The features of the wanted rows only, equal to those that `atm_features` gives them.

    One pass counts weeks; row-order windows see only weeks that hold wanted rows, and those just before them that their
    features look back to.
    """
    facts = cut_lineage(weekly_facts(tx, wanted))  # ATMs x weeks
    near = join_null_safe(
        tx.withColumns({"semana": week_ending_monday(F.col("transaction_date")), "__wanted": wanted}), weeks_around(facts), ["id_atm", "semana"], "left_semi"
    )
    largest = facts.groupBy("id_atm").agg(F.sum("rows").alias("n")).agg(F.max("n")).first()[0] or 0
    series = _looking_back(near.drop("semana"), False, series_rows, block, largest)
    series = low_sunday(series, tx, False)
    series = Series(series.df.where("__wanted").drop("__wanted"), series.key, series.order, series.blocked)
    recent = W.partitionBy("id_atm").orderBy("semana").rowsBetween(1 - AVERAGED_WEEKS, 0)  # weeks only
    moving = facts.where("weekend_rows > 0").select("id_atm", "semana", (F.col("weekend_total").cast("double") / F.col("weekend_n")).alias("mean"))
    moving = moving.select("id_atm", F.date_add("semana", 7).alias("__semana"), F.avg("mean").over(recent).alias("retiros_finde_anterior"))
    means = facts.groupBy("id_atm").agg((F.sum("total").cast("double") / F.sum("n")).alias("__mean"))
    df = series.df.withColumn("__semana", week_ending_monday(F.col("transaction_date")))
    df = join_null_safe(df.join(moving, ["id_atm", "__semana"], "left"), means, ["id_atm"]).drop("__semana")
    df = df.withColumn("retiros_finde_anterior", F.coalesce("retiros_finde_anterior", "__mean")).drop("__mean")
    return _finished(Series(df, series.key, series.order, series.blocked), tx.columns)


def weekly_facts(tx: DataFrame, wanted: Column) -> DataFrame:
    """One row per ATM and week, in one pass: what features need to know of rows outside their own series.

    Rows, rows on each of the two previous days, whether a wanted row is among them, and the sums behind the weekend
    mean of the week and the mean of the ATM.  Sums are decimals, so adding weeks up is exact.
    """
    weekday, amount = iso_weekday(F.col("transaction_date")), wide(F.col("amount"))
    weekend = F.when(weekday.isin(*WEEKEND), amount)
    per_week = tx.groupBy("id_atm", week_ending_monday(F.col("transaction_date")).alias("semana")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if((weekday == day) & F.col("amount").isNotNull()).alias(name) for name, day in PREVIOUS_DAYS.items()],
        F.max(wanted).alias("wanted"),
        F.sum(amount).alias("total"),
        F.count("amount").alias("n"),
        F.sum(weekend).alias("weekend_total"),
        F.count(weekend).alias("weekend_n"),
        F.count_if(weekday.isin(*WEEKEND)).alias("weekend_rows"),
    )
    return per_week.withColumn("week", F.coalesce(F.floor(F.unix_date("semana") / 7).cast("long"), F.lit(-(2**40))))


def weeks_around(facts: DataFrame, depth: int = max(LAGS)) -> DataFrame:
    """The weeks of each ATM whose rows the features of its wanted rows look at.

    These are the weeks with wanted rows, and before each of them as many weeks with rows as it takes to hold `depth`
    rows and an amount on each previous day.  Windows see weeks, not rows.
    """
    ordered = W.partitionBy("id_atm").orderBy("week")
    strictly = ordered.rowsBetween(W.unboundedPreceding, -1)
    seen = facts.withColumns(
        {
            # every week holds a row, so `depth` weeks back are always enough
            "__before": F.reverse(F.collect_list(F.struct("week", "rows")).over(ordered.rowsBetween(-depth, -1))),
            **{f"__last_{name}": F.max(F.when(F.col(name) > 0, F.col("week"))).over(strictly) for name in PREVIOUS_DAYS},
        }
    )
    nothing = F.struct(F.lit(None).cast("long").alias("week"), F.lit(0).cast("long").alias("held"))

    def further(got: Column, week: Column) -> Column:
        more = F.struct(week["week"].alias("week"), (got["held"] + week["rows"]).alias("held"))
        return F.when(got["held"] >= depth, got).otherwise(more)

    enough = F.aggregate("__before", nothing, further)["week"]
    needed = F.least(F.coalesce(enough, F.col("week")), *[F.coalesce(f"__last_{name}", "week") for name in PREVIOUS_DAYS])
    later = W.partitionBy("id_atm").orderBy("week").rowsBetween(0, W.unboundedFollowing)
    reached = F.min(F.when(F.col("wanted"), needed)).over(later)
    return seen.withColumn("__from", reached).where(F.col("__from") <= F.col("week")).select("id_atm", "semana")
