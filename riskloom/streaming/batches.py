"""State of each ATM after a batch, summaries of batches, derived daily totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import exact_sum


def entity_status_rollup(replayed: DataFrame) -> DataFrame:
    """Last balance and last dates per ATM; partial maxima are combined before the shuffle."""

    def last_date(condition: Column) -> Column:
        return F.max(F.when(condition, F.col("transaction_date")))

    order = F.struct("transaction_date", "transaction_type", "id_transaction")
    kind = F.col("transaction_type")
    return replayed.groupBy("id_atm").agg(
        F.max_by("balance_after", order).alias("current_balance"),
        F.max("transaction_date").alias("last_transaction_date"),
        last_date(kind == "DEPOSIT").alias("last_deposit_date"),
        last_date(F.col("reload_flag")).alias("last_reload_date"),
        last_date(kind == "WITHDRAWAL").alias("last_withdrawal_date"),
    )


KEPT_DATES = ("last_deposit_date", "last_reload_date", "last_withdrawal_date")


def status_merge(state: DataFrame, rollup: DataFrame, id_sync: int) -> DataFrame:
    """New snapshot of the state: known ATMs are updated, a null date keeps the old one, unknown ATMs are ignored."""
    new = rollup.select("id_atm", *[F.col(c).alias(f"__{c}") for c in rollup.columns if c != "id_atm"], F.lit(True).alias("__hit"))
    hit = F.col("__hit")
    joined = state.join(new, "id_atm", "left")
    columns = {
        "current_balance": F.when(hit, F.col("__current_balance")).otherwise(F.col("current_balance")),
        "last_transaction_date": F.when(hit, F.col("__last_transaction_date")).otherwise(F.col("last_transaction_date")),
        "last_sync_id": F.when(hit, F.lit(id_sync)).otherwise(F.col("last_sync_id")),
        "updated": F.coalesce(hit, F.lit(False)),
        **{c: F.coalesce(f"__{c}", c) for c in KEPT_DATES},
    }
    return joined.withColumns(columns).select(*state.columns, "updated")


def empty_status(state: DataFrame) -> DataFrame:
    """A state that knows only balances, with the date columns added."""
    dates = {c: F.lit(None).cast("date") for c in ("last_transaction_date", *KEPT_DATES)}
    return state.withColumns({**dates, "last_sync_id": F.lit(None).cast("long")})


def batch_run_summary(replayed: DataFrame, state: DataFrame) -> DataFrame:
    """Per batch: rows inserted, ATMs updated, their sum, distinct ATMs and reloads."""
    per_atm = replayed.groupBy("id_sync", "id_atm").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("reload_flag").alias("reloads")
    )
    known = state.select("id_atm").distinct().withColumn("known", F.lit(1))
    return (
        per_atm.join(known, "id_atm", "left")
        .groupBy("id_sync")
        .agg(
            F.sum("rows").alias("records_inserted"),
            F.count("known").alias("records_updated"),
            (F.sum("rows") + F.count("known")).alias("records_processed"),
            F.count(F.lit(1)).alias("atms"),
            F.sum("reloads").alias("recargas"),
        )
    )


def daily_atm_history(tx: DataFrame) -> DataFrame:
    """Totals per ATM and day."""

    def total(kind: str) -> Column:
        return F.coalesce(exact_sum(F.when(F.col("transaction_type") == kind, F.col("amount"))), F.lit(0.0))

    return tx.groupBy("id_atm", "transaction_date").agg(
        total("WITHDRAWAL").alias("withdrawn"),
        total("DEPOSIT").alias("deposited"),
        F.count(F.lit(1)).alias("movements"),
    )
