"""Account balances replayed in order, with automatic reload.

A withdrawal that the balance does not cover (or just empties it) sets the balance
to the reload amount; a deposit never lifts it above that amount.  The step is not
associative, so no window or aggregate expresses it; whole series are replayed in
groups of about SHELF_ROWS rows.  A series too long for one task is cut into blocks,
and each block is first reduced to its transfer function, which is small:

* while no reload and no cap has happened the balance is the opening balance plus
  a known shift, and that holds for one interval of opening balances;
* every opening balance outside the interval has been set to the reload amount at
  some row, and from there on all that were set at the same row are equal.

Chaining the transfer functions gives the opening balance of every block; then all
blocks are replayed in parallel.  Money is counted in integer cents, so cutting a
series never changes a result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import cents
from riskloom.plans.joins import join_null_safe
from riskloom.plans.series import SERIES_ROWS, key_sizes, series_position

RELOAD = 100_000.0
CENTS = 100
SHELF_ROWS = 50_000
ORDER = ["id_atm", "__block", "__day", "transaction_type", "id_transaction"]
OUTPUT = (
    "id_transaction long, id_atm long, transaction_date date, transaction_type string, amount double, "
    "balance_after double, reload_flag boolean"
)
SUMMARY = "id_atm long, __block long, shift long, is_low array<boolean>, limits array<long>, ends array<long>, unknown_end long"


def balance_replay(
    tx: DataFrame,
    state: DataFrame,
    reload: float = RELOAD,
    series_rows: int = SERIES_ROWS,
    block: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Balance after each row, in (day, type, id) order per ATM; an unknown opening balance stays null until a reload.

    `keep` names further whole-number columns that rows carry along.
    """
    cap = round(reload * CENTS)
    rows = tx.select("id_transaction", "id_atm", "transaction_date", "transaction_type", "amount", *(F.col(c).cast("long").alias(c) for c in keep)).withColumns(
        {"__cents": cents(F.col("amount")), "__day": F.unix_date("transaction_date")}
    )
    opening = state.select("id_atm", cents(F.col("current_balance")).alias("__open"))
    largest, total = key_sizes(tx, "id_atm")
    shelves = max(1, total // SHELF_ROWS)
    if largest <= series_rows:
        ready = rows.join(opening, "id_atm", "left").withColumn("__block", F.lit(0).cast("long"))
    else:
        size = block or series_rows
        ties = ["transaction_type", "id_transaction"]
        placed = series_position(rows, "id_atm", "transaction_date", ties)
        placed = placed.withColumn("__block", F.floor(F.col("__pos") / size)).drop("__pos")
        ready = join_null_safe(placed, _block_openings(placed, opening, cap, shelves), ["id_atm", "__block"])
    return _by_shelf(ready, shelves).applyInPandas(lambda pdf: _replay(pdf, cap, list(keep)), OUTPUT + "".join(f", {c} long" for c in keep))


def _by_shelf(df: DataFrame, shelves: int):
    """Groups that hold whole blocks, many small ones together."""
    return df.groupBy(F.pmod(F.xxhash64("id_atm", "__block"), F.lit(shelves)).alias("__shelf"))


def _replay(pdf: pd.DataFrame, cap: int, keep: list[str]) -> pd.DataFrame:
    pdf = pdf.sort_values(ORDER, na_position="first")
    key, balance = (), None
    after, reloaded = [], []
    opened = [None if pd.isna(v) else int(v) for v in pdf["__open"]]
    for atm, blk, kind, amount, start in zip(
        _ids(pdf["id_atm"]), pdf["__block"], pdf["transaction_type"], _ids(pdf["__cents"]), opened
    ):
        if (atm, blk) != key:
            key, balance = (atm, blk), start
        refill = False
        if amount is None:
            pass
        elif kind == "WITHDRAWAL":
            refill = balance is None or balance <= amount
            balance = cap if refill else balance - amount
        elif kind == "DEPOSIT" and balance is not None:
            balance = min(balance + amount, cap)
        after.append(None if balance is None else balance / CENTS)
        reloaded.append(refill)
    out = pdf[["id_transaction", "id_atm", "transaction_date", "transaction_type", "amount"]].astype({"id_transaction": "Int64", "id_atm": "Int64"})
    out["balance_after"] = pd.array(after, dtype="Float64")
    out["reload_flag"] = reloaded
    for c in keep:
        out[c] = pdf[c].astype("Int64")
    return out


def _ids(values: pd.Series) -> list:
    """Whole numbers, None where there is none (pandas has NaN there, which equals nothing)."""
    return [None if pd.isna(v) else int(v) for v in values]


def _block_openings(placed: DataFrame, opening: DataFrame, cap: int, shelves: int) -> DataFrame:
    """Opening balance of every block: transfer functions in parallel, then one short chain per ATM."""
    functions = _by_shelf(placed, shelves).applyInPandas(lambda pdf: _transfers(pdf, cap), SUMMARY)
    chained = "id_atm long, __block long, __open long"
    return functions.join(opening, "id_atm", "left").groupBy("id_atm").applyInPandas(_chain, chained)  # one row per block


class Transfer:
    """What a block does to any opening balance."""

    def __init__(self, cap: int):
        self.cap = cap
        self.shift = 0
        self.low = -math.inf  # opening balances in (low, high) were never set
        self.high = math.inf
        self.known: dict[int, list[int]] = {}  # current balance -> sets of opening balances that have it
        self.limits: list[tuple[bool, int, int]] = []  # (lower side?, limit, set), in row order
        self.unknown: int | None = None
        self.sets = 0

    def _new_set(self, members: list[int]) -> int:
        self.sets += 1
        members.append(self.sets)
        return self.sets

    def step(self, kind: str, amount: int) -> None:
        if kind not in ("WITHDRAWAL", "DEPOSIT"):
            return
        taken = kind == "WITHDRAWAL"
        moved: dict[int, list[int]] = {}
        at_cap: list[int] = []
        for balance, members in self.known.items():
            now = balance - amount if taken else balance + amount
            if (taken and now <= 0) or (not taken and now >= self.cap):
                at_cap.extend(members)
            else:
                moved.setdefault(now, []).extend(members)
        if taken:
            limit = amount - self.shift
            if limit > self.low and self.low < self.high:
                self.low = limit
                self.limits.append((True, limit, self._new_set(at_cap)))
            if self.unknown is None:
                self.unknown = self._new_set(at_cap)
            self.shift -= amount
        else:
            limit = self.cap - amount - self.shift
            if limit < self.high and self.low < self.high:
                self.high = limit
                self.limits.append((False, limit, self._new_set(at_cap)))
            self.shift += amount
        if at_cap:
            moved.setdefault(self.cap, []).extend(at_cap)
        self.known = moved

    def row(self, atm: int, block: int) -> tuple:
        ends = {s: balance for balance, members in self.known.items() for s in members}
        return (
            atm,
            block,
            self.shift,
            [is_low for is_low, _, _ in self.limits],
            [limit for _, limit, _ in self.limits],
            [ends[s] for _, _, s in self.limits],
            ends.get(self.unknown),
        )


def _transfers(pdf: pd.DataFrame, cap: int) -> pd.DataFrame:
    columns = ["id_atm", "__block", "shift", "is_low", "limits", "ends", "unknown_end"]
    done = []
    for (atm, blk), rows in pdf.sort_values(ORDER, na_position="first").groupby(["id_atm", "__block"], sort=False, dropna=False):
        transfer = Transfer(cap)
        for kind, amount in zip(rows["transaction_type"], _ids(rows["__cents"])):
            if amount is not None:
                transfer.step(kind, amount)
        done.append(transfer.row(None if pd.isna(atm) else int(atm), blk))
    return pd.DataFrame(done, columns=columns).astype({"id_atm": "Int64", "unknown_end": "Int64"})


def _apply(row, balance: int | None) -> int | None:
    if balance is None:
        return None if pd.isna(row.unknown_end) else int(row.unknown_end)
    for is_low, limit, end in zip(row.is_low, row.limits, row.ends):
        if balance <= limit if is_low else balance >= limit:  # the first row that sets this balance decides
            return int(end)
    return balance + int(row.shift)


def _chain(blocks: pd.DataFrame) -> pd.DataFrame:
    blocks = blocks.sort_values("__block")
    start = blocks["__open"].iloc[0]
    balance = None if pd.isna(start) else int(start)
    out = []
    for row in blocks.rename(columns={"__block": "block", "__open": "open"}).itertuples():
        out.append((None if pd.isna(row.id_atm) else int(row.id_atm), row.block, balance))
        balance = _apply(row, balance)
    return pd.DataFrame(out, columns=["id_atm", "__block", "__open"]).astype({"id_atm": "Int64", "__open": "Int64"})
