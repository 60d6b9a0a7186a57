"""Row-order windows per entity, safe for an entity that holds most of the rows.

Ordinary entities: one window over the entity.  When a count shows an entity
above the limit, rows are numbered per (entity, day), cut into blocks of equal
length and each block is given the last rows of the block before it, so that
row lags are exact while no task sees more than one block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.plans.joins import join_null_safe

SERIES_ROWS = 2_000_000


@dataclass(frozen=True)
class Series:
    """A frame ready for row-order windows of bounded depth."""

    df: DataFrame
    key: str
    order: tuple[str, ...]
    blocked: bool

    @property
    def keys(self) -> list[str]:
        return [self.key, "__block"] if self.blocked else [self.key]

    @property
    def window(self):
        return W.partitionBy(*self.keys).orderBy(*self.order)

    def with_columns(self, columns: dict[str, Column]) -> Series:
        return Series(self.df.withColumns(columns), self.key, self.order, self.blocked)

    def rows(self) -> DataFrame:
        """Back to plain rows: overlap rows and helper columns removed."""
        if not self.blocked:
            return self.df
        return self.df.where(~F.col("__overlap")).drop("__block", "__pos", "__overlap")


def key_sizes(df: DataFrame, key: str) -> tuple[int, int]:
    """Rows of the largest key, and rows in all."""
    largest, total = df.groupBy(key).count().agg(F.max("count"), F.sum("count")).first()
    return largest or 0, total or 0


def as_series(
    df: DataFrame,
    key: str,
    day: str,
    tie: str,
    depth: int,
    series_rows: int = SERIES_ROWS,
    block: int | None = None,
    largest: int | None = None,
) -> Series:
    """`depth` is the largest row distance that will be looked back; `largest`, if known, no key has more rows."""
    if (key_sizes(df, key)[0] if largest is None else largest) <= series_rows:
        return Series(df, key, (day, tie), False)
    size = block or series_rows
    numbered = series_position(df, key, day, [tie])
    own = numbered.withColumn("__block", F.floor(F.col("__pos") / size))
    offset = F.col("__pos") % size
    # the last `depth` rows of a block also open the next one
    copies = F.when(offset >= size - depth, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    spread = own.withColumn("__overlap", F.explode(copies))
    spread = spread.withColumn("__block", F.col("__block") + F.col("__overlap").cast("int"))
    return Series(spread, key, (day, tie), True)


def series_position(df: DataFrame, key: str, day: str, ties: list[str], out: str = "__pos") -> DataFrame:
    """0-based row number within each entity; a day of an entity is the largest unit one task sorts."""
    per_day = df.groupBy(key, day).agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(key).orderBy(day).rowsBetween(W.unboundedPreceding, -1)  # days only
    offsets = per_day.select(key, day, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    inside = W.partitionBy(key, day).orderBy(*ties)
    return (
        join_null_safe(df, offsets, [key, day])
        .withColumn(out, F.col("__off") + F.row_number().over(inside) - 1)
        .drop("__off")
    )


def last_before(series: Series, values: dict[str, Column]) -> Series:
    """For each name, the last non-null value strictly before each row, however far back."""
    held = {name: f"__v_{name}" for name in values}
    df = series.df.withColumns({held[name]: value for name, value in values.items()})
    before = series.window.rowsBetween(W.unboundedPreceding, -1)
    found = df.withColumns({name: F.last(v, ignorenulls=True).over(before) for name, v in held.items()})
    if series.blocked:
        # what earlier blocks hand over: one row per block
        own = df.where(~F.col("__overlap"))
        closing = own.groupBy(*series.keys).agg(
            *[F.max(F.when(F.col(v).isNotNull(), F.struct("__pos", v)))[v].alias(v) for v in held.values()]
        )
        earlier = W.partitionBy(series.key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
        carried = closing.select(
            *series.keys, *[F.last(v, ignorenulls=True).over(earlier).alias(f"__carry_{name}") for name, v in held.items()]
        )
        found = join_null_safe(found, carried, series.keys, "left").withColumns({name: F.coalesce(name, f"__carry_{name}") for name in values})
        found = found.drop(*[f"__carry_{name}" for name in values])
    return Series(found.drop(*held.values()), series.key, series.order, series.blocked)
