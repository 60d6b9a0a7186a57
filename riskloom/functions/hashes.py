"""Hashes that other engines have too, so that a random choice can be stated in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fifteen hexadecimal digits: never negative as a long.
HASH_BITS = 60


def text_hash(seed: int, column: Column) -> Column:
    """The first fifteen digits of md5(`seed:value`) as a number; a missing value hashes as the seed alone."""
    digits = F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), column.cast("string")).cast("binary")), F.lit(15))
    return F.conv(digits, 16, 10).cast("long")


def text_hash_sql(seed: int, column: str) -> str:
    """The same for a column without missing values, in DuckDB's words."""
    return f"CAST('0x' || left(md5('{seed}:' || {column}), 15) AS BIGINT)"
