"""Registration of queries and of the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.standins import STAND_INS, duckdb_text, stand_in

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` may use stand-in names as tables."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_stand_ins(sql)
        return fn

    return keep


def with_stand_ins(sql: str) -> str:
    """Put the stand-ins a text mentions in front of it as common table expressions."""
    used = [n for n in STAND_INS if re.search(rf"\b{n}\b", sql)]
    ctes = ",\n".join(f"{n} AS {duckdb_text(n)}" for n in used)
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"


def rounded(df: DataFrame, digits: int = 6, *only: str) -> DataFrame:
    """Round the double columns, so that two engines agree on the text of a number."""
    names = only or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, digits) for n in names}) if names else df


def frames(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [stand_in(spark, folder, n) for n in names]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def bins_sql(values: str, features: list[str]) -> str:
    """CTEs q (edges), bins and vals for decile bins of `features` over relation `values`."""
    probs = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
    edges = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, list_sort(list_distinct(quantile_cont(CAST({f} AS DOUBLE), {probs}))) AS e FROM {values}" for f in features
    )
    return f"""q AS ({edges}),
    bins AS (SELECT feature, i - 1 AS bucket, e[i] AS lo, e[i + 1] AS hi, len(e) - 1 AS k
             FROM (SELECT feature, e, unnest(range(1, CAST(len(e) AS BIGINT))) AS i FROM q) u)"""


def values_sql(relation: str, features: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM {relation} WHERE {f} IS NOT NULL" for f in features)


def counts_sql(values: str, closed: bool) -> str:
    """Count `values` (feature, v) into the CTE bins."""
    if closed:
        inside = "v.v >= b.lo AND (v.v < b.hi OR (b.bucket = b.k - 1 AND v.v <= b.hi))"
    else:
        inside = "(v.v >= b.lo OR b.bucket = 0) AND (v.v < b.hi OR b.bucket = b.k - 1)"
    return f"""SELECT b.feature, b.bucket, b.lo, b.hi, b.k, count(v.v) AS n
    FROM bins b LEFT JOIN ({values}) v ON v.feature = b.feature AND {inside} GROUP BY ALL"""
