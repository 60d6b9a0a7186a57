"""Compare a query with its SQL in DuckDB."""

import duckdb

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def twins(spark, name, folder):
    """Sorted rows of the Spark query and of its SQL, columns by name."""
    from riskloom.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = QUERIES[name](spark, folder)
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    names = sorted(columns)
    assert sorted(found.columns) == names
    at = [columns.index(n) for n in names]
    ours = sorted((tuple(row[n] for n in names) for row in found.collect()), key=repr)
    theirs = sorted((tuple(row[i] for i in at) for row in result.fetchall()), key=repr)
    return ours, theirs
