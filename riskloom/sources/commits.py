"""Rows of several tables that become visible together.

The rows of a commit lie in a partition of its own in every table it writes to.  They are in nobody's way until a manifest row
names them, which is written last and in one file: readers see the rows of named commits only.  A writer that
dies before leaves nothing that can be seen, and the same commit made again replaces what it left.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.rows import literal_rows
from riskloom.sources.sinks import read_if_there

MANIFEST = "_manifest_of_commits"
#: Partition values begin with a letter, or readers would take some of them for numbers or dates.
PREFIX = "c-"


class Commit:
    """Writes of one commit; nothing is visible before `publish`.  A commit has one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        if not re.fullmatch(r"[A-Za-z0-9._-]+", name):
            raise ValueError(f"a commit is named by letters, digits, dots, dashes and underscores, not {name!r}")
        self.spark, self.folder, self.name = spark, folder, name
        self.tables: set[str] = set()

    def there(self) -> bool:
        """Whether this commit is visible already."""
        made = commits(self.spark, self.folder)
        return made is not None and not made.where(F.col("commit") == PREFIX + self.name).isEmpty()

    def add(self, table: str, df: DataFrame) -> None:
        """Put rows into a table, in place of what an earlier try of this commit has left there."""
        path = f"{self.folder}/{table}/commit={PREFIX}{self.name}"
        df.write.mode("overwrite").parquet(path)
        self.tables.add(table)

    def publish(self, at: datetime) -> None:
        row = [(PREFIX + self.name, at.isoformat(sep=" "), f",{','.join(sorted(self.tables))},")]
        manifest = literal_rows(self.spark, row, "commit string, at string, tables string").withColumn("at", F.col("at").cast("timestamp_ntz"))
        manifest.coalesce(1).write.mode("append").parquet(f"{self.folder}/{MANIFEST}")


def commits(spark: SparkSession, folder: str) -> DataFrame | None:
    """commit, at, and tables (each between commas) of every visible commit; None before the first."""
    found = read_if_there(spark, f"{folder}/{MANIFEST}")
    return found.groupBy("commit").agg(F.min("at").alias("at"), F.min("tables").alias("tables")) if found is not None else None


def committed(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """The visible rows of a table; None where no commit has written to it.

    The partitions of other commits are pruned, so what killed writers have left is not read either.
    """
    made = commits(spark, folder)
    if made is None:
        return None
    visible = made.where(F.col("tables").contains(f",{table},")).select("commit")
    if visible.isEmpty():
        return None
    rows = spark.read.parquet(f"{folder}/{table}")
    return rows.join(visible, "commit", "left_semi").drop("commit")
