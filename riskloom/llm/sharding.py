"""Uniform shuffle into shards of exact sizes.

A communication matrix says how many rows of each part go to each shard.  It is drawn row by row from the
multivariate hypergeometric law, which is how a uniform permutation of all rows would deal them, so that
parts can be permuted on their own, exchanged, and permuted again inside each shard.  Only the matrix
(parts x shards) is made in the driver; a part has up to PART_ROWS rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import small_side, stored

SHARDS = 8
SEED = 42
#: Rows of a part: a power of two, as parts are cut from row numbers by a shift.
PART_BITS = 18
#: Rows of a stretch of a shard that one task orders.
STRETCH_ROWS = 8192
#: Values of a draw further than this many standard deviations from the mode are left out (below 1e-30).
DEVIATIONS = 15


def hypergeometric(uniform: float, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows without replacement are good, by inversion; any size of population."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    share = good / total
    deviation = np.sqrt(draws * share * (1 - share) * (total - draws) / max(1, total - 1))
    mode = (draws + 1) * (good + 1) // (total + 2)
    reach = int(DEVIATIONS * deviation) + 50
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    upto = np.cumsum(np.exp(logs - logs.max()))
    return int(first + np.searchsorted(upto, uniform * upto[-1], side="right").clip(0, len(upto) - 1))


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows of each part that go to each shard; rows add up to `parts`, columns to `shards`."""
    random = np.random.Generator(np.random.PCG64(seed))
    left, matrix = list(shards), []
    for rows in parts:
        row, rest, others = [], rows, sum(left)
        for s, room in enumerate(left):
            others -= room
            n = hypergeometric(random.random(), room, others, rest)
            row.append(n)
            rest -= n
            left[s] -= n
        matrix.append(row)
    return matrix


def shuffled_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, part_bits: int = PART_BITS, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """rows with `shard` and `slot`, in uniformly random order; shard sizes differ by one at most.

    Columns of `rows` are kept, except that ones named shard or slot are replaced.  Every row counts, also
    repeated ones and ones of nulls only.  An empty table gives no rows.
    """
    spark = rows.sparkSession
    numbered = rows.drop("shard", "slot").select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id"))
    numbered = stored(numbered.withColumn("part", F.shiftright("id", part_bits)), "shard-rows")
    counts = sorted((r["part"], r["n"]) for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    ends = [(part, np.cumsum(row).tolist()) for (part, _), row in zip(counts, matrix)]
    dealt = small_side(spark.createDataFrame(ends, "matrix_part long, ends array<long>"))

    key = lambda k: F.xxhash64(F.lit(seed), F.lit(k), F.col("id"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(key(1), "id"))
    sent = (
        numbered.withColumn("place", place)
        .join(dealt, F.col("part") == F.col("matrix_part"))
        .select("row", "id", F.size(F.filter("ends", lambda end: end < F.col("place"))).alias("shard"), key(2).alias("key"))
    )
    stretches = max(1, -(-total // (shards * stretch_rows)))
    sent = sent.withColumn("stretch", F.shiftright(F.shiftrightunsigned("key", 33) * stretches, 31))
    sent = stored(sent, "shard-sent")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("stretch")) - F.col("n")
    offsets = sent.groupBy("shard", "stretch").agg(F.count("*").alias("n")).select(F.col("shard").alias("at_shard"), F.col("stretch").alias("at_stretch"), before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "stretch").orderBy("key", "id")) - 1
    ranked = sent.withColumn("inside", inside)
    found = ranked.join(offsets, (F.col("shard") == F.col("at_shard")) & (F.col("stretch") == F.col("at_stretch")))
    return found.select("row.*", "shard", (F.col("before") + F.col("inside")).alias("slot"))


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """One folder per shard, its files in slot order."""
    ordered = sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shard and slot of every document under the law of equal counts.

    docs needs doc_id and text; other columns are ignored.  A null text has size 1 and checksum 0, as an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffled_shards(rows, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
