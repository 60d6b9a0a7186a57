"""Centroid clustering in whole numbers, with bounds that spare most vectors the scan of all centroids.

Each vector carries a lower bound on its distance to every centroid but its own.  When centroids move, the bound is
loosened, not by the whole drift of the fastest centroid, but by what the drift can take away from points of
the vector's cluster.  These lie in a sphere around the old centroid.  In the plane through its centre and
the drift, the points that come nearer by more than drift * cos(a) lie inside the cone of half angle `a`
around the drift, with its tip at the middle of the drift (the cone of a hyperbola's asymptotes).  So the angle between
the drift and the edge of the sphere bounds the loss of the whole cluster.  A vector whose exact distance to its
own centroid stays below its bound keeps its cluster; the others are ambiguous and are scanned exactly.

Vectors are stored once, packed into blocks and bucketed by block; bounds and clusters are a narrow table of each
round with the same buckets, so that rounds join the two without a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import new_folder, ship, stored

CLUSTERS = 40
ROUNDS = 5
SEED = 2
SIZE = 64
SCALE = 256
#: Magnitude of a scaled component below which all distances fit into a long; vectors beyond are left out.
LARGEST = 2**27
#: Magnitude below which sums of products are exact in doubles.
EXACT = 2**22
#: Vectors of one block, vectors of one bucket, and the most buckets there are.
BLOCK = 2048
BUCKET_VECTORS = 131_072
MOST_BUCKETS = 50_000
#: Relative room left for rounding when a distance is compared with a bound.
SLACK = 1e-9


def dots(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact products of every point with every centroid; whole numbers as int64."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        return (points.astype(float) @ centroids.T.astype(float)).astype(np.int64)
    return points @ centroids.T


def scan(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each point: the nearest centroid (the smaller number of equally near ones), its squared distance, and the next one's distance."""
    squared = (points**2).sum(axis=1)[:, None] - 2 * dots(points, centroids) + (centroids**2).sum(axis=1)[None, :]
    rows = np.arange(len(points))
    nearest = squared.argmin(axis=1)
    own = squared[rows, nearest]
    squared[rows, nearest] = np.iinfo(np.int64).max
    second = np.sqrt(squared.min(axis=1).astype(float)) if len(centroids) > 1 else np.full(len(points), np.inf)
    return nearest, own, second


def loosening(before: np.ndarray, after: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster: the most that its points' distance to any other centroid can shrink as centroids move.

    `radii` are those of the spheres around the old centroids that hold the clusters' points.
    """
    old, drift = before.astype(float), (after - before).astype(float)
    length = np.sqrt((drift**2).sum(axis=1))
    middle = old + drift / 2
    out = np.zeros(len(old))
    for i in range(len(old)):
        to_centre = old[i] - middle
        away = np.sqrt((to_centre**2).sum(axis=1))
        outside = (away > radii[i]) & (length > 0)
        far, long = np.where(outside, away, 1), np.where(outside, length, 1)
        cos = np.clip((to_centre * drift).sum(axis=1) / (far * long), -1, 1)
        sin_edge = np.clip(radii[i] / far, 0, 1)
        cos_edge = np.sqrt(1 - sin_edge**2)
        nearer = cos * cos_edge + np.sqrt(1 - cos**2) * sin_edge  # cosine of the angle less the sphere's own
        share = np.where(~outside | (cos >= cos_edge), 1, np.clip(nearer, 0, 1))
        loss = length * np.minimum(share + SLACK, 1)
        loss[i] = 0
        out[i] = loss.max(initial=0)
    return out


def assign(points: np.ndarray, centroids: np.ndarray, cluster: np.ndarray | None, lower: np.ndarray | None, loss: np.ndarray | None) -> tuple:
    """Cluster, squared distance and lower bound of each point, and how many points had to be scanned."""
    if cluster is None:
        cluster, own, lower = scan(points, centroids)
        return cluster, own, lower, len(points)
    own = ((points - centroids[cluster]) ** 2).sum(axis=1)
    distance = np.sqrt(own.astype(float))
    lower = lower - loss[cluster]
    unsure = np.nonzero(~(distance < lower - SLACK * (distance + np.abs(lower) + loss[cluster]) - SLACK))[0]
    cluster, lower = cluster.copy(), lower.copy()
    cluster[unsure], own[unsure], lower[unsure] = scan(points[unsure], centroids)
    return cluster, own, lower, len(unsure)


def whole_numbers(vectors: DataFrame, column: str = "embedding", size: int = SIZE) -> DataFrame:
    """The vectors with `size` finite components, each component x as floor(256 * x)."""
    value = F.col(column)
    held = value.isNotNull() & (F.size(value) == size) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < LARGEST))
    return vectors.where(held).withColumn(column, F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("int")))


def first_centroids(vectors: DataFrame, key: str, column: str, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the `clusters` smallest hashes of their ids, in this order; vectors without an id come last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    found = vectors.select(name.alias("name"), column).orderBy(F.col("name").asc_nulls_last(), column).limit(clusters).collect()
    return np.array([row[column] for row in found], dtype=np.int64)


class Tables:
    """The tables of one run, all with the same buckets of blocks."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table into the shared folder, bucketed and sorted by block, and read it back."""
        self.names.append(f"{name}_{uuid.uuid4().hex}")
        df.write.bucketBy(self.buckets, "block").sortBy("block").option("path", new_folder(self.spark, name)).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def forget(self) -> None:
        """Take the names out of the catalog; the files stay in the shared folder."""
        while self.names:
            self.spark.sql(f"DROP TABLE {self.names.pop()}")


def packed(vectors: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """Blocks of vectors: a name of its own, the ids, and all components as 32-bit integers."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(start, BLOCK)
                numbers = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4")
                ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), ids, pa.array([numbers.tobytes()], pa.binary())], names=["block", "ids", "vectors"])
                number += 1

    return vectors.select(key, column).mapInArrow(pack, f"block long, ids array<{dict(vectors.dtypes)[key]}>, vectors binary")


STATE = "block long, clusters binary, lower binary, distances binary, counts binary, sums binary, largest binary, scanned long"


def moved(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, loss: np.ndarray | None) -> DataFrame:
    """The state of every block after an assignment to `centroids`, with the sums over its clusters."""
    k, size = centroids.shape

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                points = np.frombuffer(row["vectors"], "<i4").reshape(-1, size).astype(np.int64)
                held = [np.frombuffer(row[c], kind) for c, kind in (("clusters", "<i4"), ("lower", "<f8"))] if loss is not None else [None, None]
                cluster, own, lower, scanned = assign(points, centroids, *held, loss)
                counts = np.bincount(cluster, minlength=k)
                sums = np.zeros((k, size), np.int64)
                order = np.argsort(cluster, kind="stable")
                present = np.nonzero(counts)[0]
                begins = (np.cumsum(counts) - counts)[present]
                sums[present] = np.add.reduceat(points[order], begins, axis=0)
                largest, total = np.zeros(k, np.int64), np.zeros(k, np.int64)
                largest[present] = np.maximum.reduceat(own[order], begins)
                total[present] = np.add.reduceat(own[order], begins)
                made = [cluster.astype("<i4"), lower.astype("<f8"), own.astype("<i8"), counts.astype("<i8"), sums, largest]
                columns = [pa.array([row["block"]], pa.int64()), *(pa.array([m.tobytes()], pa.binary()) for m in made), pa.array([scanned], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STATE.split(", ")])

    if state is None:
        return blocks.select("block", "vectors").mapInArrow(step, STATE)
    held = state.select(F.col("block").alias("state_block"), "clusters", "lower").hint("merge")
    return blocks.select("block", "vectors").join(held, F.col("block") == F.col("state_block")).mapInArrow(step, STATE)


def cluster_totals(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and largest squared distance of every cluster: k rows, whatever the number of vectors."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, largest = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for c, s, m in zip(*(batch.column(i) for i in range(3))):
                counts += np.frombuffer(c.as_py(), "<i8")
                sums += np.frombuffer(s.as_py(), "<i8").reshape(k, size)
                largest = np.maximum(largest, np.frombuffer(m.as_py(), "<i8"))
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64())), pa.array(largest)], names=["cluster", "n", "sums", "largest"])

    parts = state.select("counts", "sums", "largest").mapInArrow(add, "cluster int, n long, sums array<long>, largest long")
    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("largest").alias("largest"), *added).orderBy("cluster").collect()
    counts = np.array([r["n"] for r in rows], np.int64)
    return counts, np.array([r[3:] for r in rows], np.int64).reshape(len(rows), size), np.array([r["largest"] for r in rows], np.int64)


def tables_for(vectors: DataFrame) -> Tables:
    """As many buckets as keep one within memory, up to the bound; beyond it a bucket is streamed and its sort spills."""
    return Tables(vectors.sparkSession, min(max(vectors.count() // BUCKET_VECTORS + 1, 2), MOST_BUCKETS))


def run_rounds(tables: Tables, vectors: DataFrame, key: str, column: str, size: int, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, DataFrame, np.ndarray, list[int]]:
    """Blocks, final state, final centroids, and how many vectors each assignment scanned."""
    k = len(centroids)
    blocks = tables.keep(packed(vectors, key, column, size).repartition(tables.buckets, "block"), "vectors")
    state, loss, scanned = None, None, []
    for turn in range(rounds + 1):
        state = tables.keep(moved(blocks, state, centroids, loss), "state")
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        if turn < rounds:
            counts, sums, largest = cluster_totals(state, k, size)
            after = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
            loss = loosening(centroids, after, np.sqrt(largest.astype(float)) * (1 + SLACK))
            centroids = after
    return blocks, state, centroids, scanned


def cluster(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE,
) -> DataFrame:
    """`key`, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors of `size` components, none null, infinite or not a number; and as a squared distance has to fit
    into a long, none of 2^19 or more in magnitude.  Other columns, whatever their names, are left out.  A vector
    without an id is clustered but starts a centroid only if ids run out; repeated rows stay rows of their own, and with
    equal hashes the smaller vector starts first.  Fewer vectors than clusters start as many centroids as there are;
    of equally near centroids the one of the smaller number wins; an empty table gives no rows.
    """
    ship(__name__)
    kept = whole_numbers(vectors.select(key, column), column, size)
    centroids = first_centroids(kept, key, column, clusters, seed)
    named = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    if not len(centroids):
        return kept.select(key, *(F.lit(None).cast(kind).alias(name) for name, kind in named.items()))
    tables = tables_for(kept)
    blocks, state, centroids, _ = run_rounds(tables, kept, key, column, size, centroids, rounds)

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, clusters_, distances in zip(*(batch.column(i) for i in range(3))):
                numbers = [np.frombuffer(x.as_py(), kind) for x, kind in ((clusters_, "<i4"), (distances, "<i8"))]
                yield pa.RecordBatch.from_arrays([ids.values, *map(pa.array, numbers)], names=["key", "cluster", "distance"])

    held = state.select(F.col("block").alias("state_block"), "clusters", "distances").hint("merge")
    joined = blocks.select("block", "ids").join(held, F.col("block") == F.col("state_block"))
    kind = dict(vectors.dtypes)[key]
    rows = stored(joined.select("ids", "clusters", "distances").mapInArrow(unpack, f"key {kind}, cluster int, distance long"), "clusters")
    tables.forget()
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = vectors.sparkSession.createDataFrame([(c, s, total, names[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select(F.col("key").alias(key), *named)  # bounded: a row for each cluster
