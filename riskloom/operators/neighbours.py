"""Exact nearest neighbours among many points, and oversampling built on them.

Points are cut into boxes (a k-d tree grown on a small sample, used for nothing but
the cuts, which are laid where few points have neighbours on the other side).  A query first looks in its own box; the distance of its k-th candidate
is an upper limit, so only boxes that come nearer than that can hold a better one,
and the query is sent to those alone.  No cross join, and no candidate is left out.
Equal points are collapsed first, so a heap of copies is one point with a count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.sampling import class_counts
from riskloom.plans.cuts import HashOrder
from riskloom.session import cut_lineage

BOX_POINTS = 2_000
SAMPLE = 20_000
SAMPLE_PER_BOX = 25
MAX_BOXES = 8_192
REACH_POINTS = 500
TASK_QUERIES = 50_000


def best_cut(points: np.ndarray, reach: float = 0.0, least: float = 0.0) -> tuple[int, float] | None:
    """Axis and value of the cut between distinct values that spares the most pairs of points on its two sides; none if all points are equal.

    Points that lie no farther than `reach` from the other side are not spared.  Equal cuts: the one on the widest axis.
    Without a reach, or if no cut spares any with `least` points on both sides, it is the most even cut.
    """
    best, found = (0, 0.0), None
    for axis in range(points.shape[1] if len(points) else 0):
        values, counts = np.unique(points[:, axis], return_counts=True)
        if len(values) < 2:
            continue
        upto = np.concatenate(([0], np.cumsum(counts)))
        below, n = upto[1:-1], len(points)
        # of the points below a cut those far from the first value above it, and the other way round
        low = np.minimum(upto[np.searchsorted(values, values[1:] - reach, "left")], below)
        high = np.minimum(n - upto[np.searchsorted(values, values[:-1] + reach, "right")], n - below)
        spared = np.where(np.minimum(below, n - below) >= least, low * (n - below) + high * below, 0)
        i = int(np.argmax(spared))
        worth = (int(spared[i]), float(values[-1] - values[0]))
        if worth > best:
            best, found = worth, (axis, float(values[i + 1]))
    return found if found or not (reach or least) else best_cut(points)


def usual_reach(sample: np.ndarray, k: int, n: int) -> float:
    """About how far the k-th nearest of n points lies: of a few points, that of the place in the sample that stands for it."""
    place = min(max(1, -(-k * len(sample) // n)), len(sample) - 1)
    if place < 1:
        return 0.0
    asked = sample[:: -(-len(sample) // REACH_POINTS)]
    lengths = (sample**2).sum(axis=1)
    gaps = lengths[None, :] - 2 * (asked @ sample.T) + (asked**2).sum(axis=1)[:, None]
    reach = float(np.sqrt(np.median(np.maximum(np.partition(gaps, place, axis=1)[:, place], 0.0))))
    return reach if np.isfinite(reach) else 0.0


def grow_boxes(sample: np.ndarray, boxes: int, reach: float = 0.0) -> list[tuple]:
    """Cuts of a k-d tree as (axis, value, left, right); a leaf is (-1, number)."""
    nodes: list[tuple] = []
    leaves = 0

    def grow(points: np.ndarray, parts: int) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(())
        cut = best_cut(points, reach, len(points) / parts / 2) if parts > 1 else None
        if cut is None:
            nodes[at] = (-1, leaves)
            leaves += 1
        else:
            axis, value = cut
            left = points[:, axis] < value
            share = min(parts - 1, max(1, round(parts * left.mean())))
            nodes[at] = (axis, value, grow(points[left], share), grow(points[~left], parts - share))
        return at

    grow(sample, boxes)
    return nodes


def locate(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    out = np.zeros(len(points), dtype=np.int64)
    stack = [(0, np.arange(len(points)))]
    while stack:
        at, rows = stack.pop()
        node = nodes[at]
        if node[0] < 0:
            out[rows] = node[1]
            continue
        left = points[rows, node[0]] < node[1]
        stack += [(node[2], rows[left]), (node[3], rows[~left])]
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float) if len(column) else np.zeros((0, 1))


def _nearest(points: pd.DataFrame, queries: pd.DataFrame, k: int) -> Iterator[tuple]:
    """For each query: (id, [(distance, point id, copies)]) of up to k points, in chunks that fit in memory."""
    where = _matrix(points["v"])
    ids, copies = points["id"].to_numpy(), points["copies"].to_numpy()
    step = max(1, 4_000_000 // max(1, where.size))
    asked = _matrix(queries["v"])
    for lo in range(0, len(queries), step):
        gaps = np.sqrt(((asked[lo : lo + step, None, :] - where[None, :, :]) ** 2).sum(axis=2))
        for i, row in enumerate(gaps):
            best = np.lexsort((ids, row))[:k] if len(row) <= k else _smallest(row, ids, k)
            yield queries["id"].iloc[lo + i], [(float(row[j]), int(ids[j]), int(copies[j])) for j in best]


def _smallest(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    limit = np.partition(row, k - 1)[k - 1]
    near = np.flatnonzero(row <= limit)
    return near[np.lexsort((ids[near], row[near]))][:k]


_FOUND = "id long, found array<struct<d: double, other: long, copies: long>>"


def nearest(points: DataFrame, k: int, box_points: int = BOX_POINTS) -> DataFrame:
    """For every distinct point (id, v, copies) its k nearest points, itself included, as (id, found)."""
    spark = points.sparkSession
    n = points.count()
    boxes = min(max(1, n // box_points), MAX_BOXES)
    sample = points.orderBy(F.xxhash64("id")).limit(max(SAMPLE, SAMPLE_PER_BOX * boxes)).select("v").collect()  # at most 204,800 rows, for cuts only
    cuts = np.array([r["v"] for r in sample], dtype=float)
    nodes = grow_boxes(cuts, boxes, usual_reach(cuts, k, n) if boxes > 1 else 0.0)

    @F.pandas_udf("long")
    def box_of(v: pd.Series) -> pd.Series:
        return pd.Series(locate(nodes, _matrix(v)))

    placed = points.withColumn("box", box_of("v"))

    def search(key, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = list(_nearest(held, asked, k)) if len(held) else []
        return pd.DataFrame(found, columns=["id", "found"])

    def look(queries: DataFrame) -> DataFrame:
        """Answer queries box by box; a box asked by many is copied, so no task takes all its queries."""
        asked = queries.select("id", "v", "box")
        load = {r["box"]: r["count"] for r in asked.groupBy("box").count().collect()}  # at most MAX_BOXES rows
        shares = F.create_map(*[F.lit(x) for b, n in load.items() for x in (b, -(-n // TASK_QUERIES))])
        share = F.coalesce(shares[F.col("box")], F.lit(0))
        held = placed.where(share > 0).withColumn("part", F.explode(F.sequence(F.lit(1), share)))
        part = (F.pmod(F.xxhash64("id"), share.cast("long")) + 1).cast("int")
        spread = asked.select(F.col("id").alias("id"), F.col("v").alias("v"), F.col("box").alias("at"), part.alias("of"))
        return held.groupBy("box", "part").cogroup(spread.groupBy("at", "of")).applyInPandas(search, _FOUND)

    own = look(placed)
    if len(nodes) == 1:
        return own
    own = cut_lineage(own)  # read three times below
    dims = len(sample[0]["v"])
    limits = placed.groupBy("box").agg(
        F.array(*[F.min(F.col("v")[i]) for i in range(dims)]).alias("lo"),
        F.array(*[F.max(F.col("v")[i]) for i in range(dims)]).alias("hi"),
    )
    walls = limits.collect()  # at most MAX_BOXES rows
    box_ids = np.array([r["box"] for r in walls])
    lows, highs = np.array([r["lo"] for r in walls]), np.array([r["hi"] for r in walls])

    @F.pandas_udf("array<long>")
    def reached(v: pd.Series, radius: pd.Series, home: pd.Series) -> pd.Series:
        out = []
        for point, r, h in zip(_matrix(v), radius, home):
            gap = np.maximum(np.maximum(lows - point, point - highs), 0.0)
            near = np.sqrt((gap**2).sum(axis=1)) <= r
            out.append(box_ids[near & (box_ids != h)].tolist())
        return pd.Series(out)

    full = F.size("found") >= k
    radius = F.when(full, F.element_at("found", -1)["d"]).otherwise(F.lit(float("inf")))
    away = (
        placed.join(own, "id")
        .withColumn("box", F.explode(reached("v", radius, "box")))
        .select("id", "v", "box")
    )
    every = own.unionByName(look(away))
    merged = every.groupBy("id").agg(F.flatten(F.collect_list("found")).alias("found"))  # at most k per reached box
    return merged.withColumn("found", F.slice(F.array_sort("found"), 1, k))


def smote_oversample(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    id_col: str,
    k: int = 5,
    seed: int = 42,
    box_points: int = BOX_POINTS,
) -> DataFrame:
    """Add synthetic minority rows until the two classes are equal.

    Each synthetic row lies between a minority row and one of its k nearest minority
    rows.  Base rows are taken in turn, so each is used equally often up to one.
    Columns: features, label, id (null for synthetic rows), synthetic, and the two parents.
    """
    counts = class_counts(df, label)
    minority = min(counts, key=counts.get)
    lacking = max(counts.values()) - counts[minority]
    vector = F.array(*[F.col(f).cast("double") for f in features])
    real = df.select(
        *[F.col(f).cast("double").alias(f) for f in features],
        F.col(label),
        F.col(id_col).cast("long").alias(id_col),
        F.lit(False).alias("synthetic"),
        F.lit(None).cast("long").alias("parent_a"),
        F.lit(None).cast("long").alias("parent_b"),
    )
    if lacking == 0 or counts[minority] < 2:
        return real
    rows = df.where(F.col(label) == minority).select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("class"), vector.alias("v"))
    rows = cut_lineage(rows)  # the minority only, read many times below
    distinct = cut_lineage(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    found = nearest(distinct, k + 1, box_points)
    # each base row makes `each` synthetic rows, and the first `extra` by hash one more
    each, extra = divmod(lacking, counts[minority])
    (more,) = HashOrder(rows, "id", "class", seed).first({minority: extra})
    bases = (
        rows.withColumn("times", F.lit(each) + more.cast("int"))
        .where(F.col("times") > 0)
        .join(distinct.select("v", F.col("id").alias("spot")), "v")
        .join(found.withColumnRenamed("id", "spot"), "spot")
        .withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times"))))
    )
    # the k nearest, copies counted one by one and the row itself left out
    usable = F.transform(
        "found",
        lambda c: F.struct(
            c["other"].alias("other"),
            (c["copies"] - (c["other"] == F.col("spot")).cast("long")).alias("copies"),
        ),
    )
    listed = F.slice(F.flatten(F.transform(usable, lambda c: F.array_repeat(c["other"], F.least(c["copies"], F.lit(k)).cast("int")))), 1, k)
    drawn = (
        bases.withColumn("near", listed)
        .withColumn("pick", (F.pmod(F.xxhash64("id", "turn", F.lit(seed)), F.size("near").cast("long")) + 1).cast("int"))
        .withColumn("parent_b", F.element_at("near", F.col("pick")))
        .withColumn("gap", F.pmod(F.xxhash64("turn", "id", F.lit(seed + 1)), F.lit(1_000_000)) / 1_000_000)
    )
    mates = distinct.select(F.col("id").alias("parent_b"), F.col("v").alias("w"))
    between = F.zip_with("v", "w", lambda a, b: a + (b - a) * F.col("gap"))
    made = drawn.join(mates, "parent_b").withColumn("s", between)
    synthetic = made.select(
        *[F.col("s")[i].alias(f) for i, f in enumerate(features)],
        F.lit(minority).cast(df.schema[label].dataType).alias(label),
        F.lit(None).cast("long").alias(id_col),
        F.lit(True).alias("synthetic"),
        F.col("id").alias("parent_a"),
        "parent_b",
    )
    return real.unionByName(synthetic)
