"""Isolation forest: trees grow in parallel on small samples, scoring is a vectorised column function."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.plans.quantiles import DIRECT_ROWS, column_quantiles

TREES = 100
SAMPLE = 256
CONTAMINATION = 0.005


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes as (axis, cut, left, right, path length); axis -1 marks a leaf."""
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(())
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        axes = np.flatnonzero(hi > lo)
        if depth == max_depth or len(axes) == 0:
            nodes[at] = (-1, 0.0, 0, 0, depth + float(mean_path(len(rows))))
        else:
            axis = int(rng.choice(axes))
            cut = float(rng.uniform(lo[axis], hi[axis]))
            left = rows[:, axis] <= cut
            nodes[at] = (axis, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1), 0.0)
        return at

    grow(points, 0)
    return nodes


@dataclass(frozen=True)
class IsolationForest:
    features: tuple[str, ...]
    trees: tuple[tuple, ...]  # per tree: arrays axis, cut, left, right, path
    sample: int
    offset: float = 0.0

    def score(self) -> Column:
        """-2^(-depth / expected depth), minus the offset: negative means anomalous."""
        trees, offset, expected = self.trees, self.offset, float(mean_path(self.sample)) or 1.0

        @F.pandas_udf("double")
        def depth_score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            total, rows = np.zeros(len(x)), np.arange(len(x))
            for axis, cut, left, right, path in trees:
                at = np.zeros(len(x), dtype=np.int64)
                while (inner := axis[at] >= 0).any():
                    below = x[rows, np.maximum(axis[at], 0)] <= cut[at]
                    at = np.where(inner, np.where(below, left[at], right[at]), at)
                total += path[at]
            return pd.Series(-np.exp2(-total / len(trees) / expected) - offset)

        return depth_score(*[F.col(f).cast("double") for f in self.features])


def fit_isolation_forest(
    df: DataFrame,
    features: Sequence[str],
    id_col: str,
    trees: int = TREES,
    sample: int = SAMPLE,
    contamination: float = CONTAMINATION,
    seed: int = 42,
    direct_rows: int = DIRECT_ROWS,
) -> IsolationForest:
    """Each tree sees `sample` random rows; the pool they come from has at most trees x sample rows.

    The offset puts the `contamination` lowest training scores below zero.
    """
    spark = df.sparkSession
    columns = [F.col(f).cast("double").alias(f) for f in features]
    rows = df.select(F.col(id_col), *columns).dropna()
    pool = rows.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(trees * sample).select(*features).collect()
    points = np.array([tuple(r) for r in pool], dtype=float)
    size = min(sample, len(points))
    depth = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(batches):
        for batch in batches:
            for tree in batch["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                chosen = points[rng.choice(len(points), size, replace=False)]
                nodes = grow_tree(chosen, rng, depth)
                yield pd.DataFrame(
                    [(int(tree), *map(list, zip(*nodes)))], columns=["tree", "axis", "cut", "left", "right", "path"]
                )

    schema = "tree long, axis array<int>, cut array<double>, left array<int>, right array<int>, path array<double>"
    grown = spark.range(trees).repartition(min(trees, spark.sparkContext.defaultParallelism)).mapInPandas(grow, schema)
    nodes = tuple(
        tuple(np.array(r[c]) for c in ("axis", "cut", "left", "right", "path")) for r in sorted(grown.collect(), key=lambda r: r["tree"])
    )  # trees x (2 x sample) nodes
    raw = IsolationForest(tuple(features), nodes, size)
    scored = rows.select(raw.score().alias("score"))
    offset = column_quantiles(scored, ["score"], [contamination], direct_rows)["score"][0]
    return IsolationForest(tuple(features), nodes, size, offset)
