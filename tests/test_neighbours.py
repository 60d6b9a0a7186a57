"""Neighbours against brute force, oversampling and isolation forest invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.isolation import fit_isolation_forest
from riskloom.operators.neighbours import best_cut, grow_boxes, locate, nearest, smote_oversample, usual_reach


@pytest.mark.parametrize("box_points", [10**6, 20])
def test_nearest_is_exact(spark, box_points):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(250, 3)), rng.normal(5, 0.1, size=(50, 3))])
    df = spark.createDataFrame([(i, p.tolist(), 1) for i, p in enumerate(points)], "id long, v array<double>, copies long")
    found = {r["id"]: [c["d"] for c in r["found"]] for r in nearest(df, 6, box_points).collect()}
    gaps = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    assert len(found) == len(points)
    for i in range(len(points)):
        np.testing.assert_allclose(found[i], np.sort(gaps[i])[:6], atol=1e-12)


def flags(rng, n):
    """Columns of noughts and ones, of few whole numbers, and one narrow range."""
    return np.column_stack([rng.random(n) < 0.1, rng.random(n) < 0.5, rng.integers(1, 5, n), rng.integers(0, 400, n) / 1000]).astype(float)


def test_boxes_split_columns_of_few_values():
    points = np.unique(flags(np.random.default_rng(6), 6000), axis=0)
    for boxes in (8, 64):
        sizes = np.bincount(locate(grow_boxes(points, boxes), points))
        assert len(sizes) == boxes and sizes.max() <= 4 * len(points) / boxes
    assert grow_boxes(np.ones((50, 3)), 8) == [(-1, 0)]


def test_boxes_are_cut_where_neighbours_are_not_parted():
    """A cut through a gap beats one through the middle of a crowd, so that few points ask other boxes."""
    rng = np.random.default_rng(8)
    points = np.column_stack([rng.random(4000) < 0.45, rng.normal(size=4000), rng.normal(size=4000)]).astype(float) * [5, 1, 1]
    reach = usual_reach(points, 6, len(points))
    gaps = np.sort(np.sqrt(((points[:100, None, :] - points[None, :, :]) ** 2).sum(axis=2)), axis=1)
    assert gaps[:, 6].min() < reach < gaps[:, 6].max()
    assert best_cut(points)[0] != 0 and best_cut(points, reach) == (0, 5.0)
    assert usual_reach(points[:1], 6, 1) == 0 == usual_reach(np.full((9, 2), np.nan), 6, 9)

    def asking(nodes):
        where = locate(nodes, points)
        boxes = [points[where == b] for b in np.unique(where)]
        return sum((np.linalg.norm(np.maximum(np.maximum(b.min(axis=0) - points, points - b.max(axis=0)), 0), axis=1) <= reach).sum() for b in boxes)

    assert asking(grow_boxes(points, 4, reach)) < 0.95 * asking(grow_boxes(points, 4))


def test_nearest_is_exact_on_columns_of_few_values(spark):
    points = np.unique(flags(np.random.default_rng(6), 500), axis=0)
    df = spark.createDataFrame([(i, p.tolist(), 1) for i, p in enumerate(points)], "id long, v array<double>, copies long")
    gaps = np.sort(np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)), axis=1)[:, :5]
    for r in nearest(df, 5, 30).collect():
        np.testing.assert_allclose([c["d"] for c in r["found"]], gaps[r["id"]], atol=1e-12)


@pytest.mark.parametrize("box_points", [10**6, 15])
def test_smote(spark, box_points):
    rng = np.random.default_rng(4)
    rows = [(i, *rng.normal(size=2).tolist(), 0) for i in range(300)]
    rows += [(1000 + i, *rng.normal(4, 1, size=2).tolist(), 1) for i in range(50)]
    rows += [(2000 + i, 9.0, 9.0, 1) for i in range(20)]  # a heap of copies
    df = spark.createDataFrame(rows, "id long, x double, y double, label int")
    out = smote_oversample(df, ["x", "y"], "label", "id", box_points=box_points).toPandas()
    assert out.label.value_counts().to_dict() == {0: 300, 1: 300}
    assert (~out.synthetic).sum() == len(rows)
    at = {r[0]: np.array(r[1:3]) for r in rows if r[3] == 1}
    ids = np.array(list(at))
    where = np.array(list(at.values()))
    for r in out[out.synthetic].itertuples():
        a, b = at[int(r.parent_a)], at[int(r.parent_b)]
        p = np.array([r.x, r.y])
        assert np.linalg.norm(p - a) + np.linalg.norm(p - b) == pytest.approx(np.linalg.norm(a - b), abs=1e-9)
        gaps = np.sort(np.linalg.norm(where[ids != int(r.parent_a)] - a, axis=1))
        assert np.linalg.norm(b - a) <= gaps[4] + 1e-9
    uses = out[out.synthetic].parent_a.value_counts()
    assert uses.max() - uses.min() <= 1 and len(uses) == 70


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *rng.normal(size=3).tolist()) for i in range(2000)] + [(5000 + i, 12.0 + i, -11.0, 13.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5)
    fitted = fit_isolation_forest(df, ["a", "b", "c"], "id", trees=50, contamination=0.01)
    scored = df.select("id", fitted.score().alias("s")).toPandas()
    assert scored[scored.id >= 5000].s.max() < scored[scored.id < 5000].s.quantile(0.02)
    assert 0.005 <= (scored.s < 0).mean() <= 0.012
    again = fit_isolation_forest(df.repartition(2), ["a", "b", "c"], "id", trees=50, contamination=0.01)
    same = df.select("id", again.score().alias("s")).toPandas()
    assert scored.sort_values("id").s.tolist() == pytest.approx(same.sort_values("id").s.tolist())


def test_columns_with_nulls_are_kept_out_of_fitting(spark):
    df = spark.createDataFrame([(i, float(i % 7), None if i % 3 == 0 else float(i)) for i in range(90)], "id long, a double, b double")
    fitted = fit_isolation_forest(df, ["a", "b"], "id", trees=5)
    assert fitted.sample == 60
    assert df.where(F.col("b").isNotNull()).select(fitted.score().alias("s")).where("s is null").count() == 0
