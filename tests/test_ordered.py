"""Block-wise order, sums, quantiles and subsets against plain pandas, hot values included."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators.metrics import ks_statistic, pr_curve, roc_auc
from riskloom.operators.sampling import stratified_split, time_series_folds, undersample
from riskloom.plans.cuts import HashOrder
from riskloom.plans.ordered import cut_points, global_position, single_value_blocks
from riskloom.plans.quantiles import column_quantiles


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key, a third of those one second key."""
    rng = np.random.default_rng(1)
    n = 6000
    a = np.where(rng.random(n) < 0.34, 50, rng.integers(0, 200, n))
    b = np.where(rng.random(n) < 0.34, 7.5, rng.normal(0, 3, n).round(3))
    label = (rng.random(n) < 0.2).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "label": label, "w": rng.random(n).round(2)})
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


@pytest.mark.parametrize("block_rows", [10**6, 400, 37])
def test_global_position(hot, block_rows):
    pdf, df = hot
    expected = pdf.sort_values(["a", "b", "id"])["id"].tolist()
    rows = global_position(df, ["a", "b", "id"], "pos", block_rows).select("id", "pos").collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["pos"])] == expected
    assert sorted(r["pos"] for r in rows) == list(range(len(pdf)))


@pytest.mark.parametrize("block_rows", [10**6, 50, 7])
def test_positions_of_missing_and_nan_keys(spark, block_rows):
    """Nulls come first, NaN last, and all rows are numbered, whatever the size of a block."""
    rows = [(i, None if i % 10 == 0 else float("nan") if i % 13 == 0 else float(i % 3), None if i % 7 == 0 else i % 50) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b long").repartition(5)

    def place(value):
        return (0, 0) if value is None else (2, 0) if value != value else (1, value)

    want = [i for i, _, _ in sorted(rows, key=lambda r: (place(r[1]), place(r[2]), r[0]))]
    found = sorted((r["pos"], r["id"]) for r in global_position(df, ["a", "b", "id"], "pos", block_rows).collect())
    assert [i for _, i in found] == want and [p for p, _ in found] == list(range(400))


def test_wide_and_narrow_columns_have_codes_of_one_kind(spark):
    """The limit is per column; long texts with a common beginning are told apart."""
    from riskloom.operators.features import label_codes

    texts = ["", "é", "z", "prefix-prefix-1", "prefix-prefix-12", "prefix-prefix-2", "ab", "abc"]
    df = spark.createDataFrame([(t, str(i % 2)) for i, t in enumerate(texts)], "wide string, narrow string")
    codes = label_codes(df, ["wide", "narrow"], 3, 2)
    assert {r["wide"]: r["wide_code"] for r in codes["wide"].collect()} == {t: i for i, t in enumerate(sorted(texts))}
    assert {r["narrow"]: r["narrow_code"] for r in codes["narrow"].collect()} == {"0": 0, "1": 1}


def test_hot_value_has_its_own_block(hot):
    _, df = hot
    assert single_value_blocks(cut_points(df, "a", 400))


@pytest.mark.parametrize("block_rows", [10**6, 100])
def test_ranking_metrics(hot, block_rows):
    pdf, df = hot
    pos, neg = pdf[pdf.label == 1].b.to_numpy(), pdf[pdf.label == 0].b.to_numpy()
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert roc_auc(df, "label", "b", block_rows=block_rows).first()["auc"] == pytest.approx(wins, abs=1e-12)
    wp, wn = pdf[pdf.label == 1].w.to_numpy(), pdf[pdf.label == 0].w.to_numpy()
    pairs = wp[:, None] * wn[None, :]
    gain = (pairs * (pos[:, None] > neg[None, :])).sum() + 0.5 * (pairs * (pos[:, None] == neg[None, :])).sum()
    weighted = roc_auc(df, "label", "b", "w", block_rows=block_rows).first()["auc"]
    assert weighted == pytest.approx(gain / pairs.sum(), abs=1e-9)
    grid = np.unique(pdf.b)
    gap = max(abs((pos <= g).mean() - (neg <= g).mean()) for g in grid)
    row = ks_statistic(df, "label", "b", block_rows).first()
    assert row["ks"] == pytest.approx(gap, abs=1e-12)
    assert row["gini"] == pytest.approx(2 * wins - 1, abs=1e-12)
    curve = {r["threshold"]: r for r in pr_curve(df, "label", "b", block_rows).collect()}
    for g in grid[::50]:
        said = pdf.b >= g
        assert curve[g]["precision"] == pytest.approx(pdf.label[said].mean(), abs=1e-12)
        assert curve[g]["recall"] == pytest.approx((said & (pdf.label == 1)).sum() / (pdf.label == 1).sum(), abs=1e-12)


def test_auc_is_null_without_both_classes(spark):
    one = spark.createDataFrame([(1, float(i)) for i in range(20)], "label int, s double")
    assert roc_auc(one, "label", "s").first()["auc"] is None
    few = spark.createDataFrame([(i % 2, float(i)) for i in range(9)], "label int, s double")
    assert roc_auc(few, "label", "s").first()["auc"] is None


@pytest.mark.parametrize("direct_rows,range_rows", [(10**6, 1), (0, 10**6), (0, 40)])
def test_quantiles(hot, direct_rows, range_rows):
    pdf, df = hot
    probs = [0, 0.005, 0.1, 0.25, 0.5, 0.77, 0.9, 1]
    found = column_quantiles(df, ["a", "b"], probs, direct_rows, range_rows)
    for c in ("a", "b"):
        assert found[c] == pytest.approx(np.quantile(pdf[c], probs).tolist(), abs=1e-9)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert column_quantiles(empty, ["x", "y"], [0.5]) == {"x": None, "y": [1.0]}
    assert column_quantiles(empty, ["x", "y"], [0.5], direct_rows=0) == {"x": None, "y": [1.0]}


@pytest.mark.parametrize("few_rows", [50_000, 0])
def test_hash_order_takes_exact_counts(hot, few_rows):
    pdf, df = hot
    order = HashOrder(df, "id", "label", few_rows=few_rows)
    assert order.counts == pdf.label.value_counts().to_dict()
    small, large = order.first({0: 1000, 1: 0}, {0: 10**9, 1: 77})
    taken = df.select("label", small.alias("s"), large.alias("l")).toPandas()
    assert taken[taken.s].label.value_counts().to_dict() == {0: 1000}
    assert taken[taken.l].label.value_counts().to_dict() == {0: order.counts[0], 1: 77}


def test_undersample_counts_and_repeats(hot):
    pdf, df = hot
    positives = int(pdf.label.sum())
    first = undersample(df, "label", "id", ratio=2).toPandas()
    assert (first.label == 1).sum() == positives and (first.label == 0).sum() == 2 * positives
    again = undersample(df.repartition(3), "label", "id", ratio=2).toPandas()
    assert set(first.id) == set(again.id)
    assert len(undersample(df, "label", "id", ratio=1000).toPandas()) == len(pdf)


def test_undersample_needs_positives(spark):
    with pytest.raises(ValueError):
        undersample(spark.createDataFrame([(1, 0)], "id int, label int"), "label", "id")


def test_stratified_split(hot):
    pdf, df = hot
    parts = stratified_split(df, "label", "id", [("test", 0.2), ("val", 0.2)]).toPandas()
    assert len(parts) == len(pdf)
    for label, n in pdf.label.value_counts().items():
        sizes = parts[parts.label == label].split.value_counts()
        assert sizes["test"] == round(n * 0.2) and sizes["val"] == round(n * 0.2)


@pytest.mark.parametrize("block_rows", [10**6, 100])
def test_time_folds(hot, block_rows):
    pdf, df = hot
    folded = time_series_folds(df, ["a", "b", "id"], 5, block_rows).toPandas().sort_values("position")
    size = len(pdf) // 6
    assert folded.fold.value_counts().to_dict() == {**{i: size for i in range(1, 6)}, 0: len(pdf) - 5 * size}
    assert folded.fold.is_monotonic_increasing


def test_label_codes_by_ranges(spark):
    from riskloom.operators.features import label_codes, label_encode

    df = spark.createDataFrame([(w,) for w in "pear fig apple fig kiwi".split()], "c string")
    for limit, block_rows in ((1000, 10**6), (2, 10**6), (2, 2)):
        codes = label_codes(df, ["c"], limit, block_rows)
        assert dict(codes["c"].dtypes) == {"c": "string", "c_code": "bigint"}
        seen = {r["c"]: r["c_code"] for r in codes["c"].collect()}
        assert seen == {"apple": 0, "fig": 1, "kiwi": 2, "pear": 3}
        other = spark.createDataFrame([("plum",), ("pear",), (None,)], "c string")
        assert sorted(r["c"] for r in label_encode(other, codes).collect()) == [0, 0, 3]


def test_same_result_for_any_partitioning(hot, spark):
    _, df = hot
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = roc_auc(df.orderBy(F.rand(3)), "label", "b").first()["auc"]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == roc_auc(df, "label", "b").first()["auc"]


def test_quantiles_of_all_columns_take_as_many_jobs_as_of_one(spark):
    """Values of all sizes and signs, copies, NaN and empty columns; three passes, whatever the number of columns."""
    import math
    import random

    from riskloom.plans.quantiles import DECILES, column_quantiles

    rng = random.Random(2)
    rows = [
        (rng.choice([None, -0.0, rng.gauss(0, 1) * 10.0 ** rng.randint(-14, 15)]), rng.choice([1.0, 1.0, 1.0 + rng.random() / 1e9]), float(rng.randint(-50, 50)), math.inf if i == 7 else float(i), None, 3.0)
        for i in range(4000)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").persist()
    names, tracker = df.columns, spark.sparkContext.statusTracker()

    def jobs(columns, **more):
        spark.sparkContext.setJobGroup(f"quantiles of {columns}", "")
        found = column_quantiles(df, columns, DECILES, **more)
        return found, len(tracker.getJobIdsForGroup(f"quantiles of {columns}"))

    df.count()
    expected = column_quantiles(df, names, DECILES)
    for rows_of_range in (10, 10**6):
        every, many = jobs(names, direct_rows=10, range_rows=rows_of_range)
        assert many <= jobs(["a"], direct_rows=10, range_rows=rows_of_range)[1] + 2
        for n in names:
            assert every[n] == (None if expected[n] is None else pytest.approx(expected[n], rel=1e-12, abs=0)), n
    spark.sparkContext.setJobGroup("", "")


def test_stored_places_choose_the_same_rows(spark):
    from riskloom.plans.cuts import HashOrder

    df = spark.range(500).selectExpr("id", "int(id % 3) AS label")
    chosen = []
    for store in (False, True):
        order = HashOrder(df, "id", "label", store=store)
        (keep,) = order.first({0: 10, 1: 0, 2: 400})
        chosen.append(sorted(r["id"] for r in df.where(keep).collect()))
    assert chosen[0] == chosen[1] and len(chosen[0]) == 10 + 166


@pytest.mark.parametrize("block_rows", [10, 1_000_000])
@pytest.mark.parametrize("few_keys", [False, True])
def test_folds_without_positions(spark, block_rows, few_keys):
    """Folds come from the first row of each, with the rows they have by position; equal rows around a limit are numbered."""
    rng = random.Random(3)
    rows = [(None if i % 13 == 0 else rng.randrange(9), None if i % 11 == 0 else rng.randrange(4), 0 if few_keys else i) for i in range(203)]
    df = spark.createDataFrame(rows, "a int, b long, id long")
    order, whole = ["a", "b", "id"], lambda d: Counter(tuple(r) for r in d.select("a", "b", "id", "fold").collect())
    numbered, found = time_series_folds(df, order, 5, block_rows), time_series_folds(df, order, 5, block_rows, position=False)
    assert found.columns == ["a", "b", "id", "fold"] and found.schema["fold"].dataType == numbered.schema["fold"].dataType
    assert whole(found) == whole(numbered)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == few_keys
    few = time_series_folds(df.limit(4), order, 5, block_rows, position=False)
    assert [r["fold"] for r in few.collect()] == [0] * 4
