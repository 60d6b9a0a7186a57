"""Error, classification and ranking metrics as aggregates.

Ranking metrics first collapse rows to one per distinct score and then need
running totals over all scores; `running_total` spreads those over blocks, so no
task sees the whole score range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.bands import recall_status
from riskloom.functions.numeric import EPS, floor_target, no_nan, ratio_or_zero
from riskloom.functions.rows import literal_rows
from riskloom.functions.student import t_quantile
from riskloom.plans.ordered import BLOCK_ROWS, cut_points, running_total


def dataset_profile(df: DataFrame, label: str, date_col: str | None) -> DataFrame:
    """Rows, period and class balance of a training set; the period is null where rows have no date."""
    day = F.col(date_col) if date_col else F.lit(None)
    return df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.min(day).cast("date").alias("start_date"),
        F.max(day).cast("date").alias("end_date"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.avg(F.col(label).cast("int")).alias("positive_ratio"),
    )


def weight_summary(df: DataFrame, weight: str, label: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.avg(F.col(label)).alias("positive_ratio"),
        F.min(weight).alias("weight_min"),
        F.avg(weight).alias("weight_mean"),
        F.max(weight).alias("weight_max"),
    )


def confusion(df: DataFrame, actual: Column, predicted: Column, weight: Column | None = None) -> DataFrame:
    """Confusion counts (or weight sums) and the four derived rates; undefined rates are 0."""

    def cell(p: int, a: int) -> Column:
        match = (predicted == p) & (actual == a)
        return F.count_if(match) if weight is None else F.coalesce(F.sum(F.when(match, weight)), F.lit(0.0))

    cells = df.agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"))
    return with_rates(cells)


def with_rates(cells: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns(
        {
            "recall": ratio_or_zero(tp, tp + fn),
            "precision": ratio_or_zero(tp, tp + fp),
            "accuracy": ratio_or_zero(tp + tn, tp + fp + fn + tn),
        }
    ).withColumn("f1_score", ratio_or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, f1 and support per class."""
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    none, n = F.lit(0).cast("long"), F.col("n")

    def side(label: str, support: Column, said: Column, hits: Column) -> Column:
        return F.struct(F.col(label).alias("label"), support.alias("support"), said.alias("said"), hits.alias("hits"))

    hit = F.when(F.col("a") == F.col("p"), n).otherwise(none)
    sides = F.array(side("a", n, none, hit), side("p", none, n, none))
    per_class = pairs.select(F.inline(sides)).groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hits").alias("hits"))
    precision, recall = ratio_or_zero(F.col("hits"), F.col("said")), ratio_or_zero(F.col("hits"), F.col("support"))
    return per_class.select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio_or_zero(2 * precision * recall, precision + recall).alias("f1_score"),
        "support",
    )


def score_totals(
    df: DataFrame, label: str, score: str, weight: str | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per distinct score: class totals at it (pos, neg) and below it."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    w = F.col(weight) if weight else F.lit(1).cast("long")
    zero = F.lit(0.0) if weight else F.lit(0).cast("long")
    per_score = rows.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(zero)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(zero)).alias("neg"),
        F.count(F.lit(1)).alias("rows"),
    )
    limits = cut_points(rows, score, block_rows)
    return running_total(per_score, "score", {"pos": "pos_below", "neg": "neg_below"}, limits)


def roc_auc(
    df: DataFrame,
    label: str,
    score: str,
    weight: str | None = None,
    min_rows: int = 10,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact area under the curve, ties counted half; null below `min_rows` or with one class."""
    wide = "double" if weight else "decimal(19,0)"
    pos, neg, below = (F.col(c).cast(wide) for c in ("pos", "neg", "neg_below"))
    facts = score_totals(df, label, score, weight, block_rows).agg(
        F.sum(pos * (2 * below + neg)).cast("double").alias("pairs"),
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("q"),
        F.sum("rows").alias("n"),
    )
    usable = (F.col("n") >= min_rows) & (F.col("p") > 0) & (F.col("q") > 0)
    return facts.select(
        F.when(usable, F.col("pairs") / F.nullif(2 * F.col("p") * F.col("q"), F.lit(0.0))).alias("auc"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def ks_statistic(df: DataFrame, label: str, score: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Largest gap between the class score distributions, and Gini from the area under the curve."""
    p, q = (F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("pos_all", "neg_all"))
    gap = F.abs((F.col("pos_below") + F.col("pos")) / p - (F.col("neg_below") + F.col("neg")) / q)
    pairs = F.col("pos").cast("decimal(19,0)") * (2 * F.col("neg_below") + F.col("neg")).cast("decimal(19,0)")
    facts = score_totals(df, label, score, None, block_rows).agg(
        F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"),
        F.sum(pairs).cast("double").alias("pairs"),
        F.max(p * q).alias("all_pairs"),
    )
    return facts.select("ks", (2 * (F.col("pairs") / (2 * F.col("all_pairs"))) - 1).alias("gini"))


def pr_curve(df: DataFrame, label: str, score: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Precision and recall of `score >= threshold` at every distinct score."""
    totals = score_totals(df, label, score, None, block_rows)
    hits, misses = F.col("pos_all") - F.col("pos_below"), F.col("neg_all") - F.col("neg_below")
    return totals.select(
        F.col("score").alias("threshold"),
        ratio_or_zero(hits, hits + misses).alias("precision"),
        ratio_or_zero(hits, F.col("pos_all")).alias("recall"),
    )


def optimal_threshold(
    df: DataFrame, label: str, score: str, min_recall: float = 0.95, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The threshold of best precision that keeps the recall; the lowest one on ties, 0.5 if there is none."""
    good = pr_curve(df, label, score, block_rows).where(F.col("recall") >= min_recall)
    best = good.agg(F.max(F.struct("precision", (-F.col("threshold")).alias("t"), "recall")).alias("b"))
    return best.select(
        F.coalesce(-F.col("b.t"), F.lit(0.5)).alias("threshold"),
        F.col("b.precision").alias("precision"),
        F.col("b.recall").alias("recall"),
    )


def monitor_error(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE and MAPE in percent over pairs that have both values; NaN is no value."""
    y, p = no_nan(F.col(actual).cast("double")), no_nan(F.col(predicted).cast("double"))
    gap = y - p
    return pairs.where(y.isNotNull() & p.isNotNull()).agg(
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (F.avg(F.abs(gap / F.nullif(y + EPS, F.lit(0.0)))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("n"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted_log: str) -> DataFrame:
    """MAE, RMSE and MAPE (a fraction) in real scale for a model of log1p(target)."""
    y, p = floor_target(no_nan(F.col(actual).cast("double"))), F.expm1(no_nan(F.col(predicted_log).cast("double")))
    return df.where(y.isNotNull() & p.isNotNull()).agg(
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg(F.abs(y - p) / F.abs(y)).alias("mape"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
    )


def residual_interval(df: DataFrame, actual: str, predicted: str, confidence: float = 0.95) -> DataFrame:
    """Interval around the mean residual; one aggregate row returns to the driver for the t quantile."""
    r = F.col(actual) - F.col(predicted)
    n, mean, sd = df.agg(F.count(r), F.avg(r), F.stddev_samp(r)).first()
    t = t_quantile(1 - (1 - confidence) / 2, n - 1) if n > 1 else None
    margin = t * sd if t is not None else None
    row = (
        mean - margin if margin is not None else None,
        mean + margin if margin is not None else None,
        mean,
        sd,
        margin,
        confidence * 100,
        t,
    )
    schema = (
        "lower_bound double, upper_bound double, media_residuos double, sigma double, margin_error double, "
        "confidence_level double, t_crit double"
    )
    return literal_rows(df.sparkSession, [row], schema)


def asymmetric_loss(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Squared error, a quarter of it where the prediction is too low."""
    r = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(F.when(r < 0, r * r).otherwise(r * r / 4)).alias("loss"))


def feedback_monitor(
    feedback: DataFrame, min_recall: float = 0.70, min_samples: int = 10, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Status of a model in production from its matured predictions; one row."""
    rates = confusion(feedback, F.col("actual"), F.col("predicted"))
    area = roc_auc(feedback, "actual", "probability", block_rows=block_rows).select("auc").scalar()
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    enough = F.col("evaluated_samples") >= min_samples
    kept = {c: F.when(enough, F.round(c, 4)) for c in ("recall", "f1_score", "precision", "accuracy", "auc_roc")}
    return (
        rates.withColumn("evaluated_samples", total)
        .withColumn("auc_roc", area)
        .withColumn("status", F.when(enough, recall_status(F.col("recall"), min_recall)).otherwise("insufficient_data"))
        .withColumns(kept)
    )
