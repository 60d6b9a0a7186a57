"""Binned distributions and how far they drift.

A baseline is a table (feature, bucket, lo, hi, share, n, ...): at most bins x
features rows, small by construction.  Its edges are read once to the driver and
become literals, so the current data is counted in a single scan whatever the
number of features: each row yields its bucket per feature, counts are combined
before the shuffle, and only bins x features rows travel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.bands import ALARM, EXTREME_PSI, RETRAIN, psi_alert, psi_category
from riskloom.functions.numeric import no_nan
from riskloom.functions.rows import literal_rows
from riskloom.plans.quantiles import DECILES, DIRECT_ROWS, column_quantiles

FLOOR_PERCENT = 1e-6
EPS_FRACTION = 1e-4
BIN_SCHEMA = "feature string, bucket int, lo double, hi double"


def bucket_of(value: Column, edges: Sequence[float], closed: bool) -> Column:
    """Index of the half-open bin; the last bin also holds its upper edge.

    Closed: values outside the edges belong nowhere.  Open: they go to the end bins.
    """
    last = len(edges) - 2
    bucket = F.lit(last)
    for i in range(last, 0, -1):
        bucket = F.when(value < edges[i], F.lit(i - 1)).otherwise(bucket)
    if closed:
        return F.when(value.between(edges[0], edges[-1]), bucket)
    return F.when(value.isNotNull(), bucket)


def bin_rows(df: DataFrame, edges: dict[str, Sequence[float]]) -> DataFrame:
    rows = [(f, i, e[i], e[i + 1]) for f, e in edges.items() for i in range(len(e) - 1)]
    return literal_rows(df.sparkSession, rows, BIN_SCHEMA)


def bucket_counts(df: DataFrame, edges: dict[str, Sequence[float]], closed: bool) -> DataFrame:
    """Rows per (feature, bucket) in one scan; the null bucket holds what belongs nowhere."""
    if not edges:
        return literal_rows(df.sparkSession, [], "feature string, bucket int, n long")
    entries = [
        F.struct(F.lit(f).alias("feature"), bucket_of(no_nan(F.col(f).cast("double")), e, closed).alias("bucket"))
        for f, e in edges.items()
    ]
    return df.select(F.inline(F.array(*entries))).groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias("n"))


def histogram(counts: DataFrame, bins: DataFrame) -> DataFrame:
    """Counts beside their bins, empty bins with 0, with the share of the feature's total."""
    total = F.sum("n").over(W.partitionBy("feature"))  # bins of one feature
    return (
        bins.join(counts, ["feature", "bucket"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("total", total)
        .withColumn("share", F.coalesce(F.col("n") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)))
    )


def _counted(df: DataFrame, edges: dict[str, Sequence[float]], closed: bool) -> list[tuple]:
    """(feature, bucket, lo, hi, n, total) of every bin, on the driver: bins x features rows."""
    return _listed(edges, {(r["feature"], r["bucket"]): r["n"] for r in bucket_counts(df, edges, closed).collect()})


def _listed(edges: dict[str, Sequence[float]], found: dict[tuple, int]) -> list[tuple]:
    out = []
    for f, e in edges.items():
        counts = [found.get((f, i), 0) for i in range(len(e) - 1)]
        out += [(f, i, e[i], e[i + 1], n, sum(counts)) for i, n in enumerate(counts)]
    return out


def baseline_deciles_pct(df: DataFrame, features: Sequence[str], direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Decile bins with closed ends; shares in percent."""
    values = _projection(df, features)
    found = column_quantiles(values, features, DECILES, direct_rows)
    edges = {f: _distinct(q) for f, q in found.items() if q}
    for f in [f for f, e in edges.items() if len(e) < 2]:  # one value only: a single bin, as wide as 0
        edges[f] = edges[f] * 2
    rows = [
        (f, i, round(lo, 6), round(hi, 6), round(n / total * 100, 6) if total else 0.0, total)
        for f, i, lo, hi, n, total in _counted(values, edges, closed=True)
    ]
    values.unpersist()
    return literal_rows(df.sparkSession, rows, f"{BIN_SCHEMA}, share double, n long")


def baseline_deciles_open(df: DataFrame, features: Sequence[str], direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Decile bins with open ends (null limits), shares as fractions, and summary statistics.

    A feature with fewer than three distinct edges has one row without a bucket and a warning.
    """
    values = _projection(df, features)
    found = column_quantiles(values, features, DECILES, direct_rows)

    def counted(edges: dict[str, Sequence[float]]) -> dict[tuple, int]:
        return {(r["feature"], r["bucket"]): r["n"] for r in bucket_counts(values, edges, closed=False).collect()}

    baseline = open_baseline(df.sparkSession, features, found, counted, _summary(values, features, found))
    values.unpersist()
    return baseline


def open_baseline(
    spark: SparkSession,
    features: Sequence[str],
    found: dict[str, list[float] | None],
    count: Callable[[dict[str, Sequence[float]]], dict[tuple, int]],
    stats: dict[str, tuple],
) -> DataFrame:
    """Rows of a baseline with open ends from deciles, a count of rows per (feature, bin) and summary statistics."""
    edges = {f: _distinct(q) for f, q in found.items() if q}
    usable = {f: e for f, e in edges.items() if len(e) >= 3}
    counted = _listed(usable, count(usable)) if usable else []
    rows = []
    for f in features:
        if f not in usable:
            rows.append((f, None, None, None, None, *stats[f], "insufficient variance"))
        for _, i, lo, hi, n, total in (c for c in counted if c[0] == f):
            limits = (None if i == 0 else lo, None if i == len(usable[f]) - 2 else hi)
            rows.append((f, i, *limits, n / total, *stats[f], None))
    schema = f"{BIN_SCHEMA}, share double, n long, mean double, sd double, median double, null_pct double, warning string"
    return literal_rows(spark, rows, schema)


def _projection(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The features only, NaN as null, kept while several passes read them (spilling to disk as needed)."""
    return df.select(*[no_nan(F.col(f).cast("double")).alias(f) for f in features]).persist()


def _summary(df: DataFrame, features: Sequence[str], quantiles: dict) -> dict[str, tuple]:
    """Per feature: n, mean, sd, median, share of nulls."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(f).alias(f"n_{f}") for f in features],
        *[F.avg(f).alias(f"m_{f}") for f in features],
        *[F.stddev_samp(f).alias(f"s_{f}") for f in features],
    ).first()
    return {
        f: (
            row[f"n_{f}"],
            row[f"m_{f}"],
            row[f"s_{f}"],
            quantiles[f][5] if quantiles[f] else None,
            1 - row[f"n_{f}"] / row["rows"] if row["rows"] else None,
        )
        for f in features
    }


def baseline_mixed(df: DataFrame, categorical: Sequence[str], continuous: Sequence[str], bins: int = 10) -> DataFrame:
    """Value shares of categorical columns and equal-width bins of continuous ones."""
    limits = [f(no_nan(F.col(c).cast("double"))).alias(f"{n}_{c}") for c in continuous for n, f in (("lo", F.min), ("hi", F.max))]
    row = df.agg(*limits).first()
    edges = {c: _linear(row[f"lo_{c}"], row[f"hi_{c}"], bins) for c in continuous if row[f"lo_{c}"] is not None}
    widths = histogram(bucket_counts(df, edges, closed=True), bin_rows(df, edges)).select(
        "feature", F.lit("continuous").alias("type"), "bucket", "lo", "hi", "share", "n"
    )
    entries = [F.struct(F.lit(c).alias("feature"), no_nan(F.col(c).cast("double")).alias("lo")) for c in categorical]
    found = df.select(F.inline(F.array(*entries))).where(F.col("lo").isNotNull())
    counts = found.groupBy("feature", "lo").agg(F.count(F.lit(1)).alias("n"))
    per_feature = W.partitionBy("feature")  # distinct codes of one column
    values = counts.select(
        "feature",
        F.lit("categorical").alias("type"),
        (F.row_number().over(per_feature.orderBy("lo")) - 1).alias("bucket"),
        "lo",
        F.col("lo").alias("hi"),
        (F.col("n") / F.sum("n").over(per_feature)).alias("share"),
        "n",
    )
    return values.unionByName(widths)


def edges_of(baseline: DataFrame) -> dict[str, list]:
    """Bin limits per feature, in order; None marks an open end.  Bins x features rows."""
    bins = baseline.where(F.col("bucket").isNotNull()).select("feature", "bucket", "lo", "hi").collect()
    edges: dict[str, list] = {}
    for r in sorted(bins, key=lambda r: (r["feature"], r["bucket"])):
        edges.setdefault(r["feature"], [r["lo"]]).append(r["hi"])
    return edges


def edge_histogram(df: DataFrame, baseline: DataFrame, closed: bool = True) -> DataFrame:
    """Current values counted into the bins of a baseline."""
    edges = {f: usable_edges(e, closed) for f, e in edges_of(baseline).items() if f in df.columns}
    counted = histogram(bucket_counts(df, edges, closed), bin_rows(df, edges))
    return counted.select("feature", "bucket", "n", "share", "total")


def psi_percent(baseline: DataFrame, current: DataFrame, round_to: int = 6) -> DataFrame:
    """Stability index on percentages, floored at 1e-6 on both sides.

    Shares are percentages, so values are 100 times those on fractions while the
    bands are the usual ones; the service that is monitored works like this.
    """
    edges = {f: _distinct(e) for f, e in edges_of(baseline).items() if f in current.columns}
    listed = literal_rows(current.sparkSession, [(f,) for f in edges], "feature string")
    edges = {f: e for f, e in edges.items() if len(e) >= 2}
    now = histogram(bucket_counts(current, edges, closed=True), bin_rows(current, edges))
    floored = lambda c: F.when(c < FLOOR_PERCENT, FLOOR_PERCENT).otherwise(c)
    base, share = floored(F.col("base")), floored(F.col("share") * 100)
    parts = now.join(baseline.select("feature", "bucket", F.col("share").alias("base")), ["feature", "bucket"])
    scored = parts.groupBy("feature").agg(
        F.when(F.max("total") > 0, F.round(F.abs(F.sum((share - base) * F.ln(share / base))), round_to)).alias("psi"),
        F.max("total").alias("n"),
    )
    return listed.join(scored, "feature", "left").select(
        "feature", F.coalesce("psi", F.lit(0.0)).alias("psi"), F.coalesce("n", F.lit(0)).alias("n")
    )


def psi_fraction(
    baseline: DataFrame,
    current: DataFrame,
    warn: float,
    critical: float,
    order: Sequence[str] | None = None,
    round_to: int = 4,
) -> DataFrame:
    """Stability index on fractions, 1e-4 added inside the logarithm only; reasons for skipped features.

    `order` is the order of the monitored features, used for ties further on.
    """
    edges = {f: usable_edges(e, closed=False) for f, e in edges_of(baseline).items()}
    known = order or sorted(r["feature"] for r in baseline.select("feature").distinct().collect())
    present = {f: edges[f] for f in known if f in edges and f in current.columns}
    return psi_of_counts(baseline, bucket_counts(current, present, closed=False), edges, known, set(current.columns), warn, critical, round_to)


def psi_of_counts(
    baseline: DataFrame,
    counts: DataFrame,
    edges: dict[str, Sequence[float]],
    known: Sequence[str],
    columns: set[str],
    warn: float,
    critical: float,
    round_to: int = 4,
) -> DataFrame:
    """The same from rows counted per (feature, bucket); `columns` are those that production has."""
    present = {f: edges[f] for f in known if f in edges and f in columns}
    reasons = [
        (f, i, "insufficient variance" if f not in edges else None if f in columns else "missing in production")
        for i, f in enumerate(known)
    ]
    listed = literal_rows(counts.sparkSession, reasons, "feature string, position int, reason string")
    now = histogram(counts, bin_rows(counts, present))
    base, share = F.col("base"), F.col("share")
    term = (share - base) * F.ln((share + EPS_FRACTION) / (base + EPS_FRACTION))
    parts = now.join(
        baseline.where(F.col("bucket").isNotNull()).select("feature", "bucket", F.col("share").alias("base")),
        ["feature", "bucket"],
    )
    vectors = F.sort_array(F.collect_list(F.struct("bucket", "share", "base")))  # bins of one feature
    scored = parts.groupBy("feature").agg(
        F.sum(term).alias("raw"), F.max("total").alias("prod_samples"), vectors.alias("v")
    )
    missing = F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n"))), F.lit(0))
    nulls = counts.groupBy("feature").agg((missing / F.sum("n")).alias("prod_null_pct"))
    valid = F.col("prod_samples") > 0
    return (
        listed.join(scored, "feature", "left")
        .join(nulls, "feature", "left")
        .select(
            "feature",
            "position",
            F.when(valid, F.round("raw", round_to)).alias("psi"),
            psi_alert(F.when(valid, F.col("raw")), warn, critical).alias("alert"),
            F.when(F.col("reason").isNull() & ~F.coalesce(valid, F.lit(False)), "no valid rows")
            .otherwise(F.col("reason"))
            .alias("reason"),
            F.when(valid, F.col("v.share")).alias("actual_pct"),
            F.when(valid, F.col("v.base")).alias("expected_pct"),
            F.when(valid, F.col("prod_samples")).alias("prod_samples"),
            F.when(valid, F.col("prod_null_pct")).alias("prod_null_pct"),
        )
    )


def drift_report(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Percent-based index per feature with its band."""
    return psi_percent(baseline, current).select(
        "feature", "psi", psi_category(F.col("psi")).alias("band"), (F.col("psi") >= 0.25).alias("critical")
    )


def drift_decision(
    psi: DataFrame, warn: float, critical: float, critical_share: float, warning_share: float
) -> DataFrame:
    """Roll per-feature indexes up to one decision; the thresholds have no defaults on purpose."""
    value = F.col("psi")
    facts = psi.agg(
        F.count(value).alias("total_features"),
        F.count_if(value >= critical).alias("n_critical"),
        F.count_if((value >= warn) & (value < critical)).alias("n_warning"),
        F.count_if(value < warn).alias("n_ok"),
        F.count_if(value.isNull()).alias("n_skipped"),
        F.max(F.when(value.isNotNull(), F.struct(value, -F.col("position"), F.col("feature")))).alias("worst"),
    )
    share = lambda n: n / F.nullif(F.col("total_features"), F.lit(0))
    facts = facts.select(
        "*",
        share(F.col("n_critical")).alias("pct_critical"),
        share(F.col("n_critical") + F.col("n_warning")).alias("pct_warning_plus"),
        F.col("worst.feature").alias("worst_feature"),
        F.col("worst.psi").alias("worst_psi"),
    ).drop("worst")
    decision = (
        F.when(F.col("total_features") == 0, "INSUFICIENTE")
        .when((F.col("pct_critical") >= critical_share) | (F.col("worst_psi") >= EXTREME_PSI), RETRAIN)
        .when((F.col("pct_warning_plus") >= warning_share) | (F.col("n_critical") > 0), ALARM)
        .otherwise("OK")
    )
    action = (
        F.when(F.col("decision") == "INSUFICIENTE", "collect more data")
        .when(F.col("decision") == RETRAIN, "retrain now")
        .when(F.col("decision") == ALARM, "watch daily, prepare retraining")
        .otherwise("none")
    )
    return (
        facts.withColumn("decision", decision)
        .withColumn("action", action)
        .withColumns({c: F.round(c, 4) for c in ("pct_critical", "pct_warning_plus")})
    )


def _distinct(edges: Sequence[float]) -> list[float]:
    return sorted(set(edges))


def usable_edges(edges: list, closed: bool) -> list[float]:
    """Open ends get a finite stand-in; only the inner limits matter there."""
    if closed:
        return list(edges)
    inner = edges[1:-1]
    return [edges[0] if edges[0] is not None else inner[0], *inner, edges[-1] if edges[-1] is not None else inner[-1]]


def _linear(lo: float, hi: float, bins: int) -> list[float]:
    """Equal-width limits; a constant column is widened by a half to each side."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    return [lo + step * i for i in range(bins)] + [hi]


def pack_baseline(baseline: DataFrame) -> DataFrame:
    """A baseline as one JSON document: feature -> limits and shares.  Bins x features entries."""
    bins = F.sort_array(F.collect_list(F.struct("bucket", "lo", "hi", "share")))
    per_feature = baseline.where(F.col("bucket").isNotNull()).groupBy("feature").agg(bins.alias("bins"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "bins"))))
    return per_feature.agg(F.to_json(entries, {"ignoreNullFields": "false"}).alias("psi_baseline"))


def baseline_of_champion(audits: DataFrame, flag: str = "is_production", document: str = "psi_baseline") -> DataFrame:
    """Rows of the baseline stored with the model in production; empty when there is none."""
    schema = "map<string, array<struct<bucket: int, lo: double, hi: double, share: double>>>"
    stored = audits.where(F.col(flag)).select(F.explode(F.from_json(document, schema)).alias("feature", "bins"))
    return stored.select("feature", F.inline("bins"))
