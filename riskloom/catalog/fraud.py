"""Card fraud queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.catalog.base import bins_sql, counts_sql, frames, query, rounded, values_sql
from riskloom.functions.dates import completed_years, completed_years_strict, decay_rate, decay_weight, timestamp_ntz
from riskloom.functions.geo import haversine_km
from riskloom.functions.rows import literal_rows
from riskloom.jobs import fraud
from riskloom.jobs.records import champion, record_training, trainings
from riskloom.operators.distributions import (
    baseline_deciles_pct,
    drift_report,
    edge_histogram,
    psi_percent,
)
from riskloom.operators.features import fraud_features, label_codes, label_encode, robust_scaler, scale
from riskloom.operators.joins import high_risk
from riskloom.operators.metrics import confusion, dataset_profile
from riskloom.operators.registry import fraud_rule
from riskloom.operators.scans import latest
from riskloom.session import shared_folder
from riskloom.sources.commits import committed

START, END, LAM = "2024-01-05", "2024-01-25", decay_rate(180)
NUMERIC = ["amt", "city_pop", "age", "distance_km", "hour"]
SPLIT_AT = "2024-01-20"


def tables(spark, folder) -> fraud.FraudTables:
    tx, cards, people, places, genders, categories = frames(
        spark, folder, "fraud_tx", "fraud_cards", "fraud_people", "fraud_places", "fraud_genders", "fraud_categories"
    )
    people = people.withColumn("dob", F.date_from_unix_date(F.col("dob_days").cast("int"))).drop("dob_days")
    return fraud.FraudTables(
        tx.withColumnRenamed("category", "id_category"), cards, people, places, genders, categories
    )


STAR = """star AS (
    SELECT t.id_transaction, amt, city_pop, category, gender, job, lat, long, merch_lat, merch_long,
           trans_date_time AS trans_date_trans_time, DATE '1970-01-01' + CAST(dob_days AS INT) AS dob, is_fraud, state
    FROM fraud_tx t JOIN fraud_customer c ON t.cc_num = c.id_customer)"""
DAY = "CASE WHEN strftime({b}, '%m%d') = '0229' AND year({t}) % 4 <> 0 THEN '0228' ELSE strftime({b}, '%m%d') END"
AGE = (
    "CAST(year(trans_date_trans_time) - year(dob) - CASE WHEN strftime(trans_date_trans_time, '%m%d') < "
    + DAY.format(b="dob", t="trans_date_trans_time")
    + " THEN 1 ELSE 0 END AS INT)"
)
STRICT_AGE = "CAST(year({t}) - year({b}) - CASE WHEN strftime({t}, '%m%d') < strftime({b}, '%m%d') THEN 1 ELSE 0 END AS INT)"
H = (
    "pow(sin(radians(merch_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(merch_lat)) "
    "* pow(sin(radians(merch_long - long) / 2), 2)"
)
KM = f"12742.0 * asin(sqrt(CASE WHEN {H} > 1 THEN 1.0 ELSE {H} END))"
FEATURES = f"""{STAR},
    feats AS (SELECT *, {AGE} AS age, CAST(hour(trans_date_trans_time) AS INT) AS hour, {KM} AS distance_km FROM star)"""
STAR_COLUMNS = "id_transaction, amt, city_pop, category, gender, job, lat, long, merch_lat, merch_long, trans_date_trans_time, dob, is_fraud"


@query(
    "raw_transactions",
    f"""WITH {STAR} SELECT {STAR_COLUMNS} FROM star
        WHERE trans_date_trans_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'""",
)
def raw_transactions(spark, folder):
    return fraud.raw_transactions(tables(spark, folder), START, END)


def extract_sql(end: str) -> str:
    return f"""SELECT {STAR_COLUMNS},
            round(exp(-{LAM!r} * date_sub('day', trans_date_trans_time, TIMESTAMP '{end}')), 9) AS sample_weight
        FROM star WHERE trans_date_trans_time BETWEEN TIMESTAMP '{end}' - INTERVAL 730 DAY AND TIMESTAMP '{end}'"""


@query("fraud_extract", f"WITH {STAR} {extract_sql(END)}")
def fraud_extract(spark, folder):
    return rounded(fraud.extract(tables(spark, folder), END), 9, "sample_weight")


@query(
    "time_decay_weight",
    f"""SELECT id_transaction, date_sub('day', trans_date_time, TIMESTAMP '2024-02-15 12:00:00') AS days,
            round(exp(-{LAM!r} * date_sub('day', trans_date_time, TIMESTAMP '2024-02-15 12:00:00')), 9) AS sample_weight
        FROM fraud_tx""",
)
def time_decay_weight(spark, folder):
    end = timestamp_ntz("2024-02-15 12:00:00")
    ts = F.col("trans_date_time")
    (tx,) = frames(spark, folder, "fraud_tx")
    return tx.select(
        "id_transaction",
        F.timestamp_diff("DAY", ts, end).alias("days"),
        F.round(decay_weight(ts, end, LAM), 9).alias("sample_weight"),
    )


@query("haversine_distance", f"WITH {STAR} SELECT id_transaction, round({KM}, 4) AS distance_km FROM star")
def haversine_distance(spark, folder):
    t = tables(spark, folder)
    km = haversine_km(F.col("long"), F.col("lat"), F.col("merch_long"), F.col("merch_lat"))
    return t.star(t.tx).select("id_transaction", F.round(km, 4).alias("distance_km"))


@query(
    "completed_age",
    f"""WITH {STAR} SELECT id_transaction, {AGE} AS age,
        {STRICT_AGE.format(t="trans_date_trans_time", b="dob")} AS age_strict FROM star""",
)
def completed_age(spark, folder):
    t = tables(spark, folder)
    at, born = F.col("trans_date_trans_time"), F.col("dob")
    return t.star(t.tx).select(
        "id_transaction", completed_years(born, at).alias("age"), completed_years_strict(born, at).alias("age_strict")
    )


@query("fraud_features", f"WITH {FEATURES} SELECT * EXCLUDE (state, distance_km), round(distance_km, 4) AS distance_km FROM feats")
def features(spark, folder):
    t = tables(spark, folder)
    return rounded(fraud_features(t.star(t.tx)), 4, "distance_km")


@query(
    "high_risk_extract",
    f"""WITH {STAR} SELECT s.id_transaction, amt, CAST(hour(trans_date_trans_time) AS INT) AS hour,
            {STRICT_AGE.format(t="trans_date_trans_time", b="dob")} AS age, round({KM}, 4) AS distance_km, city_pop, category, state
        FROM star s JOIN fraud_predictions p ON s.id_transaction = p.id_transaction
        WHERE veredicto = 'ALTO RIESGO' AND merch_lat IS NOT NULL
          AND p.prediction_date >= (SELECT max(prediction_date) FROM fraud_predictions) - INTERVAL 20 DAY""",
)
def high_risk_extract(spark, folder):
    t = tables(spark, folder)
    (predictions,) = frames(spark, folder, "fraud_predictions")
    since = latest(predictions, "prediction_date") - F.make_dt_interval(F.lit(20))
    return rounded(high_risk(predictions, t.tx, t.cards, t.people, t.places, t.categories, since), 4, "distance_km")


BASE_ROWS = f"base AS (SELECT * FROM feats WHERE trans_date_trans_time < TIMESTAMP '{SPLIT_AT}')"
CURRENT_ROWS = f"cur AS (SELECT * FROM feats WHERE trans_date_trans_time >= TIMESTAMP '{SPLIT_AT}')"
PCT_BASELINE = f"""{FEATURES}, {BASE_ROWS}, {bins_sql("base", NUMERIC)},
    counted AS ({counts_sql(values_sql("base", NUMERIC), closed=True)}),
    baseline AS (SELECT feature, CAST(bucket AS INT) AS bucket, round(lo, 6) AS lo, round(hi, 6) AS hi,
                        round(n * 100.0 / sum(n) OVER (PARTITION BY feature), 6) AS share,
                        CAST(sum(n) OVER (PARTITION BY feature) AS BIGINT) AS n, k
                 FROM counted)"""


def parts(spark, folder):
    t = tables(spark, folder)
    rows = fraud_features(t.star(t.tx))
    at = F.col("trans_date_trans_time")
    return rows.where(at < timestamp_ntz(SPLIT_AT)), rows.where(at >= timestamp_ntz(SPLIT_AT))


@query("baseline_deciles_pct", f"WITH {PCT_BASELINE} SELECT * EXCLUDE (k) FROM baseline")
def baseline_pct(spark, folder):
    return baseline_deciles_pct(parts(spark, folder)[0], NUMERIC)


CURRENT_COUNTS = f"""{PCT_BASELINE}, {CURRENT_ROWS},
    now AS (SELECT b.feature, b.bucket, count(v.v) AS n FROM baseline b LEFT JOIN ({values_sql("cur", NUMERIC)}) v
            ON v.feature = b.feature AND v.v >= b.lo AND (v.v < b.hi OR (b.bucket = b.k - 1 AND v.v <= b.hi)) GROUP BY ALL),
    shares AS (SELECT *, CAST(sum(n) OVER (PARTITION BY feature) AS BIGINT) AS total FROM now)"""


@query(
    "edge_histogram",
    f"""WITH {CURRENT_COUNTS} SELECT feature, bucket, n, round(n / total, 6) AS share, total FROM shares""",
)
def histogram_query(spark, folder):
    base, current = parts(spark, folder)
    return rounded(edge_histogram(current, baseline_deciles_pct(base, NUMERIC)))


PSI_PCT = f"""{CURRENT_COUNTS},
    pairs AS (SELECT s.feature, total, greatest(b.share, 1e-6) AS b, greatest(s.n * 100.0 / total, 1e-6) AS c
              FROM shares s JOIN baseline b ON s.feature = b.feature AND s.bucket = b.bucket),
    psi AS (SELECT feature, round(abs(sum((c - b) * ln(c / b))), 4) AS psi, max(total) AS n FROM pairs GROUP BY feature)"""


@query("psi_percent", f"WITH {PSI_PCT} SELECT feature, psi, n FROM psi")
def psi_percent_query(spark, folder):
    base, current = parts(spark, folder)
    return rounded(psi_percent(baseline_deciles_pct(base, NUMERIC), current), 4)


@query(
    "drift_report",
    f"""WITH {PSI_PCT} SELECT feature, psi, CASE WHEN psi < 0.10 THEN 'LOW' WHEN psi < 0.25 THEN 'MODERATE' ELSE 'HIGH' END AS band,
        psi >= 0.25 AS critical FROM psi""",
)
def drift_report_query(spark, folder):
    base, current = parts(spark, folder)
    return rounded(drift_report(baseline_deciles_pct(base, NUMERIC), current), 4)


CODES = "SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM base WHERE {c} IS NOT NULL) d"


@query(
    "label_encode",
    f"""WITH {STAR}, base AS (SELECT * FROM star WHERE category <> 'view'),
        c1 AS ({CODES.format(c="category")}), c2 AS ({CODES.format(c="gender")}), c3 AS ({CODES.format(c="job")})
        SELECT id_transaction, CAST(coalesce(c1.code, 0) AS INT) AS category, CAST(coalesce(c2.code, 0) AS INT) AS gender,
               CAST(coalesce(c3.code, 0) AS INT) AS job
        FROM star LEFT JOIN c1 ON category = c1.v LEFT JOIN c2 ON gender = c2.v LEFT JOIN c3 ON job = c3.v""",
)
def label_encode_query(spark, folder):
    """Codes are fitted without one category, which then counts as unseen."""
    t = tables(spark, folder)
    star = t.star(t.tx)
    fitted = label_codes(star.where(F.col("category") != "view"), fraud.CATEGORIES)
    return label_encode(star.select("id_transaction", *fraud.CATEGORIES), fitted)


def _scaled(columns: list[str]) -> str:
    quart = "quantile_cont(CAST({c} AS DOUBLE), {p})"
    fit = ", ".join(
        f"{quart.format(c=c, p=0.5)} AS {c}_m, CASE WHEN {quart.format(c=c, p=0.75)} = {quart.format(c=c, p=0.25)} THEN 1.0 "
        f"ELSE {quart.format(c=c, p=0.75)} - {quart.format(c=c, p=0.25)} END AS {c}_w"
        for c in columns
    )
    use = ", ".join(f"round(({c} - {c}_m) / {c}_w, 6) AS {c}" for c in columns)
    return f"fit AS (SELECT {fit} FROM base) SELECT id_transaction, {use} FROM feats, fit"


@query("robust_scale", f"WITH {FEATURES}, {BASE_ROWS}, {_scaled(['amt', 'city_pop', 'age', 'hour'])}")
def robust_scale_query(spark, folder):
    base, current = parts(spark, folder)
    columns = ["amt", "city_pop", "age", "hour"]
    fitted = robust_scaler(base, columns)
    return rounded(scale(base.unionByName(current).select("id_transaction", *columns), fitted))


RECORDED = {"first": (SPLIT_AT, 100.0), "second": ("2024-01-25", 90.0)}
RECORDED_FEATURES = ["amt", "merch_lat", "merch_long"]


def threshold_training(rows, limit, champion):
    """Metrics of the rule "amounts from `limit` on are fraud", judged as a trained model is."""
    found = confusion(rows, F.col("is_fraud"), (F.col("amt") >= limit).cast("int"))
    theirs = champion or {"f1_score": None, "recall": None}
    best = {n: F.lit(theirs[n]).cast("double") for n in ("f1_score", "recall")}
    won = fraud_rule(F.col("f1_score"), F.col("recall"), best["f1_score"], best["recall"])
    return found.withColumn("promotion_status", F.when(won, "PROMOTED").otherwise("REJECTED"))


def recorded_folder(spark):
    return f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"


def record_threshold(spark, rows, folder, name, limit):
    held = champion(spark, folder)
    return record_training(
        spark, folder, name,
        lambda: threshold_training(rows, limit, held[1] if held else None),
        lambda: baseline_deciles_pct(rows, RECORDED_FEATURES),
        lambda: dataset_profile(rows, "is_fraud", "trans_date_time"),
    )


def _recorded_sql() -> str:
    parts = []
    for name, (until, limit) in RECORDED.items():
        parts.append(
            f"""SELECT * FROM (WITH part AS (SELECT * FROM fraud_tx WHERE trans_date_time < TIMESTAMP '{until}'), {bins_sql("part", RECORDED_FEATURES)},
                counted AS ({counts_sql(values_sql("part", RECORDED_FEATURES), closed=True)}),
                cells AS (SELECT count(*) FILTER (amt >= {limit} AND is_fraud = 1) AS tp, count(*) FILTER (amt >= {limit}) AS said, count(*) FILTER (is_fraud = 1) AS pos,
                                 count(*) AS total, CAST(min(trans_date_time) AS DATE) AS start_date, CAST(max(trans_date_time) AS DATE) AS end_date FROM part)
                SELECT '{name}' AS id_audit, feature, CAST(bucket AS INT) AS bucket, round(lo, 6) AS lo, round(hi, 6) AS hi,
                       round(n * 100.0 / sum(n) OVER (PARTITION BY feature), 6) AS share, total AS total_samples, pos AS positives, start_date, end_date,
                       CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (said + pos) END AS f1, CASE WHEN pos = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / pos END AS rec
                FROM counted, cells) {name}"""
        )
    best = "(SELECT max({m}) FROM every WHERE id_audit = 'first')"
    won = "(rec >= {r} AND f1 >= {f}) OR (rec - {r} >= CAST(-0.01 AS DOUBLE) AND f1 - {f} > CAST(0.005 AS DOUBLE))".format(r=best.format(m="rec"), f=best.format(m="f1"))
    return f"""WITH every AS ({" UNION ALL ".join(parts)})
        SELECT id_audit, feature, bucket, lo, hi, share, total_samples, positives, start_date, end_date, 'SUCCESS' AS status, id_audit = 'first' OR ({won}) AS promoted FROM every"""


@query("committed_training", _recorded_sql())
def committed_query(spark, folder):
    """Two recorded trainings, the second one repeated; what readers see of all tables, side by side."""
    (tx,) = frames(spark, folder, "fraud_tx")
    root = recorded_folder(spark)
    for name in (*RECORDED, "second"):
        until, limit = RECORDED[name]
        record_threshold(spark, tx.where(F.col("trans_date_time") < timestamp_ntz(until)), root, name, limit)
    baselines, datasets = committed(spark, root, "baselines"), committed(spark, root, "datasets")
    promoted = committed(spark, root, "promotions").select("id_audit", F.lit(True).alias("promoted"))
    return (
        baselines.select("id_audit", "feature", "bucket", "lo", "hi", "share")
        .join(datasets.select("id_audit", "total_samples", "positives", "start_date", "end_date"), "id_audit")
        .join(trainings(spark, root).select("id_audit", "status"), "id_audit")
        .join(promoted, "id_audit", "left")
        .withColumn("promoted", F.coalesce("promoted", F.lit(False)))
    )


@query(
    "fraud_drift_job",
    f"""WITH {PSI_PCT} SELECT feature, psi, CASE WHEN psi < 0.10 THEN 'LOW' WHEN psi < 0.25 THEN 'MODERATE' ELSE 'HIGH' END AS band,
        psi >= 0.25 AS critical, '{SPLIT_AT}' AS period_start, '2100-01-01' AS period_end FROM psi""",
)
def drift_job_query(spark, folder):
    """A training leaves its baseline in the registry; the drift job finds it there and appends its rows."""
    t, root = tables(spark, folder), recorded_folder(spark)
    base = t.tx.where(F.col("trans_date_time") < timestamp_ntz(SPLIT_AT))
    result = literal_rows(spark, [(0.5, 0.5, "PROMOTED")], "f1_score double, recall double, promotion_status string")
    record_training(spark, root, "base", lambda: result, lambda: baseline_deciles_pct(fraud_features(t.star(base)), NUMERIC))
    return rounded(fraud.drift_and_record(t, root, SPLIT_AT, "2100-01-01"), 4)
