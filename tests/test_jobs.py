"""Whole jobs and learners on the smallest tables."""

import pytest

from riskloom.catalog import QUERIES, SQL
from riskloom.catalog import atm as atm_queries
from riskloom.catalog.base import frames
from riskloom.jobs import atm
from riskloom.operators.models import DELINQUENCY_SPACE, booster_params, param_search
from riskloom.streaming.batches import empty_status


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"atm_train"}))
def test_runs(spark, folder, name):
    found = QUERIES[name](spark, folder)
    rows = found.collect()
    assert rows and len(set(found.columns)) == len(found.columns)
    for column in ("score", "probability"):
        if column in found.columns:
            assert all(0.0 <= r[column] <= 1.0 for r in rows)


def test_sync_writes_what_it_reports(spark, folder, tmp_path):
    tx, state = frames(spark, folder, "atm_tx", "atm_state")
    known = tx.where("id_sync < 40")
    done = atm.sync(tx.where("id_sync = 40").drop("id_sync", "id_weather"), known, empty_status(state), 40, atm_queries.RELOAD, folder=str(tmp_path))
    summary = done.summary.first()
    stored = spark.read.parquet(f"{tmp_path}/daily_atm_transactions")
    assert stored.count() == summary["records_inserted"]
    first = known.agg({"id_transaction": "max"}).first()[0] + 1
    assert sorted(r["id_transaction"] for r in stored.collect()) == list(range(first, first + summary["records_inserted"]))
    weather = stored.groupBy("transaction_date").agg({"id_weather": "max"}).count()
    assert stored.select("transaction_date", "id_weather").distinct().count() == weather


def test_batches_that_share_days(spark, tmp_path):
    """Totals are those of all stored rows, ids are never given twice, and repeating a batch changes nothing."""
    import datetime

    from riskloom.sources.sinks import read_snapshot

    one, two = datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)
    schema = "id_transaction long, id_atm long, transaction_date date, transaction_type string, amount double"
    batches = [
        [(1, 1, one, "WITHDRAWAL", 10.0), (2, 2, one, "WITHDRAWAL", 7.0)],
        [(1, 1, one, "WITHDRAWAL", 5.0), (2, 1, two, "DEPOSIT", 3.0)],
        [(1, 2, None, "WITHDRAWAL", 1.0), (2, 2, two, "WITHDRAWAL", 2.0)],
    ]
    none = spark.createDataFrame([], schema)
    state = empty_status(spark.createDataFrame([(1, 100.0), (2, 50.0)], "id_atm long, current_balance double"))
    root = str(tmp_path)
    for number, batch in enumerate(batches, start=1):
        for _ in range(2):
            done = atm.sync(spark.createDataFrame(batch, schema), none, state, number, folder=root)
            assert done.summary.first()["records_inserted"] == 2
        state = read_snapshot(spark, f"{root}/atm_current_status")
    rows = spark.read.parquet(f"{root}/daily_atm_transactions").collect()
    assert sorted(r["id_transaction"] for r in rows) == [1, 2, 3, 4, 5, 6] and "new_id" not in rows[0]
    totals = {(r["id_atm"], r["transaction_date"]): (r["withdrawn"], r["deposited"], r["movements"]) for r in spark.read.parquet(f"{root}/historical_daily_atm").collect()}
    assert totals == {(1, one): (15.0, 0.0, 2), (2, one): (7.0, 0.0, 1), (1, two): (0.0, 3.0, 1), (2, two): (2.0, 0.0, 1), (2, None): (1.0, 0.0, 1)}
    assert {r["id_atm"]: r["current_balance"] for r in state.collect()} == {1: 88.0, 2: 40.0}


def test_every_searched_parameter_counts(spark):
    from pyspark.ml.linalg import Vectors

    from riskloom.operators.models import asymmetric_boosting

    rows = [(i, float(i % 37), float(i * 7 % 11), float((i % 37) ** 2 + i * 7 % 11 + i % 3), i % 5 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, held boolean")

    def fit(validation=None, rounds=2, **params):
        trees, predict = asymmetric_boosting(df, ["a", "b"], "y", rounds, 0.5, 4, params=params, validation=validation)
        return trees, [r["prediction"] for r in predict(df).orderBy("id").collect()]

    trees, plain = fit()
    for i in (0, 99, 598):  # one model gives what the trees give one by one
        assert plain[i] == pytest.approx(0.5 + 0.5 * sum(t.predict(Vectors.dense(rows[i][1:3])) for t in trees))
    for more in ({"min_child_weight": 90}, {"subsample": 0.5}, {"colsample_bytree": 0.5}, {"gamma": 0.5}):
        assert fit(**more)[1] != plain, more
    assert fit("held")[1] != plain


def test_every_row_is_scored(spark):
    from riskloom.operators.models import batch_score, fit_booster, fit_regressor

    rows = [(i, float(i % 10) if i % 5 else None, float("nan") if i % 7 == 0 else float(i % 3), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    for model in (fit_booster(df, ["a", "b"], "y", {"n_estimators": 2}), fit_regressor(df, ["a", "b"], "y", {"n_estimators": 2})):
        scored = batch_score(model, df)
        assert scored.columns == [*df.columns, "score"]
        assert scored.where("score IS NOT NULL").count() == 100


def test_search_is_repeatable():
    def objective(p):
        return p["learning_rate"]

    first = param_search(DELINQUENCY_SPACE, objective, 5, seed=3)
    assert [p for _, p, _ in first] == [p for _, p, _ in param_search(DELINQUENCY_SPACE, objective, 5, seed=3)]
    for _, p, v in first:
        assert 0.01 <= p["learning_rate"] <= 0.3 and 3 <= p["max_depth"] <= 8 and v == p["learning_rate"]
        assert booster_params(p)["minInstancesPerNode"] == p["min_child_weight"]


def test_training_records(spark, tmp_path):
    from datetime import datetime

    from riskloom.functions.rows import literal_rows
    from riskloom.jobs.records import log_failure, log_result, log_start, trainings

    root, t = str(tmp_path), datetime
    for name in ("a", "b", "c"):
        log_start(spark, root, name, t(2024, 1, 1))
    log_result(literal_rows(spark, [(0.9,)], "auc double"), root, "a", t(2024, 1, 1, 0, 5))
    log_failure(spark, root, "b", t(2024, 1, 1, 0, 1), "no data")
    seen = {r["id_audit"]: (r["status"], r["training_duration_seconds"], r["error_message"]) for r in trainings(spark, root).collect()}
    assert seen == {"a": ("SUCCESS", 300, None), "b": ("ERROR", 60, "no data"), "c": ("PENDING", None, None)}


def test_a_recorded_training_can_be_monitored(spark, folder, tmp_path):
    """Training leaves baseline, data record and promotion; the next one meets the champion, and drift finds its baseline."""
    from riskloom.catalog import fraud as fraud_queries
    from riskloom.catalog import models as m
    from riskloom.jobs import fraud
    from riskloom.jobs.records import champion, champion_table, record_training, trainings

    root, tables = str(tmp_path), fraud_queries.tables(spark, folder)
    assert champion(spark, root) is None
    with pytest.raises(ValueError, match="no model"):
        fraud.drift_and_record(tables, root, m.END, m.END)
    settings = {"trials": 1, "space": {**m.SMALL_SPACE, "scale_pos_weight": ("float", 15, 35)}, "ratio": 2}
    first = fraud.train_and_record(tables, m.END, root, "first", **settings).first()
    assert first["promotion_status"] == "PROMOTED" and first["champion_f1"] is None
    name, result = champion(spark, root)
    assert (name, result["f1_score"]) == ("first", first["f1_score"])
    second = fraud.train_and_record(tables, m.END, root, "second", **settings).first()
    assert second["champion_f1"] == first["f1_score"]
    with pytest.raises(ZeroDivisionError):
        record_training(spark, root, "third", lambda: 1 / 0)
    assert {r["id_audit"]: r["status"] for r in trainings(spark, root).collect()} == {"first": "SUCCESS", "second": "SUCCESS", "third": "ERROR"}
    assert champion_table(spark, root, "datasets").first()["total_samples"] > 0
    found = fraud.drift_and_record(tables, root, "2024-01-01", m.END)
    assert {r["feature"] for r in found.collect()} == set(fraud.SCALED)
    assert spark.read.parquet(f"{root}/feature_drift").count() == len(fraud.SCALED)


def test_champion_is_scored_on_the_same_rows(spark, folder, tmp_path):
    from riskloom.catalog import models as m
    from riskloom.jobs import delinquency

    def train(**more):
        return delinquency.train(
            m.delinquency_rows(spark, folder), m.DELINQUENCY_FEATURES, m.LABEL, "sample_weight", "id_row",
            trials=2, spaces=(m.SMALL_SPACE, m.SMALL_LEAF_SPACE), forest_trees=3, **more,
        ).first()

    first = train(save_to=str(tmp_path))
    assert first["champion_auc"] is None and first["deployment_status"] == "NEW_CHAMPION"
    second = train(champion_folder=str(tmp_path))
    assert second["champion_auc"] == pytest.approx(first["auc_roc"], abs=1e-4)
    assert second["deployment_status"] == "KEEP_CHAMPION"


def test_churn_monitor_records_real_verdicts_only(spark, folder, tmp_path):
    from riskloom.functions.dates import timestamp_ntz
    from riskloom.jobs import churn

    predictions, accounts = frames(spark, folder, "churn_predictions", "churn_accounts")
    churn.monitor(predictions, accounts, timestamp_ntz("1990-01-01"), folder=str(tmp_path))
    churn.monitor(predictions, accounts, timestamp_ntz("2024-01-26"), folder=str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/churn_training_history").collect()
    assert [r["status"] for r in rows] in (["healthy"], ["degraded"])


def test_every_domain_records_its_trainings(spark, folder, tmp_path):
    """Champions are found in the registry, their models are scored, and baselines and data records are kept."""
    from riskloom.catalog import churn as churn_queries
    from riskloom.catalog import models as m
    from riskloom.jobs import churn, delinquency
    from riskloom.jobs.records import champion, champion_table
    from riskloom.sources.commits import committed

    roots = {n: f"{tmp_path}/{n}" for n in ("atm", "churn", "delinquency")}
    space = {**m.SMALL_SPACE, "n_estimators": ("int", 2, 3)}
    for name in ("one", "two"):
        found = atm.train_and_record(m.atm_rows(spark, folder), roots["atm"], name, trials=1, space=space, folds=2).first()
    assert found["champion_mape"] == pytest.approx(found["mape"]) and found["deployment_status"] == "KEEP_CHAMPION"
    assert sum(__import__("json").loads(found["feature_importance"]).values()) == pytest.approx(100, abs=0.1)
    assert found["lower_bound"] < found["upper_bound"]
    assert {r["feature"] for r in champion_table(spark, roots["atm"], "baselines").collect()} == set(atm.MONITORED)
    for name in ("one", "two"):
        found = churn.train_and_record(churn_queries.extract(spark, folder), roots["churn"], name, trials=1, space=m.SMALL_SPACE, vocabulary=churn_queries.VOCABULARY).first()
    assert found["champion_f1"] == found["f1_score"] and found["promotion_status"] == "REJECTED"
    assert champion_table(spark, roots["churn"], "datasets").first()["start_date"] is None
    rows = m.delinquency_rows(spark, folder)
    for name in ("one", "two"):
        found = delinquency.train_and_record(
            rows, m.DELINQUENCY_FEATURES, m.LABEL, "sample_weight", "id_row", "monthly_period", roots["delinquency"], name, ["pay_0", "pay_2", "pay_3"],
            trials=2, spaces=(m.SMALL_SPACE, m.SMALL_LEAF_SPACE), forest_trees=3,
        ).first()
    assert found["champion_auc"] == pytest.approx(found["auc_roc"], abs=1e-4)
    assert champion(spark, roots["delinquency"])[0] == "one"
    assert {r["type"] for r in champion_table(spark, roots["delinquency"], "baselines").collect()} == {"categorical", "continuous"}
    assert champion_table(spark, roots["delinquency"], "columns").where("rol = 'TARGET'").count() == 1
    assert committed(spark, roots["delinquency"], "datasets").where("dataset_start IS NOT NULL").count() == 2


@pytest.fixture(scope="module")
def gappy(spark):
    """`y` follows from which rows lack `a`; `b` is noise, `c` has no value at all."""
    rows = [(i, None if i % 3 == 0 else float(i * 7919 % 1000), float(i * 31 % 17) if i % 5 else float("nan"), None, int(i % 3 == 0), 100.0 if i % 3 == 0 else 5.0) for i in range(600)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, amount double")


def test_missing_values_are_a_branch(spark, gappy, tmp_path):
    from riskloom.operators.models import asymmetric_boosting, batch_score, feature_importance, fit_booster, fit_forest, fit_regressor, load_and_score, save_model

    names, few = ["a", "b", "c"], {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.5}
    for model in (fit_booster(gappy, names, "y", few), fit_forest(gappy, names, "y", 5, 3)):
        scored = batch_score(model, gappy)
        assert scored.columns == [*gappy.columns, "score"]
        assert all((r["score"] > 0.5) == (r["y"] == 1) for r in scored.collect())
        shares = {r["feature"]: r["porcentaje"] for r in feature_importance(model, names, gappy).collect()}
        assert shares["a"] > 80 and "c" not in shares
    model = fit_regressor(gappy, names, "amount", few)
    assert all((r["score"] > 3) == (r["y"] == 1) for r in batch_score(model, gappy).collect())
    _, predict = asymmetric_boosting(gappy, names, "amount", 4, 0.5, 2)
    assert all((r["prediction"] > 2.5) == (r["y"] == 1) for r in predict(gappy).collect())
    save_model(model, str(tmp_path / "m"))
    stored = {r["id"]: r["score"] for r in load_and_score(str(tmp_path / "m"), gappy).collect()}
    assert stored == {r["id"]: r["score"] for r in batch_score(model, gappy).collect()}


def test_side_of_a_split_is_learnt(spark):
    """Missing rows behave like those with large values in one frame, like those with small values in the other."""
    from riskloom.operators.models import batch_score, fit_booster

    for like_large in (True, False):
        rows = [(float(i % 10), int(i % 10 >= 5)) for i in range(400)] + [(None, int(like_large))] * 200
        df = spark.createDataFrame(rows, "a double, y int")
        stump = fit_booster(df, ["a"], "y", {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0})
        assert all((r["score"] > 0.5) == (r["y"] == 1) for r in batch_score(stump, df).collect())
        assert batch_score(stump, spark.createDataFrame([(None,), (2.0,)], "a double")).count() == 2


@pytest.mark.parametrize("maximise", [True, False])
def test_halving_ends_with_trials_that_have_had_all_rounds(maximise):
    """The best trial is among those judged last, few rounds are spent, and small searches are plain ones."""
    from riskloom.operators.models import best_trial, halving_search

    space, spent = {"n_estimators": ("int", 100, 400), "learning_rate": ("float", 0.0, 1.0)}, []

    def objective(p):
        spent.append(p["n_estimators"])
        value = p["learning_rate"] - 1.0 / p["n_estimators"]
        return value if maximise else -value

    found = halving_search(space, objective, 30, maximise=maximise, parallelism=1)
    assert [r[0] for r in found] == list(range(30)) and spent[:30] == [10] * 30
    number, params, value = best_trial(found, maximise)
    assert params["learning_rate"] == max(r[1]["learning_rate"] for r in found)
    assert found[number][3] == params["n_estimators"] and spent[-1] == params["n_estimators"]
    assert sum(spent) < 0.25 * sum(r[1]["n_estimators"] for r in found)
    small = {"n_estimators": ("int", 2, 9), "learning_rate": ("float", 0.0, 1.0)}
    plain = param_search(small, objective, 7)
    halved = halving_search(small, objective, 7, maximise=maximise)
    assert [r[:3] for r in halved] == plain and all(r[3] == r[1]["n_estimators"] for r in halved)
    (only,) = halving_search(space, objective, 1, maximise=maximise)
    assert only[3] == only[1]["n_estimators"]


def test_modelling_rows_are_made_once(spark, folder):
    """Learners read them in every round, so they hang on no scan of the line items; they are those of the plain joins."""
    from riskloom.catalog import models as m
    from riskloom.sources.standins import stand_in

    rows = m.atm_rows(spark, folder)
    assert rows.inputFiles() == []
    plain = atm.training_rows(*(stand_in(spark, folder, n) for n in ("atm_tx", "atms", "weathers")))
    assert rows.columns == plain.columns and sorted(rows.collect()) == sorted(plain.collect())


def test_boosting_writes_nothing_after_its_last_round(spark, monkeypatch):
    from riskloom.operators import models

    written = []
    monkeypatch.setattr(models, "cut_lineage", lambda df: written.append(df.columns) or df)
    rows = spark.range(400).selectExpr("id", "CAST(id % 20 AS DOUBLE) AS x", "CAST(id % 20 * 3 + id % 7 AS DOUBLE) AS y", "id % 5 = 0 AS held", "'long text' AS other")
    trees, predict = models.asymmetric_boosting(rows, ["x"], "y", rounds=3)
    assert (written, len(trees), predict(rows).count()) == ([], 3, 400)
    models.asymmetric_boosting(rows, ["x"], "y", rounds=2, validation="held")
    assert [sorted(c) for c in written] == [["__f", "__y", "features", "held"]]


def test_trees_read_few_partitions(spark):
    """A stored frame of many small partitions is joined for the learner, with the rows it had; a frame of few stays as it is."""
    from pyspark.sql import functions as F

    from riskloom.operators.models import PARTS_PER_CORE, fit_booster, fit_forest, fit_regressor, in_few_parts

    context = spark.sparkContext
    most = PARTS_PER_CORE * context.defaultParallelism
    rows = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    many = rows.repartition(3 * most, "id").persist()
    few = in_few_parts(many)
    assert few.rdd.getNumPartitions() == most
    assert sorted(few.collect()) == sorted(rows.collect())
    assert in_few_parts(many, part_rows=400 // (2 * most)).rdd.getNumPartitions() >= 2 * most
    own = rows.repartition(most)
    assert in_few_parts(own) is own
    settings = {"n_estimators": 1, "max_depth": 2}
    for k, fit in enumerate((lambda: fit_booster(many, ["a"], "y", settings), lambda: fit_regressor(many, ["a"], "y", settings), lambda: fit_forest(many, ["a"], "y", 2, 2))):
        context.setJobGroup(f"fit-{k}", "trees")
        fit()
        tracker = context.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(f"fit-{k}") for s in tracker.getJobInfo(j).stageIds]
        tasks = [s.numTasks for s in stages if s and "RandomForest" in s.name]
        assert tasks and max(tasks) <= most
    context.setLocalProperty("spark.jobGroup.id", None)
    many.unpersist()


def test_rows_with_a_repeated_id_meet_all_its_weathers(spark):
    """Weather is looked up before the features are made; what comes out is the plain join after them."""
    import datetime

    from pyspark.sql import functions as F

    from riskloom.operators.atm_series import atm_features

    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    rows = [(i // 2 if i < 30 else None if i % 9 == 0 else i, i % 2, day(i), "DEPOSIT" if i % 11 == 0 else "WITHDRAWAL", float(i * 37 % 100), None if i % 7 == 0 else i % 3) for i in range(120)]
    tx = spark.createDataFrame(rows, "id_transaction long, id_atm long, transaction_date date, transaction_type string, amount double, id_weather int")
    atms = spark.createDataFrame([(0, 1), (1, 2)], "id_atm long, id_location_type int")
    weathers = spark.createDataFrame([(0, 5), (1, 6), (1, 7)], "id_weather int, impact int")
    known = atm_features(tx.where("transaction_type = 'WITHDRAWAL'").select("id_transaction", "id_atm", "transaction_date", "amount"))
    plain = known.join(tx.select("id_transaction", "id_weather"), "id_transaction").join(weathers, "id_weather").groupBy("id_transaction", "id_atm", "lag_11", F.col("impact").alias("ambiente")).count()
    found = atm.training_rows(tx, atms, weathers)
    assert found.groupBy("id_transaction").count().where("count > 1").count() > 0
    assert sorted(found.groupBy("id_transaction", "id_atm", "lag_11", "ambiente").count().collect()) == sorted(plain.collect())


def test_training_leaves_only_what_may_still_be_read(spark, tmp_path):
    """Stored rows of earlier rounds go as learning does, and those of the job with its end: the disk does not follow the rounds."""
    import os

    from riskloom import session
    from riskloom.operators import models

    def files(root):
        return {os.path.join(at, f) for at, _, fs in os.walk(root) for f in fs if f.startswith("part-")}

    root = session.shared_folder(spark)
    tx = spark.range(900).selectExpr(
        "id AS id_transaction", "id % 3 AS id_atm", "date_add(DATE '2024-01-01', CAST(id / 3 AS INT)) AS transaction_date", "CAST(id % 17 * 10 + 5 AS DOUBLE) AS retiro",
        *[f"CAST(id * {k + 3} % 29 AS DOUBLE) AS {f}" for k, f in enumerate(atm.MODEL_FEATURES)],
    )
    source = f"{tmp_path}/rows"
    tx.write.parquet(source)
    most, kept = [], models.cut_lineage

    def counted(df):
        made = kept(df)
        most.append(len(files(root) - before))
        return made

    before = files(root)
    models.cut_lineage = counted
    try:
        models.asymmetric_boosting(spark.read.parquet(source), atm.MODEL_FEATURES, "retiro", 20, 0.3, 2)
    finally:
        models.cut_lineage = kept
    assert len(most) == 3 and max(most) <= 2 * most[0] and files(root) <= before  # nothing is stored after the last round
    atm.train(spark.read.parquet(source), trials=1, space={"n_estimators": ("int", 6, 6), "learning_rate": ("float", 0.3, 0.3), "max_depth": ("int", 2, 2)}, folds=2)
    assert files(root) <= before and spark.read.parquet(source).count() == 900


def test_atm_training_is_that_of_the_service(spark, folder, monkeypatch):
    """The query gives no smaller search; the job's own defaults are 50 trials over five folds and the service's ranges and patience."""
    import inspect

    from riskloom.catalog import models as m
    from riskloom.operators import models

    given = []
    monkeypatch.setattr(m, "atm_rows", lambda *a, **k: "rows")
    monkeypatch.setattr(m.atm, "train", lambda *a, **k: given.append((a, k)))
    QUERIES["atm_train"](spark, folder)
    monkeypatch.undo()
    assert given == [(("rows",), {})]
    defaults = {n: p.default for n, p in inspect.signature(atm.train).parameters.items()}
    assert (defaults["trials"], defaults["folds"], defaults["space"], defaults["test_days"], defaults["val_days"]) == (50, 5, None, 60, 15)
    assert models.ATM_SPACE["n_estimators"] == ("int", 500, 2500) and (models.SEARCH_PATIENCE, models.FINAL_PATIENCE) == (50, 100)


def test_slow_learning_goes_on_until_patience_ends_it(spark):
    """A round of a slow learner gains less than a hundredth of the error, and still learning goes on; what follows the least error is dropped."""
    from riskloom.operators.models import fit_regressor, least_error, per_row

    assert least_error([3.0, 2.0, 2.5, 1.0, 1.5, 1.4], 2) == (4, True)
    assert least_error([3.0, 2.0, 2.5, 2.1, 1.0], 2) == (2, True)
    assert least_error([3.0, 2.0, 2.5], 2) == (2, False) and least_error([float("nan")] * 3, 5) == (3, False)
    rows = spark.range(600).selectExpr("CAST(id % 40 AS DOUBLE) AS a", "exp(id % 40 / 10.0 + id * 7919 % 13 / 13.0) AS y", "id % 5 = 0 AS held", "false AS none")
    params = {"n_estimators": 30, "learning_rate": 0.01, "max_depth": 2, "min_child_weight": 3, **per_row({"gamma": 2.5}, 480)}
    slow = fit_regressor(rows, ["a"], "y", params, "held").stages[-1]
    assert len(slow.trees) == 30 and slow.trees[0].depth == 2
    quick = fit_regressor(rows, ["a"], "y", {**params, "learning_rate": 1.0, "n_estimators": 40}, "held", patience=3).stages[-1]
    errors = fit_regressor(rows.where("NOT held"), ["a"], "y", {**params, "learning_rate": 1.0, "n_estimators": 40}).stages[-1]
    assert 1 <= len(quick.trees) < len(errors.trees) == 40
    assert [t.toDebugString.split("\n")[1:] for t in quick.trees] == [t.toDebugString.split("\n")[1:] for t in errors.trees[: len(quick.trees)]]
    assert len(fit_regressor(rows, ["a"], "y", {**params, "n_estimators": 3}, "none").stages[-1].trees) == 3


def test_forecast_is_fitted_in_full(spark, folder, monkeypatch):
    """The learner gets the rounds of the service, and its early end is the patience's, not a round's small gain."""
    from riskloom.catalog import models as m
    from riskloom.operators.models import fit_regressor

    given = []

    def fit(rows, features, target, params, *rest):
        given.append((params, rest))
        return fit_regressor(rows, features, target, {**params, "n_estimators": 3}, *rest)

    monkeypatch.setattr(m, "fit_regressor", fit)
    assert QUERIES["gbt_withdrawal_forecast"](spark, folder).count() > 0
    ((params, rest),) = given
    assert (params["n_estimators"], params["max_depth"], rest) == (1500, 7, ("is_val",))
    assert 0.02 < params["learning_rate"] < 0.03 and 0 < params["gamma"] < 0.01
