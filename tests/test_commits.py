"""Commits over several tables: what readers see while writers die, repeat and fail."""

from datetime import datetime

import pytest

from riskloom.functions.rows import literal_rows
from riskloom.jobs import records
from riskloom.sources.commits import Commit, commits, committed

AT = datetime(2024, 1, 1)


class Killed(BaseException):
    """As when the driver is lost: no handler of the training runs."""


def values(spark, root, table, column):
    found = committed(spark, root, table)
    return None if found is None else sorted(r[column] for r in found.collect())


def test_tables_become_visible_together(spark, tmp_path):
    root = str(tmp_path)
    assert commits(spark, root) is None and committed(spark, root, "a") is None
    one = Commit(spark, root, "2024-01-01")
    one.add("a", spark.range(2))
    one.add("b", spark.range(3))
    assert committed(spark, root, "a") is None and not one.there()
    one.publish(AT)
    assert one.there() and values(spark, root, "a", "id") == [0, 1] and values(spark, root, "b", "id") == [0, 1, 2]
    torn = Commit(spark, root, "7")
    torn.add("a", spark.range(10, 12))
    assert values(spark, root, "a", "id") == [0, 1]
    again = Commit(spark, root, "7")
    again.add("a", spark.range(20, 21))
    again.publish(AT)
    again.publish(AT)
    assert values(spark, root, "a", "id") == [0, 1, 20] and values(spark, root, "b", "id") == [0, 1, 2]
    assert committed(spark, root, "c") is None and commits(spark, root).count() == 2
    with pytest.raises(ValueError, match="named by"):
        Commit(spark, root, "a/b")


def test_reading_prunes_unseen_partitions(spark, tmp_path):
    root = str(tmp_path)
    for name in "abc":
        commit = Commit(spark, root, name)
        commit.add("t", spark.range(5))
        if name != "b":
            commit.publish(AT)
    plan = committed(spark, root, "t")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def result(spark, status="PROMOTED"):
    return literal_rows(spark, [(0.9, 0.8, status)], "f1_score double, recall double, promotion_status string")


@pytest.mark.parametrize("dies_in", ["baseline", "dataset", "publish"])
def test_a_killed_training_leaves_nothing_and_may_be_repeated(spark, tmp_path, monkeypatch, dies_in):
    root, runs = str(tmp_path), []

    def train(fails):
        def part(name, n):
            def make():
                if fails and dies_in == name:
                    raise Killed
                return spark.range(n)

            return make

        def job():
            runs.append(fails)
            return result(spark)

        return records.record_training(spark, root, "t1", job, part("baseline", 3), part("dataset", 1))

    with monkeypatch.context() as patch:
        if dies_in == "publish":
            publish = Commit.publish
            patch.setattr(Commit, "publish", lambda self, at: (_ for _ in ()).throw(Killed) if self.name == "t1" else publish(self, at))
        with pytest.raises(Killed):
            train(True)
    assert all(committed(spark, root, t) is None for t in ("baselines", "datasets", "promotions"))
    assert records.champion(spark, root) is None
    assert [r["status"] for r in records.trainings(spark, root).collect()] == ["PENDING"]
    for _ in range(2):  # repeated, and repeated again after it has succeeded
        assert train(False).first()["f1_score"] == 0.9
    assert runs == [True, False]
    assert values(spark, root, "baselines", "id") == [0, 1, 2] and values(spark, root, "datasets", "id") == [0]
    assert records.champion(spark, root)[0] == "t1" and committed(spark, root, "promotions").count() == 1
    assert [r["status"] for r in records.trainings(spark, root).collect()] == ["SUCCESS"]


def test_a_failed_training_is_told_and_may_succeed_later(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ZeroDivisionError):
        records.record_training(spark, root, "t1", lambda: result(spark, "REJECTED"), lambda: 1 / 0)
    assert [(r["status"], r["error_message"]) for r in records.trainings(spark, root).collect()] == [("ERROR", "division by zero")]
    records.record_training(spark, root, "t1", lambda: result(spark, "REJECTED"), lambda: spark.range(1))
    assert [r["status"] for r in records.trainings(spark, root).collect()] == ["SUCCESS"]
    assert committed(spark, root, "promotions") is None and records.champion_table(spark, root, "baselines") is None
