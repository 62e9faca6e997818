import random
import threading

import pytest
from pyspark.ml.classification import RandomForestClassifier

from faultlens.functions.constants import FEATURES
from faultlens.operators import classify
from faultlens.session import materialize


@pytest.fixture(scope="module")
def rows(spark):
    dice = random.Random(7)
    made = [(f"app_{k}", k % 4, *[dice.gauss(k % 4, 2.0) for _ in FEATURES]) for k in range(400)]
    return materialize(spark.createDataFrame(made, "app_id STRING, label INT, " + ", ".join(f"{f} DOUBLE" for f in FEATURES)).coalesce(2), "rows")


def test_rows_keep_their_nodes_and_trees_stay_the_same(rows):
    forest = classify.fit(rows).stages[-1]
    assert forest.getOrDefault("cacheNodeIds")
    prepared = classify.pipeline("decision_tree").fit(rows)
    plain = RandomForestClassifier(numTrees=100, maxDepth=10, maxBins=32, seed=42).fit(prepared.stages[1].transform(prepared.stages[0].transform(rows)))
    text = lambda model: model.toDebugString.partition("\n")[2]  # the first line names the model
    assert len(text(plain)) > 10_000 and text(forest) == text(plain)


def test_every_core_has_an_equal_share(spark, monkeypatch):
    monkeypatch.setattr(classify, "TASK_ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    for count in (200, 1_000):
        table = materialize(spark.range(count).selectExpr("concat('app_', id) AS app_id").coalesce(1), "rows")
        spread = classify.dealt(table)
        assert spread.rdd.getNumPartitions() == cores and spread.count() == count


def test_large_tables_are_fitted_one_by_one(rows, monkeypatch):
    inside, most, lock = [0], [0], threading.Lock()
    meet = threading.Barrier(2)

    def fit(*_):
        with lock:
            inside[0] += 1
            most[0] = max(most[0], inside[0])
        try:
            meet.wait(2 if wait else 0)
        except threading.BrokenBarrierError:
            pass
        with lock:
            inside[0] -= 1
        return "model"

    monkeypatch.setattr(classify, "fit", fit)
    models = [("random_forest", FEATURES)] * 4
    wait = True
    assert classify.fit_all([rows] * 4, models, 400) == ["model"] * 4 and most[0] > 1
    wait, most[0] = False, 0
    assert classify.fit_all([rows] * 4, models, classify.FIT_ROWS + 1) == ["model"] * 4 and most[0] == 1
