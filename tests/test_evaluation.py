import random

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator

from faultlens.operators import classify, evaluation
from faultlens.operators.splits import random_split, split_by_key
from faultlens.plans import registry
from faultlens.plans.train import train

CASES = {
    "mixed": [(lambda r: (r.randrange(7), r.randrange(7)))(random.Random(i)) for i in range(200)],
    "never_predicted": [(0, 1), (1, 1), (2, 1)],
    "unknown_class_predicted": [(0, 5), (0, 0), (3, 3)],
    "all_wrong": [(0, 1), (1, 0)],
}


@pytest.mark.parametrize("case", CASES)
def test_metrics_match_spark_ml(spark, case):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in CASES[case]], "label DOUBLE, prediction DOUBLE")
    got = evaluation.classification_metrics(df).first()
    names = {"accuracy": "accuracy", "f1": "f1", "precision": "weightedPrecision", "recall": "weightedRecall"}
    for ours, theirs in names.items():
        want = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName=theirs)
        assert got[ours] == pytest.approx(want.evaluate(df)), ours


def test_confusion_matrix_has_every_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (0, 2), (6, 6)], "label INT, prediction INT")
    rows = sorted(evaluation.confusion_matrix(df).collect())
    assert [list(r) for r in rows] == [
        [0, 1, 0, 2, 0, 0, 0, 0],
        *[[c] + [0] * 7 for c in range(1, 6)],
        [6, 0, 0, 0, 0, 0, 0, 1],
    ]
    classes = {r.label: (r.correct, r.total, r.passed) for r in evaluation.per_class_accuracy(df).collect()}
    assert classes == {0: (1, 3, False), 6: (1, 1, True)}


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("concat('app_', id) AS app_id")
    a, b = split_by_key(df)
    c, _ = split_by_key(df.repartition(7))
    assert sorted(a.collect()) == sorted(c.collect())
    assert a.count() + b.count() == 1000 and 750 < a.count() < 850
    left, right = random_split(df)
    assert left.count() + right.count() == 1000


def test_training_stores_model_and_predictions(spark, data, tmp_path):
    features = registry._features(spark, data)
    features.write.parquet(f"{tmp_path}/features")
    tables = train(spark, f"{tmp_path}/features", f"{tmp_path}/model", f"{tmp_path}/predictions")
    stored = spark.read.parquet(f"{tmp_path}/predictions")
    assert stored.columns == classify.SCORED and stored.count() > 0
    assert {r.model for r in tables["comparison"].collect()} == set(classify.CLASSIFIERS)
    ablation = {r.model: r for r in tables["ablation"].collect()}
    assert {m: r.feature_count for m, r in ablation.items()} == {"A": 25, "B": 23, "C": 22, "D": 18}
    assert ablation["A"].f1_change == 0.0
    ranked = sorted(tables["importance"].collect(), key=lambda r: r["rank"])
    assert len(ranked) == 22 and ranked[-1].cumulative_share == pytest.approx(1.0)
    wrong = tables["mistakes"].collect()
    assert all(r.label != r.prediction for r in wrong)
    tested = stored.count()
    for model, row in ablation.items():
        assert row.accuracy == pytest.approx(1 - sum(r.model == model for r in wrong) / tested)
    folds = {r.model: r for r in tables["cross_validation"].collect()}
    assert set(folds) == set(ablation) and all(r.folds == 5 and 0 <= r.f1 <= 1 for r in folds.values())
    assert all(ablation[m].cv_f1 == pytest.approx(folds[m].f1) for m in folds)
    for r in tables["overfitting"].collect():
        assert r.overfitted == (r.cv_f1 < r.test_f1)
    for kind in classify.CLASSIFIERS:
        matrix = [r for r in tables["confusion"].collect() if r.model == kind]
        assert len(matrix) == 7 and sum(r[f"predicted_{c}"] for r in matrix for c in range(7)) == tested
        right = sum(r.correct for r in tables["class_accuracy"].collect() if r.model == kind)
        assert right == sum(r[f"predicted_{r.label}"] for r in matrix)


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    """Twenty fits overlap, and give what they give one by one."""
    import random
    import time

    from faultlens.functions.constants import FEATURES
    from faultlens.operators import classify

    dice = random.Random(5)
    rows = [(f"app_{k}", k % 3, *[dice.gauss(k % 3, 1.0) for _ in FEATURES]) for k in range(90)]
    df = spark.createDataFrame(rows, "app_id STRING, label INT, " + ", ".join(f"{f} DOUBLE" for f in FEATURES))
    spans, real = [], classify.fit

    def timed(*args):
        begun = time.time()
        model = real(*args)
        spans.append((begun, time.time()))
        return model

    monkeypatch.setattr(classify, "fit", timed)
    models = {str(n): ("decision_tree", FEATURES[: 5 + n]) for n in range(4)}
    together = sorted(classify.cross_validate(df, models).collect())
    assert len(spans) == 20 and sum(a[0] < b[0] < a[1] for a in spans for b in spans) >= 15
    spans.clear()
    monkeypatch.setattr(classify, "FITS", 1)
    monkeypatch.setattr(classify, "side_by_side", lambda jobs: [job() for job in jobs])
    assert sorted(classify.cross_validate(df, models).collect()) == together
    assert not any(a[0] < b[0] < a[1] for a in spans for b in spans)
