"""Train, compare and store the failure classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultlens.functions.constants import DROPPED_BY_MODEL, FEATURES
from faultlens.operators import classify, evaluation
from faultlens.operators.confound import without
from faultlens.operators.splits import split_by_key
from faultlens.session import materialize

EXPORTED_MODEL = "C"


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).fillna(0, subset=FEATURES)


def train(spark: SparkSession, features: str, model_path: str, predictions_path: str) -> dict[str, DataFrame]:
    """Fit all classifiers on the stored features and keep the production one.

    The production model is the random forest on the features that describe
    behaviour rather than the workload. Every model is fitted once; returns
    the comparison tables, which read its stored scored rows.
    """
    rows = load_features(spark, features)
    train_rows, test_rows = split_by_key(rows)
    columns = without(DROPPED_BY_MODEL[EXPORTED_MODEL])
    model = classify.fit(train_rows, "random_forest", columns)
    classify.save(model, classify.score(model, test_rows), model_path, predictions_path)
    scored = classify.score_all(train_rows, test_rows, classify.classifier_models())
    reduced = classify.score_all(train_rows, test_rows, classify.ablation_models())
    validated = materialize(classify.cross_validate(rows, classify.ablation_models()), "validated")
    return {
        "comparison": classify.compare_models(scored),
        "confusion": evaluation.confusion_matrix(scored, "model"),
        "class_accuracy": evaluation.per_class_accuracy(scored, "model"),
        "ablation": classify.ablation(reduced, validated),
        "mistakes": classify.mistakes(reduced),
        "cross_validation": validated,
        "overfitting": classify.overfitting(validated, evaluation.classification_metrics(reduced, "model")),
        "importance": classify.feature_importance(model, spark, columns),
    }
