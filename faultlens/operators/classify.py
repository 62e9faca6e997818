"""Failure classifiers on the application features.

The features are one row per application; fitting and scoring are Spark ML jobs
over that table, and every quality measure is a Spark aggregation over scored
rows. Rows are assigned to folds by a hash of the application id.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.functions.constants import DROPPED_BY_MODEL, FEATURES, LABEL_NAMES
from faultlens.operators.confound import without
from faultlens.operators.evaluation import classification_metrics, confusion_matrix, per_class_accuracy
from faultlens.session import materialize

_T = TypeVar("_T")
#: Models that are fitted at a time. A fit has steps that leave most executors idle; others fill them.
FITS = 4
#: Rows, in all, of the tables that are fitted at a time; a fit keeps about 2 KB of every row in memory.
FIT_ROWS = 1 << 22
#: Rows of a file of a table that is fitted, and files of a core at most, above which Spark's reader no longer gives every core as many.
TASK_ROWS, CORE_FILES = 1 << 14, 8
SCORED = ["app_id", "label", "prediction", "features", "probability"]

# Fixed settings of the three classifiers.
CLASSIFIERS = {
    "logistic_regression": lambda: LogisticRegression(maxIter=100, regParam=0.01, elasticNetParam=0.0, family="multinomial"),
    "decision_tree": lambda: DecisionTreeClassifier(maxDepth=5, maxBins=32, impurity="entropy", seed=42),
    # Rows keep their nodes, so a level of the trees is not searched from the roots again; the trees are the same.
    "random_forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, maxBins=32, seed=42, cacheNodeIds=True, checkpointInterval=-1),
}


def feature_vectors(features: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Add the feature columns as one vector; invalid values stay in it."""
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(features)


def pipeline(kind: str = "random_forest", columns: list[str] = FEATURES) -> Pipeline:
    assembler = VectorAssembler(inputCols=columns, outputCol="raw_features", handleInvalid="keep")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[assembler, scaler, CLASSIFIERS[kind]()])


def fit(train: DataFrame, kind: str = "random_forest", columns: list[str] = FEATURES) -> PipelineModel:
    return pipeline(kind, columns).fit(train)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows``, a stored table, in as many files for every core, so that each has an equal share in a fit; a small table as it is.

    A stored table of one row per application has few files, and a file is read by one task.
    """
    count, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    if count <= TASK_ROWS:
        return rows
    files = cores * min(CORE_FILES, -(-count // (TASK_ROWS * cores)))
    return materialize(rows.repartition(files, "app_id"), "dealt")


def side_by_side(jobs: list[Callable[[], _T]], at_once: int = FITS) -> list[_T]:
    """The results of the jobs, in their order; a few of them run at a time."""
    with ThreadPoolExecutor(max(1, min(at_once, len(jobs)))) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(SparkSession.active())(job)) for job in jobs]]


def fit_all(train: list[DataFrame], models: list[tuple[str, list[str]]], rows: int) -> list[PipelineModel]:
    """A model of each table with ``rows`` rows or less; large ones one by one, since one alone fills cores and memory."""
    jobs = [partial(fit, table, kind, columns) for table, (kind, columns) in zip(train, models, strict=True)]
    at_once = max(1, min(FITS, FIT_ROWS // max(rows, 1)))
    return side_by_side(jobs) if at_once == FITS else side_by_side(jobs, at_once)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select(*SCORED)


def save(model: PipelineModel, scored: DataFrame, model_path: str, predictions_path: str) -> None:
    """Replace the stored model and its scored rows."""
    model.write().overwrite().save(model_path)
    scored.select(*SCORED).write.mode("overwrite").parquet(predictions_path)


def feature_importance(model: PipelineModel, spark, columns: list[str] = FEATURES) -> DataFrame:
    """Features by importance, with rank and cumulative share."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(columns, weights)), "feature STRING, importance DOUBLE")
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("importance"), "feature")  # one row per feature
    return rows.select(
        "feature",
        "importance",
        F.row_number().over(order).alias("rank"),
        F.sum("importance").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_share"),
    )


def fold_of(key: str, folds: int):
    return F.pmod(F.xxhash64(F.lit(42), F.col(key)), F.lit(folds)).cast("int")


def score_all(train: DataFrame, test: DataFrame, models: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Fit every named (classifier, columns) once and store its scored test rows: model, app_id, label, prediction.

    Metrics, matrices and mistakes are all read from this one table.
    """
    fitted = fit_all([train] * len(models), list(models.values()), train.count())
    scored = [
        model.transform(test).select(F.lit(name).alias("model"), "app_id", "label", F.col("prediction").cast("int").alias("prediction"))
        for name, model in zip(models, fitted, strict=True)
    ]
    return materialize(reduce(DataFrame.unionByName, scored), "scored")


def classifier_models(columns: list[str] = FEATURES) -> dict[str, tuple[str, list[str]]]:
    return {kind: (kind, columns) for kind in CLASSIFIERS}


def ablation_models() -> dict[str, tuple[str, list[str]]]:
    """The random forest on shrinking feature sets."""
    return {name: ("random_forest", without(dropped)) for name, dropped in DROPPED_BY_MODEL.items()}


def compare_models(scored: DataFrame) -> DataFrame:
    """Metrics of every model of ``score_all``; ``is_best`` marks the highest F1."""
    best = Window.partitionBy(F.lit(1)).orderBy(F.desc("f1"), "model")  # one row per model
    return classification_metrics(scored, "model").withColumn("is_best", F.row_number().over(best) == 1)


def cross_validate(rows: DataFrame, models: dict[str, tuple[str, list[str]]], folds: int = 5) -> DataFrame:
    """Per model the mean accuracy, precision, recall and F1 over the folds.

    Every row is scored once, by the model that did not see its fold; one
    aggregation over the stored scored rows gives the measures of every fold.
    """
    numbered = materialize(rows.withColumn("fold", fold_of("app_id", folds)), "folds")
    tasks = [(name, kind, columns, fold) for name, (kind, columns) in models.items() for fold in range(folds)]
    parts = [numbered.filter(F.col("fold") != fold) for *_, fold in tasks]
    fitted = fit_all(parts, [(kind, columns) for _, kind, columns, _ in tasks], numbered.count())
    scored = []
    for (name, _, _, fold), model in zip(tasks, fitted, strict=True):
        held_out = model.transform(numbered.filter(F.col("fold") == fold))
        scored.append(held_out.select(F.lit(name).alias("model"), "fold", "label", "prediction"))
    per_fold = classification_metrics(materialize(reduce(DataFrame.unionByName, scored), "scored"), "model", "fold")
    means = [F.avg(m).alias(m) for m in ("accuracy", "f1", "precision", "recall")]
    return per_fold.groupBy("model").agg(F.count(F.lit(1)).alias("folds"), *means)


def overfitting(validated: DataFrame, tested: DataFrame) -> DataFrame:
    """Per model F1 over the folds next to F1 on the test rows; lower over the folds may be over-fitting."""
    return validated.select("model", F.col("f1").alias("cv_f1")).join(
        tested.select("model", F.col("f1").alias("test_f1")), "model"
    ).withColumn("overfitted", F.col("cv_f1") < F.col("test_f1"))


def ablation(scored: DataFrame, validated: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Held-out and cross-validated quality of the models on shrinking feature sets.

    ``f1_change`` is against model A, which has all features. A set supports
    the hypothesis that the dropped features carry no signal of their own if F1
    falls by no more than ``tolerance``. ``confound_percent`` is the part of
    model A's F1 that is lost.
    """
    size = F.create_map(*[F.lit(v) for name, (_, columns) in ablation_models().items() for v in (name, len(columns))])
    whole = F.max(F.when(F.col("model") == "A", F.col("f1"))).over(Window.partitionBy(F.lit(1)))  # four rows
    folds = validated.select("model", F.col("f1").alias("cv_f1"), F.col("accuracy").alias("cv_accuracy"))
    return (
        classification_metrics(scored, "model")
        .withColumn("feature_count", size[F.col("model")])
        .withColumn("f1_change", F.col("f1") - whole)
        .withColumn("supported", F.col("f1_change") >= -tolerance)
        .withColumn("confound_percent", F.when(whole > 0, -F.col("f1_change") / whole * 100))
        .join(folds, "model")
    )


def mistakes(scored: DataFrame) -> DataFrame:
    """Misclassified applications of every model of ``score_all``."""
    return scored.filter(F.col("label") != F.col("prediction")).select("model", "app_id", "label", "prediction")


def vector_values(vectors: DataFrame) -> DataFrame:
    """(app_id, label, position, value): the entries of the feature vectors, positions from 0."""
    entries = F.posexplode(vector_to_array("features")).alias("position", "value")
    return vectors.select("app_id", F.col("label").cast("int").alias("label"), entries)


def prediction_checks(predictions: DataFrame) -> DataFrame:
    """One row: applications scored, classes in range, and probabilities that sum to 1."""
    sums = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x)
    return predictions.agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_distinct("app_id").alias("apps"),
        F.count_if(F.col("prediction").between(0, len(LABEL_NAMES) - 1)).alias("in_range"),
        F.count_if(F.abs(sums - 1) < 1e-9).alias("probabilities_sum_to_one"),
    )


def model_checks(scored: DataFrame) -> DataFrame:
    """One row per model of ``score_all``: applications scored, what its matrix and its class table add up to, and whether they and the accuracy agree."""
    sizes = scored.groupBy("model").agg(F.count(F.lit(1)).alias("scored"), F.count_distinct("app_id").alias("apps"))
    cells = [f"predicted_{c}" for c in LABEL_NAMES]
    diagonal = sum((F.when(F.col("label") == c, F.col(f"predicted_{c}")).otherwise(0) for c in LABEL_NAMES), F.lit(0))
    matrix = confusion_matrix(scored, "model").select("model", sum((F.col(c) for c in cells), F.lit(0)).alias("cells"), diagonal.alias("hits"))
    matrix = matrix.groupBy("model").agg(F.sum("cells").alias("matrix_total"), F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("matrix_rows"))
    classes = per_class_accuracy(scored, "model").groupBy("model").agg(F.sum("correct").alias("correct"), F.sum("total").alias("class_total"))
    overall = classification_metrics(scored, "model").select("model", "accuracy")
    joined = sizes.join(matrix, "model").join(classes, "model").join(overall, "model")
    agree = (F.col("hits") == F.col("correct")) & (F.abs(F.col("accuracy") * F.col("scored") - F.col("hits")) < 1e-6)
    return joined.select("model", "scored", "apps", "matrix_rows", "matrix_total", "class_total", agree.alias("counts_agree"))


def importance_checks(importance: DataFrame) -> DataFrame:
    """One row: features, the sum of their shares, the last cumulative share, and whether ranks follow the shares."""
    later = importance.select((F.col("rank") - 1).alias("rank"), F.col("importance").alias("next"))
    falls = importance.join(later, "rank", "left").agg(F.min(F.coalesce(F.col("importance") >= F.col("next"), F.lit(True))).alias("ranks_follow"))
    sums = importance.agg(
        F.count_distinct("feature").alias("features"),
        F.sum("rank").alias("rank_sum"),
        F.round(F.sum("importance"), 9).alias("share_sum"),
        F.round(F.max("cumulative_share"), 9).alias("last_share"),
    )
    # One row each.
    return sums.join(falls)
