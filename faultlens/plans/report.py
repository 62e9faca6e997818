"""The unified report: root causes next to the predicted failure class."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.columns import label_name, parent_id_array
from faultlens.functions.constants import NOT_AVAILABLE, REPORT_CLASS_NAMES, REPORT_NOTE
from faultlens.sources.tables import parquet_or_empty

_RESULTS = T.StructType([T.StructField(c, T.StringType()) for c in ("app_id", "root_cause_stage_ids", "victim_stages")])
_SCORED = T.StructType(
    [
        T.StructField("app_id", T.StringType()),
        T.StructField("prediction", T.DoubleType()),
        T.StructField("probability", VectorUDT()),
    ]
)


def _ids(text: Column) -> Column:
    """An id list as integers; results of older runs hold a single number."""
    return parent_id_array(text.cast("string"))


def unified_report(results: DataFrame, predictions: DataFrame, app_id: str | None = None) -> DataFrame:
    """One row per application known to either table, with the report as JSON.

    ``probability`` may be an array or an ML vector. With ``app_id`` the filter
    goes to both inputs before the join.
    """
    if app_id is not None:
        results = results.filter(F.col("app_id") == app_id)
        predictions = predictions.filter(F.col("app_id") == app_id)
    roots = "root_cause_stage_ids" if "root_cause_stage_ids" in results.columns else "root_cause_stage_id"
    left = results.select(
        "app_id", _ids(F.col(roots)).alias("root_cause_stages"), _ids(F.col("victim_stages")).alias("victim_stages")
    )
    chances = F.col("probability")
    if isinstance(predictions.schema["probability"].dataType, VectorUDT):
        chances = vector_to_array(chances)
    right = predictions.select(
        "app_id",
        label_name(F.col("prediction"), REPORT_CLASS_NAMES).alias("predicted_class"),
        F.array_max(chances).alias("confidence"),
    )
    nothing = F.array().cast("array<int>")
    rows = left.join(right, "app_id", "full").select(
        "app_id",
        F.coalesce("root_cause_stages", nothing).alias("root_cause_stages"),
        F.coalesce("victim_stages", nothing).alias("victim_stages"),
        F.coalesce("predicted_class", F.lit(NOT_AVAILABLE)).alias("predicted_class"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
    report = F.struct(
        "app_id",
        F.struct("root_cause_stages", "victim_stages").alias("root_cause_analysis"),
        F.struct("predicted_class", "confidence").alias("failure_classification"),
        F.lit(REPORT_NOTE).alias("note"),
    )
    return rows.withColumn("report_json", F.to_json(report))


def report(spark: SparkSession, results_path: str, predictions_path: str, app_id: str | None = None) -> DataFrame:
    """The report over stored tables; one that is missing counts as empty."""
    return unified_report(
        parquet_or_empty(spark, results_path, _RESULTS), parquet_or_empty(spark, predictions_path, _SCORED), app_id
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """One line of JSON per application."""
    reports.select("report_json").write.mode("overwrite").text(path)
