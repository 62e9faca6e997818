"""The 25 behavioural features of an application.

Tasks and stages are aggregated per application with map-side partial sums, so
an application of any size reaches the shuffle as one row per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.columns import label_name, ratio
from faultlens.functions.constants import FEATURES
from faultlens.functions.exact import spread, whole_mean, whole_variance


def with_duration(tasks: DataFrame) -> DataFrame:
    """The recorded duration, or the run time where none was recorded."""
    return tasks.withColumn(
        "computed_duration", F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(F.col("executor_run_time"))
    )


def task_aggregates(tasks: DataFrame) -> DataFrame:
    duration, peak = F.col("computed_duration"), F.col("peak_execution_memory")
    return (
        with_duration(tasks)
        .groupBy("app_id")
        .agg(
            F.max("label").alias("label"),
            F.count(F.lit(1)).alias("total_tasks"),
            F.count_if(~F.col("success")).alias("failed_tasks"),
            F.count_if(F.col("task_attempt") > 0).alias("retry_count"),
            whole_mean(duration).alias("mean_task_duration"),
            F.sqrt(whole_variance(duration)).alias("std_task_duration"),
            whole_variance(duration).alias("duration_variance"),
            F.min(duration).alias("min_task_duration"),
            F.max(duration).alias("max_task_duration"),
            whole_mean(peak).alias("avg_peak_memory"),
            F.max(peak).alias("max_peak_memory"),
            F.sum("memory_bytes_spilled").alias("total_memory_spilled"),
            F.sum("disk_bytes_spilled").alias("total_disk_spilled"),
            F.sum("shuffle_bytes_read").alias("total_shuffle_read"),
            F.sum("shuffle_bytes_written").alias("total_shuffle_write"),
            F.sum("jvm_gc_time").alias("total_gc_time"),
            F.sum("executor_run_time").alias("total_run_time"),
            F.sum("input_bytes_read").alias("total_input"),
        )
    )


def stage_aggregates(stages: DataFrame) -> DataFrame:
    """Counts over all stage rows; every attempt of a stage counts.

    ``stage_depth_of_failure`` is the number of completed stages; the name is
    kept because models and reports refer to it.
    """
    return stages.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("total_stages"),
        F.count_if(F.col("status") == "FAILED").alias("failed_stages"),
        F.count_if(F.col("status") == "COMPLETED").alias("stage_depth_of_failure"),
        F.max("num_tasks").alias("max_stage_parallelism"),
    )


def _derived(c: dict[str, Column]) -> dict[str, Column]:
    stages, spilled = c["total_stages"], c["total_memory_spilled"] + c["total_disk_spilled"]
    return {
        "completed_stage_ratio": ratio(c["stage_depth_of_failure"], stages, 0.0),
        "failed_stage_ratio": ratio(c["failed_stages"], stages, 0.0),
        "spill_per_stage": ratio(spilled, stages, 0.0),
        "gc_per_stage": ratio(c["total_gc_time"], stages, 0.0),
        "duration_heterogeneity_ratio": ratio(c["max_task_duration"], c["mean_task_duration"], 1.0),
        "max_min_duration_ratio": ratio(c["max_task_duration"], c["min_task_duration"], 1.0),
        "spill_ratio": ratio(c["total_memory_spilled"], c["total_input"], 0.0),
        "disk_spill_ratio": ratio(c["total_disk_spilled"], c["total_input"], 0.0),
        "peak_memory_ratio": ratio(c["max_peak_memory"], c["avg_peak_memory"], 1.0),
        "gc_time_ratio": ratio(c["total_gc_time"], c["total_run_time"], 0.0),
        "task_failure_rate": ratio(c["failed_tasks"], c["total_tasks"], 0.0),
    }


def app_features(tasks: DataFrame, stages: DataFrame, ground_truth: DataFrame | None = None) -> DataFrame:
    """app_id, label and the features as doubles, one row per application.

    Applications without tasks have no row. The label is the one of the tasks
    unless ``ground_truth`` (app_id, label) says otherwise; applications it does
    not name are then left out. Missing aggregates count as 0 before any ratio.
    """
    joined = task_aggregates(tasks).join(stage_aggregates(stages), "app_id", "left")
    if ground_truth is not None:
        joined = joined.drop("label").join(ground_truth.select("app_id", "label"), "app_id")
    filled = {n: F.coalesce(F.col(n), F.lit(0)) for n in joined.columns if n not in ("app_id", "label")}
    values = {**filled, **_derived(filled)}
    return joined.select("app_id", "label", *[values[n].cast("double").alias(n) for n in FEATURES])


def unpivoted(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(app_id, label, feature, value), one row per application and feature."""
    return features.unpivot(["app_id", "label"], columns or FEATURES, "feature", "value")


def describe(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, least and greatest value of every feature."""
    return spread(unpivoted(features, columns), ["feature"])


def ground_truth(labelled: DataFrame) -> DataFrame:
    """(app_id, label, label_name) from any table with app_id and label."""
    return (
        labelled.groupBy("app_id")
        .agg(F.max("label").cast("int").alias("label"))
        .withColumn("label_name", label_name(F.col("label")))
        .orderBy("label", "app_id")
    )


def label_distribution(labelled: DataFrame) -> DataFrame:
    return (
        labelled.groupBy(F.col("label").cast("int").alias("label"))
        .agg(F.count(F.lit(1)).alias("app_count"))
        .withColumn("label_name", label_name(F.col("label")))
        .orderBy("label")
    )
