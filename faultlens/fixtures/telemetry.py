"""Telemetry derived from the order tables.

The given tables hold no event logs, so one customer stands for one
application, one order for one stage and one order line for one task. The rules
are portable SQL (see FIXTURES.md), which lets every telemetry query be checked
against another engine on the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators.prefix import running_before
from faultlens.session import materialize
from faultlens.sources.tables import table


# At least six digits; longer keys keep all of theirs.
APP_ID = """concat('app_', lpad(CAST(o_custkey AS STRING), greatest(6, length(CAST(o_custkey AS STRING))), '0')) AS app_id"""
LABEL = "CAST(o_custkey % 7 AS INT) AS label"

STAGE_COLUMNS = [
    APP_ID,
    LABEL,
    "stage_id",
    "0 AS stage_attempt_id",
    "concat('stage ', o_orderpriority) AS stage_name",
    "coalesce(num_tasks, 0) AS num_tasks",
    "o_orderkey * 1000 AS submission_time",
    "o_orderkey * 1000 + 500 AS completion_time",
    "CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'COMPLETED' END AS status",
    """CASE WHEN o_orderstatus <> 'F' THEN NULL
            WHEN o_orderpriority = '1-URGENT' THEN 'java.lang.OutOfMemoryError: Java heap space'
            WHEN o_orderpriority = '2-HIGH' THEN 'FetchFailed: shuffle block missing'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'No space left on device'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Stage was cancelled'
            ELSE 'timeout' END AS failure_reason""",
    """CASE WHEN o_custkey % 10 = 0 OR stage_id = 0 THEN ''
            WHEN stage_id % 11 = 10 THEN concat(first_parent, ',900')
            WHEN stage_id % 3 = 2 AND first_parent <> second_parent
                THEN concat(first_parent, ',', second_parent)
            ELSE CAST(first_parent AS STRING) END AS parent_ids""",
]

TASK_COLUMNS = [
    APP_ID,
    "label",
    "stage_id",
    "0 AS stage_attempt_id",
    "l_orderkey * 10 + l_linenumber AS task_id",
    "CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 1 ELSE 0 END AS task_attempt",
    "CAST(l_suppkey % 4 AS STRING) AS executor_id",
    "concat('host-', CAST(l_suppkey % 2 AS STRING)) AS host",
    "NOT (o_orderstatus = 'F' AND l_returnflag = 'R') AS success",
    """CAST(CASE WHEN l_linestatus <> 'O' THEN 0
                 WHEN label = 2 AND l_linenumber = 1 THEN l_quantity * 2000
                 ELSE l_quantity * 100 END AS BIGINT) AS duration_ms""",
    "CAST(l_quantity * 90 AS BIGINT) AS executor_run_time",
    "CAST(l_quantity * CASE WHEN label = 1 THEN 30 ELSE 2 END AS BIGINT) AS jvm_gc_time",
    "CAST(CASE WHEN label IN (1, 5) THEN l_partkey * 1024 ELSE 0 END AS BIGINT) AS memory_bytes_spilled",
    "CAST(CASE WHEN label = 5 THEN l_partkey * 512 ELSE 0 END AS BIGINT) AS disk_bytes_spilled",
    "CAST(l_suppkey * 4096 AS BIGINT) AS peak_execution_memory",
    "CAST(l_partkey * 100 AS BIGINT) AS input_bytes_read",
    "CAST(CASE WHEN stage_id > 0 THEN l_quantity * 1000 ELSE 0 END AS BIGINT) AS shuffle_bytes_read",
    "CAST(l_quantity * 800 AS BIGINT) AS shuffle_bytes_written",
    "CAST(l_quantity * CASE WHEN label = 4 THEN 50 ELSE 1 END AS BIGINT) AS shuffle_fetch_wait_time",
]


def _numbered_orders(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Orders with their position among the orders of the same customer."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", *columns)
    numbered = running_before(orders, ["o_custkey"], "o_orderkey", sums={"stage_id": F.lit(1)})
    return numbered.withColumn("stage_id", F.col("stage_id").cast("int"))


def tasks_and_stages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``task_metrics`` and ``stage_metrics`` over orders that are numbered once, for plans that need both."""
    numbered = materialize(_numbered_orders(spark, folder, "o_orderstatus", "o_orderpriority"), "orders")
    return task_metrics(spark, folder, numbered.drop("o_orderpriority")), stage_metrics(spark, folder, numbered)


def stage_metrics(spark: SparkSession, folder: str, numbered: DataFrame | None = None) -> DataFrame:
    orders = (_numbered_orders(spark, folder, "o_orderstatus", "o_orderpriority") if numbered is None else numbered).selectExpr(
        "*",
        "CAST(floor((stage_id - 1) / 2.0D) AS INT) AS first_parent",
        "stage_id - 2 AS second_parent",
    )
    lines = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).cast("int").alias("num_tasks"))
    )
    return orders.join(lines, "o_orderkey", "left").selectExpr(*STAGE_COLUMNS)


def task_metrics(spark: SparkSession, folder: str, numbered: DataFrame | None = None) -> DataFrame:
    """Order lines as tasks.

    Both sides grow with the data, so the join shuffles them by order at any
    size; Spark splits the partition of a hot order.
    """
    orders = (_numbered_orders(spark, folder, "o_orderstatus") if numbered is None else numbered).hint("merge")
    return (
        table(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .selectExpr("*", LABEL)
        .selectExpr(*TASK_COLUMNS)
    )


def predictions(features: DataFrame) -> DataFrame:
    """Deterministic stand-in for classifier output: one application in five is
    misclassified, and the predicted class has a probability that varies by
    application."""
    number = F.substring("app_id", 5, 20).cast("bigint")
    predicted = F.when(number % 5 == 0, (F.col("label") + 1) % 7).otherwise(F.col("label")).cast("int")
    chance = (F.lit(70) + number % 30) / F.lit(100.0)
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(6)),
        lambda c: F.when(c == F.col("prediction"), chance).otherwise((1 - chance) / 6),
    )
    return (
        features.select("app_id", F.col("label").cast("int").alias("label"))
        .withColumn("prediction", predicted)
        .withColumn("probability", spread)
    )


def manifest(stages: DataFrame, class_names: Column) -> DataFrame:
    """One run per application, with a status that depends on its stages."""
    number = F.substring("app_id", 5, 20).cast("bigint")
    per_app = stages.groupBy("app_id").agg(
        F.max("label").alias("Label"),
        F.max(F.col("status") == "FAILED").alias("any_failed"),
        F.max("completion_time").alias("finished_at"),
    )
    status = (
        F.when(number % 9 == 0, "ERROR")
        .when(number % 9 == 1, "TIMEOUT")
        .when(F.col("any_failed"), "FAILED")
        .otherwise("FINISHED")
    )
    return per_app.select(
        F.concat(F.lit("RUN_"), "app_id").alias("AppName"),
        class_names.alias("FailureType"),
        "Label",
        F.substring("app_id", 5, 20).alias("RunId"),
        F.col("finished_at").cast("string").alias("Timestamp"),
        F.col("app_id").alias("AppId"),
        status.alias("Status"),
    )
