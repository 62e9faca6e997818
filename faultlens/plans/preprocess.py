"""From event logs to the eight result tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators import features as ft
from faultlens.operators import graph, root_cause
from faultlens.operators.splits import split_by_key
from faultlens.session import materialize, scratch_scope
from faultlens.sources.event_logs import parse_once, scan_event_logs

OUTPUTS = [
    "task_metrics",
    "stage_metrics",
    "dag_edges",
    "root_causes",
    "features",
    "ground_truth",
    "train",
    "test",
]


def preprocess(spark: SparkSession, logs: str, out: str, skip_damaged: bool = False) -> dict[str, DataFrame]:
    """Parse the logs below ``logs`` and write every result table to ``out``."""
    return preprocess_lines(scan_event_logs(spark, logs, skip_damaged), out)


def preprocess_lines(lines: DataFrame, out: str) -> dict[str, DataFrame]:
    """Parse log lines (app_id, label, value) and write every result table to ``out``.

    Each table is written once and later steps read what was written, so no
    step repeats another one's work and a lost executor costs no more than the
    step it was in. What is stored on the way is removed at the end. Returns
    the stored tables by name.
    """
    spark = lines.sparkSession

    def store(df: DataFrame, name: str) -> DataFrame:
        path = f"{out}/{name}.parquet"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    tables: dict[str, DataFrame] = {}
    with scratch_scope(spark):
        tasks, stages = parse_once(lines)
        tables["task_metrics"] = tasks = store(tasks, "task_metrics")
        tables["stage_metrics"] = stages = store(stages, "stage_metrics")
        result_tables(tasks, stages, store, tables)
    return tables


def result_tables(
    tasks: DataFrame,
    stages: DataFrame,
    store: Callable[[DataFrame, str], DataFrame] = materialize,
    tables: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """The eight tables from the first two, each stored by ``store`` and read from there by the next."""
    if tables is None:
        tables = {"task_metrics": store(tasks, "task_metrics"), "stage_metrics": store(stages, "stage_metrics")}
        tasks, stages = tables["task_metrics"], tables["stage_metrics"]
    nodes = materialize(graph.stage_nodes(stages), "nodes")
    tables["dag_edges"] = store(graph.edges_with_roots(nodes), "dag_edges")
    traced = materialize(root_cause.traced_stages(nodes), "trace")
    tables["root_causes"] = store(root_cause.result_table(nodes, traced), "root_causes")

    tables["features"] = rows = store(ft.app_features(tasks, stages), "features")
    tables["ground_truth"] = store(ft.ground_truth(rows), "ground_truth")
    train, test = split_by_key(rows)
    tables["train"], tables["test"] = store(train, "train"), store(test, "test")
    return tables


def counts(named: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of every table, as columns."""
    parts = [df.select(F.lit(name).alias("name")).groupBy("name").count() for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts).agg(
        *[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("count"))), F.lit(0)).alias(n) for n in named]
    )
