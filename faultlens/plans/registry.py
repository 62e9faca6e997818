"""Every query by name: callables of (spark, folder of the given tables)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.fixtures import log_files, log_text, telemetry
from faultlens.functions.columns import format_bytes, label_name
from faultlens.functions.constants import FEATURES
from faultlens.operators import classify, confound, evaluation, graph, lineage, root_cause, splits
from faultlens.operators import features as ft
from faultlens.plans import workloads as w
from faultlens.plans.preprocess import counts, preprocess_lines
from faultlens.plans.report import unified_report
from faultlens.session import materialize, remove, scratch_path, shuffles_removed
from faultlens.sources import delimited, event_logs
from faultlens.sources import manifest as runs
from faultlens.sources.tables import row_counts, table, table_sizes

GIVEN_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

Query = Callable[[SparkSession, str], DataFrame]


def _on_tables(plan: Callable[[w.Tables], DataFrame]) -> Query:
    return lambda spark, folder: plan(w.Tables(spark, folder))


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.stage_nodes(telemetry.stage_metrics(spark, folder))


def _on_nodes(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: plan(_nodes(spark, folder))


def _on_stored_nodes(plan: Callable[[DataFrame], DataFrame]) -> Query:
    """For plans that read the nodes several times or iterate over them."""
    return lambda spark, folder: plan(materialize(_nodes(spark, folder), "nodes"))


WORKLOADS: dict[str, Query] = {
    "q3_shipping_priority": _on_tables(w.shipping_priority),
    "q4_order_priority": _on_tables(w.order_priority),
    "q10_returned_revenue": _on_tables(w.returned_revenue),
    "q10_customer_top20": _on_tables(w.returned_revenue_by_customer),
    "q12_mode_priority": _on_tables(w.mode_priority),
    "q9_part_revenue": _on_tables(w.part_revenue),
    "revenue_by_nation": _on_tables(w.revenue_by_nation),
    "join_composite_key": _on_tables(w.composite_key_join),
    "join_bucketed": _on_tables(w.bucketed_join),
    "q18_large_orders": _on_tables(w.large_orders),
    "skew_union_agg": _on_tables(w.skewed_large_orders),
    "segment_priority_rollup": _on_tables(w.segment_priority_rollup),
    "nation_status_revenue": _on_tables(w.nation_status_revenue),
    "customer_spend_topk": _on_tables(w.customer_spend_topk),
    "q2_supplier_part": _on_tables(w.supplier_part),
    "customer_total_price": _on_tables(w.customer_total_price),
    "customer_supplier_total": _on_tables(w.customer_supplier_total),
    "category_totals": lambda spark, folder: w.category_totals(table(spark, folder, "events")),
    "order_pairs_total": _on_tables(w.order_pairs_total),
    "cross_join_agg": _on_tables(w.line_customer_pairs_total),
    "q1_pricing_summary": _on_tables(w.pricing_summary),
}


def _first_failures(nodes: DataFrame) -> DataFrame:
    return nodes.filter("status = 'FAILED'").groupBy("app_id").agg(F.min("stage_id").alias("stage_id"))


def _node_listing(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("parents", F.array_join(F.array_sort("parents"), ",")).withColumnRenamed("parents", "parent_ids")


GRAPHS: dict[str, Query] = {
    "dag_nodes": _on_nodes(_node_listing),
    "dag_mode": lambda s, d: graph.graph_mode(telemetry.stage_metrics(s, d)),
    "dag_heuristic_chain": _on_nodes(graph.heuristic_chain),
    "dag_edges": _on_nodes(graph.declared_edges),
    "dag_edges_with_roots": _on_nodes(graph.edges_with_roots),
    "dag_roots_leaves": _on_stored_nodes(graph.roots_and_leaves),
    "dag_neighbors": _on_stored_nodes(graph.neighbors),
    "dag_ancestors": _on_stored_nodes(lambda n: lineage.ancestors(n, root_cause.terminal_failed_stage(n))),
    "dag_descendants": _on_stored_nodes(lambda n: lineage.descendants(n, _first_failures(n))),
    "dag_is_acyclic": _on_stored_nodes(lambda n: lineage.depth_and_cycles(n).select("app_id", "is_acyclic")),
    "dag_depth": _on_stored_nodes(lambda n: lineage.depth_and_cycles(n).select("app_id", "depth")),
    "dag_summary": _on_stored_nodes(lineage.graph_summary),
    "failed_stages": _on_stored_nodes(graph.failed_stages),
    "first_failed_leaf": _on_stored_nodes(graph.first_failed_leaf),
    "logical_aborts": _on_nodes(root_cause.logical_aborts),
    "terminal_failed_stage": _on_stored_nodes(root_cause.terminal_failed_stage),
    "root_cause_stages": _on_stored_nodes(lambda n: root_cause.trace(n).filter("is_root_cause").select("app_id", "stage_id")),
    "victim_stages": _on_stored_nodes(lambda n: root_cause.trace(n).filter("NOT is_root_cause").select("app_id", "stage_id")),
    "propagation_path": _on_stored_nodes(lambda n: root_cause.trace(n).select("app_id", "stage_id", "bfs_level")),
    "rca_confidence": _on_nodes(root_cause.confidence),
    "root_causes": _on_nodes(root_cause.analyze),
    "root_cause_summary": _on_nodes(lambda n: root_cause.summary_by_reason(root_cause.analyze(n))),
}


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return ft.app_features(telemetry.task_metrics(spark, folder), telemetry.stage_metrics(spark, folder))


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Doubles whose last bits depend on the order of summation."""
    return df.withColumns({name: F.round(name, places) for name, places in digits.items()})


_SPREAD = {"std_task_duration": 4, "duration_variance": 4}
_STATS = {"mean": 3, "std": 2, "min": 4, "max": 4}


def _on_features(plan: Callable[[DataFrame], DataFrame], digits: dict[str, int] | None = None) -> Query:
    return lambda spark, folder: _rounded(plan(_features(spark, folder)), digits or {})


def _on_stored_features(plan: Callable[[DataFrame], DataFrame], digits: dict[str, int]) -> Query:
    """For plans that read the features several times."""
    return lambda spark, folder: _rounded(plan(materialize(_features(spark, folder), "features")), digits)


def _labelled_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.task_metrics(spark, folder).select("app_id", "label")


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.predictions(ft.ground_truth(_labelled_tasks(spark, folder)))


def _on_predictions(plan: Callable[[DataFrame], DataFrame], digits: dict[str, int] | None = None) -> Query:
    return lambda spark, folder: _rounded(plan(_predictions(spark, folder)), digits or {})


def _task_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The derived telemetry as log text, stored like a log is."""
    return materialize(log_text.task_lines(telemetry.task_metrics(spark, folder)), "lines")


def _stage_lines(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(log_text.stage_lines(telemetry.stage_metrics(spark, folder)), "lines")


def _parse_once_counts(spark: SparkSession, folder: str) -> DataFrame:
    lines = _task_lines(spark, folder).unionByName(_stage_lines(spark, folder))
    tasks, stages = event_logs.parse_once(lines)
    return counts({"tasks": tasks, "stages": stages})


def _split(spark: SparkSession, folder: str) -> DataFrame:
    apps = _labelled_tasks(spark, folder).groupBy("app_id").agg(F.max("label").alias("label"))
    train, test = splits.split_by_key(apps)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def _split_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).groupBy("split", "label").agg(F.count(F.lit(1)).alias("app_count")).orderBy("split", "label")


def _report(spark: SparkSession, folder: str) -> DataFrame:
    results = root_cause.analyze(_nodes(spark, folder))
    report = unified_report(results, _predictions(spark, folder))
    return report.select("app_id", "predicted_class", "confidence", "report_json")


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The derived manifest, written as CSV and read back."""
    path = scratch_path(spark, "manifest")
    rows = telemetry.manifest(telemetry.stage_metrics(spark, folder), label_name(F.col("Label")))
    runs.append_runs(rows, path)
    return runs.read_manifest(spark, path)


def _delimited_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    path = scratch_path(spark, "orders.tbl")
    delimited.write_delimited(orders, path)
    return delimited.read_delimited(spark, path, orders.schema)


def _row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return row_counts({n: table(spark, folder, n) for n in GIVEN_TABLES})


def _table_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return table_sizes({n: table(spark, folder, n) for n in GIVEN_TABLES})


def _repeated_append(spark: SparkSession, folder: str) -> DataFrame:
    """The derived manifest appended a part, then whole, then whole again."""
    path = scratch_path(spark, "manifest")
    rows = materialize(telemetry.manifest(telemetry.stage_metrics(spark, folder), label_name(F.col("Label"))), "runs")
    for part in (rows.filter("Label < 3"), rows, rows):
        runs.append_runs(part, path)
    return runs.read_manifest(spark, path).select("FailureType", "RunId", "Status")


def _formatted_bytes(spark: SparkSession, folder: str) -> DataFrame:
    size = F.floor(F.col("o_totalprice") * 10000)
    return table(spark, folder, "orders").select(
        "o_orderkey", size.alias("bytes"), format_bytes(size).alias("size")
    )


def _log_files(spark: SparkSession, folder: str) -> Iterator[str]:
    """Folders of log files with the derived telemetry and noise in class folders, a part of the applications in each.

    A folder is removed when the next one is asked for, so that the text of one part lies on disk at a time.
    """
    rows = log_text.log_rows(*telemetry.tasks_and_stages(spark, folder))
    parts = log_files.part_count(sum(table(spark, folder, name).count() for name in ("lineitem", "orders")))
    for part in log_files.parted(rows, parts):
        base = scratch_path(spark, "logs")
        with shuffles_removed(spark):
            materialize(log_files.write_logs(part, base), "written")
        yield base
        remove(spark, base)


def _plain_ids(rows: DataFrame) -> DataFrame:
    """The derived ids; those of log files have the file's prefix."""
    return rows.withColumn("app_id", F.regexp_replace("app_id", "^application_", ""))


def _scanned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, event_logs.ScanCounts]:
    found = event_logs.ScanCounts()
    parts = (event_logs.scan_event_logs(spark, base, counts=found) for base in _log_files(spark, folder))
    tasks, stages = event_logs.parse_each(spark, parts, found)
    return _plain_ids(tasks), _plain_ids(stages), found


def _scan_counters(spark: SparkSession, folder: str) -> DataFrame:
    totals = _scanned(spark, folder)[2].totals()
    return spark.range(1).select(*[F.lit(count).cast("long").alias(name) for name, count in totals.items()])


def _scan_rejected(spark: SparkSession, folder: str) -> DataFrame:
    rejected = _plain_ids(_scanned(spark, folder)[2].rejected)
    return rejected.groupBy("app_id", "label", "reason").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("file").alias("files"))


def _scan_report(spark: SparkSession, folder: str) -> DataFrame:
    with shuffles_removed(spark):
        parts = [materialize(event_logs.scan_report(spark, base, skip_damaged=False), "report") for base in _log_files(spark, folder)]
    report = reduce(DataFrame.unionByName, parts)
    app = _plain_ids(report.withColumn("app_id", event_logs.app_id_of(F.regexp_extract("path", "[^/]*$", 0))))
    return app.select("app_id", "lines", "ended", (F.col("bytes") > 0).alias("has_bytes"))


def _preprocessed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The eight result tables, from log text with noise in it."""
    wanted = _task_lines(spark, folder).unionByName(_stage_lines(spark, folder))
    return preprocess_lines(wanted.unionByName(log_text.noise_lines(wanted)), scratch_path(spark, "preprocessed"))


def _pipeline_counts(spark: SparkSession, folder: str) -> DataFrame:
    tables = _preprocessed(spark, folder)
    names = {"tasks": "task_metrics", "stages": "stage_metrics", "root_causes": "root_causes", "features": "features", "train": "train", "test": "test"}
    return counts({n: tables[t] for n, t in names.items()} | {"graphs": tables["dag_edges"].select("app_id").distinct()})


TELEMETRY: dict[str, Query] = {
    "task_metrics": telemetry.task_metrics,
    "stage_metrics": telemetry.stage_metrics,
    "parse_task_events": lambda s, d: event_logs.task_events(_task_lines(s, d)),
    "parse_stage_events": lambda s, d: event_logs.stage_events(_stage_lines(s, d)),
    "parse_stage_parents": lambda s, d: event_logs.stage_parents(event_logs.submitted_stages(_stage_lines(s, d))),
    "parse_once_counts": _parse_once_counts,
    "scan_task_rows": lambda s, d: _scanned(s, d)[0],
    "scan_stage_rows": lambda s, d: _scanned(s, d)[1],
    "scan_counters": _scan_counters,
    "scan_rejected": _scan_rejected,
    "scan_report": _scan_report,
    "task_aggregates": lambda s, d: _rounded(ft.task_aggregates(telemetry.task_metrics(s, d)), _SPREAD),
    "stage_aggregates": lambda s, d: ft.stage_aggregates(telemetry.stage_metrics(s, d)),
    "app_features": _on_features(lambda f: f, _SPREAD),
    "feature_describe": _on_stored_features(ft.describe, _STATS),
    "ground_truth": lambda s, d: ft.ground_truth(_labelled_tasks(s, d)),
    "label_distribution": lambda s, d: ft.label_distribution(ft.ground_truth(_labelled_tasks(s, d))).select(
        "label", "label_name", "app_count"
    ),
    "split_by_key": _split,
    "split_label_counts": _split_labels,
    "classification_metrics": _on_predictions(
        evaluation.classification_metrics, dict.fromkeys(["accuracy", "f1", "precision", "recall"], 6)
    ),
    "confusion_matrix": _on_predictions(evaluation.confusion_matrix),
    "per_class_accuracy": _on_predictions(evaluation.per_class_accuracy, {"accuracy": 6}),
    "misclassified": _on_predictions(evaluation.misclassified),
    "class_feature_stats": _on_stored_features(confound.class_feature_stats, _STATS),
    "feature_correlation": _on_stored_features(confound.label_correlation, {"pearson": 6}),
    "feature_redundancy": _on_stored_features(confound.redundancy, {"pearson": 6, "identical_share": 6}),
    "confound_verdict": _on_stored_features(confound.verdicts, {"pearson": 6}),
    "unified_report": _report,
    "manifest_completed_runs": lambda s, d: runs.completed_runs(_manifest(s, d)),
    "manifest_pending_runs": lambda s, d: (lambda m: runs.pending_runs(m, m))(_manifest(s, d)),
    "manifest_summary": lambda s, d: runs.summary(_manifest(s, d)),
    "manifest_repeated_append": _repeated_append,
    "table_row_counts": _row_counts,
    "table_sizes": _table_sizes,
    "delimited_roundtrip": _delimited_roundtrip,
    "format_bytes": _formatted_bytes,
    "pipeline_counts": _pipeline_counts,
    "pipeline_task_rows": lambda s, d: _preprocessed(s, d)["task_metrics"],
    "pipeline_root_causes": lambda s, d: _preprocessed(s, d)["root_causes"],
}


def _stored_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return splits.split_by_key(classify.dealt(materialize(_features(spark, folder), "features")))


def _ml_vectors(spark: SparkSession, folder: str) -> DataFrame:
    values = classify.vector_values(classify.feature_vectors(_features(spark, folder)))
    return values.withColumn("value", F.round("value", 4))


def _ml_scored(spark: SparkSession, folder: str, models: dict[str, tuple[str, list[str]]]) -> DataFrame:
    return classify.score_all(*_stored_split(spark, folder), models)


def _ml_predictions(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _stored_split(spark, folder)
    return classify.score(classify.fit(train), test)


def _ml_importance(spark: SparkSession, folder: str) -> DataFrame:
    train, _ = _stored_split(spark, folder)
    return classify.feature_importance(classify.fit(train), spark)


def _ml_cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = classify.dealt(materialize(_features(spark, folder), "features"))
    return classify.cross_validate(rows, {"random_forest": ("random_forest", FEATURES)})


def _ml_ablation(spark: SparkSession, folder: str) -> DataFrame:
    rows = classify.dealt(materialize(_features(spark, folder), "features"))
    models = classify.ablation_models()
    return classify.ablation(classify.score_all(*splits.split_by_key(rows), models), classify.cross_validate(rows, models))


def _ml_overfitting(spark: SparkSession, folder: str) -> DataFrame:
    rows = classify.dealt(materialize(_features(spark, folder), "features"))
    models = {"random_forest": ("random_forest", FEATURES)}
    tested = evaluation.classification_metrics(classify.score_all(*splits.split_by_key(rows), models), "model")
    return classify.overfitting(classify.cross_validate(rows, models), tested)


def _on_scored(plan: Callable[[DataFrame], DataFrame], models: Callable[[], dict]) -> Query:
    return lambda spark, folder: plan(_ml_scored(spark, folder, models()))


MODELS: dict[str, Query] = {
    "feature_vectors": _ml_vectors,
    "ml_model_comparison": _on_scored(classify.compare_models, classify.classifier_models),
    "ml_model_confusion": _on_scored(lambda s: evaluation.confusion_matrix(s, "model"), classify.classifier_models),
    "ml_model_class_accuracy": _on_scored(lambda s: evaluation.per_class_accuracy(s, "model"), classify.classifier_models),
    "ml_predictions": _ml_predictions,
    "ml_prediction_checks": lambda s, d: classify.prediction_checks(_ml_predictions(s, d)),
    "ml_model_checks": _on_scored(classify.model_checks, classify.classifier_models),
    "ml_feature_importance": _ml_importance,
    "ml_importance_checks": lambda s, d: classify.importance_checks(_ml_importance(s, d)),
    "ml_cross_validation": _ml_cross_validation,
    "ml_overfitting": _ml_overfitting,
    "ml_ablation": _ml_ablation,
    "ml_ablation_mistakes": _on_scored(classify.mistakes, classify.ablation_models),
}


def all_queries() -> dict[str, Query]:
    return {**WORKLOADS, **GRAPHS, **TELEMETRY, **MODELS}
