"""Root-cause analysis: from the last failed stage back to where it began.

All applications are analysed together. The walk covers failed stages only, so
everything it touches is small next to the stage table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions import constants as k
from faultlens.functions.columns import is_failed, is_logical_abort
from faultlens.operators.closure import reach
from faultlens.operators.graph import NODE, with_child_counts
from faultlens.operators.prefix import running_before
from faultlens.session import materialize, merged


def logical_aborts(nodes: DataFrame) -> DataFrame:
    return nodes.filter(is_logical_abort()).select(*NODE, "stage_name", "status", "failure_reason")


def terminal_failed_stage(nodes: DataFrame) -> DataFrame:
    """Per application the failed stage the walk starts from.

    Preferred is a failed leaf, then a failed stage without failed children,
    then any failed stage; the highest id within the preferred kind.
    """
    stage = F.col("stage_id")
    return (
        with_child_counts(nodes)
        .filter(is_failed())
        .groupBy("app_id")
        .agg(
            F.max(F.when(F.col("child_count") == 0, stage)).alias("leaf"),
            F.max(F.when(F.col("failed_child_count") == 0, stage)).alias("last"),
            F.max(stage).alias("any"),
        )
        .select("app_id", F.coalesce("leaf", "last", "any").alias("stage_id"))
    )


def _blamed_edges(nodes: DataFrame) -> DataFrame:
    """Edges from a failed stage to a failed parent that was not merely aborted."""
    to_blame = nodes.filter(is_failed() & ~is_logical_abort()).select("app_id", F.col("stage_id").alias("next"))
    return (
        nodes.filter(is_failed())
        .select("app_id", F.col("stage_id").alias("at"), F.explode("parents").alias("next"), "used_true_parents")
        .join(merged(to_blame), ["app_id", "next"], "left_semi")
    )


def _chain_walk(nodes: DataFrame, terminals: DataFrame) -> DataFrame:
    """The walk in chain mode: the unbroken run of failures up to the terminal.

    A stage that completed or was aborted breaks the run, so the run is known
    from the last break before a stage and needs no iteration.
    """
    breaks = ~(is_failed() & ~is_logical_abort())
    chain = running_before(
        nodes.filter(~F.col("used_true_parents")).select(*NODE, "status", "failure_reason"),
        ["app_id"],
        "stage_id",
        sums={"position": F.lit(1)},
        maxima={"last_break": F.when(breaks, F.col("stage_id"))},
    ).withColumn("broken", breaks)
    ends = chain.join(merged(terminals), NODE, "left_semi").select(
        "app_id",
        F.col("stage_id").alias("terminal_id"),
        F.col("position").alias("end"),
        F.coalesce("last_break", F.lit(-1)).alias("run"),
    )
    # An aborted terminal is part of its own walk, but of no other.
    runs = chain.filter(is_failed()).withColumn("run", F.coalesce("last_break", F.lit(-1)))
    return (
        runs.join(merged(ends), ["app_id", "run"])
        .filter((F.col("stage_id") == F.col("terminal_id")) | (~F.col("broken") & (F.col("stage_id") < F.col("terminal_id"))))
        .select(*NODE, (F.col("end") - F.col("position")).cast("int").alias("bfs_level"))
    )


def trace(nodes: DataFrame) -> DataFrame:
    """Every stage on the walk: (app_id, stage_id, bfs_level, is_root_cause).

    ``bfs_level`` counts the steps from the terminal failed stage. Stages whose
    parents give no further failure to blame are root causes, the others are
    victims.
    """
    terminals = materialize(terminal_failed_stage(nodes), "terminals")
    blamed = materialize(_blamed_edges(nodes), "blamed")
    listed_start = terminals.join(
        merged(nodes.filter("used_true_parents").select(*NODE)), NODE, "left_semi"
    ).select("app_id", F.col("stage_id").alias("at"))
    walked = reach(listed_start, blamed.filter("used_true_parents"), ["app_id"]).select(
        "app_id", F.col("at").alias("stage_id"), F.col("steps").alias("bfs_level")
    )
    visited = walked.unionByName(_chain_walk(nodes, terminals))
    has_cause = blamed.select("app_id", F.col("at").alias("stage_id"), F.lit(True).alias("victim")).distinct()
    return visited.join(merged(has_cause), NODE, "left").select(
        *NODE, "bfs_level", F.col("victim").isNull().alias("is_root_cause")
    )


def traced_stages(nodes: DataFrame) -> DataFrame:
    """The walk with the name, reason and parents of its stages."""
    about = nodes.select(*NODE, "stage_name", "failure_reason", "parents")
    return trace(nodes).join(merged(about), NODE)


def _clean_parents(nodes: DataFrame, traced: DataFrame) -> DataFrame:
    """Per application: did every known parent of every root cause complete?"""
    parents = traced.filter("is_root_cause").select("app_id", F.explode("parents").alias("stage_id")).distinct()
    return (
        parents.join(merged(nodes.select(*NODE, "status")), NODE)
        .groupBy("app_id")
        .agg(F.min(F.col("status") == "COMPLETED").alias("clean_parents"))
    )


def confidence_table(nodes: DataFrame, traced: DataFrame) -> DataFrame:
    """(app_id, analysis_confidence) of the applications with a failed stage; counts and flags only."""
    root = F.col("is_root_cause")
    clear = F.length(F.coalesce("failure_reason", F.lit(k.UNKNOWN))) > 10
    per_app = traced.groupBy("app_id").agg(
        F.count_if(root).alias("roots"),
        F.max(F.when(root, clear)).alias("clear_root"),
        F.max(F.when(F.col("bfs_level") == 0, clear)).alias("clear_terminal"),
        F.max(F.size("parents")).alias("most_parents"),
    )
    # Where every failure blames another one in a circle, the terminal stage
    # stands for the cause; its own parents did not all complete.
    caused = F.col("roots") > 0
    clear_reason = F.when(caused, F.col("clear_root")).otherwise(F.col("clear_terminal"))
    clean_parents = caused & F.coalesce("clean_parents", F.lit(True))
    raw = (
        F.lit(k.CONFIDENCE_BASE)
        + F.when(clear_reason, k.CONFIDENCE_CLEAR_REASON).otherwise(0.0)
        + F.when(F.col("most_parents") <= 1, k.CONFIDENCE_SINGLE_PARENT).otherwise(0.0)
        + F.when(clean_parents, k.CONFIDENCE_CLEAN_PARENTS).otherwise(0.0)
        - F.greatest(F.col("roots") - 2, F.lit(0)) * k.CONFIDENCE_EXTRA_ROOT
    )
    return per_app.join(merged(_clean_parents(nodes, traced)), "app_id", "left").select(
        "app_id", F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 4).alias("analysis_confidence")
    )


def _full_confidence_elsewhere(nodes: DataFrame, confidence: DataFrame) -> DataFrame:
    apps = nodes.select("app_id").distinct()
    return apps.join(merged(confidence), "app_id", "left").select("app_id", F.coalesce("analysis_confidence", F.lit(1.0)).alias("analysis_confidence"))


def confidence(nodes: DataFrame) -> DataFrame:
    """(app_id, analysis_confidence) of every application; 1 where no stage failed."""
    nodes = materialize(nodes, "nodes")
    return _full_confidence_elsewhere(nodes, confidence_table(nodes, materialize(traced_stages(nodes), "trace")))


def result_table(nodes: DataFrame, traced: DataFrame) -> DataFrame:
    """One row per application with the analysis as text columns.

    ``traced`` is ``traced_stages``, best as a stored table.
    Ids ascend; names and reasons follow the order of the ids. The path runs
    from the root causes down to the terminal stage. An application without a
    failed stage has an empty analysis of full confidence.
    """
    item = F.struct("stage_id", "stage_name", F.coalesce("failure_reason", F.lit(k.UNKNOWN)).alias("reason"))
    root = F.col("is_root_cause")
    texts = (
        traced.groupBy("app_id")
        .agg(
            F.array_sort(F.collect_list(F.when(root, item))).alias("causes"),
            F.array_sort(F.collect_list(F.when(~root, F.col("stage_id")))).alias("victims"),
            F.sort_array(F.collect_list(F.struct("bfs_level", "stage_id")), asc=False).alias("path"),
            F.max(F.when(F.col("bfs_level") == 0, item)).alias("terminal"),
        )
        .withColumn("roots", F.when(F.size("causes") > 0, F.col("causes")).otherwise(F.array("terminal")))
    )
    found = F.col("roots").isNotNull()
    empty = F.lit("")
    return (
        _full_confidence_elsewhere(nodes, confidence_table(nodes, traced))
        .join(merged(texts), "app_id", "left")
        .select(
            "app_id",
            F.when(found, F.array_join(F.col("roots.stage_id"), ",")).otherwise(empty).alias("root_cause_stage_ids"),
            F.when(found, F.array_join(F.col("roots.stage_name"), " | "))
            .otherwise(k.NO_FAILURE_NAME)
            .alias("root_cause_stage_names"),
            F.when(found, F.array_join(F.col("roots.reason"), " | ")).otherwise(k.NO_FAILURE_REASON).alias("failure_reasons"),
            F.when(found, F.array_join(F.col("path.stage_id"), ",")).otherwise(empty).alias("propagation_path"),
            F.when(found, F.array_join("victims", ",")).otherwise(empty).alias("victim_stages"),
            "analysis_confidence",
        )
    )


def analyze(nodes: DataFrame) -> DataFrame:
    """Node table to result table; the nodes are written once and reused."""
    nodes = materialize(nodes, "nodes")
    return result_table(nodes, materialize(traced_stages(nodes), "trace"))


def summary_by_reason(results: DataFrame) -> DataFrame:
    """Applications per failure text, of which the first 30 characters count."""
    return results.groupBy(F.substring("failure_reasons", 1, 30).alias("reason")).agg(
        F.count(F.lit(1)).alias("app_count")
    )
