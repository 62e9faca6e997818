"""Stage graphs of all applications as node and edge tables.

``stage_nodes`` is the entry: one row per (app_id, stage_id) carrying the array
of parent ids. Parent ids that belong to no known stage are kept in that array
("declared" edges) and dropped by the operators that walk between known stages
("known" edges).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions.columns import is_failed, parent_id_array
from faultlens.operators.prefix import running_before
from faultlens.session import materialize, merged

NODE = ["app_id", "stage_id"]


def _with_listed_parents(stages: DataFrame) -> DataFrame:
    text = F.col("parent_ids") if "parent_ids" in stages.columns else F.lit("")
    return stages.withColumn("listed", parent_id_array(text))


def latest_attempts(stages: DataFrame) -> DataFrame:
    """One row per stage: the highest attempt, ties broken by the row itself, and whether any attempt lists a parent."""
    attempt = F.col("stage_attempt_id") if "stage_attempt_id" in stages.columns else F.lit(0)
    row = F.struct(
        attempt.alias("attempt"),
        F.coalesce("stage_name", F.lit("")).alias("stage_name"),
        F.coalesce("status", F.lit("UNKNOWN")).alias("status"),
        "failure_reason",
        "listed",
    )
    return (
        stages.groupBy(*NODE)
        .agg(F.max(row).alias("last"), F.max(F.size("listed") > 0).alias("any_listed"))
        .select(*NODE, "last.stage_name", "last.status", "last.failure_reason", "last.listed", "any_listed")
    )


def stage_nodes(stages: DataFrame) -> DataFrame:
    """Node table with parent ids.

    An application none of whose stages lists a parent falls back to a chain:
    each stage follows the stage with the next smaller id. A parent listed by
    any attempt counts for that choice.
    """
    # Stored, since the segments and the rows inside them are two passes.
    placed = running_before(
        materialize(latest_attempts(_with_listed_parents(stages)), "attempts"),
        ["app_id"],
        "stage_id",
        maxima={"previous_stage": F.col("stage_id")},
        any_in_group={"used_true_parents": F.col("any_listed")},
    )
    chained = F.when(F.col("previous_stage").isNotNull(), F.array("previous_stage")).otherwise(
        F.array().cast("array<int>")
    )
    return placed.select(
        *NODE,
        "stage_name",
        "status",
        "failure_reason",
        F.when(F.col("used_true_parents"), F.col("listed")).otherwise(chained).alias("parents"),
        "used_true_parents",
    )


def graph_mode(stages: DataFrame) -> DataFrame:
    """(app_id, used_true_parents) from the stage table: does any stage list a parent?"""
    listed = _with_listed_parents(stages)
    return listed.groupBy("app_id").agg(F.max(F.size("listed") > 0).alias("used_true_parents"))


def heuristic_chain(nodes: DataFrame) -> DataFrame:
    """The chain edges of the applications without listed parents."""
    return nodes.filter(~F.col("used_true_parents")).select(
        *NODE, F.element_at(F.when(F.size("parents") > 0, F.col("parents")), 1).alias("previous_stage_id")
    )


def declared_edges(nodes: DataFrame) -> DataFrame:
    """(app_id, parent_stage_id, child_stage_id), unknown parents included."""
    return nodes.select(
        "app_id",
        F.explode("parents").alias("parent_stage_id"),
        F.col("stage_id").alias("child_stage_id"),
    )


def edges_with_roots(nodes: DataFrame) -> DataFrame:
    """Edges seen from the child; a stage without parents gets parent -1."""
    return nodes.select(
        *NODE,
        F.explode(
            F.when(F.size("parents") > 0, F.col("parents")).otherwise(F.array(F.lit(-1)))
        ).alias("parent_stage_id"),
        "stage_name",
        "status",
    )


def known_edges(nodes: DataFrame) -> DataFrame:
    """Declared edges whose parent is a stage of the same application."""
    stages = nodes.select("app_id", F.col("stage_id").alias("parent_stage_id"))
    return declared_edges(nodes).join(merged(stages), ["app_id", "parent_stage_id"], "left_semi")


def with_child_counts(nodes: DataFrame) -> DataFrame:
    """Nodes with the number of their children and of their failed children.

    The edges are counted per parent before they meet the nodes, so a stage
    with very many children is one row by then.
    """
    children = (
        nodes.select("app_id", F.explode("parents").alias("stage_id"), is_failed().alias("failed"))
        .groupBy(*NODE)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("n_failed"))
    )
    return nodes.join(merged(children), NODE, "left").select(
        nodes["*"],
        F.coalesce("n", F.lit(0)).alias("child_count"),
        F.coalesce("n_failed", F.lit(0)).alias("failed_child_count"),
    )


def roots_and_leaves(nodes: DataFrame) -> DataFrame:
    """Every stage that has no declared parent (root) or no child (leaf)."""
    flags = with_child_counts(nodes).select(
        *NODE,
        (F.size("parents") == 0).alias("is_root"),
        (F.col("child_count") == 0).alias("is_leaf"),
    )
    return flags.filter(F.col("is_root") | F.col("is_leaf"))


def neighbors(nodes: DataFrame) -> DataFrame:
    """Both directions of every known edge, with the neighbour's own status."""
    edges = declared_edges(nodes)
    about = nodes.select("app_id", F.col("stage_id").alias("neighbor_id"), F.col("status").alias("neighbor_status"))
    parents = edges.select(
        "app_id",
        F.col("child_stage_id").alias("stage_id"),
        F.lit("parent").alias("relation"),
        F.col("parent_stage_id").alias("neighbor_id"),
    ).join(merged(about), ["app_id", "neighbor_id"])
    children = known_edges(nodes).select(
        "app_id",
        F.col("parent_stage_id").alias("stage_id"),
        F.lit("child").alias("relation"),
        F.col("child_stage_id").alias("neighbor_id"),
    ).join(merged(about), ["app_id", "neighbor_id"])
    return parents.unionByName(children).select(*NODE, "relation", "neighbor_id", "neighbor_status")


def failed_stages(nodes: DataFrame) -> DataFrame:
    return with_child_counts(nodes).filter(is_failed()).select(
        *NODE, "stage_name", "failure_reason", (F.col("child_count") == 0).alias("is_leaf")
    )


def first_failed_leaf(nodes: DataFrame) -> DataFrame:
    """Per application the failed leaf with the smallest id, where there is one."""
    return failed_stages(nodes).filter("is_leaf").groupBy("app_id").agg(F.min("stage_id").alias("stage_id"))
