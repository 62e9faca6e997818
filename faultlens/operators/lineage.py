"""Ancestors, descendants, depth, acyclicity and the per-application summary.

Applications in chain mode need no iteration: everything before a stage is an
ancestor, everything after it a descendant, and the depth is the number of
stages. Only applications with listed parents go through the closure rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.operators.closure import longest_paths, reach
from faultlens.operators.graph import NODE, declared_edges, roots_and_leaves
from faultlens.session import materialize, merged

_SEED = ["app_id", "seed_stage_id"]


def _listed(nodes: DataFrame) -> DataFrame:
    return nodes.filter("used_true_parents")


def _chained(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.col("used_true_parents"))


def _lineage(nodes: DataFrame, seeds: DataFrame, edges: DataFrame, name: str, upwards: bool) -> DataFrame:
    """``seeds`` has app_id and stage_id; seeds that are no stage find nothing."""
    wanted = seeds.select("app_id", F.col("stage_id").alias("seed_stage_id")).distinct()
    start = wanted.join(
        merged(_listed(nodes).select("app_id", F.col("stage_id").alias("seed_stage_id"))), _SEED, "left_semi"
    ).withColumn("at", F.col("seed_stage_id"))
    walked = reach(start, materialize(edges, "edges"), _SEED, include_seeds=False)

    stage = F.col("stage_id")
    side = stage < F.col("seed_stage_id") if upwards else stage > F.col("seed_stage_id")
    chain = _chained(nodes).select(*NODE)
    chain_seeds = wanted.join(merged(chain.withColumnRenamed("stage_id", "seed_stage_id")), _SEED, "left_semi")
    in_chain = chain.join(merged(chain_seeds), "app_id").filter(side).select(*_SEED, F.col("stage_id").alias(name))
    return walked.select(*_SEED, F.col("at").alias(name)).unionByName(in_chain)


def ancestors(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(app_id, seed_stage_id, ancestor_id); unknown parents count as ancestors."""
    edges = declared_edges(_listed(nodes)).select(
        "app_id", F.col("child_stage_id").alias("at"), F.col("parent_stage_id").alias("next")
    )
    return _lineage(nodes, seeds, edges, "ancestor_id", upwards=True)


def descendants(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(app_id, seed_stage_id, descendant_id)."""
    edges = declared_edges(_listed(nodes)).select(
        "app_id", F.col("parent_stage_id").alias("at"), F.col("child_stage_id").alias("next")
    )
    return _lineage(nodes, seeds, edges, "descendant_id", upwards=False)


def depth_and_cycles(nodes: DataFrame) -> DataFrame:
    """(app_id, depth, is_acyclic).

    The depth is the longest path counted in stages, an unknown parent being
    one more stage at the top. It is NULL for applications with a cycle.
    """
    # An unknown parent is no child of any edge, so it counts as a first layer.
    edges = declared_edges(_listed(nodes)).select(
        "app_id", F.col("parent_stage_id").alias("parent"), F.col("child_stage_id").alias("child")
    )
    walked = longest_paths(edges).select("app_id", F.col("depth").cast("int").alias("depth"), F.col("depth").isNotNull().alias("is_acyclic"))
    chain = (
        _chained(nodes)
        .groupBy("app_id")
        .agg(F.count(F.lit(1)).cast("int").alias("depth"))
        .withColumn("is_acyclic", F.lit(True))
    )
    return walked.unionByName(chain)


def graph_summary(nodes: DataFrame) -> DataFrame:
    """One row per application: counts, depth, acyclicity and graph mode."""
    counts = nodes.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("stage_count"),
        F.count_if(F.col("status") == "FAILED").alias("failed_count"),
        F.max("used_true_parents").alias("used_true_parents"),
    )
    ends = (
        roots_and_leaves(nodes)
        .groupBy("app_id")
        .agg(F.count_if("is_root").alias("root_count"), F.count_if("is_leaf").alias("leaf_count"))
    )
    return (
        counts.join(merged(ends), "app_id", "left")
        .join(merged(depth_and_cycles(nodes)), "app_id", "left")
        .select(
            "app_id",
            "stage_count",
            "failed_count",
            F.coalesce("root_count", F.lit(0)).alias("root_count"),
            F.coalesce("leaf_count", F.lit(0)).alias("leaf_count"),
            "depth",
            "is_acyclic",
            "used_true_parents",
        )
    )
