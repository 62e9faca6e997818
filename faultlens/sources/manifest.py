"""The run manifest: which runs of which failure type ended how."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.constants import COMPLETED_STATUSES, MANIFEST_COLUMNS
from faultlens.session import materialize
from faultlens.sources.tables import path_exists

_SCHEMA = ", ".join(f"{c} STRING" for c in MANIFEST_COLUMNS)
_RUN = ["FailureType", "RunId"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the CSV file or folder, fields trimmed, Label as a number."""
    rows = spark.read.schema(_SCHEMA).option("header", "true").csv(path)
    trimmed = rows.select(*[F.trim(c).alias(c) for c in MANIFEST_COLUMNS])
    return trimmed.withColumn("Label", F.col("Label").try_cast("int"))


def append_runs(runs: DataFrame, path: str) -> int:
    """Add the runs that are not there yet, as new files; returns how many.

    An entry is known by its type, run and time, so a job that is repeated, or
    was lost after a part of its files appeared, adds nothing twice. Of what is
    there only these columns are read, and nothing is rewritten. One job at a
    time may append.
    """
    spark = runs.sparkSession
    entry = [*_RUN, "Timestamp"]
    # A file does not tell an empty field from a missing one.
    fresh = runs.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in MANIFEST_COLUMNS]).dropDuplicates(entry)
    if path_exists(spark, path):
        there = read_manifest(spark, path).select(*entry).distinct()
        same = reduce(lambda a, b: a & b, [fresh[c].eqNullSafe(there[c]) for c in entry])
        fresh = fresh.join(there, same, "left_anti")
    fresh = materialize(fresh, "runs")
    count = fresh.count()
    if count:
        fresh.write.mode("append").option("header", "true").csv(path)
    return count


def completed_runs(manifest: DataFrame) -> DataFrame:
    """Runs that left a usable event log; timeouts and errors are to be repeated."""
    return manifest.filter(F.col("Status").isin(*COMPLETED_STATUSES)).select(*_RUN).distinct()


def pending_runs(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    return planned.select(*_RUN).distinct().join(completed_runs(manifest), _RUN, "left_anti")


def summary(manifest: DataFrame) -> DataFrame:
    """Submitted and failed submissions per scenario."""
    return manifest.groupBy("FailureType", "Label").agg(
        F.count_if(F.col("Status").isin(*COMPLETED_STATUSES)).alias("submitted"),
        F.count_if(F.col("Status").startswith("ERROR")).alias("errors"),
    )
