"""Parquet tables: scans, views, row counts and storage inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.columns import format_bytes


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or no rows of ``schema`` where nothing is there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def register_views(spark: SparkSession, folder: str, names: list[str], suffix: str = "") -> list[str]:
    """Temporary views for the tables that exist; returns their names."""
    found = [n for n in names if path_exists(spark, f"{folder}/{n}{suffix}")]
    for name in found:
        spark.read.parquet(f"{folder}/{name}{suffix}").createOrReplaceTempView(name)
    return found


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table; the counts come from file footers alone."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, files and bytes of every table, from what the scans know of their files; a table without rows has no files here."""
    parts = []
    for name, df in tables.items():
        files = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("size"))
        sums = [F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")]
        parts.append(files.agg(*sums).select(F.lit(name).alias("table_name"), "row_count", "files", "bytes"))
    return reduce(DataFrame.unionByName, parts).withColumn("size", format_bytes(F.col("bytes")))


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file below ``folder``; the file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "modificationTime", "length")
    )


def storage_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes per directory below ``folder``."""
    return (
        stored_files(spark, folder)
        .groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
        .withColumn("size", format_bytes(F.col("bytes")))
    )


def table_summary(spark: SparkSession, folder: str, names: list[str], suffix: str = "") -> DataFrame:
    """Rows and bytes of every named table, ``NOT FOUND`` where it is absent."""
    found = [n for n in names if path_exists(spark, f"{folder}/{n}{suffix}")]
    asked = reduce(DataFrame.unionByName, [spark.range(1).select(F.lit(n).alias("table_name")) for n in names])
    if not found:
        return asked.select(
            "table_name",
            F.lit(None).cast("bigint").alias("row_count"),
            F.lit(None).cast("bigint").alias("bytes"),
            F.lit("NOT FOUND").alias("size"),
        )
    counts = row_counts({n: spark.read.parquet(f"{folder}/{n}{suffix}") for n in found})
    sizes = reduce(
        DataFrame.unionByName,
        [
            stored_files(spark, f"{folder}/{n}{suffix}").agg(F.sum("length").alias("bytes")).withColumn("table_name", F.lit(n))
            for n in found
        ],
    )
    return (
        asked.join(counts, "table_name", "left")
        .join(sizes, "table_name", "left")
        .select(
            "table_name",
            "row_count",
            "bytes",
            F.coalesce(format_bytes(F.col("bytes")), F.lit("NOT FOUND")).alias("size"),
        )
    )
