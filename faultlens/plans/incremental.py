"""Result tables that follow the logs: new and changed files only, as batches or as a stream.

Applications are dealt to buckets by a hash of their id. Parsed events are kept
by bucket, each with the file it came from. An update parses the files that are
new or changed, replaces what the same files gave before in the buckets they
touch, and rebuilds all result tables for these buckets alone; the others are
not read. Every step overwrites whole buckets and the ledger of files is
written last, so an update that was lost half-way is simply done again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.constants import APPLICATION_END
from faultlens.plans.preprocess import OUTPUTS, result_tables
from faultlens.session import materialize, scratch_scope
from faultlens.sources import event_logs
from faultlens.sources.tables import parquet_or_empty, path_exists, stored_files

#: Buckets of applications. An update rewrites the buckets it touches, so their number sets the least work of one.
BUCKETS = 256

_FILE = "file STRING, length BIGINT, modified TIMESTAMP"


def bucket_of(app_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(app_id), F.lit(buckets)).cast("int")


def _same_name(path: Column) -> Column:
    """Both ways to write a local path name the same file."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _ledger(spark: SparkSession, store: str) -> tuple[DataFrame, int]:
    """The files that are in the result, and the number of the ledger's version."""
    versions = parquet_or_empty(spark, f"{store}/ledger", spark.createDataFrame([], f"{_FILE}, version INT").schema)
    last = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == (last or 0)).drop("version"), last or 0


def changed_files(spark: SparkSession, logs: str, store: str) -> tuple[DataFrame, DataFrame]:
    """(file, length, modified) of the log files that are not in the ledger as they are now, and files of the ledger that are gone."""
    known, _ = _ledger(spark, store)
    paths = event_logs.labelled_paths(spark, logs)
    if not paths:
        return spark.createDataFrame([], _FILE), known
    listed = [stored_files(spark, p) for p in paths]
    there = listed[0]
    for more in listed[1:]:
        there = there.unionByName(more)
    there = there.filter(F.regexp_extract("path", event_logs.PLACE, 1) != "")
    there = there.select(_same_name(F.col("path")).alias("file"), "length", F.col("modificationTime").alias("modified"))
    return there.join(known, ["file", "length", "modified"], "left_anti"), known.join(there, "file", "left_anti")


def update(spark: SparkSession, logs: str, store: str, buckets: int = BUCKETS, only_ended: bool = False) -> int:
    """Bring the tables in ``store`` up to the logs below ``logs``; returns the number of files parsed.

    With ``only_ended`` an application is in the result tables once its end
    event has been read; without, as soon as anything of it is there.
    """
    with scratch_scope(spark):
        fresh, gone = (materialize(df, "files") for df in changed_files(spark, logs, store))
        count, lost = fresh.count(), gone.count()
        if count or lost:
            lines = event_logs.scan_event_logs(spark, logs, counts=None, ends=True)
            wanted = lines.withColumn("file", _same_name(F.col("file"))).join(fresh.select("file"), "file", "left_semi") if count else lines.limit(0)
            replaced = fresh.select("file").unionByName(gone.select("file"))
            apply_lines(wanted, replaced, store, buckets, only_ended)
            known, version = _ledger(spark, store)
            kept = known.join(replaced, "file", "left_anti")
            kept.unionByName(fresh).withColumn("version", F.lit(version + 1)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("version").parquet(f"{store}/ledger")
    return count


def _write(rows: DataFrame, path: str) -> None:
    """Replace the buckets that ``rows`` has; the others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def apply_lines(lines: DataFrame, replaced: DataFrame, store: str, buckets: int = BUCKETS, only_ended: bool = False) -> None:
    """Put ``lines`` (app_id, label, file, value), whole files, in place of what ``replaced`` (file) gave before."""
    spark = lines.sparkSession
    events = f"{store}/events"
    fresh = event_logs.event_rows(lines).withColumn("bucket", bucket_of(F.col("app_id"), buckets))
    fresh = materialize(fresh, "fresh")
    old = parquet_or_empty(spark, events, fresh.schema).select(*fresh.columns)
    replaced = materialize(replaced.select("file").distinct(), "replaced")
    touched = fresh.select("bucket").unionByName(old.join(replaced, "file", "left_semi").select("bucket")).distinct()
    # At most one number for each bucket, so the files of all others are not even opened.
    numbers = [r.bucket for r in touched.collect()]
    old = old.filter(F.col("bucket").isin(numbers)).join(replaced, "file", "left_anti")
    now = materialize(old.unionByName(fresh), "events")
    _emptied(spark, events, numbers, now)
    _write(now, events)
    if only_ended:
        now = now.join(now.filter(F.col("kind") == APPLICATION_END).select("app_id").distinct(), "app_id", "left_semi")
    for name, rows in result_tables(*event_logs.tables_of(now)).items():
        rows = materialize(rows.withColumn("bucket", bucket_of(F.col("app_id"), buckets)), name)
        # The columns, for as long as the table has no rows.
        rows.drop("bucket").limit(0).write.mode("ignore").parquet(f"{store}/columns/{name}")
        _emptied(spark, f"{store}/{name}.parquet", numbers, rows)
        _write(rows, f"{store}/{name}.parquet")


def _emptied(spark: SparkSession, path: str, numbers: list[int], rows: DataFrame) -> None:
    """Remove the buckets of which nothing is left; writing ``rows`` replaces only buckets that have some."""
    left = {r.bucket for r in rows.select("bucket").distinct().collect()}
    for number in set(numbers) - left:
        place = f"{path}/bucket={number}"
        if path_exists(spark, place):
            target = spark._jvm.org.apache.hadoop.fs.Path(place)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def result(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A result table as it is now."""
    if name not in OUTPUTS:
        raise ValueError(f"no such table: {name}")
    columns = spark.read.parquet(f"{store}/columns/{name}").schema
    return parquet_or_empty(spark, f"{store}/{name}.parquet", columns).select(*columns.names)


def follow(spark: SparkSession, logs: str, store: str, checkpoint: str, buckets: int = BUCKETS, files_at_once: int = 1000, **trigger):
    """A stream over the logs below ``logs``: applications enter the result tables when their end event has been read.

    Files may come in any order, rolled parts after the end event too; they
    have to appear whole. A batch that is repeated after a restart replaces
    what it wrote. ``trigger`` is that of ``writeStream``, by default all files
    that are there now.
    """

    def batch(lines: DataFrame, number: int) -> None:
        with scratch_scope(spark):
            lines = materialize(lines, "lines")
            apply_lines(lines, lines.select("file"), store, buckets, only_ended=True)

    lines = event_logs.stream_event_logs(spark, logs, files_at_once)
    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
