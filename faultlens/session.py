"""Session settings for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, name: str = "faultlens") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Recording the Python call site of every column costs more than planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, because a folder on one machine
    would not survive the loss of that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="faultlens-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    root = f"{shared_folder(spark)}/faultlens-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(root)
    return f"{root}/{name}"


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch tables made inside are removed at the end, so results must be stored elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for root in _scopes.pop():
            remove(spark, root)


#: Spark's setting for removing the shuffles of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffles of what is written inside are removed once it is written; else they lie beside it until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a scratch file or folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage, so iterative jobs neither re-plan nor recompute earlier
    rounds, and a lost executor only re-reads files. The read side also has
    real file sizes, which is what Spark checks before it broadcasts a side.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a table may be sent whole to every task, whatever its files' size says.
SENT_ROWS = 100_000


def merged(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, never sent whole to every task.

    The optimizer goes by the size of files and shuffles, and packed ids take a
    fiftieth of their room in memory, so tables of millions of rows pass its
    limit. With ``rows``, the known size, a small table is left to the optimizer.
    """
    return df if rows is not None and rows <= SENT_ROWS else df.hint("merge")


def broadcast_if_small(df: DataFrame, limit: int = 10 << 20) -> DataFrame:
    """Ask for a broadcast if the optimizer's size estimate is within ``limit``.

    A larger side stays as it is and is joined by shuffling.
    """
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(estimate)) <= limit else df
