"""Tables stored in buckets of a key, so that joins on the key read bucket beside bucket and move nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.session import scratch_path

#: Estimated bytes of a bucket, and the most buckets of a table.
BUCKET_BYTES, BUCKETS = 256 << 20, 1 << 14
#: Rows of a bucket, since well packed files say little about the room that rows take in memory.
BUCKET_ROWS = 1 << 20


def bucket_count(*tables: DataFrame, rows: int = 0) -> int:
    """Buckets for tables that are to be joined: a power of two, by the largest one's size as the optimizer estimates it and by its ``rows`` if the caller knows them."""
    sizes = [int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in tables]
    return 1 << min(BUCKETS, max(-(-max(sizes) // BUCKET_BYTES), -(-rows // BUCKET_ROWS))).bit_length()


def bucketed(df: DataFrame, key: str, buckets: int, name: str, path: str | None = None) -> DataFrame:
    """Store ``df`` in ``buckets`` buckets of ``key``, sorted by it inside, as a table of the session's catalog.

    Each bucket is written by one task, which is the only time that the rows
    move. All rows of a key are in one bucket, so a key that very many rows
    share is better joined without buckets, where Spark can split it. Without
    ``path`` the files are in the scratch folder and the name gets a suffix.
    """
    spark = df.sparkSession
    if path is None:
        path, name = scratch_path(spark, name), f"{name}_{uuid.uuid4().hex[:12]}"
    dealt = df.repartition(buckets, F.col(key))
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)
