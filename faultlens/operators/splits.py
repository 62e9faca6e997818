"""Train and test sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_percent(key: str) -> Column:
    """A number from 0 to 99 that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("bigint") % 100


def split_by_key(df: DataFrame, key: str = "app_id", train_percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key.

    The same application lands on the same side whatever the partitioning, and
    also when a lost executor makes Spark recompute part of the input.
    """
    in_train = hash_percent(key) < train_percent
    return df.filter(in_train), df.filter(~in_train)


def random_split(df: DataFrame, train_share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Spark's own random split; the rows depend on how ``df`` is partitioned."""
    train, test = df.randomSplit([train_share, 1 - train_share], seed=seed)
    return train, test
