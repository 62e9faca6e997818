"""From raw documents to packed training sequences, in five stages.

Each stage takes the session, the documents that its predecessor kept and the
folder of the tables. All but the last return the columns of documents. Between
stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import decontaminate, minmax, packing, pii, toxicity
from faultlens.llm.common import ship, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go. It learns from the labelled rows of ``docs`` that are not held out.

    Rows go or stay by their text alone, so null and repeated doc_ids do not
    matter; a null text is scored as an empty one.
    """
    ship(spark)
    network = toxicity.train(*toxicity.training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.without_toxic(docs, network)


#: Names a row by its id and text, so that rows without an id, or with another row's, are told apart.
KEY = "row_key__"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def _operand(keyed: DataFrame) -> DataFrame:
    """What an operator sees: the row key as the id."""
    return keyed.select(F.col(KEY).alias("doc_id"), "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, similarity 0.8), and one of equal rows.

    Of a group the smallest doc_id stays, a null one only if there is no other.
    Rows are told apart by doc_id and text; of those that agree in both one stays.
    """
    ship(spark)
    keyed = _keyed(docs)
    groups = minmax.near_duplicates(_operand(keyed), size=5, percent=80).select(F.col("doc_id").alias(KEY), F.col("component_id").alias("group"))
    named = keyed.select(KEY, "doc_id").join(groups.distinct(), KEY)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", KEY)
    leaders = named.groupBy("group").agg(F.min(order).alias("leader"), F.count("*").alias("rows")).filter("rows > 1")
    leaders = store(leaders.select("group", F.col(f"leader.{KEY}").alias("leader")), "leaders")
    # Groups of more than one row: copies go, and of equal rows of the leader one stays.
    copies = groups.distinct().join(leaders, "group").filter(F.col(KEY) != F.col("leader")).select(KEY)
    kept = keyed.join(store(copies, "copies"), KEY, "left_anti")
    several = store(named.groupBy(KEY).agg(F.count("*").alias("rows")).filter("rows > 1").select(KEY), "equal")
    once = kept.join(several, KEY, "left_anti").unionByName(kept.join(several, KEY, "left_semi").dropDuplicates([KEY]))
    return once.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go; rows are told apart by doc_id and text."""
    ship(spark)
    keyed = _keyed(docs)
    found = decontaminate.contaminated(_operand(keyed), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias(KEY)).distinct()
    return keyed.join(store(found, "contaminated"), KEY, "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows."""
    ship(spark)
    redacted = pii.redacted(docs, pii.train(pii.training_texts(docs)))
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of all documents in sequences of at most 2,048; a null text is empty, null and repeated doc_ids are packed like any others."""
    ship(spark)
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: No SQL for a trained network; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
