"""The registered queries: each applies one operator to its whole table; those named ``text_`` give what SQL can check of one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import (
    blob_secrets,
    decontaminate,
    language,
    lexical,
    licenses,
    minmax,
    packing,
    pii,
    ring,
    simhash,
    suffix_dedup,
    toxicity,
    whitening,
)
from faultlens.llm.common import ship, store


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a copy of a benchmark item, whole or edited."""
    return decontaminate.contaminated(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op2_minmax(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components: sets of 4-word shingles, similarity 0.8."""
    return minmax.near_duplicates(_documents(spark, folder), size=4, percent=80)


def op3_ring(spark: SparkSession, folder: str) -> DataFrame:
    """All documents on 16 shards whose counts are at most one apart."""
    return ring.document_shards(_documents(spark, folder), shards=16)


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text, by patterns and the semi-Markov field."""
    return pii.personal_data(_documents(spark, folder))


def op5_blob_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every text, each distinct text scanned once."""
    return blob_secrets.document_secrets(_documents(spark, folder))


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licences in every text, by sentences."""
    return licenses.licensed(_documents(spark, folder))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and what is near."""
    return simhash.document_fingerprints(_documents(spark, folder))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens."""
    return packing.packed_documents(_documents(spark, folder))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text; labels teach from rows that are not held out."""
    return toxicity.toxicity(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What remains of every document without 100-byte strings that start earlier."""
    return suffix_dedup.deduplicated(_documents(spark, folder)).drop("spans")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings on their 16 leading components, whitened."""
    ship(spark)
    return whitening.whitened_embeddings(spark.read.parquet(f"{folder}/embeddings.parquet"), wanted=16)


def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that rank highest for every benchmark item."""
    return lexical.search(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), top=10)


def op13_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every text; lang teaches from rows that are not held out."""
    return language.languages_of(_documents(spark, folder))


def text_edited_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The edited texts that op7 fingerprints."""
    return op7_simhash(spark, folder).select("doc_id", "n_chars", "edited_sha256")


def text_whitening_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The whole numbers of op11, once for each vector."""
    return op11_whitening(spark, folder).filter("component = 1").select("vec_id", "n", "deviation")


def text_personal_data_base(spark: SparkSession, folder: str) -> DataFrame:
    """What op4 finds by its fixed patterns, in counts and hashes that SQL can express."""
    return op4_personal_data(spark, folder).select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256")


def text_secrets_base(spark: SparkSession, folder: str) -> DataFrame:
    """What op5 finds by its base rules."""
    return op5_blob_secrets(spark, folder).select("doc_id", *[f"n_{r.name}" for r in blob_secrets.RULES if r.base], "base_sha256")


def text_ring_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of op3, whether its shards differ by one at most, and whether each shard's slots are 0, 1, 2 and so on."""
    placed = op3_ring(spark, folder)
    shards = placed.groupBy("shard").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high")
    )
    return shards.agg(
        F.sum("n").alias("documents"),
        F.sum("bytes").alias("bytes"),
        F.count("*").alias("shards"),
        (F.max("n") - F.min("n") <= 1).alias("even"),
        F.bool_and((F.col("low") == 0) & (F.col("slots") == F.col("n")) & (F.col("high") == F.col("n") - 1)).alias("gapless"),
    )


def text_packing_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Of op8: documents packed, those with a first piece, those cut although they fit, and whether pieces and places follow each other."""
    pieces = store(op8_packing(spark, folder), "packed")
    size = packing.CAPACITY
    documents = pieces.groupBy("doc_id").agg(
        F.count("*").alias("pieces"),
        F.sum("length").alias("tokens"),
        F.max("piece").alias("last"),
        F.count(F.when((F.col("piece") == 0) & (F.col("start") == 0), 1)).alias("begun"),
        F.max(F.col("start") + F.col("length")).alias("end"),
        F.count(F.when((F.col("piece") > 0) & (F.col("length") != size), 1)).alias("short"),
    )
    whole = (F.col("last") == F.col("pieces") - 1) & (F.col("end") == F.col("tokens")) & (F.col("short") == 0)
    documents = documents.agg(
        F.count("*").alias("documents"), F.sum("begun").alias("begun"),
        F.count(F.when((F.col("pieces") > 1) & (F.col("tokens") <= size), 1)).alias("cut_without_need"), F.bool_and(whole).alias("whole"),
    )
    sequences = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("low"), F.countDistinct("offset").alias("places"), F.count("*").alias("n")
    )
    follow = (F.col("low") == 0) & (F.col("end") == F.col("tokens")) & (F.col("places") == F.col("n"))
    sequences = sequences.agg(F.bool_and(follow).alias("gapless"), F.bool_and(F.col("tokens") <= size).alias("fit"))
    # Two rows, each with half of the columns.
    both = documents.unionByName(sequences, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_decontaminate,
        op2_minmax,
        op3_ring,
        op4_personal_data,
        op5_blob_secrets,
        op6_licenses,
        op7_simhash,
        op8_packing,
        op9_toxicity,
        op10_repeats,
        op11_whitening,
        op12_lexical,
        op13_language,
        text_edited_documents,
        text_whitening_totals,
        text_personal_data_base,
        text_secrets_base,
        text_ring_balance,
        text_packing_balance,
    )
    return {f.__name__: f for f in found}
