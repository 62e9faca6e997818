"""Pipe-separated text tables and their conversion to Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Text table schemas (fixed): dates stay text, prices are doubles.
SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_address STRING, c_nationkey BIGINT, c_phone STRING,"
    " c_acctbal DOUBLE, c_mktsegment STRING, c_comment STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate STRING, l_commitdate STRING, l_receiptdate STRING, l_shipinstruct STRING, l_shipmode STRING,"
    " l_comment STRING",
    "nation": "n_nationkey BIGINT, n_name STRING, n_regionkey BIGINT, n_comment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate STRING,"
    " o_orderpriority STRING, o_clerk STRING, o_shippriority INT, o_comment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_mfgr STRING, p_brand STRING, p_type STRING, p_size INT,"
    " p_container STRING, p_retailprice DOUBLE, p_comment STRING",
    "partsupp": "ps_partkey BIGINT, ps_suppkey BIGINT, ps_availqty INT, ps_supplycost DOUBLE, ps_comment STRING",
    "region": "r_regionkey BIGINT, r_name STRING, r_comment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_address STRING, s_nationkey BIGINT, s_phone STRING,"
    " s_acctbal DOUBLE, s_comment STRING",
}


def read_delimited(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of pipe-separated text; a closing pipe at the line end is ignored."""
    return spark.read.schema(schema).option("sep", "|").option("header", "false").csv(path)


def read_raw_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    if name not in SCHEMAS:
        raise ValueError(f"no such table: {name}")
    return read_delimited(spark, f"{folder}/{name}.tbl", SCHEMAS[name])


def write_delimited(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "|").option("header", "false").csv(path)


def convert_table(spark: SparkSession, name: str, source: str, target: str) -> None:
    """One text table to snappy Parquet.

    Every table is dealt out anew by its size: Spark aims at partitions of
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` and splits what is
    larger, so a table of any size is written by as many tasks as it needs.
    """
    rows = read_raw_table(spark, name, source).hint("rebalance")
    rows.write.mode("overwrite").option("compression", "snappy").parquet(f"{target}/{name}")


def convert_all(spark: SparkSession, source: str, target: str) -> dict[str, str | None]:
    """Convert every table; a failing table does not stop the others.

    Returns the error text per table, None where the conversion worked.
    """
    outcome: dict[str, str | None] = {}
    for name in SCHEMAS:
        try:
            convert_table(spark, name, source, target)
            outcome[name] = None
        except Exception as problem:
            outcome[name] = str(problem)
    return outcome
