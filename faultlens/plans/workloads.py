"""The analytic workloads over the order tables.

Three habits keep them cheap and safe at scale. Order lines are the large,
possibly skewed side. Where an answer needs one figure per order they are summed
per order first: the sum has the partitioning the join needs, so it costs no
shuffle of its own, and a hot order is one row by then. Where lines keep a second
key (supplier, part), summing first would cost a shuffle and shrink nothing, so
they are joined as they are. Prices are summed as decimals, so no answer depends
on row order. Join strategies are left to Spark, which checks sizes before it
broadcasts, and which splits skewed sort-merge partitions at run time.

Every top-k has a unique tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.columns import exact, money, net_price, rate, total
from faultlens.session import broadcast_if_small, materialize
from faultlens.sources.bucketed import bucket_count, bucketed
from faultlens.sources.tables import table

class Tables(dict):
    """The given tables by name, each opened when a query first asks for it."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def __missing__(self, name: str) -> DataFrame:
        self[name] = table(self.spark, self.folder, name)
        return self[name]


def _in_dates(column: str, start: str, end: str):
    """start <= column < end; the texts become literals of the column's own type,
    so the test reaches the scan whether dates are stored as time or as text."""
    return (F.col(column) >= start) & (F.col(column) < end)


def _lines_per_order(lines: DataFrame, *sums) -> DataFrame:
    return lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*sums)


def _orders_of_customers(t: Tables, *order_columns: str) -> DataFrame:
    return t["orders"].select("o_orderkey", F.col("o_custkey").alias("c_custkey"), *order_columns)


def part_suppliers(t: Tables) -> DataFrame:
    """The pairs of part and supplier that were ever ordered."""
    return t["lineitem"].select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()


def shipping_priority(t: Tables, segment: str = "BUILDING", day: str = "1996-03-15", k: int = 100) -> DataFrame:
    """Open orders of a market segment by revenue still to be shipped."""
    revenue = _lines_per_order(t["lineitem"].filter(F.col("l_shipdate") > day), F.sum(net_price()).alias("revenue"))
    customers = t["customer"].filter(F.col("c_mktsegment") == segment).select("c_custkey")
    return (
        _orders_of_customers(t, "o_orderdate")
        .filter(F.col("o_orderdate") < day)
        .join(customers, "c_custkey")
        .join(revenue, "o_orderkey")
        .groupBy(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
        .agg(total("revenue").alias("revenue"))
        .orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey")
        .limit(k)
    )


def order_priority(t: Tables, start: str = "1996-07-01", end: str = "1996-10-01") -> DataFrame:
    """Orders of a quarter with a line shipped after the order, by priority.

    The latest shipment per order decides, so each order is looked up once.
    """
    latest = _lines_per_order(t["lineitem"], F.max("l_shipdate").alias("last_ship"))
    return (
        t["orders"]
        .filter(_in_dates("o_orderdate", start, end))
        .join(latest, "o_orderkey")
        .filter(F.col("last_ship") > F.col("o_orderdate"))
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("order_count"))
        .orderBy("o_orderpriority")
    )


def _returned_revenue(t: Tables, start: str, end: str) -> DataFrame:
    """Revenue of returned lines per customer, for orders of a period."""
    returned = _lines_per_order(t["lineitem"].filter(F.col("l_returnflag") == "R"), F.sum(net_price()).alias("net"))
    return (
        _orders_of_customers(t, "o_orderdate")
        .filter(_in_dates("o_orderdate", start, end))
        .join(returned, "o_orderkey")
        .groupBy("c_custkey")
        .agg(F.sum("net").alias("net"))
    )


def returned_revenue(t: Tables, start: str = "1996-10-01", end: str = "1997-01-01", k: int = 50) -> DataFrame:
    nations = t["nation"].select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return (
        _returned_revenue(t, start, end)
        .join(t["customer"].select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), "c_custkey")
        .join(nations, "c_nationkey")
        .groupBy("c_custkey", "c_name", "c_acctbal", "n_name")
        .agg(total("net").alias("revenue"))
        .orderBy(F.desc("revenue"), "c_custkey")
        .limit(k)
    )


def returned_revenue_by_customer(
    t: Tables, start: str = "1996-10-01", end: str = "1997-01-01", k: int = 20
) -> DataFrame:
    nations = t["nation"].select(F.col("n_nationkey").alias("c_nationkey"))
    return (
        _returned_revenue(t, start, end)
        .join(t["customer"].select("c_custkey", "c_name", "c_nationkey"), "c_custkey")
        .join(nations, "c_nationkey")
        .groupBy("c_custkey", "c_name")
        .agg(total("net").alias("revenue"))
        .orderBy(F.desc("revenue"), "c_custkey")
        .limit(k)
    )


def mode_priority(t: Tables, start: str = "1996-01-01", end: str = "1997-01-01") -> DataFrame:
    """Lines shipped in a year by return flag, split by order priority."""
    lines = (
        t["lineitem"]
        .filter(F.col("l_returnflag").isin("R", "A") & _in_dates("l_shipdate", start, end))
        .select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    )
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (
        lines.join(t["orders"].select("o_orderkey", "o_orderpriority"), "o_orderkey")
        .groupBy("l_returnflag")
        .agg(F.count_if(urgent).alias("high_line_count"), F.count_if(~urgent).alias("low_line_count"))
        .orderBy("l_returnflag")
    )


def _by_supplier_nation(t: Tables, per_supplier: DataFrame) -> DataFrame:
    """Attach nation names to rows keyed by supplier."""
    suppliers = t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nations = broadcast_if_small(t["nation"].select("n_nationkey", "n_name"))
    return per_supplier.join(broadcast_if_small(suppliers), "l_suppkey").join(nations, "n_nationkey")


def _lines_in_orders(t: Tables, lines: DataFrame, *order_columns: str) -> DataFrame:
    """Order lines, one by one, next to their order."""
    orders = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), *order_columns)
    return lines.join(orders, "l_orderkey")


def _sums_in_orders(t: Tables, lines: DataFrame, sums: list, *order_columns: str) -> DataFrame:
    """Order lines summed per order, then joined with their order."""
    return _lines_per_order(lines, *sums).join(t["orders"].select("o_orderkey", *order_columns), "o_orderkey")


def part_revenue(t: Tables, word: str = "red") -> DataFrame:
    """Revenue by nation for the parts whose name has a word in it."""
    parts = t["part"].filter(F.col("p_name").contains(word)).select(F.col("p_partkey").alias("l_partkey"))
    lines = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", money("l_extendedprice").alias("price"))
    per_supplier = (
        _lines_in_orders(t, lines.join(parts, "l_partkey")).groupBy("l_suppkey").agg(F.sum("price").alias("price"))
    )
    return _by_supplier_nation(t, per_supplier).groupBy("n_name").agg(total("price").alias("total")).orderBy(F.desc("total"), "n_name")


def revenue_by_nation(t: Tables) -> DataFrame:
    lines = t["lineitem"].select("l_orderkey", "l_suppkey", money("l_extendedprice").alias("price"))
    per_supplier = _lines_in_orders(t, lines).groupBy("l_suppkey").agg(F.sum("price").alias("price"))
    per_nation = _by_supplier_nation(t, per_supplier).groupBy("n_name").agg(total("price").alias("total_price"))
    return per_nation.orderBy(F.desc("total_price"), "n_name")


def composite_key_join(t: Tables) -> DataFrame:
    """Lines that match a part-supplier pair, counted by order status.

    The pairs are stored first: with a stored table on either side Spark can
    split the partition of a pair that very many lines share.
    """
    pairs = materialize(part_suppliers(t), "partsupp")
    lines = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey")
    matched = lines.join(
        pairs, (F.col("l_partkey") == F.col("ps_partkey")) & (F.col("l_suppkey") == F.col("ps_suppkey"))
    )
    return (
        _sums_in_orders(t, matched, [F.count(F.lit(1)).alias("n")], "o_orderstatus")
        .groupBy("o_orderstatus")
        .agg(F.sum("n").alias("cnt"))
        .orderBy(F.desc("cnt"), "o_orderstatus")
    )


def bucketed_join(t: Tables) -> DataFrame:
    """Lines and revenue by order status; lines and orders are stored in buckets of the order key and joined without a shuffle."""
    lines = t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_discount", "l_quantity")
    orders = t["orders"].select("o_orderkey", "o_orderstatus")
    buckets = bucket_count(lines, orders, rows=max(lines.count(), orders.count()))
    lines, orders = (bucketed(df, "o_orderkey", buckets, name) for df, name in ((lines, "lines"), (orders, "orders")))
    return (
        lines.hint("merge")
        .join(orders, "o_orderkey")
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("line_count"), total(net_price()).alias("revenue"), total(money("l_quantity")).alias("quantity"))
        .orderBy("o_orderstatus")
    )


def _large_orders(t: Tables, lines: DataFrame, threshold: float, k: int) -> DataFrame:
    """Orders above a quantity, with customer; one row per order after one
    aggregation, which also holds the quantity a second pass would give."""
    large = _lines_per_order(lines, F.sum(money("l_quantity")).alias("quantity")).filter(F.col("quantity") > threshold)
    return (
        _orders_of_customers(t, "o_orderdate", "o_totalprice")
        .join(large, "o_orderkey")
        .join(t["customer"].select("c_custkey", "c_name"), "c_custkey")
        .groupBy("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
        .agg(total("quantity").alias("sum_qty"))
        .orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")
        .limit(k)
    )


def large_orders(t: Tables, threshold: float = 200, k: int = 100) -> DataFrame:
    return _large_orders(t, t["lineitem"].select("l_orderkey", "l_quantity"), threshold, k)


def hot_key_lines(spark: SparkSession, rows: int, order_key: int, quantity: float) -> DataFrame:
    """Generated order lines that all belong to one order."""
    return spark.range(rows).select(
        F.lit(order_key).cast("bigint").alias("l_orderkey"), F.lit(float(quantity)).alias("l_quantity")
    )


def generated_values(spark: SparkSession, rows: int, categories: int, seed: int) -> DataFrame:
    """Generated rows with a seeded random value and a cyclic category."""
    return spark.range(1, rows).select(
        "id", F.rand(seed).alias("value"), (F.col("id") % categories).cast("string").alias("category")
    )


def skewed_large_orders(
    t: Tables, rows: int = 200_000, order_key: int = 1, quantity: float = 50.0, threshold: float = 200, k: int = 100
) -> DataFrame:
    """``large_orders`` over the order lines and one very hot order.

    Partial sums leave one row of the hot order per input partition, so the
    shuffle does not see the skew.
    """
    lines = t["lineitem"].select("l_orderkey", "l_quantity")
    hot = hot_key_lines(lines.sparkSession, rows, order_key, quantity)
    return _large_orders(t, lines.unionByName(hot), threshold, k)


def segment_priority_rollup(t: Tables, k: int = 200) -> DataFrame:
    """Price, quantity, discount and tax by market segment and priority."""
    sums = [
        F.sum(money("l_extendedprice")).alias("price"),
        F.sum(money("l_quantity")).alias("qty"),
        F.sum(rate("l_discount")).alias("disc"),
        F.sum(rate("l_tax")).alias("tax"),
        F.count("l_discount").alias("n"),
    ]
    return (
        _sums_in_orders(t, t["lineitem"], sums, F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
        .groupBy("c_custkey", "o_orderpriority")
        .agg(*[F.sum(c).alias(c) for c in ("price", "qty", "disc", "tax", "n")])
        .join(t["customer"].select("c_custkey", "c_mktsegment"), "c_custkey")
        .groupBy("c_mktsegment", "o_orderpriority")
        .agg(
            total("price").alias("total_price"),
            total("qty").alias("total_qty"),
            F.round(F.sum("disc").cast("double") / F.sum("n"), 6).alias("avg_disc"),
            total("tax").alias("total_tax"),
        )
        .orderBy(F.desc("total_price"), "c_mktsegment", "o_orderpriority")
        .limit(k)
    )


def nation_status_revenue(t: Tables, k: int = 100) -> DataFrame:
    lines = t["lineitem"].select("l_orderkey", "l_suppkey", net_price().alias("net"))
    per_supplier = (
        _lines_in_orders(t, lines, "o_orderstatus")
        .groupBy("l_suppkey", "o_orderstatus")
        .agg(F.sum("net").alias("net"), F.count(F.lit(1)).alias("n"))
    )
    return (
        _by_supplier_nation(t, per_supplier)
        .groupBy("n_name", "o_orderstatus")
        .agg(total("net").alias("revenue"), F.sum("n").alias("cnt"))
        .orderBy(F.desc("revenue"), "n_name", "o_orderstatus")
        .limit(k)
    )


def _per_customer(t: Tables, sums: list, again: list) -> DataFrame:
    """Order lines summed per order, then per customer."""
    return (
        _sums_in_orders(t, t["lineitem"], sums, F.col("o_custkey").alias("c_custkey"))
        .groupBy("c_custkey")
        .agg(*again)
        .join(t["customer"].select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    )


def customer_spend_topk(t: Tables, k: int = 150) -> DataFrame:
    sums = [
        F.sum(money("l_extendedprice")).alias("price"),
        F.count(F.lit(1)).alias("n"),
        F.sum(money("l_quantity")).alias("qty"),
    ]
    return (
        _per_customer(t, sums, [F.sum(c).alias(c) for c in ("price", "n", "qty")])
        .groupBy("c_custkey", "c_name", "c_mktsegment")
        .agg(total("price").alias("total_spent"), F.sum("n").alias("line_count"), total("qty").alias("total_qty"))
        .orderBy(F.desc("total_spent"), "c_custkey")
        .limit(k)
    )


def supplier_part(t: Tables, size: int = 15, suffix: str = "Y", region: str = "EUROPE", k: int = 100) -> DataFrame:
    """Suppliers of a region for parts of a size and type, richest first."""
    parts = (
        t["part"]
        .filter((F.col("p_size") == size) & F.col("p_type").endswith(suffix))
        .select(F.col("p_partkey").alias("ps_partkey"), "p_brand")
    )
    suppliers = (
        t["supplier"]
        .join(t["nation"].withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
        .join(t["region"].filter(F.col("r_name") == region).select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey")
        .select(F.col("s_suppkey").alias("ps_suppkey"), "s_acctbal", "s_name", "n_name")
    )
    return (
        part_suppliers(t)
        .join(parts, "ps_partkey")
        .join(suppliers, "ps_suppkey")
        .select("s_acctbal", "s_name", "n_name", F.col("ps_partkey").alias("p_partkey"), "p_brand")
        .orderBy(F.desc("s_acctbal"), "s_name", "p_partkey")
        .limit(k)
    )


def customer_total_price(t: Tables, k: int = 100) -> DataFrame:
    sums = [F.sum(money("l_extendedprice")).alias("price"), F.count(F.lit(1)).alias("n")]
    return (
        _per_customer(t, sums, [F.sum("price").alias("price"), F.sum("n").alias("n")])
        .groupBy("c_name", "c_custkey")
        .agg(total("price").alias("total_price"), F.sum("n").alias("order_count"))
        .orderBy(F.desc("total_price"), "c_custkey")
        .limit(k)
    )


def customer_supplier_total(t: Tables, k: int = 50) -> DataFrame:
    lines = t["lineitem"].select("l_orderkey", "l_suppkey", money("l_extendedprice").alias("price"))
    return (
        _lines_in_orders(t, lines, F.col("o_custkey").alias("c_custkey"))
        .join(t["customer"].select("c_custkey", "c_name"), "c_custkey")
        .join(t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
        .groupBy("c_name", "s_name")
        .agg(total("price").alias("total_price"))
        .orderBy(F.desc("total_price"), "c_name", "s_name")
        .limit(k)
    )


def category_totals(events: DataFrame, categories: int = 5) -> DataFrame:
    return events.groupBy((F.col("event_id") % categories).cast("string").alias("category")).agg(
        total(exact("value")).alias("total")
    )


def order_pairs_total(t: Tables) -> DataFrame:
    """Count and price sum over all pairs of orders.

    Every order meets every order once, so the answer follows from one count
    and one sum; no pair is ever formed. The number of pairs is a double
    because it leaves the range of a bigint at some billions of orders.
    """
    one = t["orders"].agg(
        F.count(F.lit(1)).cast("decimal(19,0)").alias("n"), F.sum(money("o_totalprice")).alias("price")
    )
    return one.select(
        (F.col("n") * F.col("n")).cast("double").alias("total_rows"),
        (F.col("price") * F.col("n")).cast("double").alias("total_price"),
    )


def line_customer_pairs_total(t: Tables) -> DataFrame:
    """Count and price sum over all pairs of an order line and a customer."""
    lines = t["lineitem"].select(money("l_extendedprice").alias("price"), F.lit(1).alias("line"), F.lit(0).alias("customer"))
    customers = t["customer"].select(
        F.lit(0).cast("decimal(12,2)").alias("price"), F.lit(0).alias("line"), F.lit(1).alias("customer")
    )
    both = lines.unionByName(customers).agg(
        F.sum("price").alias("price"),
        F.sum("line").cast("decimal(19,0)").alias("n_lines"),
        F.sum("customer").cast("decimal(19,0)").alias("n_customers"),
    )
    return both.select(
        (F.col("n_lines") * F.col("n_customers")).cast("double").alias("total_rows"),
        (F.col("price") * F.col("n_customers")).cast("double").alias("total_price"),
    )


def pricing_summary(t: Tables, until: str = "2000-09-02") -> DataFrame:
    discounted = net_price()
    return (
        t["lineitem"]
        .filter(F.col("l_shipdate") <= until)
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            total(money("l_quantity")).alias("sum_qty"),
            total(money("l_extendedprice")).alias("sum_base_price"),
            total(discounted).alias("sum_disc_price"),
            total(discounted * (F.lit(1) + rate("l_tax"))).alias("sum_charge"),
            F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )
