"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a circle of 2**52 positions. A key
belongs to the first point at or clockwise after its own position, and so to
that point's shard. A shard has a bound of keys: ``n // shards``, one more for
the first ``n % shards`` shards. The keys above a bound go on clockwise to the
next virtual nodes whose shard has room. The bounds add up to ``n``, so every
shard ends full and counts are at most one apart (law ``rows``), while only
keys above a bound leave their shard.

Only the counts of virtual nodes (``shards * vnodes`` rows) are put in one
order. A key learns its place from its rank inside a small cell and from the
counts before that cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import store

#: Virtual nodes of a shard.
VNODES = 64
#: Copies of one row that are numbered at a time; a row with more is dealt out in pieces of so many.
PIECE = 1 << 16
_CIRCLE_BITS, _PREFIX_BITS, _CELL_DIGITS = 52, 12, 3


def _digits(text: Column, first: int, count: int) -> Column:
    return F.conv(F.substring(F.md5(text), first, count), 16, 10).cast("long")


def ring_points(df: DataFrame, shards: int, vnodes: int) -> DataFrame:
    """(vnode, shard, at, turn): the points in ring order; ``shards * vnodes`` rows whatever the data."""
    ids = df.sparkSession.range(shards * vnodes, numPartitions=1).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("turn")
    )
    at = ids.withColumn("at", _digits(F.concat_ws("-", F.lit("shard"), F.col("shard").cast("string"), F.col("turn").cast("string")), 1, 13))
    numbered = at.withColumn("vnode", (F.row_number().over(Window.orderBy("at", "shard")) - 1).cast("int"))
    # Inside its shard a virtual node is known by its place in ring order.
    return numbered.withColumn("turn", F.row_number().over(Window.partitionBy("shard").orderBy("vnode")) - 1)


def _arcs(points: DataFrame, n: int) -> DataFrame:
    """(prefix, inside, following): for each of 4,096 parts of the circle the points in it and the first one after it."""
    inside = points.groupBy(F.shiftright("at", _CIRCLE_BITS - _PREFIX_BITS).alias("prefix")).agg(
        F.array_sort(F.collect_list(F.struct("at", "vnode"))).alias("inside")
    )
    parts = points.sparkSession.range(1 << _PREFIX_BITS, numPartitions=1).withColumnRenamed("id", "prefix").join(inside, "prefix", "left")
    later = Window.orderBy("prefix").rowsBetween(1, Window.unboundedFollowing)
    first = F.first(F.element_at("inside", 1)["vnode"], ignorenulls=True).over(later)
    return parts.select("prefix", "inside", F.coalesce(first, F.lit(0)).alias("following"))


def _plan(counts: DataFrame, points: DataFrame, shards: int, vnodes: int) -> DataFrame:
    """For each virtual node: how many of its keys stay, their first slot, and the runs of slots its other keys go to."""
    ring = Window.orderBy("vnode")
    whole = Window.partitionBy()
    in_shard = Window.partitionBy("shard")
    before = in_shard.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)


    nodes = points.join(counts, "vnode", "left").withColumn("keys", F.coalesce("keys", F.lit(0).cast("long")))
    nodes = nodes.withColumns({"n": F.sum("keys").over(whole), "load": F.sum("keys").over(in_shard), "earlier": F.coalesce(F.sum("keys").over(before), F.lit(0))})
    nodes = nodes.withColumn("bound", F.expr(f"n div {shards} + if(shard < n % {shards}, 1, 0)"))
    nodes = nodes.withColumns({"stay": F.least("load", "bound"), "room": F.greatest(F.col("bound") - F.col("load"), F.lit(0))})
    nodes = nodes.withColumns(
        {
            "first_slot": F.expr("if(load = 0, 0, CAST(CAST(earlier AS DECIMAL(20,0)) * stay AS DECIMAL(38,0)) div greatest(load, 1))"),
            "next_slot": F.expr("if(load = 0, 0, CAST(CAST(earlier + keys AS DECIMAL(20,0)) * stay AS DECIMAL(38,0)) div greatest(load, 1))"),
            "room_before": F.expr(f"turn * room div {vnodes}"),
            "room_here": F.expr(f"(turn + 1) * room div {vnodes} - turn * room div {vnodes}"),
        }
    ).withColumn("over", F.col("keys") - (F.col("next_slot") - F.col("first_slot")))

    # The queue of keys that move on is never empty before a free slot if the ring is entered where it is shortest.
    net = F.sum(F.col("over") - F.col("room_here")).over(ring.rowsBetween(Window.unboundedPreceding, 0))
    start = nodes.withColumn("net", net).withColumn("start", F.min(F.struct("net", "vnode")).over(whole)["vnode"] + 1)
    turned = start.withColumn("place", F.pmod(F.col("vnode") - F.col("start"), F.lit(shards * vnodes)))
    passed = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turned = turned.withColumns(
        {"over_rank": F.coalesce(F.sum("over").over(passed), F.lit(0)), "room_rank": F.coalesce(F.sum("room_here").over(passed), F.lit(0))}
    )
    leaving = turned.filter("over > 0").select(F.col("over_rank").alias("rank"), F.struct("vnode", "over_rank").alias("source"))
    taking = turned.filter("room_here > 0").select(
        F.col("room_rank").alias("rank"), F.struct("shard", (F.col("stay") + F.col("room_before")).alias("slot"), "room_rank").alias("target")
    )
    cuts = leaving.unionByName(taking, allowMissingColumns=True).groupBy("rank").agg(F.max("source").alias("source"), F.max("target").alias("target"))
    so_far = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    runs = cuts.select(
        "rank", F.last("source", ignorenulls=True).over(so_far).alias("source"), F.last("target", ignorenulls=True).over(so_far).alias("target")
    )
    runs = runs.groupBy(F.col("source.vnode").alias("vnode")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (F.col("rank") - F.col("source.over_rank")).alias("from_rank"),
                    F.col("target.shard").alias("shard"),
                    (F.col("target.slot") + F.col("rank") - F.col("target.room_rank")).alias("slot"),
                )
            )
        ).alias("runs")
    )
    return nodes.join(runs, "vnode", "left").select(
        "vnode", "shard", F.col("first_slot").cast("long").alias("first_slot"), (F.col("next_slot") - F.col("first_slot")).cast("long").alias("stays"), "runs"
    )


def _numbered_copies(rows: DataFrame) -> DataFrame:
    """Every copy of every row with its number ``copy__``; the copies of one row are made by many tasks."""
    zero = F.lit(0).cast("long")
    few = rows.filter(F.col("copies__") <= PIECE).withColumn("copy__", F.explode(F.sequence(zero, F.col("copies__") - 1)))
    many = rows.filter(F.col("copies__") > PIECE).withColumn("piece__", F.explode(F.sequence(zero, F.floor((F.col("copies__") - 1) / PIECE))))
    many = many.repartition("vnode", "cell__", "within__", "piece__").withColumn("first__", F.col("piece__") * PIECE)
    last = F.least(F.col("first__") + PIECE, "copies__") - 1
    return few.unionByName(many.withColumn("copy__", F.explode(F.sequence("first__", last))).drop("piece__", "first__"))


def bounded_shards(df: DataFrame, key: str, others: list[str], shards: int = 16, vnodes: int = VNODES) -> DataFrame:
    """``key`` and ``others`` of every row with ``shard`` (int), ``slot`` (long, gapless from 0 in each shard) and ``home_shard`` (int, owner of the key's arc).

    Keys may repeat or be null (null is the key ``''``). Equal rows are counted
    before they are dealt out and numbered afterwards, so one row repeated very
    often is no hot group. ``others`` must be small columns that order rows of
    one key. An empty table gives no rows; all other columns of ``df`` stay
    behind, whatever their names.

    Built-in functions only; ``df`` is read once.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    points = store(ring_points(df, shards, vnodes), "ring")
    rows = df.groupBy(key, *others).agg(F.count("*").alias("copies__"))
    rows = rows.select(
        "*",
        _digits(text, 1, 13).alias("at__"),
        _digits(F.concat_ws("/", text, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in others]), 1, _CELL_DIGITS).alias("cell__"),
    )
    rows = rows.join(F.broadcast(_arcs(points, shards * vnodes)), F.shiftright("at__", _CIRCLE_BITS - _PREFIX_BITS) == F.col("prefix"))
    reached = F.filter("inside", lambda p: p["at"] >= F.col("at__"))
    rows = rows.select(
        key, *others, "copies__", "cell__", F.coalesce(F.try_element_at(reached, F.lit(1))["vnode"], F.col("following")).alias("vnode")
    )
    rows = store(rows, "ring-keys")

    cells = rows.groupBy("vnode", "cell__").agg(F.sum("copies__").alias("keys"))
    plan = store(_plan(cells.groupBy("vnode").agg(F.sum("keys").alias("keys")), points, shards, vnodes), "ring-plan")
    ordered = Window.partitionBy("vnode").orderBy("cell__").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("vnode", "cell__", F.coalesce(F.sum("keys").over(ordered), F.lit(0)).alias("before__"))
    inside = Window.partitionBy("vnode", "cell__").orderBy(key, *others).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("within__", F.coalesce(F.sum("copies__").over(inside), F.lit(0)))
    ranked = ranked.join(cells, ["vnode", "cell__"]).join(F.broadcast(plan), "vnode")
    ranked = _numbered_copies(ranked)
    ranked = ranked.withColumn("rank__", F.col("before__") + F.col("within__") + F.col("copy__"))
    moved = F.col("rank__") - F.col("stays")
    run = F.element_at(F.filter("runs", lambda r: r["from_rank"] <= moved), -1)
    return ranked.withColumn("run__", F.when(moved >= 0, run)).select(
        key,
        *others,
        F.coalesce(F.col("run__.shard"), F.col("shard")).cast("int").alias("shard"),
        F.coalesce(F.col("run__.slot") + moved - F.col("run__.from_rank"), F.col("first_slot") + F.col("rank__")).cast("long").alias("slot"),
        F.col("shard").cast("int").alias("home_shard"),
    )


def document_shards(documents: DataFrame, shards: int = 16, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard of every row of ``documents``.

    A null text has size 1 and the CRC of the empty text. ``grown_shard`` is
    null: under law ``rows`` the bounds change with the number of shards.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32")
    )
    placed = bounded_shards(rows, "doc_id", ["size", "text_crc32"], shards, vnodes)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )
