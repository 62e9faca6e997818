"""Reachability and longest paths over edge tables, in rounds of stored tables.

A run is a path on which every node but the last has one way on, and every
node but the first one way in. Long recorded chains are runs, so both walks go
from run to run: ``unary_runs`` finds the runs by pointer doubling, in about
log2(longest run) rounds. A chain of any length is a single run.

On the graph of runs a walk first takes one round per level. After ``LEVELS``
of them the graph is contracted instead: nodes with few ways in and on, no two
of them neighbours, are taken out together, and every way through them becomes
one edge of the same length. As long as nodes with few ways are left, a round
takes out a share of them all, so a deep graph needs about as many rounds as
its depth has binary digits, and the edges of all rounds together are a few
times those of the graph. Shortest ways to the nodes taken out follow in the
opposite order. What cannot be contracted any more is walked level by level.

Longest paths of small graphs need no rounds: a graph of up to ``SMALL`` edges is
one row, in which the layers of its nodes are raised until nothing changes. Only
the larger ones, told apart by counting, go from run to run.

Each round joins only the newest rows and writes them to the shared folder. No
round re-plans an earlier one, and cyclic input ends by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.session import SENT_ROWS, materialize, merged, scratch_path

_NODE = ["app_id", "node"]
#: Rounds of one level each before a graph is contracted.
LEVELS = 8
#: A node is taken out if its ways in times its ways on are no more than this, or than both together.
WAYS = 36
#: A round that leaves more than this share of the edges is a poor one; two in a row end the contraction.
POOR = 0.95
#: A graph of no more edges than this is one row when its longest path is sought.
SMALL = 128
#: Nodes before and after all others, beyond any stage id.
_TOP, _END = -(1 << 40), 1 << 40


def unary_runs(edges: DataFrame) -> DataFrame:
    """(app_id, node, head, place) of all nodes that are not the head of their run.

    ``edges`` is a stored table of distinct (app_id, at, next). ``place`` is
    the number of steps from the head. A run that closes to a circle begins at
    its smallest node.
    """
    size = edges.count()
    ways_on = edges.groupBy("app_id", "at").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    ways_in = edges.groupBy("app_id", "next").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    inner = edges.filter("at <> next").join(merged(ways_on, size), ["app_id", "at"], "left_semi")
    inner = inner.join(merged(ways_in, size), ["app_id", "next"], "left_semi")
    links = materialize(inner.select("app_id", F.col("next").alias("node"), F.col("at").alias("head")), "links")
    placed, circles = _doubled(links)
    if circles is None:
        return placed
    # Cut every circle at its smallest node and place what is then a plain run.
    cut = circles.filter("node <> low").select(*_NODE)
    rest, _ = _doubled(materialize(links.join(merged(cut, size), _NODE, "left_semi"), "links"))
    return placed.unionByName(rest)


def _doubled(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Follow all links (app_id, node, head = the node before) at once, twice as far in each round.

    Returns the placed nodes, and those on circles with the circle's smallest
    node, or None if there are none.
    """
    size = links.count()
    current = links.select(*_NODE, "head", F.lit(1).cast("long").alias("place"), F.least("node", "head").alias("low"), F.lit(True).alias("open"))
    rounds = 0
    while size:
        before = current.select("app_id", F.col("node").alias("head"), F.col("head").alias("to"), F.col("place").alias("more"), F.col("low").alias("other"))
        further = current.join(merged(before, size), ["app_id", "head"], "left").select(
            *_NODE,
            F.coalesce("to", "head").alias("head"),
            (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"),
            F.least("low", F.coalesce("other", "low")).alias("low"),
            F.col("to").isNotNull().alias("open"),
        )
        current = materialize(further, "runs")
        rounds += 1
        still = current.filter("open")
        if still.isEmpty():
            break
        if (1 << rounds) > 2 * size:
            return current.filter("NOT open").select(*_NODE, "head", "place"), still.select(*_NODE, "low")
    return current.select(*_NODE, "head", "place"), None


def _with_runs(rows: DataFrame, runs: DataFrame, node: str) -> DataFrame:
    """``rows`` with the head and place of the run that ``node`` is in."""
    found = runs.withColumnRenamed("node", node)
    return rows.join(merged(found), ["app_id", node], "left").select(
        *rows.columns, F.coalesce("head", node).alias("head"), F.coalesce("place", F.lit(0).cast("long")).alias("place")
    )


def _between_runs(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """(app_id, head, after, to): steps from a run's head to its last node, and the head that follows."""
    ends = edges.join(merged(runs.select("app_id", F.col("node").alias("next"), F.lit(True).alias("inner"))), ["app_id", "next"], "left")
    # Inside a run there is one edge to each node; a circle's closing edge leads to its head.
    leaving = ends.filter("inner IS NULL").select("app_id", "at", F.col("next").alias("to"))
    return materialize(_with_runs(leaving, runs, "at").select("app_id", "head", F.col("place").alias("after"), "to"), "between")


def _independent(edges: DataFrame, kept: DataFrame, turn: int, size: int) -> DataFrame:
    """Nodes with few ways in and on of which no two are neighbours; none of ``kept``.

    Of neighbours the one with fewer ways through it is taken, a hash decides
    between equals.
    """
    outs = edges.groupBy("app_id", F.col("at").alias("node")).agg(F.count(F.lit(1)).alias("outs"))
    ins = edges.groupBy("app_id", F.col("next").alias("node")).agg(F.count(F.lit(1)).alias("ins"))
    nodes = outs.join(merged(ins, size), _NODE, "full").na.fill(0, ["outs", "ins"])
    through = F.col("ins") * F.col("outs")
    few = nodes.filter(through <= F.greatest(F.col("ins") + F.col("outs"), F.lit(WAYS))).join(merged(kept), _NODE, "left_anti")
    few = few.select(*_NODE, F.struct(through.alias("through"), F.xxhash64(*_NODE, F.lit(turn)).alias("hash"), "node").alias("order"))
    ends = [few.select("app_id", F.col("node").alias(end), F.col("order").alias(f"{end}_order")) for end in ("at", "next")]
    both = edges.filter("at <> next").join(merged(ends[0], size), ["app_id", "at"]).join(merged(ends[1], size), ["app_id", "next"])
    beside = both.select("app_id", F.explode(F.array(*[
        F.struct(F.col(one).alias("node"), F.col(f"{two}_order").alias("other")) for one, two in (("at", "next"), ("next", "at"))
    ])).alias("pair")).select("app_id", "pair.*")
    lowest = beside.groupBy(*_NODE).agg(F.min("other").alias("lowest"))
    return few.join(merged(lowest, size), _NODE, "left").filter("lowest IS NULL OR order < lowest").select(*_NODE)


def contracted(edges: DataFrame, kept: DataFrame, longest: bool) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """Take out nodes that are not in ``kept`` (app_id, node) as long as few edges come of it.

    ``edges`` is a stored table of distinct (app_id, at, next, length). Of
    several ways between two nodes the longest or the shortest is left.
    Returns the edges that remain, for each round the edges that led to the
    nodes then taken out, and with ``longest`` the applications in which a
    circle was found; they have no edges any more. Without ``longest`` a circle
    at a kept node stays as an edge to itself.
    """
    best = F.max if longest else F.min
    trail: list[DataFrame] = []
    cyclic: list[DataFrame] = []
    before, poor = None, 0
    while True:
        count, loops = edges.agg(F.count(F.lit(1)), F.count_if(F.col("at") == F.col("next"))).first()
        if loops and longest:
            cyclic.append(materialize(edges.filter("at = next").select("app_id").distinct(), "cyclic"))
            edges = edges.join(merged(cyclic[-1], count), "app_id", "left_anti")
        elif loops:
            at_kept = edges.filter("at = next").join(merged(kept.withColumnRenamed("node", "at")), ["app_id", "at"], "left_semi")
            edges = edges.filter("at <> next").unionByName(at_kept)
        poor = poor + 1 if before is not None and count > POOR * before else 0
        before = count
        if not count or poor == 2:
            break
        taken = materialize(_independent(edges, kept, len(trail), count), "taken")
        if taken.isEmpty():
            break
        entered = edges.join(merged(taken.withColumnRenamed("node", "next"), count), ["app_id", "next"])
        if not longest:
            entered = materialize(entered, "entered")
        trail.append(entered)
        ways = entered.select("app_id", "at", F.col("next").alias("node"), F.col("length").alias("first"))
        left = edges.join(merged(taken, count), (edges["app_id"] == taken["app_id"]) & (edges["at"] == taken["node"]), "left_semi")
        through = ways.join(merged(left.select("app_id", F.col("at").alias("node"), "next", "length"), count), _NODE)
        through = through.select("app_id", "at", "next", (F.col("first") + F.col("length")).alias("length"))
        rest = edges
        for end in ("at", "next"):
            rest = rest.join(merged(taken.withColumnRenamed("node", end), count), ["app_id", end], "left_anti")
        joined = rest.select(*through.columns).unionByName(through).groupBy("app_id", "at", "next").agg(best("length").alias("length"))
        edges = materialize(joined, "contracted")
    return edges, trail, reduce(DataFrame.unionByName, cyclic) if cyclic else None


def _walked(start: DataFrame, between: DataFrame, keys: list[str], limit: int | None = None) -> tuple[DataFrame | None, bool]:
    """Least distances by levels: (keys, head, steps) of the heads entered, and whether the walk came to its end.

    ``start`` has ``keys``, head and steps (at the head); ``between`` has
    app_id, head, length and to.
    """
    spark, base, rounds = start.sparkSession, scratch_path(start.sparkSession, "reach"), []
    newest, schema, size, far = start, None, start.count(), between.count()
    while limit is None or len(rounds) < limit:
        ahead = merged(newest, min(size, far)).join(between, ["app_id", "head"]).select(*keys, F.col("to").alias("head"), (F.col("steps") + F.col("length")).alias("steps"))
        ahead = ahead.groupBy(*keys, "head").agg(F.min("steps").alias("steps"))
        if rounds:
            known = spark.read.schema(schema).parquet(*rounds).groupBy(*keys, "head").agg(F.min("steps").alias("known"))
            ahead = ahead.join(merged(known, size), [*keys, "head"], "left").filter("known IS NULL OR steps < known").drop("known")
        path = f"{base}/{len(rounds)}"
        newest = materialize(ahead, "round", path)
        schema, size = newest.schema, newest.count()
        if not size:
            break
        rounds.append(path)
    else:
        return None, False
    if not rounds:
        return None, True
    return spark.read.schema(schema).parquet(*rounds).groupBy(*keys, "head").agg(F.min("steps").alias("steps")), True


def _entered(start: DataFrame, between: DataFrame, keys: list[str]) -> DataFrame | None:
    """Least distances (keys, head, steps) of all heads entered from ``start``; None if there are none."""
    found, ended = _walked(start, between, keys, LEVELS)
    if ended:
        return found
    edges = between.groupBy("app_id", F.col("head").alias("at"), F.col("to").alias("next")).agg(F.min("length").alias("length"))
    kept = materialize(start.select("app_id", F.col("head").alias("node")).distinct(), "kept")
    core, trail, _ = contracted(materialize(edges, "edges"), kept, longest=False)
    found, _ = _walked(start, core.select("app_id", F.col("at").alias("head"), "length", F.col("next").alias("to")), keys)
    spark, base, schema = start.sparkSession, scratch_path(start.sparkSession, "back"), None
    paths: list[str] = []
    # From the last nodes taken out to the first: the ways that led to them come from nodes known by then.
    for entered in [None, *reversed(trail)]:
        if entered is None:
            rows = found
        else:
            departed = start.select(*keys, "head", "steps")
            if paths:
                departed = departed.unionByName(spark.read.schema(schema).parquet(*paths))
            rows = departed.withColumnRenamed("head", "at").join(merged(entered), ["app_id", "at"])
            rows = rows.groupBy(*keys, F.col("next").alias("head")).agg(F.min(F.col("steps") + F.col("length")).alias("steps"))
        if rows is not None:
            paths.append(f"{base}/{len(paths)}")
            schema = materialize(rows.select(*keys, "head", "steps"), "back", paths[-1]).schema
    return spark.read.schema(schema).parquet(*paths) if paths else None


def reach(seeds: DataFrame, edges: DataFrame, keys: list[str], include_seeds: bool = True) -> DataFrame:
    """Everything reachable from ``seeds``, with the least number of steps.

    ``seeds`` has ``keys`` and ``at``; ``edges`` has ``app_id``, ``at`` and
    ``next``. The result has ``keys``, ``at`` and ``steps``. A seed that can be
    reached again from itself is reported once when seeds are included, and at
    its first return when they are not.
    """
    edges = materialize(edges.select("app_id", "at", "next").distinct(), "edges")
    runs = unary_runs(edges)
    between = _between_runs(edges, runs).select("app_id", "head", (F.col("after") + 1).alias("length"), "to")
    start = _with_runs(seeds.select(*keys, "at").distinct(), runs, "at").select(*keys, "at", "head", "place", F.lit(0).cast("long").alias("steps"))
    start = materialize(start, "start")
    # Counted from the head of its run, a seed has taken ``place`` steps already.
    entered = _entered(start.select(*keys, "head", (F.col("steps") - F.col("place")).alias("steps")), between, keys)

    first = F.col("place") if include_seeds else F.col("place") + 1
    ways = start.select(*keys, "head", first.alias("place"), (F.col("steps") + first - F.col("place")).alias("steps"))
    if entered is not None:
        ways = ways.unionByName(entered.withColumn("place", F.lit(0).cast("long")))
    heads = ways.filter("place = 0").select(*keys, F.col("head").alias("at"), "steps")
    along = ways.join(merged(runs.withColumnRenamed("place", "there")), ["app_id", "head"]).filter("there >= place")
    along = along.select(*keys, F.col("node").alias("at"), (F.col("steps") + F.col("there") - F.col("place")).alias("steps"))
    found = heads.unionByName(along).groupBy(*keys, "at").agg(F.min("steps").cast("int").alias("steps"))
    return found.select(*keys, "at", "steps")


def _placed(edges: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """(app_id, node, layer) of all nodes whose ways in all come from placed ones, and whether no more can be placed.

    ``edges`` is a stored table of distinct (app_id, at, next, length); what
    begins at ``_TOP`` begins at layer 0, and a layer is the longest way from
    there. A round writes for every node entered, now or earlier, how many of
    its ways in are known and the longest of them.
    """
    spark, base, rounds = edges.sparkSession, scratch_path(edges.sparkSession, "placed"), []
    ways = edges.groupBy("app_id", "next").agg(F.count(F.lit(1)).alias("ways"))
    edges = materialize(edges.join(merged(ways), ["app_id", "next"]), "ways")
    top = edges.select("app_id").distinct().select("app_id", F.lit(_TOP).alias("node"), F.lit(0).cast("long").alias("layer"))
    newest, waiting, far = top, None, edges.count()
    size = far
    while limit is None or len(rounds) < limit:
        came = merged(newest.withColumnRenamed("node", "at"), min(size, far)).join(edges, ["app_id", "at"]).groupBy("app_id", F.col("next").alias("node")).agg(
            F.count(F.lit(1)).alias("known"), F.max(F.col("layer") + F.col("length")).alias("layer"), F.max("ways").alias("ways")
        )
        if waiting is not None:
            came = came.unionByName(waiting).groupBy(*_NODE).agg(F.sum("known").alias("known"), F.max("layer").alias("layer"), F.max("ways").alias("ways"))
        rounds.append(f"{base}/{len(rounds)}")
        known = materialize(came, "layer", rounds[-1])
        newest, waiting = known.filter("known = ways").select(*_NODE, "layer"), known.filter("known < ways")
        size = newest.count()
        if not size:
            break
    done = spark.read.schema(known.schema).parquet(*rounds).filter("known = ways").select(*_NODE, "layer")
    return top.unionByName(done), not size


def _depths_by_rounds(edges: DataFrame) -> DataFrame:
    """(app_id, depth) as in ``longest_paths``; ``edges`` has distinct app_id, at and next."""
    edges = materialize(edges, "edges")
    runs = unary_runs(edges)
    between = _between_runs(edges, runs)
    ends = runs.groupBy("app_id", "head").agg(F.max("place").alias("last"))
    heads = between.select("app_id", "head").union(ends.select("app_id", "head")).distinct()
    first = heads.join(merged(between.select("app_id", F.col("to").alias("head"))), ["app_id", "head"], "left_anti")
    last = between.select("app_id", F.col("to").alias("head")).union(ends.select("app_id", "head")).distinct()
    last = last.join(merged(between), ["app_id", "head"], "left_anti").join(merged(ends), ["app_id", "head"], "left")
    # From before all others to the first runs, from run to run, and from the last runs to after all others.
    ways = (
        first.select("app_id", F.lit(_TOP).alias("at"), F.col("head").alias("next"), F.lit(1).cast("long").alias("length"))
        .unionByName(between.groupBy("app_id", F.col("head").alias("at"), F.col("to").alias("next")).agg(F.max(F.col("after") + 1).alias("length")))
        .unionByName(last.select("app_id", F.col("head").alias("at"), F.lit(_END).alias("next"), F.coalesce("last", F.lit(0).cast("long")).alias("length")))
    )
    ways = materialize(ways, "ways")
    placed, ended = _placed(ways, LEVELS)
    depths = placed.filter(F.col("node") == _END).select("app_id", F.col("layer").alias("depth"))
    open_ = ways.join(merged(placed.select("app_id", F.col("node").alias("next"))), ["app_id", "next"], "left_anti")
    if ended:
        circular = open_.select("app_id").distinct()
    else:
        at = placed.withColumnRenamed("node", "at")
        # A way from a placed node begins at the top, as long as the longest way to it.
        open_ = open_.join(merged(at), ["app_id", "at"], "left").select(
            "app_id",
            F.when(F.col("layer").isNull(), F.col("at")).otherwise(F.lit(_TOP)).alias("at"),
            "next",
            (F.col("length") + F.coalesce("layer", F.lit(0))).alias("length"),
        )
        open_ = materialize(open_.groupBy("app_id", "at", "next").agg(F.max("length").alias("length")), "ways")
        kept = open_.select("app_id").distinct().select("app_id", F.explode(F.array(F.lit(_TOP), F.lit(_END))).alias("node"))
        core, _, cyclic = contracted(open_, materialize(kept, "kept"), longest=True)
        core = materialize(core, "core")
        late, _ = _placed(core)
        circular = core.join(merged(late.select("app_id", F.col("node").alias("next"))), ["app_id", "next"], "left_anti").select("app_id").distinct()
        if cyclic is not None:
            circular = circular.unionByName(cyclic).distinct()
        depths = depths.unionByName(late.filter(F.col("node") == _END).select("app_id", F.col("layer").alias("depth")))
    apps = edges.select("app_id").distinct()
    sound = depths.join(merged(circular), "app_id", "left_anti")
    return apps.join(merged(sound), "app_id", "left")


def _raised(state: Column) -> Column:
    """One step: every node comes one layer after the last of the nodes before it, unless the step before changed nothing."""
    layers, before = state["layers"], state["before"]
    after = F.transform(before, lambda at: F.coalesce(F.array_max(F.transform(at, lambda i: F.element_at(layers, i))) + 1, F.lit(1).cast("long")))
    return F.when(layers == state["last"], state).otherwise(F.struct(after.alias("layers"), layers.alias("last"), before.alias("before")))


def _depths_in_rows(edges: DataFrame) -> DataFrame:
    """(app_id, depth) as in ``longest_paths`` of graphs that fit in a row; ``edges`` has app_id, at and next."""
    graphs = edges.groupBy("app_id").agg(F.collect_list(F.struct("at", "next")).alias("edges"))
    graphs = graphs.withColumn("nodes", F.array_distinct(F.concat("edges.at", "edges.next")))
    # Places of the nodes before each node.
    before = F.transform("nodes", lambda node: F.transform(
        F.filter("edges", lambda edge: edge["next"] == node), lambda edge: F.array_position("nodes", edge["at"]).cast("int")
    ))
    start = F.struct(
        F.transform("nodes", lambda _: F.lit(1).cast("long")).alias("layers"), F.lit(None).cast("array<long>").alias("last"), before.alias("before")
    )
    # Without a circle no way has more nodes than there are, and as many steps settle all layers; on a circle they rise with every step.
    steps = F.sequence(F.lit(1), F.size("nodes"))
    walked = graphs.select("app_id", F.size("nodes").alias("n"), F.aggregate(steps, start, lambda s, _: _raised(s), lambda s: F.array_max(s["layers"])).alias("layer"))
    return walked.select("app_id", F.when(F.col("layer") <= F.col("n"), F.col("layer")).alias("depth"))


def longest_paths(edges: DataFrame) -> DataFrame:
    """(app_id, depth): the number of nodes on the longest path of every graph that ``edges`` has; NULL if it has a circle.

    ``edges`` has ``app_id``, ``parent`` and ``child``.
    """
    edges = edges.select("app_id", F.col("parent").cast("long").alias("at"), F.col("child").cast("long").alias("next"))
    edges = materialize(edges, "edges")
    # Without an application there is no graph to follow.
    lost = edges.filter("app_id IS NULL").select("app_id", F.lit(None).cast("long").alias("depth")).distinct()
    edges = edges.filter("app_id IS NOT NULL")
    sizes = edges.groupBy("app_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at").isNull() | F.col("next").isNull()).alias("open"))
    large = materialize(sizes.filter((F.col("n") > SMALL) | (F.col("open") > 0)).select("app_id"), "large")
    count = large.count()
    if not count:
        return _depths_in_rows(edges).unionByName(lost)
    small = edges.join(merged(large, count), "app_id", "left_anti")
    if count > SENT_ROWS:
        # Stored, so that Spark may split the partitions of large graphs in this join.
        small = materialize(small, "small")
    walked = _depths_by_rounds(edges.join(merged(large, count), "app_id", "left_semi").distinct())
    return _depths_in_rows(small).unionByName(walked).unionByName(lost)
