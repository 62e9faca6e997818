import math
import random

import pytest
from pyspark.sql import functions as F

from faultlens import session
from faultlens.operators import graph, lineage, root_cause
from faultlens.session import materialize
from tests import brute

SCHEMA = (
    "app_id STRING, stage_id INT, stage_attempt_id INT, stage_name STRING, status STRING,"
    " failure_reason STRING, parent_ids STRING"
)


def rows_of(app, stages):
    return [
        (app, s, 0, f"stage {s}", status, reason, ",".join(map(str, parents)))
        for s, (status, reason, parents) in stages.items()
    ]


def nodes_of(spark, apps):
    rows = [r for app, stages in apps.items() for r in rows_of(app, stages)]
    return materialize(graph.stage_nodes(spark.createDataFrame(rows, SCHEMA)), "nodes")


def ids(text):
    return [int(v) for v in text.split(",") if v]


CASES = {
    "chain": {1: ("COMPLETED", None, []), 2: ("COMPLETED", None, [1]), 3: ("COMPLETED", None, [2])},
    "cycle": {1: ("COMPLETED", None, [2]), 2: ("COMPLETED", None, [1])},
    "two_roots": {
        1: ("FAILED", "Timeout A", []),
        2: ("FAILED", "Timeout B", []),
        3: ("FAILED", "Fetch Failed (Victim)", [1, 2]),
    },
    "cascade": {
        1: ("COMPLETED", None, []),
        2: ("FAILED", "OOM", [1]),
        3: ("FAILED", "Fetch Failed", [2]),
        4: ("FAILED", "Fetch Failed", [3]),
    },
    "abort_between": {
        1: ("FAILED", "OOM", []),
        2: ("FAILED", "Job cancelled", [1]),
        3: ("FAILED", "No space left", [2]),
    },
    "aborted_terminal": {1: ("FAILED", "OOM", []), 2: ("FAILED", "Job aborted", [1])},
    "skipped_parent": {1: ("SKIPPED", None, []), 2: ("FAILED", "OOM", [1])},
    "unknown_parent": {5: ("FAILED", "OOM", [4])},
    "single": {7: ("FAILED", "a rather long reason", [])},
    "healthy": {0: ("COMPLETED", None, []), 1: ("COMPLETED", None, [0])},
    "failed_cycle": {1: ("FAILED", "a", [2]), 2: ("FAILED", "b", [1])},
    "self_parent": {1: ("FAILED", "a", [1]), 2: ("COMPLETED", None, [1])},
    "three_roots": {
        1: ("FAILED", "a", []),
        2: ("FAILED", "b", []),
        3: ("FAILED", "c", []),
        4: ("FAILED", "d", [1, 2, 3]),
    },
    "heuristic_run": {
        0: ("FAILED", "early", []),
        3: ("COMPLETED", None, []),
        5: ("FAILED", "the cause is here", []),
        70000: ("FAILED", "x", []),
        140000: ("FAILED", "y", []),
        140001: ("COMPLETED", None, []),
    },
    "heuristic_abort": {
        0: ("FAILED", "early", []),
        1: ("FAILED", "was cancelled", []),
        2: ("FAILED", "y", []),
        3: ("FAILED", "was aborted", []),
    },
}


def random_apps(count, seed, cyclic):
    rnd = random.Random(seed)
    apps = {}
    for n in range(count):
        size = rnd.randint(1, 14)
        stages = {}
        heuristic = rnd.random() < 0.25
        names = rnd.sample(range(30), size)
        for s in names:
            status = rnd.choice(["FAILED", "FAILED", "COMPLETED", "SKIPPED"])
            reason = rnd.choice([None, "short", "a longer failure text", "Stage cancelled"]) if status == "FAILED" else None
            pool = names + [900] if cyclic else [x for x in names if x < s] + [900]
            parents = [] if heuristic else rnd.sample(pool, min(len(pool), rnd.randint(0, 3)))
            stages[s] = (status, reason, parents)
        apps[f"r{seed}_{n}"] = stages
    return apps


@pytest.fixture(scope="module")
def apps():
    return {**CASES, **random_apps(60, 1, False), **random_apps(60, 2, True)}


@pytest.fixture(scope="module")
def nodes(spark, apps):
    return nodes_of(spark, apps)


def test_nodes_and_edges(nodes, apps):
    found = {(r.app_id, r.stage_id): r for r in nodes.collect()}
    for app, stages in apps.items():
        parents, listed = brute.build(stages)
        for stage in stages:
            row = found.pop((app, stage))
            assert sorted(row.parents) == parents[stage], (app, stage)
            assert row.used_true_parents == listed
    assert not found


def test_results_match_brute_force(nodes, apps):
    found = {r.app_id: r for r in root_cause.analyze(nodes).collect()}
    assert set(found) == set(apps)
    for app, stages in apps.items():
        row, want = found[app], brute.analyse(stages)
        if want is None:
            assert (row.root_cause_stage_ids, row.root_cause_stage_names, row.failure_reasons) == ("", "None", "NO_FAILURE")
            assert (row.propagation_path, row.victim_stages, row.analysis_confidence) == ("", "", 1.0)
            continue
        roots, victims, path, confidence = want
        assert ids(row.root_cause_stage_ids) == roots, app
        assert ids(row.victim_stages) == victims, app
        assert ids(row.propagation_path) == path, app
        assert row.analysis_confidence == pytest.approx(confidence, abs=1e-9), app
        assert row.root_cause_stage_names == " | ".join(f"stage {s}" for s in roots)
        assert row.failure_reasons == " | ".join(stages[s][1] or "Unknown" for s in roots)


def test_published_cases(nodes):
    found = {r.app_id: r for r in root_cause.analyze(nodes).collect()}
    assert ids(found["two_roots"].root_cause_stage_ids) == [1, 2]
    assert ids(found["two_roots"].propagation_path) == [2, 1, 3]
    assert found["two_roots"].analysis_confidence == 0.65
    assert ids(found["cascade"].root_cause_stage_ids) == [2]
    assert ids(found["cascade"].victim_stages) == [3, 4]
    assert ids(found["cascade"].propagation_path) == [2, 3, 4]
    assert found["cascade"].analysis_confidence == 0.8
    assert ids(found["abort_between"].root_cause_stage_ids) == [3]
    assert ids(found["heuristic_run"].propagation_path) == [5, 70000, 140000]


def test_lineage_matches_brute_force(nodes, apps):
    seeds = nodes.select("app_id", "stage_id")
    up, down = {}, {}
    for r in lineage.ancestors(nodes, seeds).collect():
        up.setdefault((r.app_id, r.seed_stage_id), []).append(r.ancestor_id)
    for r in lineage.descendants(nodes, seeds).collect():
        down.setdefault((r.app_id, r.seed_stage_id), []).append(r.descendant_id)
    for app, stages in apps.items():
        parents, _ = brute.build(stages)
        for stage in stages:
            assert sorted(up.get((app, stage), [])) == sorted(brute.ancestors(parents, stage)), (app, stage)
            assert sorted(down.get((app, stage), [])) == sorted(brute.descendants(parents, stage)), (app, stage)


def test_depth_and_summary(nodes, apps):
    found = {r.app_id: r for r in lineage.graph_summary(nodes).collect()}
    for app, stages in apps.items():
        parents, listed = brute.build(stages)
        row = found[app]
        assert row.is_acyclic == brute.is_acyclic(parents), app
        assert row.depth == brute.depth(parents), app
        assert row.stage_count == len(stages)
        assert row.root_count == sum(not p for p in parents.values())
        assert row.leaf_count == sum(not any(s in p for p in parents.values()) for s in stages)
        assert row.used_true_parents == listed


def test_neighbors_and_edges(nodes, apps):
    found = {(r.app_id, r.stage_id, r.relation, r.neighbor_id) for r in graph.neighbors(nodes).collect()}
    rooted = {(r.app_id, r.stage_id, r.parent_stage_id) for r in graph.edges_with_roots(nodes).collect()}
    want, want_rooted = set(), set()
    for app, stages in apps.items():
        parents, _ = brute.build(stages)
        for stage, above in parents.items():
            want_rooted |= {(app, stage, p) for p in above} or {(app, stage, -1)}
            for p in above:
                if p in stages:
                    want |= {(app, stage, "parent", p), (app, p, "child", stage)}
    assert found == want
    assert rooted == want_rooted


def test_highest_attempt_wins(spark):
    rows = [
        ("a", 1, 0, "s", "FAILED", "lost executor", ""),
        ("a", 1, 1, "s", "COMPLETED", None, ""),
        ("a", 2, 0, None, None, None, "1, x,1,,2147483648"),
        ("a", 2, 0, None, None, None, "1, x,1,,2147483648"),
    ]
    found = {r.stage_id: r for r in graph.stage_nodes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1].status == "COMPLETED"
    assert (found[2].stage_name, found[2].status, found[2].parents) == ("", "UNKNOWN", [1])


def test_tables_without_parent_column(spark):
    rows = [("a", 4, "s", "FAILED", "x"), ("a", 9, "s", "FAILED", "y")]
    stages = spark.createDataFrame(rows, "app_id STRING, stage_id INT, stage_name STRING, status STRING, failure_reason STRING")
    found = {r.stage_id: r.parents for r in graph.stage_nodes(stages).collect()}
    assert found == {4: [], 9: [4]}


def test_long_chain_needs_no_rounds(spark):
    """A chain of many failed stages is traced without a round per stage."""
    count = 150_000
    stages = spark.range(count).selectExpr(
        "'big' AS app_id",
        "CAST(id AS INT) AS stage_id",
        "0 AS stage_attempt_id",
        "'s' AS stage_name",
        "CASE WHEN id = 99999 THEN 'COMPLETED' ELSE 'FAILED' END AS status",
        "CASE WHEN id <> 99999 THEN 'out of memory' END AS failure_reason",
        "'' AS parent_ids",
    )
    nodes = materialize(graph.stage_nodes(stages), "nodes")
    traced = root_cause.trace(nodes)
    causes = traced.filter("is_root_cause").collect()
    assert [(r.stage_id, r.bfs_level) for r in causes] == [(100_000, 49_999)]
    assert traced.count() == 50_000
    assert lineage.depth_and_cycles(nodes).first().depth == count


@pytest.fixture
def written(monkeypatch):
    """Rows that the rounds of a walk write, and how many tables."""
    from faultlens.operators import closure

    tables = []
    real = closure.materialize
    monkeypatch.setattr(closure, "materialize", lambda df, *a: tables.append(real(df, *a)) or tables[-1])
    return tables


def test_long_recorded_chain(spark, written):
    """A chain of 5,000 stages with recorded parents needs log2 of that many rounds, and writes as few rows."""
    size = 5_000
    stages = spark.range(size).selectExpr(
        "'app' AS app_id", "CAST(id AS INT) AS stage_id", "0 AS stage_attempt_id", "concat('s', id) AS stage_name",
        "'FAILED' AS status", "'a rather long reason' AS failure_reason", "if(id = 0, '', CAST(id - 1 AS STRING)) AS parent_ids",
    )
    nodes = materialize(graph.stage_nodes(stages), "nodes")
    last = nodes.filter(f"stage_id = {size - 1}").select("app_id", "stage_id")

    def effort():
        rows, count = sum(t.count() for t in written), len(written)
        written.clear()
        return rows, count

    row = lineage.depth_and_cycles(nodes).first()
    assert (row.depth, row.is_acyclic) == (size, True)
    rows, tables = effort()
    assert tables < 30 and rows < 20 * size
    assert {r.ancestor_id for r in lineage.ancestors(nodes, last).collect()} == set(range(size - 1))
    rows, tables = effort()
    assert tables < 30 and rows < 20 * size
    traced = root_cause.trace(nodes).collect()
    assert {r.stage_id: r.bfs_level for r in traced} == {s: size - 1 - s for s in range(size)}
    assert [r.stage_id for r in traced if r.is_root_cause] == [0]
    rows, tables = effort()
    assert tables < 30 and rows < 20 * size


def deep_graphs(spark, levels, width, order=1):
    """Every stage of a level has all stages of the level above as parents; ids jump about if ``order`` is no 1."""
    size = levels * width
    ids = f"CAST(pmod(id * {order}, {size}) AS INT)"
    above = f"transform(sequence(0, {width - 1}), k -> CAST(pmod(((id DIV {width} - 1) * {width} + k) * {order}, {size}) AS STRING))"
    stages = spark.range(size).selectExpr(
        "'app' AS app_id", f"{ids} AS stage_id", "0 AS stage_attempt_id", "'s' AS stage_name", "'FAILED' AS status",
        "'a rather long reason' AS failure_reason", f"if(id < {width}, '', array_join({above}, ',')) AS parent_ids",
    )
    return materialize(graph.stage_nodes(stages), "nodes")


@pytest.mark.parametrize(("levels", "width", "order"), [(5_000, 2, 1), (300, 3, 7)])
def test_deep_graph_needs_few_rounds(spark, monkeypatch, levels, width, order):
    """A ladder of 5,000 levels with two parents each: under 40 rounds, and rows in proportion to edges and their logarithm."""
    from faultlens.operators import closure

    written, real = [], closure.materialize
    monkeypatch.setattr(closure, "materialize", lambda df, name, *a: written.append((name, real(df, name, *a))) or written[-1][1])
    edges = (levels - 1) * width**2

    def effort():
        rounds = sum(name in ("contracted", "round", "layer", "back") for name, _ in written)
        contractions = sum(name == "contracted" for name, _ in written)
        rows = sum(t.count() for _, t in written)
        written.clear()
        return contractions, rounds, rows

    nodes = deep_graphs(spark, levels, width, order)
    row = lineage.depth_and_cycles(nodes).first()
    assert (row.depth, row.is_acyclic) == (levels, True)
    contractions, rounds, rows = effort()
    assert 0 < contractions < 40 and rounds < 40 + closure.LEVELS + 4 and rows < edges * math.log2(edges)
    last = nodes.filter(f"stage_id = pmod({levels * width - 1} * {order}, {levels * width})").select("app_id", "stage_id")
    found = lineage.ancestors(nodes, last).agg(F.count_distinct("ancestor_id"), F.count("*")).first()
    assert tuple(found) == ((levels - 1) * width, (levels - 1) * width)
    contractions, rounds, rows = effort()
    assert 0 < contractions < 40 and rounds < 2 * 40 + closure.LEVELS + 4 and rows < edges * math.log2(edges)


def test_contraction_matches_brute_force(spark, monkeypatch):
    """Random graphs, some with circles, contracted from the first level on: depth, ancestors, descendants and the walk."""
    from faultlens.operators import closure

    monkeypatch.setattr(closure, "LEVELS", 1)
    dice = random.Random(11)
    apps = {}
    for a in range(60):
        size = dice.randrange(2, 40)
        near = dice.choice([3, 8, 40])
        apps[f"g{a}"] = {
            s: ("FAILED" if dice.random() < 0.8 else "COMPLETED", "lost" if dice.random() < 0.9 else "aborted", [p for p in range(max(0, s - near), s) if dice.random() < 2 / near])
            for s in range(size)
        }
        if a % 4 == 0:
            at = dice.randrange(size)
            apps[f"g{a}"][at][2].append(dice.randrange(at, size))
    nodes = materialize(nodes_of(spark, apps), "nodes")
    found = {r.app_id: (r.depth, r.is_acyclic) for r in lineage.depth_and_cycles(nodes).collect()}
    seeds = nodes.filter("stage_id % 5 = 1").select("app_id", "stage_id")
    above, below = {}, {}
    for r in lineage.ancestors(nodes, seeds).collect():
        above.setdefault((r.app_id, r.seed_stage_id), set()).add(r.ancestor_id)
    for r in lineage.descendants(nodes, seeds).collect():
        below.setdefault((r.app_id, r.seed_stage_id), set()).add(r.descendant_id)
    levels = {}
    for r in root_cause.trace(nodes).collect():
        levels.setdefault(r.app_id, {})[r.stage_id] = r.bfs_level
    for app, stages in apps.items():
        parents, _ = brute.build(stages)
        acyclic = brute.is_acyclic(parents)
        assert found[app] == (brute.depth(parents) if acyclic else None, acyclic), app
        for s in stages:
            if s % 5 == 1:
                assert above.get((app, s), set()) == brute.ancestors(parents, s), (app, s)
                assert below.get((app, s), set()) == brute.descendants(parents, s), (app, s)
        want = brute.analyse(stages)
        steps = levels.get(app, {})
        assert sorted(steps, key=lambda s: (steps[s], s), reverse=True) == (want[2] if want else []), app


def test_circle_and_tail(spark):
    """A recorded circle of 40 stages with a tail of 40: no depth, and everything before is an ancestor."""
    apps = {"loop": {s: ("COMPLETED", None, [39 if s == 0 else s - 1]) for s in range(80)}}
    nodes = nodes_of(spark, apps)
    row = lineage.depth_and_cycles(nodes).first()
    assert (row.depth, row.is_acyclic) == (None, False)
    seeds = nodes.filter("stage_id IN (60, 5)").select("app_id", "stage_id")
    found = {}
    for r in lineage.ancestors(nodes, seeds).collect():
        found.setdefault(r.seed_stage_id, set()).add(r.ancestor_id)
    assert found == {5: set(range(40)), 60: set(range(60))}


def test_confidence_needs_no_lists(spark):
    nodes = nodes_of(spark, CASES)
    plan = root_cause.confidence(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    want = {r.app_id: r.analysis_confidence for r in root_cause.analyze(nodes).collect()}
    assert {r.app_id: r.analysis_confidence for r in root_cause.confidence(nodes).collect()} == want


def test_mode_is_one_aggregation(spark):
    rows = [r for app, stages in CASES.items() for r in rows_of(app, stages)]
    plan = graph.graph_mode(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_tables_that_grow_send_none_whole(spark, monkeypatch):
    """Stored ids are packed so well that file sizes pass the limit for sending a table to every task."""
    monkeypatch.setattr(session, "SENT_ROWS", 0)
    rows = [("a", i, str(max(0, i - 1)) if i else "", "FAILED") for i in range(30)] + [("b", i, "", "FAILED") for i in range(5)]
    stages = spark.createDataFrame(rows, "app_id string, stage_id int, parent_ids string, status string").selectExpr(
        "*", "0 AS stage_attempt_id", "'s' AS stage_name", "'timeout' AS failure_reason"
    )
    nodes = session.materialize(graph.stage_nodes(stages), "nodes")
    terminals = root_cause.terminal_failed_stage(nodes)
    found = [
        graph.stage_nodes(stages),
        graph.neighbors(nodes),
        graph.known_edges(nodes),
        graph.with_child_counts(nodes),
        terminals,
        root_cause.trace(nodes),
        lineage.ancestors(nodes, terminals),
        lineage.graph_summary(nodes),
    ]
    for df in found:
        assert "Broadcast" not in _plan(df)


def test_a_parent_named_by_an_earlier_attempt_counts(spark):
    stages = spark.createDataFrame(
        [("a", 0, 0, ""), ("a", 1, 0, "0"), ("a", 1, 1, ""), ("b", 0, 0, ""), ("b", 1, 0, "")],
        "app_id string, stage_id int, stage_attempt_id int, parent_ids string",
    ).selectExpr("*", "'s' AS stage_name", "'COMPLETED' AS status", "CAST(NULL AS STRING) AS failure_reason")
    found = {(r.app_id, r.stage_id): (r.parents, r.used_true_parents) for r in graph.stage_nodes(stages).collect()}
    assert found == {("a", 0): ([], True), ("a", 1): ([], True), ("b", 0): ([], False), ("b", 1): ([0], False)}


def random_edges(graphs):
    """(app_id, parent, child) of random graphs with ids in any order, a third of them with circles, one edge twice; and their depths."""
    dice = random.Random(5)
    rows, depths = [], {}
    for g in range(graphs):
        app, size = f"r{g:03}", dice.randrange(2, 12)
        ids = dice.sample(range(1000), size)
        parents = {ids[k]: {ids[p] for p in range(k) if dice.random() < 3 / size} for k in range(size)}
        if g % 3 == 0:
            at = dice.randrange(size)
            parents[ids[dice.randrange(at + 1)]].add(ids[at])
        edges = [(app, p, c) for c in parents for p in parents[c]]
        if edges:
            rows += [*edges, edges[0]]
            depths[app] = brute_depth(parents, {x for edge in edges for x in edge[1:]})
    return rows, depths


def brute_depth(parents, nodes):
    """Nodes of the longest path; None if there is a circle."""
    layers = {}
    while left := [n for n in nodes if n not in layers]:
        ready = [n for n in left if all(p in layers for p in parents.get(n, ()))]
        if not ready:
            return None
        layers |= {n: 1 + max((layers[p] for p in parents.get(n, ())), default=0) for n in ready}
    return max(layers.values())


@pytest.mark.parametrize(("small", "sent"), [(10, 1), (128, 100_000)])
def test_depth_in_rows_and_by_rounds(spark, monkeypatch, small, sent):
    """The same depths whether a graph is one row or walked by rounds; without an application there is none."""
    from faultlens.operators import closure

    monkeypatch.setattr(closure, "SMALL", small)
    monkeypatch.setattr(closure, "SENT_ROWS", sent)
    rows, depths = random_edges(60)
    edges = spark.createDataFrame([*rows, (None, 1, 2), (None, 2, 3)], "app_id string, parent int, child int")
    found = closure.longest_paths(edges).collect()
    assert {r.app_id: r.depth for r in found} == depths | {None: None} and len(found) == len(depths) + 1


def test_small_graphs_need_no_rounds(spark, written):
    """Depths of many small graphs are found in two stored tables, whatever their levels."""
    rows = [(f"a{a}", s, s + 1) for a in range(50) for s in range(a + 1)]
    found = lineage.longest_paths(spark.createDataFrame(rows, "app_id string, parent int, child int")).collect()
    assert {r.app_id: r.depth for r in found} == {f"a{a}": a + 2 for a in range(50)}
    assert len(written) <= 2
