"""Independent SQL for the registered queries, for an engine other than Spark.

The telemetry views are spelled out as common table expressions, the graph
walks as recursive ones. Nothing here shares code with the package; the order
of the feature vector is its list of names.
"""

from __future__ import annotations

from faultlens.functions.constants import FEATURES

PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"
NET = f"{PRICE} * (1 - CAST(l_discount AS DECIMAL(4,2)))"
QTY = "CAST(l_quantity AS DECIMAL(12,2))"

PARTSUPP = "partsupp AS (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem)"


def workloads() -> dict[str, str]:
    return {
        "q3_shipping_priority": f"""
            SELECT l_orderkey, o_orderdate, CAST(sum({NET}) AS DOUBLE) AS revenue
            FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
            WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-03-15' AND l_shipdate > TIMESTAMP '1996-03-15'
            GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 100""",
        "join_bucketed": f"""
            SELECT o_orderstatus, count(*) AS line_count, CAST(sum({NET}) AS DOUBLE) AS revenue, CAST(sum({QTY}) AS DOUBLE) AS quantity
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus""",
        "q4_order_priority": """
            SELECT o_orderpriority, count(*) AS order_count FROM orders
            WHERE o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01'
              AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
            GROUP BY o_orderpriority""",
        "q10_returned_revenue": f"""
            SELECT c_custkey, c_name, c_acctbal, n_name, CAST(sum({NET}) AS DOUBLE) AS revenue
            FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
            JOIN nation ON c_nationkey = n_nationkey
            WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND l_returnflag = 'R'
            GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 50""",
        "q10_customer_top20": f"""
            SELECT c_custkey, c_name, CAST(sum({NET}) AS DOUBLE) AS revenue
            FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
            JOIN nation ON c_nationkey = n_nationkey
            WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND l_returnflag = 'R'
            GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
        "q12_mode_priority": """
            SELECT l_returnflag,
              CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
              CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            WHERE l_returnflag IN ('R', 'A') AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
            GROUP BY l_returnflag""",
        "q9_part_revenue": f"""
            SELECT n_name, CAST(sum({PRICE}) AS DOUBLE) AS total
            FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey
            JOIN orders ON l_orderkey = o_orderkey JOIN nation ON s_nationkey = n_nationkey
            WHERE p_name LIKE '%red%' GROUP BY n_name""",
        "revenue_by_nation": f"""
            SELECT n_name, CAST(sum({PRICE}) AS DOUBLE) AS total_price
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
            JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
        "join_composite_key": f"""
            WITH {PARTSUPP}
            SELECT o_orderstatus, count(*) AS cnt
            FROM lineitem JOIN partsupp ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey
            JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus""",
        "q18_large_orders": f"""
            WITH large AS (SELECT l_orderkey AS k FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
            SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(sum({QTY}) AS DOUBLE) AS sum_qty
            FROM customer JOIN orders ON c_custkey = o_custkey JOIN large ON o_orderkey = k JOIN lineitem ON l_orderkey = o_orderkey
            GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
            ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
        "skew_union_agg": f"""
            WITH lines AS (SELECT l_orderkey, l_quantity FROM lineitem
                           UNION ALL SELECT 1, 50.0 FROM range(200000)),
            large AS (SELECT l_orderkey AS k FROM lines GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
            SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(sum({QTY}) AS DOUBLE) AS sum_qty
            FROM customer JOIN orders ON c_custkey = o_custkey JOIN large ON o_orderkey = k JOIN lines ON l_orderkey = o_orderkey
            GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
            ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
        "segment_priority_rollup": f"""
            SELECT c_mktsegment, o_orderpriority, CAST(sum({PRICE}) AS DOUBLE) AS total_price,
              CAST(sum({QTY}) AS DOUBLE) AS total_qty,
              round(CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(l_discount), 6) AS avg_disc,
              CAST(sum(CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS total_tax
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
            GROUP BY c_mktsegment, o_orderpriority ORDER BY total_price DESC, c_mktsegment, o_orderpriority LIMIT 200""",
        "nation_status_revenue": f"""
            SELECT n_name, o_orderstatus, CAST(sum({NET}) AS DOUBLE) AS revenue, count(*) AS cnt
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
            JOIN nation ON s_nationkey = n_nationkey
            GROUP BY n_name, o_orderstatus ORDER BY revenue DESC, n_name, o_orderstatus LIMIT 100""",
        "customer_spend_topk": f"""
            SELECT c_custkey, c_name, c_mktsegment, CAST(sum({PRICE}) AS DOUBLE) AS total_spent,
              count(*) AS line_count, CAST(sum({QTY}) AS DOUBLE) AS total_qty
            FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
            GROUP BY c_custkey, c_name, c_mktsegment ORDER BY total_spent DESC, c_custkey LIMIT 150""",
        "q2_supplier_part": f"""
            WITH {PARTSUPP}
            SELECT s_acctbal, s_name, n_name, p_partkey, p_brand
            FROM part JOIN partsupp ON p_partkey = ps_partkey JOIN supplier ON ps_suppkey = s_suppkey
            JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
            WHERE p_size = 15 AND p_type LIKE '%Y' AND r_name = 'EUROPE'
            ORDER BY s_acctbal DESC, s_name, p_partkey LIMIT 100""",
        "customer_total_price": f"""
            SELECT c_name, c_custkey, CAST(sum({PRICE}) AS DOUBLE) AS total_price, count(*) AS order_count
            FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
            GROUP BY c_name, c_custkey ORDER BY total_price DESC, c_custkey LIMIT 100""",
        "customer_supplier_total": f"""
            SELECT c_name, s_name, CAST(sum({PRICE}) AS DOUBLE) AS total_price
            FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
            JOIN supplier ON l_suppkey = s_suppkey
            GROUP BY c_name, s_name ORDER BY total_price DESC, c_name, s_name LIMIT 50""",
        "category_totals": """
            SELECT CAST(event_id % 5 AS VARCHAR) AS category, CAST(sum(CAST(value AS DECIMAL(24,9))) AS DOUBLE) AS total
            FROM events GROUP BY category""",
        "order_pairs_total": """
            SELECT CAST(count(*) AS DOUBLE) AS total_rows, CAST(sum(CAST(a.o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total_price
            FROM orders a CROSS JOIN orders b""",
        "cross_join_agg": f"""
            SELECT CAST(count(*) AS DOUBLE) AS total_rows, CAST(sum({PRICE}) AS DOUBLE) AS total_price
            FROM lineitem CROSS JOIN customer""",
        "q1_pricing_summary": f"""
            SELECT l_returnflag, l_linestatus, CAST(sum({QTY}) AS DOUBLE) AS sum_qty,
              CAST(sum({PRICE}) AS DOUBLE) AS sum_base_price, CAST(sum({NET}) AS DOUBLE) AS sum_disc_price,
              CAST(sum({NET} * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS DOUBLE) AS sum_charge, count(*) AS count_order
            FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus""",
    }


# One customer is an application, one order a stage, one order line a task.
NUMBERED = """
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS stage_id FROM orders)"""

STAGES = f"""{NUMBERED},
line_count AS (SELECT l_orderkey, CAST(count(*) AS INT) AS num_tasks FROM lineitem GROUP BY l_orderkey),
placed AS (SELECT *, CAST(floor((stage_id - 1) / 2.0) AS INT) AS p1, stage_id - 2 AS p2 FROM numbered),
stage_metrics AS (
  SELECT concat('app_', lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(6, length(CAST(o_custkey AS VARCHAR))) AS INT), '0')) AS app_id, CAST(o_custkey % 7 AS INT) AS label,
    stage_id, 0 AS stage_attempt_id, concat('stage ', o_orderpriority) AS stage_name, coalesce(num_tasks, 0) AS num_tasks,
    o_orderkey * 1000 AS submission_time, o_orderkey * 1000 + 500 AS completion_time,
    CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
    CASE WHEN o_orderstatus <> 'F' THEN NULL
      WHEN o_orderpriority = '1-URGENT' THEN 'java.lang.OutOfMemoryError: Java heap space'
      WHEN o_orderpriority = '2-HIGH' THEN 'FetchFailed: shuffle block missing'
      WHEN o_orderpriority = '3-MEDIUM' THEN 'No space left on device'
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Stage was cancelled' ELSE 'timeout' END AS failure_reason,
    CASE WHEN o_custkey % 10 = 0 OR stage_id = 0 THEN ''
      WHEN stage_id % 11 = 10 THEN concat(p1, ',900')
      WHEN stage_id % 3 = 2 AND p2 <> p1 THEN concat(p1, ',', p2)
      ELSE CAST(p1 AS VARCHAR) END AS parent_ids
  FROM placed LEFT JOIN line_count ON l_orderkey = o_orderkey)"""

TASKS = f"""{NUMBERED},
lines AS (SELECT *, CAST(o_custkey % 7 AS INT) AS label FROM lineitem JOIN numbered ON l_orderkey = o_orderkey),
task_metrics AS (
  SELECT concat('app_', lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(6, length(CAST(o_custkey AS VARCHAR))) AS INT), '0')) AS app_id, label, stage_id, 0 AS stage_attempt_id,
    l_orderkey * 10 + l_linenumber AS task_id,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 1 ELSE 0 END AS task_attempt,
    CAST(l_suppkey % 4 AS VARCHAR) AS executor_id, concat('host-', l_suppkey % 2) AS host,
    NOT (o_orderstatus = 'F' AND l_returnflag = 'R') AS success,
    CAST(CASE WHEN l_linestatus = 'O' THEN l_quantity * CASE WHEN label = 2 AND l_linenumber = 1 THEN 2000 ELSE 100 END ELSE 0 END AS BIGINT) AS duration_ms,
    CAST(l_quantity * 90 AS BIGINT) AS executor_run_time,
    CAST(l_quantity * CASE WHEN label = 1 THEN 30 ELSE 2 END AS BIGINT) AS jvm_gc_time,
    CAST(CASE WHEN label IN (1, 5) THEN l_partkey * 1024 ELSE 0 END AS BIGINT) AS memory_bytes_spilled,
    CAST(CASE WHEN label = 5 THEN l_partkey * 512 ELSE 0 END AS BIGINT) AS disk_bytes_spilled,
    CAST(l_suppkey * 4096 AS BIGINT) AS peak_execution_memory, CAST(l_partkey * 100 AS BIGINT) AS input_bytes_read,
    CAST(CASE WHEN stage_id > 0 THEN l_quantity * 1000 ELSE 0 END AS BIGINT) AS shuffle_bytes_read,
    CAST(l_quantity * 800 AS BIGINT) AS shuffle_bytes_written,
    CAST(l_quantity * CASE WHEN label = 4 THEN 50 ELSE 1 END AS BIGINT) AS shuffle_fetch_wait_time
  FROM lines)"""

# Both sets of views; the numbering is shared.
BOTH = STAGES + TASKS.replace(NUMBERED, "", 1)

NODES = f"""{STAGES},
tokens AS (SELECT app_id, stage_id, CAST(unnest(string_split(parent_ids, ',')) AS INT) AS parent
           FROM stage_metrics WHERE parent_ids <> ''),
true_apps AS (SELECT DISTINCT app_id FROM tokens),
chain AS (SELECT app_id, stage_id, lag(stage_id) OVER (PARTITION BY app_id ORDER BY stage_id) AS parent
          FROM stage_metrics WHERE app_id NOT IN (SELECT app_id FROM true_apps)),
edge AS (SELECT DISTINCT app_id, parent, stage_id AS child FROM tokens
         UNION ALL SELECT app_id, parent, stage_id FROM chain WHERE parent IS NOT NULL),
known AS (SELECT e.* FROM edge e JOIN stage_metrics s ON s.app_id = e.app_id AND s.stage_id = e.parent)"""

FAILED = f"""{NODES},
failed AS (SELECT app_id, stage_id, stage_name, failure_reason,
             (lower(failure_reason) LIKE '%cancelled%' OR lower(failure_reason) LIKE '%aborted%') AS aborted
           FROM stage_metrics WHERE status = 'FAILED'),
placed_failed AS (
  SELECT f.*, NOT EXISTS (SELECT 1 FROM known k WHERE k.app_id = f.app_id AND k.parent = f.stage_id) AS is_leaf,
    NOT EXISTS (SELECT 1 FROM known k JOIN failed c ON c.app_id = k.app_id AND c.stage_id = k.child
                WHERE k.app_id = f.app_id AND k.parent = f.stage_id) AS is_last
  FROM failed f),
terminal AS (SELECT app_id, coalesce(max(CASE WHEN is_leaf THEN stage_id END), max(CASE WHEN is_last THEN stage_id END),
               max(stage_id)) AS stage_id FROM placed_failed GROUP BY app_id)"""

WALK = f"""{FAILED},
blamed AS (SELECT k.app_id, k.child, k.parent FROM known k
           JOIN failed c ON c.app_id = k.app_id AND c.stage_id = k.child
           JOIN failed p ON p.app_id = k.app_id AND p.stage_id = k.parent WHERE NOT p.aborted),
walk AS (SELECT app_id, stage_id, 0 AS lvl FROM terminal
         UNION SELECT w.app_id, b.parent, w.lvl + 1 FROM walk w JOIN blamed b ON b.app_id = w.app_id AND b.child = w.stage_id
         WHERE w.lvl < 1000),
visited AS (SELECT app_id, stage_id, min(lvl) AS bfs_level FROM walk GROUP BY app_id, stage_id),
trace AS (SELECT v.*, NOT EXISTS (SELECT 1 FROM blamed b WHERE b.app_id = v.app_id AND b.child = v.stage_id) AS is_root_cause
          FROM visited v)"""

RESULTS = f"""{WALK},
apps AS (SELECT DISTINCT app_id FROM stage_metrics),
parent_count AS (SELECT app_id, child AS stage_id, count(*) AS n FROM edge GROUP BY app_id, child),
detail AS (SELECT t.*, s.stage_name, s.failure_reason, coalesce(n, 0) AS n_parents
           FROM trace t JOIN stage_metrics s USING (app_id, stage_id) LEFT JOIN parent_count USING (app_id, stage_id)),
unclean AS (SELECT DISTINCT d.app_id FROM detail d JOIN known k ON k.app_id = d.app_id AND k.child = d.stage_id
            JOIN stage_metrics p ON p.app_id = k.app_id AND p.stage_id = k.parent
            WHERE d.is_root_cause AND p.status <> 'COMPLETED'),
analysed AS (
  SELECT app_id,
    string_agg(CAST(stage_id AS VARCHAR), ',' ORDER BY stage_id) FILTER (WHERE is_root_cause) AS root_cause_stage_ids,
    string_agg(stage_name, ' | ' ORDER BY stage_id) FILTER (WHERE is_root_cause) AS root_cause_stage_names,
    string_agg(coalesce(failure_reason, 'Unknown'), ' | ' ORDER BY stage_id) FILTER (WHERE is_root_cause) AS failure_reasons,
    string_agg(CAST(stage_id AS VARCHAR), ',' ORDER BY bfs_level DESC, stage_id DESC) AS propagation_path,
    coalesce(string_agg(CAST(stage_id AS VARCHAR), ',' ORDER BY stage_id) FILTER (WHERE NOT is_root_cause), '') AS victim_stages,
    0.5 + max(CASE WHEN is_root_cause AND length(failure_reason) > 10 THEN 0.2 ELSE 0.0 END)
        + CASE WHEN max(n_parents) <= 1 THEN 0.15 ELSE 0.0 END
        + CASE WHEN app_id IN (SELECT app_id FROM unclean) THEN 0.0 ELSE 0.15 END
        - 0.1 * greatest(count(*) FILTER (WHERE is_root_cause) - 2, 0) AS confidence
  FROM detail GROUP BY app_id),
root_causes AS (
  SELECT app_id, coalesce(root_cause_stage_ids, '') AS root_cause_stage_ids,
    coalesce(root_cause_stage_names, 'None') AS root_cause_stage_names,
    coalesce(failure_reasons, 'NO_FAILURE') AS failure_reasons,
    coalesce(propagation_path, '') AS propagation_path, coalesce(victim_stages, '') AS victim_stages,
    CASE WHEN confidence IS NULL THEN 1.0 ELSE round(CAST(least(greatest(confidence, 0.0), 1.0) AS DOUBLE), 4) END AS analysis_confidence
  FROM apps LEFT JOIN analysed USING (app_id))"""

LINEAGE = f"""{FAILED},
first_failed AS (SELECT app_id, min(stage_id) AS stage_id FROM failed GROUP BY app_id),
up AS (SELECT app_id, stage_id AS seed, stage_id AS node FROM terminal
       UNION SELECT u.app_id, u.seed, e.parent FROM up u JOIN edge e ON e.app_id = u.app_id AND e.child = u.node),
down AS (SELECT app_id, stage_id AS seed, stage_id AS node FROM first_failed
         UNION SELECT d.app_id, d.seed, k.child FROM down d JOIN known k ON k.app_id = d.app_id AND k.parent = d.node)"""

# The longest path: every step adds one, the deepest step counts.
SUMMARY = f"""{NODES},
steps AS (SELECT app_id, stage_id, 1 AS depth FROM stage_metrics
          UNION SELECT app_id, parent, 1 FROM edge
          UNION SELECT s.app_id, e.child, s.depth + 1 FROM steps s JOIN edge e ON e.app_id = s.app_id AND e.parent = s.stage_id
          WHERE s.depth < 1000),
depths AS (SELECT app_id, max(depth) AS depth FROM steps GROUP BY app_id),
reachable AS (SELECT app_id, parent AS a, child AS b FROM known
              UNION SELECT r.app_id, r.a, k.child FROM reachable r JOIN known k ON k.app_id = r.app_id AND k.parent = r.b),
cyclic AS (SELECT DISTINCT app_id FROM reachable WHERE a = b),
summary AS (
  SELECT s.app_id, count(*) AS stage_count, count(*) FILTER (WHERE status = 'FAILED') AS failed_count,
    count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.app_id = s.app_id AND e.child = s.stage_id)) AS root_count,
    count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.app_id = s.app_id AND e.parent = s.stage_id)) AS leaf_count,
    CAST(max(d.depth) AS INT) AS depth, s.app_id NOT IN (SELECT app_id FROM cyclic) AS is_acyclic,
    s.app_id IN (SELECT app_id FROM true_apps) AS used_true_parents
  FROM stage_metrics s JOIN depths d ON d.app_id = s.app_id GROUP BY s.app_id)"""


def graphs() -> dict[str, str]:
    return {
        "dag_nodes": f"""WITH {NODES}
            SELECT app_id, stage_id, stage_name, status, failure_reason,
              coalesce((SELECT string_agg(CAST(parent AS VARCHAR), ',' ORDER BY parent) FROM edge e
                        WHERE e.app_id = s.app_id AND e.child = s.stage_id), '') AS parent_ids,
              app_id IN (SELECT app_id FROM true_apps) AS used_true_parents
            FROM stage_metrics s""",
        "dag_mode": f"WITH {NODES} SELECT DISTINCT app_id, app_id IN (SELECT app_id FROM true_apps) AS used_true_parents FROM stage_metrics",
        "dag_heuristic_chain": f"WITH {NODES} SELECT app_id, stage_id, parent AS previous_stage_id FROM chain",
        "dag_edges": f"WITH {NODES} SELECT app_id, parent AS parent_stage_id, child AS child_stage_id FROM edge",
        "dag_edges_with_roots": f"""WITH {NODES}
            SELECT s.app_id, s.stage_id, coalesce(parent, -1) AS parent_stage_id, stage_name, status
            FROM stage_metrics s LEFT JOIN edge e ON e.app_id = s.app_id AND e.child = s.stage_id""",
        "dag_roots_leaves": f"""WITH {NODES},
            flags AS (SELECT app_id, stage_id,
              NOT EXISTS (SELECT 1 FROM edge e WHERE e.app_id = s.app_id AND e.child = s.stage_id) AS is_root,
              NOT EXISTS (SELECT 1 FROM edge e WHERE e.app_id = s.app_id AND e.parent = s.stage_id) AS is_leaf
              FROM stage_metrics s)
            SELECT * FROM flags WHERE is_root OR is_leaf""",
        "dag_neighbors": f"""WITH {NODES}
            SELECT k.app_id, k.child AS stage_id, 'parent' AS relation, k.parent AS neighbor_id, s.status AS neighbor_status
            FROM known k JOIN stage_metrics s ON s.app_id = k.app_id AND s.stage_id = k.parent
            UNION ALL
            SELECT k.app_id, k.parent, 'child', k.child, s.status
            FROM known k JOIN stage_metrics s ON s.app_id = k.app_id AND s.stage_id = k.child""",
        "dag_ancestors": f"WITH RECURSIVE {LINEAGE} SELECT app_id, seed AS seed_stage_id, node AS ancestor_id FROM up WHERE node <> seed",
        "dag_descendants": f"WITH RECURSIVE {LINEAGE} SELECT app_id, seed AS seed_stage_id, node AS descendant_id FROM down WHERE node <> seed",
        "dag_is_acyclic": f"WITH RECURSIVE {SUMMARY} SELECT app_id, is_acyclic FROM summary",
        "dag_depth": f"WITH RECURSIVE {SUMMARY} SELECT app_id, depth FROM summary",
        "dag_summary": f"WITH RECURSIVE {SUMMARY} SELECT * FROM summary",
        "failed_stages": f"WITH {FAILED} SELECT app_id, stage_id, stage_name, failure_reason, is_leaf FROM placed_failed",
        "first_failed_leaf": f"WITH {FAILED} SELECT app_id, min(stage_id) AS stage_id FROM placed_failed WHERE is_leaf GROUP BY app_id",
        "logical_aborts": f"""WITH {FAILED}
            SELECT f.app_id, f.stage_id, f.stage_name, 'FAILED' AS status, f.failure_reason FROM failed f WHERE aborted""",
        "terminal_failed_stage": f"WITH {FAILED} SELECT app_id, stage_id FROM terminal",
        "root_cause_stages": f"WITH RECURSIVE {WALK} SELECT app_id, stage_id FROM trace WHERE is_root_cause",
        "victim_stages": f"WITH RECURSIVE {WALK} SELECT app_id, stage_id FROM trace WHERE NOT is_root_cause",
        "propagation_path": f"WITH RECURSIVE {WALK} SELECT app_id, stage_id, CAST(bfs_level AS INT) AS bfs_level FROM trace",
        "rca_confidence": f"WITH RECURSIVE {RESULTS} SELECT app_id, analysis_confidence FROM root_causes",
        "root_causes": f"WITH RECURSIVE {RESULTS} SELECT * FROM root_causes",
        "root_cause_summary": f"""WITH RECURSIVE {RESULTS}
            SELECT substr(failure_reasons, 1, 30) AS reason, count(*) AS app_count FROM root_causes GROUP BY reason""",
    }


FEATURE_NAMES = """mean_task_duration std_task_duration max_task_duration total_memory_spilled total_disk_spilled
total_shuffle_read total_shuffle_write total_gc_time total_stages failed_stages max_stage_parallelism
stage_depth_of_failure completed_stage_ratio failed_stage_ratio spill_per_stage gc_per_stage
duration_heterogeneity_ratio duration_variance max_min_duration_ratio spill_ratio disk_spill_ratio
peak_memory_ratio gc_time_ratio task_failure_rate retry_count""".split()

#: Lines of an application's log file: its events, and how many of them have noise beside them.
NOISE = """parts AS (
  SELECT app_id, label, count(*) AS events, count(*) FILTER (WHERE task_id % 20 = 0) AS noisy FROM task_metrics GROUP BY app_id, label
  UNION ALL
  SELECT app_id, label, 2 * count(*), count(*) FILTER (WHERE stage_id % 5 = 0) FROM stage_metrics GROUP BY app_id, label),
per_app AS (SELECT app_id, label, CAST(sum(events) AS BIGINT) AS events, CAST(sum(noisy) AS BIGINT) AS noisy FROM parts GROUP BY app_id, label),
apps AS (SELECT DISTINCT app_id FROM per_app)"""

#: The mean of doubles below 2^56 over their exact sum: multiples of 2^-70 as whole numbers, which add without rounding.
EXACT_MEAN = "CAST(sum(CAST(trunc(value * power(2.0::DOUBLE, 70)) AS HUGEINT)) AS DOUBLE) / power(2.0::DOUBLE, 70) / count(value)"

FEATS = f"""{BOTH},
timed AS (SELECT *, CASE WHEN duration_ms > 0 THEN duration_ms ELSE executor_run_time END AS d FROM task_metrics),
t AS (SELECT app_id, min(label) AS label, count(*) AS n_tasks, sum(CASE WHEN success THEN 0 ELSE 1 END) AS n_failed,
  sum(CASE WHEN task_attempt > 0 THEN 1 ELSE 0 END) AS retry_count, avg(d) AS mean_task_duration,
  stddev_samp(d) AS std_task_duration, var_samp(d) AS duration_variance, min(d) AS min_d, max(d) AS max_task_duration,
  avg(peak_execution_memory) AS avg_peak, max(peak_execution_memory) AS max_peak,
  sum(memory_bytes_spilled) AS total_memory_spilled, sum(disk_bytes_spilled) AS total_disk_spilled,
  sum(shuffle_bytes_read) AS total_shuffle_read, sum(shuffle_bytes_written) AS total_shuffle_write,
  sum(jvm_gc_time) AS total_gc_time, sum(executor_run_time) AS run_time, sum(input_bytes_read) AS input
  FROM timed GROUP BY app_id),
s AS (SELECT app_id, count(*) AS total_stages, sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS failed_stages,
  sum(CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END) AS stage_depth_of_failure, max(num_tasks) AS max_stage_parallelism
  FROM stage_metrics GROUP BY app_id),
j AS (SELECT t.*, coalesce(total_stages, 0) AS total_stages, coalesce(failed_stages, 0) AS failed_stages,
  coalesce(stage_depth_of_failure, 0) AS stage_depth_of_failure, coalesce(max_stage_parallelism, 0) AS max_stage_parallelism
  FROM t LEFT JOIN s ON s.app_id = t.app_id),
features AS (SELECT app_id, label, CAST(mean_task_duration AS DOUBLE) AS mean_task_duration,
  coalesce(std_task_duration, 0.0) AS std_task_duration, CAST(max_task_duration AS DOUBLE) AS max_task_duration,
  CAST(total_memory_spilled AS DOUBLE) AS total_memory_spilled, CAST(total_disk_spilled AS DOUBLE) AS total_disk_spilled,
  CAST(total_shuffle_read AS DOUBLE) AS total_shuffle_read, CAST(total_shuffle_write AS DOUBLE) AS total_shuffle_write,
  CAST(total_gc_time AS DOUBLE) AS total_gc_time, CAST(total_stages AS DOUBLE) AS total_stages,
  CAST(failed_stages AS DOUBLE) AS failed_stages, CAST(max_stage_parallelism AS DOUBLE) AS max_stage_parallelism,
  CAST(stage_depth_of_failure AS DOUBLE) AS stage_depth_of_failure,
  CASE WHEN total_stages > 0 THEN CAST(stage_depth_of_failure AS DOUBLE) / total_stages ELSE 0.0 END AS completed_stage_ratio,
  CASE WHEN total_stages > 0 THEN CAST(failed_stages AS DOUBLE) / total_stages ELSE 0.0 END AS failed_stage_ratio,
  CASE WHEN total_stages > 0 THEN CAST(total_memory_spilled + total_disk_spilled AS DOUBLE) / total_stages ELSE 0.0 END AS spill_per_stage,
  CASE WHEN total_stages > 0 THEN CAST(total_gc_time AS DOUBLE) / total_stages ELSE 0.0 END AS gc_per_stage,
  CASE WHEN mean_task_duration > 0 THEN CAST(max_task_duration AS DOUBLE) / mean_task_duration ELSE 1.0 END AS duration_heterogeneity_ratio,
  coalesce(duration_variance, 0.0) AS duration_variance,
  CASE WHEN min_d > 0 THEN CAST(max_task_duration AS DOUBLE) / min_d ELSE 1.0 END AS max_min_duration_ratio,
  CASE WHEN input > 0 THEN CAST(total_memory_spilled AS DOUBLE) / input ELSE 0.0 END AS spill_ratio,
  CASE WHEN input > 0 THEN CAST(total_disk_spilled AS DOUBLE) / input ELSE 0.0 END AS disk_spill_ratio,
  CASE WHEN avg_peak > 0 THEN CAST(max_peak AS DOUBLE) / avg_peak ELSE 1.0 END AS peak_memory_ratio,
  CASE WHEN run_time > 0 THEN CAST(total_gc_time AS DOUBLE) / run_time ELSE 0.0 END AS gc_time_ratio,
  CASE WHEN n_tasks > 0 THEN CAST(n_failed AS DOUBLE) / n_tasks ELSE 0.0 END AS task_failure_rate,
  CAST(retry_count AS DOUBLE) AS retry_count FROM j),
long AS (""" + " UNION ALL ".join(
    f"SELECT app_id, label, '{name}' AS feature, {name} AS value FROM features" for name in FEATURE_NAMES
) + ")"

NAMES = """(VALUES (0, 'Baseline'), (1, 'OOM'), (2, 'Data Skew'), (3, 'Serialization Failure'),
  (4, 'Network Timeout'), (5, 'Disk Space Failure'), (6, 'Metadata Failure')) AS names(label, label_name)"""

PREDICTED = f"""{TASKS},
predictions AS (SELECT app_id, min(label) AS label,
  CAST(CASE WHEN CAST(substr(app_id, 5) AS BIGINT) % 5 = 0 THEN (min(label) + 1) % 7 ELSE min(label) END AS INT) AS prediction,
  (70 + CAST(substr(app_id, 5) AS BIGINT) % 30) / CAST(100 AS DOUBLE) AS confidence
  FROM task_metrics GROUP BY app_id)"""

PER_CLASS = f"""{PREDICTED},
classes AS (SELECT label AS c FROM predictions UNION SELECT prediction FROM predictions),
per_class AS (SELECT c, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS predicted,
  count(*) FILTER (WHERE label = c AND prediction = c) AS tp FROM classes, predictions GROUP BY c),
scored AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM per_class)"""

VERDICT_FEATURES = "('total_stages', 'stage_depth_of_failure', 'peak_memory_ratio', 'duration_heterogeneity_ratio')"

TASK_LIST = """app_id, label, stage_id, stage_attempt_id, task_id, task_attempt, executor_id, host, success, duration_ms,
  executor_run_time, jvm_gc_time, memory_bytes_spilled, disk_bytes_spilled, peak_execution_memory, input_bytes_read,
  shuffle_bytes_read, shuffle_bytes_written, shuffle_fetch_wait_time"""

MANIFEST = f"""{STAGES},
manifest AS (SELECT concat('RUN_', app_id) AS AppName, label_name AS FailureType, s.label AS Label, substr(app_id, 5) AS RunId,
  app_id AS AppId, CASE WHEN CAST(substr(app_id, 5) AS BIGINT) % 9 = 0 THEN 'ERROR'
    WHEN CAST(substr(app_id, 5) AS BIGINT) % 9 = 1 THEN 'TIMEOUT'
    WHEN count(*) FILTER (WHERE status = 'FAILED') > 0 THEN 'FAILED' ELSE 'FINISHED' END AS Status
  FROM stage_metrics s JOIN {NAMES} ON names.label = s.label GROUP BY app_id, s.label, label_name)"""


def _rounded(exact: dict[str, int] | None = None) -> str:
    digits = exact or {}
    return ", ".join(f"round({n}, {digits[n]}) AS {n}" if n in digits else n for n in FEATURE_NAMES)


def telemetry() -> dict[str, str]:
    spread = {"std_task_duration": 4, "duration_variance": 4}
    return {
        "task_metrics": f"WITH {TASKS} SELECT {TASK_LIST} FROM task_metrics",
        "stage_metrics": f"WITH {STAGES} SELECT * FROM stage_metrics",
        "parse_task_events": f"WITH {TASKS} SELECT {TASK_LIST} FROM task_metrics",
        "parse_stage_events": f"WITH {STAGES} SELECT * FROM stage_metrics",
        "parse_stage_parents": f"WITH {STAGES} SELECT app_id, stage_id, parent_ids FROM stage_metrics",
        "scan_task_rows": f"WITH {TASKS} SELECT {TASK_LIST} FROM task_metrics",
        "scan_stage_rows": f"WITH {STAGES} SELECT * FROM stage_metrics",
        "scan_counters": f"""WITH {BOTH}, {NOISE}
            SELECT (SELECT count(*) FROM apps) AS files, events + 3 * noisy + (SELECT count(*) FROM apps) AS lines, events AS parsed,
              noisy AS malformed, noisy AS other_event
            FROM (SELECT CAST(sum(events) AS BIGINT) AS events, CAST(sum(noisy) AS BIGINT) AS noisy FROM per_app)""",
        "scan_rejected": f"""WITH {BOTH}, {NOISE}
            SELECT app_id, label, reason, noisy AS lines, 1 AS files FROM per_app, (VALUES ('malformed'), ('other_event')) r(reason) WHERE noisy > 0""",
        "scan_report": f"""WITH {BOTH}, {NOISE}
            SELECT app_id, events + 3 * noisy + 1 AS lines, true AS ended, true AS has_bytes FROM per_app""",
        "parse_once_counts": f"""WITH {BOTH} SELECT (SELECT count(*) FROM task_metrics) AS tasks,
            (SELECT count(*) FROM stage_metrics) AS stages""",
        "task_aggregates": f"""WITH {FEATS} SELECT app_id, label, n_tasks AS total_tasks, CAST(n_failed AS BIGINT) AS failed_tasks,
            CAST(retry_count AS BIGINT) AS retry_count, mean_task_duration, round(std_task_duration, 4) AS std_task_duration,
            round(duration_variance, 4) AS duration_variance, min_d AS min_task_duration, max_task_duration,
            avg_peak AS avg_peak_memory, max_peak AS max_peak_memory, CAST(total_memory_spilled AS BIGINT) AS total_memory_spilled,
            CAST(total_disk_spilled AS BIGINT) AS total_disk_spilled, CAST(total_shuffle_read AS BIGINT) AS total_shuffle_read,
            CAST(total_shuffle_write AS BIGINT) AS total_shuffle_write, CAST(total_gc_time AS BIGINT) AS total_gc_time,
            CAST(run_time AS BIGINT) AS total_run_time, CAST(input AS BIGINT) AS total_input FROM t""",
        "stage_aggregates": f"""WITH {FEATS} SELECT app_id, total_stages, CAST(failed_stages AS BIGINT) AS failed_stages,
            CAST(stage_depth_of_failure AS BIGINT) AS stage_depth_of_failure, max_stage_parallelism FROM s""",
        "app_features": f"WITH {FEATS} SELECT app_id, label, {_rounded(spread)} FROM features",
        "feature_vectors": f"WITH {FEATS} "
        + " UNION ALL ".join(
            f"SELECT app_id, CAST(label AS INT) AS label, {i} AS position, round(CAST({name} AS DOUBLE), 4) AS value FROM features"
            for i, name in enumerate(FEATURES)
        ),
        "ml_prediction_checks": f"""WITH {TASKS}, a AS (SELECT DISTINCT app_id FROM task_metrics),
            t AS (SELECT count(*) AS n FROM a WHERE CAST(concat('0x', substr(md5(app_id), 1, 8)) AS BIGINT) % 100 >= 80)
            SELECT n AS scored, n AS apps, n AS in_range, n AS probabilities_sum_to_one FROM t""",
        "ml_model_checks": f"""WITH {TASKS}, a AS (SELECT DISTINCT app_id FROM task_metrics),
            t AS (SELECT count(*) AS n FROM a WHERE CAST(concat('0x', substr(md5(app_id), 1, 8)) AS BIGINT) % 100 >= 80)
            SELECT model, n AS scored, n AS apps, 7 AS matrix_rows, n AS matrix_total, n AS class_total, true AS counts_agree
            FROM t, (VALUES ('logistic_regression'), ('decision_tree'), ('random_forest')) m(model)""",
        "ml_importance_checks": f"""SELECT {len(FEATURES)} AS features, {sum(range(len(FEATURES) + 1))} AS rank_sum,
            1.0::DOUBLE AS share_sum, 1.0::DOUBLE AS last_share, true AS ranks_follow""",
        "feature_describe": f"""WITH {FEATS} SELECT feature, count(value) AS n, round({EXACT_MEAN}, 3) AS mean,
            round(stddev_samp(value), 2) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max FROM long GROUP BY feature""",
        "ground_truth": f"""WITH {TASKS}, g AS (SELECT app_id, max(label) AS label FROM task_metrics GROUP BY app_id)
            SELECT app_id, g.label, label_name FROM g JOIN {NAMES} ON names.label = g.label""",
        "label_distribution": f"""WITH {TASKS}, g AS (SELECT app_id, max(label) AS label FROM task_metrics GROUP BY app_id)
            SELECT g.label, label_name, count(*) AS app_count FROM g JOIN {NAMES} ON names.label = g.label GROUP BY g.label, label_name""",
        "split_by_key": f"""WITH {TASKS}, a AS (SELECT DISTINCT app_id, label FROM task_metrics)
            SELECT app_id, label, CASE WHEN CAST(concat('0x', substr(md5(app_id), 1, 8)) AS BIGINT) % 100 < 80
              THEN 'train' ELSE 'test' END AS split FROM a""",
        "split_label_counts": f"""WITH {TASKS}, a AS (SELECT DISTINCT app_id, label FROM task_metrics),
            s AS (SELECT label, CASE WHEN CAST(concat('0x', substr(md5(app_id), 1, 8)) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM a)
            SELECT split, label, count(*) AS app_count FROM s GROUP BY split, label""",
        "classification_metrics": f"""WITH {PER_CLASS} SELECT round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy,
            round(sum(support * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(support), 6) AS f1,
            round(sum(support * p) / sum(support), 6) AS precision, round(sum(support * r) / sum(support), 6) AS recall FROM scored""",
        "confusion_matrix": f"""WITH {PREDICTED} SELECT names.label, """
        + ", ".join(f"count(*) FILTER (WHERE prediction = {c}) AS predicted_{c}" for c in range(7))
        + f" FROM {NAMES} LEFT JOIN predictions p ON p.label = names.label GROUP BY names.label",
        "per_class_accuracy": f"""WITH {PREDICTED} SELECT p.label, label_name, count(*) FILTER (WHERE p.label = prediction) AS correct,
            count(*) AS total, round(count(*) FILTER (WHERE p.label = prediction) / count(*), 6) AS accuracy,
            count(*) FILTER (WHERE p.label = prediction) / count(*) >= 0.5 AS passed
            FROM predictions p JOIN {NAMES} ON names.label = p.label GROUP BY p.label, label_name""",
        "misclassified": f"WITH {PREDICTED} SELECT app_id, label, prediction FROM predictions WHERE label <> prediction",
        "class_feature_stats": f"""WITH {FEATS} SELECT feature, label, round({EXACT_MEAN}, 3) AS mean, round(stddev_samp(value), 2) AS std,
            round(min(value), 4) AS min, round(max(value), 4) AS max, count(*) AS n FROM long GROUP BY feature, label""",
        "feature_correlation": f"""WITH {FEATS} SELECT feature, round(corr(value, CAST(label AS DOUBLE)), 6) AS pearson FROM long GROUP BY feature""",
        "feature_redundancy": f"""WITH {FEATS} SELECT 'total_stages' AS first_feature, 'stage_depth_of_failure' AS second_feature,
            round(corr(total_stages, stage_depth_of_failure), 6) AS pearson,
            count(*) FILTER (WHERE total_stages = stage_depth_of_failure) AS identical_rows, count(*) AS total_rows,
            round(count(*) FILTER (WHERE total_stages = stage_depth_of_failure) / count(*), 6) AS identical_share,
            corr(total_stages, stage_depth_of_failure) > 0.95 AS is_redundant FROM features""",
        "confound_verdict": f"""WITH {FEATS}, c AS (SELECT feature, label, count(*) AS n,
              coalesce(stddev_samp(value), 0) = 0 OR min(value) = max(value) AS fixed
              FROM long WHERE feature IN {VERDICT_FEATURES} GROUP BY feature, label),
            v AS (SELECT feature, count(*) FILTER (WHERE fixed) AS zero_variance_classes,
              CAST(coalesce(sum(n) FILTER (WHERE fixed), 0) AS BIGINT) AS zero_variance_rows, CAST(sum(n) AS BIGINT) AS total_rows
              FROM c GROUP BY feature),
            p AS (SELECT feature, round(corr(value, CAST(label AS DOUBLE)), 6) AS pearson FROM long GROUP BY feature)
            SELECT v.*, pearson, CASE WHEN zero_variance_classes >= 4 THEN 'STRONG' WHEN zero_variance_classes >= 2 THEN 'MODERATE'
              ELSE 'LOW' END AS verdict FROM v JOIN p ON p.feature = v.feature""",
        "unified_report": f"""WITH RECURSIVE {RESULTS}, {PREDICTED.replace(NUMBERED + ',', '', 1)},
            rows AS (SELECT coalesce(r.app_id, p.app_id) AS app_id,
              concat('[', coalesce(root_cause_stage_ids, ''), ']') AS roots, concat('[', coalesce(victim_stages, ''), ']') AS victims,
              coalesce(CASE prediction WHEN 0 THEN 'Baseline' WHEN 1 THEN 'OOM' WHEN 2 THEN 'Data Skew' WHEN 3 THEN 'Serialization'
                WHEN 4 THEN 'Network Timeout' WHEN 5 THEN 'Disk Space' WHEN 6 THEN 'Metadata' END, 'Not Available') AS predicted_class,
              coalesce(p.confidence, 0.0) AS confidence
              FROM root_causes r FULL JOIN predictions p ON p.app_id = r.app_id)
            SELECT app_id, predicted_class, confidence, concat('{{"app_id":"', app_id, '","root_cause_analysis":{{"root_cause_stages":', roots,
              ',"victim_stages":', victims, '}},"failure_classification":{{"predicted_class":"', predicted_class, '","confidence":',
              CAST(confidence AS VARCHAR), '}},"note":"root_cause_analysis and failure_classification are independent analyses over the '
              'same raw event log; classification does not currently use root_cause_analysis as an input."}}') AS report_json
            FROM rows""",
        "manifest_completed_runs": f"WITH {MANIFEST} SELECT DISTINCT FailureType, RunId FROM manifest WHERE Status IN ('FINISHED', 'FAILED')",
        "manifest_repeated_append": f"WITH {MANIFEST} SELECT FailureType, RunId, Status FROM manifest",
        "manifest_pending_runs": f"""WITH {MANIFEST} SELECT DISTINCT FailureType, RunId FROM manifest m
            WHERE NOT EXISTS (SELECT 1 FROM manifest d WHERE d.FailureType = m.FailureType AND d.RunId = m.RunId AND d.Status IN ('FINISHED', 'FAILED'))""",
        "manifest_summary": f"""WITH {MANIFEST} SELECT FailureType, Label, count(*) FILTER (WHERE Status IN ('FINISHED', 'FAILED')) AS submitted,
            count(*) FILTER (WHERE Status LIKE 'ERROR%') AS errors FROM manifest GROUP BY FailureType, Label""",
        "table_row_counts": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
            for t in (
                "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
            ).split()
        ),
        "delimited_roundtrip": "SELECT * FROM orders",
        "format_bytes": """SELECT o_orderkey, CAST(floor(o_totalprice * 10000) AS BIGINT) AS bytes,
            CASE WHEN floor(o_totalprice * 10000) < 1024 THEN concat(CAST(floor(o_totalprice * 10000) AS BIGINT), ' B')
              WHEN floor(o_totalprice * 10000) < 1048576 THEN printf('%.2f KB', floor(o_totalprice * 10000) / 1024.0)
              WHEN floor(o_totalprice * 10000) < 1073741824 THEN printf('%.2f MB', floor(o_totalprice * 10000) / 1048576.0)
              ELSE printf('%.2f GB', floor(o_totalprice * 10000) / 1073741824.0) END AS size FROM orders""",
        "pipeline_task_rows": f"WITH {TASKS} SELECT {TASK_LIST} FROM task_metrics",
        "pipeline_root_causes": f"WITH RECURSIVE {RESULTS} SELECT * FROM root_causes",
        "pipeline_counts": f"""WITH {BOTH}, a AS (SELECT DISTINCT app_id FROM task_metrics),
            e AS (SELECT app_id, CAST(concat('0x', substr(md5(app_id), 1, 8)) AS BIGINT) % 100 < 80 AS train FROM a)
            SELECT (SELECT count(*) FROM task_metrics) AS tasks, (SELECT count(*) FROM stage_metrics) AS stages,
              (SELECT count(DISTINCT app_id) FROM stage_metrics) AS graphs, (SELECT count(DISTINCT app_id) FROM stage_metrics) AS root_causes,
              (SELECT count(*) FROM a) AS features, (SELECT count(*) FROM e WHERE train) AS train,
              (SELECT count(*) FROM e WHERE NOT train) AS test""",
    }


def oracle_sql() -> dict[str, str]:
    return {**workloads(), **graphs(), **telemetry()}
