import random

from pyspark.sql import functions as F

from faultlens.operators.prefix import running_before


def test_matches_a_plain_loop(spark):
    rnd = random.Random(5)
    rows = []
    for key in range(6):
        for order in rnd.sample(range(-100_000, 400_000), 300):
            rows.append((key, order, rnd.random() < 0.2))
    df = spark.createDataFrame(rows, "key INT, at INT, mark BOOLEAN")
    got = running_before(
        df,
        ["key"],
        "at",
        sums={"position": F.lit(1)},
        maxima={"previous": F.col("at"), "last_mark": F.when(F.col("mark"), F.col("at"))},
        any_in_group={"any_far": F.col("at") > 399_000},
    )
    found = {(r.key, r["at"]): r for r in got.collect()}
    assert len(found) == len(rows)
    for key in range(6):
        mine = sorted(r for r in rows if r[0] == key)
        far = any(r[1] > 399_000 for r in mine)
        last = None
        for i, (_, at, mark) in enumerate(mine):
            row = found[(key, at)]
            assert row.position == i
            assert row.previous == (mine[i - 1][1] if i else None)
            assert row.last_mark == last
            assert row.any_far == far
            last = at if mark else last


def test_levels_for_keys_of_any_range(spark):
    """Keys near 2^60 and below zero; no window sees more rows than a segment has."""
    rnd = random.Random(6)
    orders = sorted({rnd.randrange(-(1 << 62), 1 << 62) for _ in range(400)} | {(1 << 60) + i * 70_000 for i in range(200)})
    df = spark.createDataFrame([(1, o) for o in orders], "key INT, at LONG")
    got = running_before(df, ["key"], "at", sums={"position": F.lit(1)}, maxima={"previous": F.col("at")})
    rows = {r["at"]: (r.position, r.previous) for r in got.collect()}
    assert rows == {o: (i, orders[i - 1] if i else None) for i, o in enumerate(orders)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # Only the top level's window is over the whole group, which by then is cut into 2^16 segments at most.
    assert sum("segment__" not in w.split("],")[1] for w in windows) == 1, windows
