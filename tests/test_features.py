import math
import statistics

import pytest

from faultlens.functions.constants import FEATURES
from faultlens.operators import confound
from faultlens.operators import features as ft
from faultlens.sources import event_logs


def task(app, label=1, **values):
    row = dict.fromkeys(event_logs.TASK_COLUMNS, 0)
    row.update(app_id=app, label=label, executor_id="1", host="h", success=True)
    row.update(values)
    return tuple(row[c] for c in event_logs.TASK_COLUMNS)


def stage(app, number, attempt=0, status="COMPLETED", tasks=3):
    return (app, 1, number, attempt, "s", tasks, 0, 0, status, None, "")


@pytest.fixture(scope="module")
def rows(spark):
    tasks = [
        task("a", duration_ms=100, executor_run_time=7, jvm_gc_time=5, memory_bytes_spilled=10, disk_bytes_spilled=4,
             peak_execution_memory=8, input_bytes_read=20, shuffle_bytes_read=3, shuffle_bytes_written=2),
        task("a", duration_ms=0, executor_run_time=50, success=False, task_attempt=1, peak_execution_memory=2),
        task("a", duration_ms=300, executor_run_time=3, jvm_gc_time=1),
        task("one", duration_ms=9),
        task("no_stage", label=4, duration_ms=0),
    ]
    stages = [
        stage("a", 0), stage("a", 1, 0, "FAILED", 9), stage("a", 1, 1), stage("one", 0, tasks=1), stage("no_task", 0),
    ]
    return ft.app_features(
        spark.createDataFrame(tasks, event_logs.TASK_SCHEMA), spark.createDataFrame(stages, event_logs.STAGE_SCHEMA)
    )


def test_all_features_of_an_application(rows):
    got = rows.filter("app_id = 'a'").first().asDict()
    times = [100, 50, 300]
    want = {
        "mean_task_duration": 150.0,
        "std_task_duration": statistics.stdev(times),
        "max_task_duration": 300.0,
        "total_memory_spilled": 10.0,
        "total_disk_spilled": 4.0,
        "total_shuffle_read": 3.0,
        "total_shuffle_write": 2.0,
        "total_gc_time": 6.0,
        "total_stages": 3.0,
        "failed_stages": 1.0,
        "max_stage_parallelism": 9.0,
        "stage_depth_of_failure": 2.0,
        "completed_stage_ratio": 2 / 3,
        "failed_stage_ratio": 1 / 3,
        "spill_per_stage": 14 / 3,
        "gc_per_stage": 2.0,
        "duration_heterogeneity_ratio": 2.0,
        "duration_variance": statistics.variance(times),
        "max_min_duration_ratio": 6.0,
        "spill_ratio": 0.5,
        "disk_spill_ratio": 0.2,
        "peak_memory_ratio": 8 / (10 / 3),
        "gc_time_ratio": 6 / 60,
        "task_failure_rate": 1 / 3,
        "retry_count": 1.0,
    }
    assert list(want) == FEATURES
    assert {k: got[k] for k in FEATURES} == pytest.approx(want)


def test_missing_parts_are_zero_or_neutral(rows):
    found = {r.app_id: r for r in rows.collect()}
    assert set(found) == {"a", "one", "no_stage"}
    assert (found["one"].std_task_duration, found["one"].duration_variance) == (0.0, 0.0)
    bare = found["no_stage"]
    assert bare.label == 4
    neutral = ("duration_heterogeneity_ratio", "max_min_duration_ratio", "peak_memory_ratio")
    assert all(bare[f] == (1.0 if f in neutral else 0.0) for f in FEATURES)


def test_ground_truth_replaces_the_label(spark, rows):
    tasks = spark.createDataFrame([task("a", duration_ms=1), task("b", duration_ms=1)], event_logs.TASK_SCHEMA)
    stages = spark.createDataFrame([], event_logs.STAGE_SCHEMA)
    truth = spark.createDataFrame([("a", 6)], "app_id STRING, label INT")
    assert [(r.app_id, r.label) for r in ft.app_features(tasks, stages, truth).collect()] == [("a", 6)]
    named = {r.app_id: r.label_name for r in ft.ground_truth(rows).collect()}
    assert named == {"a": "OOM", "one": "OOM", "no_stage": "Network Timeout"}


def test_confound_verdicts(spark):
    base = dict.fromkeys(FEATURES, 0.0)
    data = []
    for label in range(7):
        for n in range(3):
            values = dict(base)
            values["total_stages"] = float(label)
            values["stage_depth_of_failure"] = float(label + n * (label > 2))
            values["peak_memory_ratio"] = float(n)
            data.append((f"{label}-{n}", label, *values.values()))
    df = spark.createDataFrame(data, "app_id STRING, label INT, " + ", ".join(f"{f} DOUBLE" for f in FEATURES))
    found = {r.feature: r for r in confound.verdicts(df).collect()}
    assert found["total_stages"].verdict == "STRONG" and found["total_stages"].pearson == pytest.approx(1.0)
    assert (found["stage_depth_of_failure"].zero_variance_classes, found["stage_depth_of_failure"].verdict) == (3, "MODERATE")
    assert found["stage_depth_of_failure"].zero_variance_rows == 9
    assert found["peak_memory_ratio"].verdict == "LOW"
    assert found["duration_heterogeneity_ratio"].pearson is None
    pair = confound.redundancy(df).first()
    assert (pair.identical_rows, pair.total_rows) == (13, 21) and not math.isnan(pair.pearson)


def test_exact_totals_of_measures(spark):
    """Values with six decimals are summed without rounding them first."""
    from faultlens.plans.workloads import category_totals

    rows = [(i, 0.000001 * (i + 1) + 1000 * (i % 3)) for i in range(1000)]
    got = {r.category: r.total for r in category_totals(spark.createDataFrame(rows, "event_id LONG, value DOUBLE")).collect()}
    for c in range(5):
        assert got[str(c)] == pytest.approx(sum(v for i, v in rows if i % 5 == c), abs=1e-9)


def test_rows_to_fit_are_dealt_to_many_files(spark, monkeypatch):
    from faultlens.operators import classify
    from faultlens.session import materialize

    rows = materialize(spark.createDataFrame([(f"app_{k}", k) for k in range(200)], "app_id string, label int").coalesce(1), "rows")
    assert classify.dealt(rows) is rows
    monkeypatch.setattr(classify, "TASK_ROWS", 10)
    spread = classify.dealt(rows)
    assert len(spread.inputFiles()) > 10 and sorted(spread.collect()) == sorted(rows.collect())
