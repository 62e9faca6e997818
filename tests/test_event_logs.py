import json
import pathlib
import subprocess
import sys
import textwrap

import pytest
import zstandard
from pyspark.sql import functions as F

from faultlens.functions.constants import CLASS_LABELS
from faultlens.plans.preprocess import OUTPUTS, preprocess
from faultlens.fixtures import log_text, telemetry
from faultlens.sources import event_logs


def task(stage=0, **info):
    return {
        "Event": "SparkListenerTaskEnd",
        "Stage ID": stage,
        "Stage Attempt ID": 1,
        "Task End Reason": {"Reason": info.pop("reason", "Success")},
        "Task Info": {"Task ID": 5, "Attempt": 2, "Executor ID": "3", "Host": "h", "Launch Time": 1, **info},
        "Task Metrics": {
            "Executor Run Time": 11,
            "JVM GC Time": 12,
            "Memory Bytes Spilled": 13,
            "Disk Bytes Spilled": 14,
            "Peak Execution Memory": 15,
            "Input Metrics": {"Bytes Read": 16, "Records Read": 1},
            "Shuffle Read Metrics": {"Remote Bytes Read": 17, "Local Bytes Read": 18, "Fetch Wait Time": 19},
            "Shuffle Write Metrics": {"Shuffle Bytes Written": 20},
        },
    }


def submitted(stage, parents):
    return {"Event": "SparkListenerStageSubmitted", "Stage Info": {"Stage ID": stage, "Parent IDs": parents}}


def completed(stage, attempt=0, reason=None):
    info = {
        "Stage ID": stage,
        "Stage Attempt ID": attempt,
        "Stage Name": f"s{stage}",
        "Number of Tasks": 4,
        "Submission Time": 100,
        "Completion Time": 200,
        "Parent IDs": [77],
    }
    return {"Event": "SparkListenerStageCompleted", "Stage Info": {**info, **({"Failure Reason": reason} if reason else {})}}


LOG = [
    {"Event": "SparkListenerLogStart", "Spark Version": "x"},
    submitted(0, []),
    completed(0),
    submitted(1, [0, 9]),
    submitted(1, [0, 9]),
    completed(1, 0, "lost executor"),
    completed(1, 1),
    completed(2),
    task(),
    task(1, reason="ExceptionFailure", Duration=40),
    {"Event": "SparkListenerTaskEnd"},
    {"Event": "Custom", "text": "mentions SparkListenerTaskEnd and SparkListenerStageCompleted"},
]


def text_of(events):
    return "\n".join(json.dumps(e) for e in events) + '\n{"Event":"SparkListenerTaskEnd","Stage ID":3,"Task In\nnot json\n'


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    base = tmp_path_factory.mktemp("logs")
    for name in ("oom", "disk", "network", "elsewhere"):
        (base / name).mkdir()
    (base / "oom" / "application_1_1").write_text(text_of(LOG))
    (base / "disk" / "application_1_2.zstd").write_bytes(zstandard.compress(text_of(LOG).encode()))
    (base / "network" / "notes.txt").write_text(text_of(LOG))
    (base / "elsewhere" / "application_1_9").write_text(text_of(LOG))
    rolled = base / "network" / "eventlog_v2_application_1_3"
    rolled.mkdir()
    (rolled / "events_1_application_1_3.zstd").write_bytes(zstandard.compress(text_of(LOG).encode()))
    (rolled / "events_2_application_1_3").write_text(text_of([task(8)]))
    return str(base)


def test_scan(spark, logs):
    lines = event_logs.scan_event_logs(spark, logs)
    found = {(r.app_id, r.label): r["count"] for r in lines.groupBy("app_id", "label").count().collect()}
    # All but the log's start mention a wanted event, and so does the broken line.
    size = len(LOG)
    assert found == {("application_1_1", 1): size, ("application_1_2", 5): size, ("application_1_3", 4): size + 2}


def test_damage_fails_unless_skipped(spark, tmp_path):
    folder = tmp_path / "oom"
    folder.mkdir()
    whole = [*LOG, {"Event": "SparkListenerApplicationEnd", "Timestamp": 1}]
    (folder / "application_1_1").write_text(text_of(whole))
    (folder / "application_1_4.zstd").write_bytes(b"\x28\xb5\x2f\xfdbroken")
    with pytest.raises(Exception, match="(?i)zstd|corrupt|decompress|frame"):
        event_logs.scan_event_logs(spark, str(tmp_path)).count()
    assert event_logs.scan_event_logs(spark, str(tmp_path), skip_damaged=True).count() == len(LOG) + 0
    report = {r.path.rsplit("/", 1)[1]: r for r in event_logs.scan_report(spark, str(tmp_path)).collect()}
    assert (report["application_1_1"].lines, report["application_1_1"].ended) == (len(whole) + 2, True)
    broken = report["application_1_4.zstd"]
    assert (broken.lines, broken.ended, broken.bytes) == (0, False, 10)
    assert event_logs.scan_report(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize(
    ("name", "app"),
    [
        ("application_1", "application_1"),
        ("application_1.zst", "application_1"),
        ("application_1.zstd", "application_1"),
        ("events_1_app.zstd.compact", "app"),
        ("events_12_app.compact", "app"),
        ("application_1.zstd.old", "application_1.zstd.old"),
        ("application_1.gz", "application_1"),
    ],
)
def test_application_ids(spark, name, app):
    row = spark.createDataFrame([(name,)], "n STRING").select(event_logs.app_id_of(F.col("n")))
    assert row.first()[0] == app


def test_scan_without_folders(spark, tmp_path):
    assert event_logs.scan_event_logs(spark, str(tmp_path)).count() == 0


def test_single_log(spark, logs):
    lines = event_logs.scan_event_log(spark, f"{logs}/disk/application_1_2.zstd", 5)
    assert {(r.app_id, r.label) for r in lines.collect()} == {("application_1_2", 5)}


def test_tasks(spark, logs):
    tasks = event_logs.task_events(event_logs.scan_event_logs(spark, logs))
    assert tasks.columns == event_logs.TASK_COLUMNS
    rows = [r for r in tasks.collect() if r.app_id == "application_1_1"]
    assert len(rows) == 3
    full = {r.stage_id: r for r in rows}
    assert list(full[0])[2:] == [0, 1, 5, 2, "3", "h", True, 0, 11, 12, 13, 14, 15, 16, 35, 20, 19]
    assert (full[1].success, full[1].duration_ms) == (False, 40)
    assert list(full[-1])[2:] == [-1, 0, -1, 0, "", "", True] + [0] * 10


def test_stages(spark, logs):
    stages = event_logs.stage_events(event_logs.scan_event_logs(spark, logs))
    assert stages.columns == event_logs.STAGE_COLUMNS
    rows = {(r.stage_id, r.stage_attempt_id): r for r in stages.collect() if r.app_id == "application_1_2"}
    assert list(rows[0, 0])[1:] == [5, 0, 0, "s0", 4, 100, 200, "COMPLETED", None, ""]
    assert (rows[1, 0].status, rows[1, 0].failure_reason, rows[1, 0].parent_ids) == ("FAILED", "lost executor", "0,9")
    assert (rows[1, 1].status, rows[1, 1].parent_ids) == ("COMPLETED", "0,9")
    assert rows[2, 0].parent_ids == ""
    assert len(rows) == 4


def test_one_pass_gives_the_same_tables(spark, logs):
    lines = event_logs.scan_event_logs(spark, logs)
    tasks, stages = event_logs.parse_once(lines)
    assert tasks.columns == event_logs.TASK_COLUMNS
    assert sorted(tasks.collect()) == sorted(event_logs.task_events(lines).collect())
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(stages.collect(), key=key) == sorted(event_logs.stage_events(lines).collect(), key=key)


def test_cut_lines_are_dropped(spark):
    """A line cut anywhere is no event; one with a field of another type is."""
    line = json.dumps(task(4))
    cut = [line[:k] for k in range(1, len(line))]
    odd = json.dumps({**task(5), "Stage Attempt ID": "seven"})
    lines = spark.createDataFrame([("a", 1, v) for v in [*cut, line, odd]], "app_id STRING, label INT, value STRING")
    assert sorted((r.stage_id, r.stage_attempt_id) for r in event_logs.task_events(lines).collect()) == [(4, 1), (5, 0)]


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([], "app_id STRING, label INT, value STRING")
    plan = event_logs.task_events(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_derived_telemetry_as_files(spark, data, tmp_path):
    """Telemetry written as log files per application comes back unchanged, and
    the whole pipeline over the files equals the pipeline over the tables."""
    tasks, stages = telemetry.task_metrics(spark, data), telemetry.stage_metrics(spark, data)
    lines = log_text.task_lines(tasks).unionByName(log_text.stage_lines(stages))
    folders = {label: name for name, label in CLASS_LABELS.items()}
    for number, row in enumerate(lines.groupBy("app_id", "label").agg({"value": "collect_list"}).collect()):
        folder = pathlib.Path(tmp_path, "logs", folders[row.label])
        folder.mkdir(parents=True, exist_ok=True)
        text = "\n".join(row[2]).encode()
        if number % 2:
            (folder / f"application_{row.app_id}").write_bytes(text)
        else:
            (folder / f"application_{row.app_id}.zstd").write_bytes(zstandard.compress(text))
    out = preprocess(spark, f"{tmp_path}/logs", f"{tmp_path}/out")
    assert sorted(out) == sorted(OUTPUTS)
    renamed = tasks.selectExpr("concat('application_', app_id) AS app_id", "* EXCEPT (app_id)")
    assert out["task_metrics"].exceptAll(renamed).isEmpty() and renamed.exceptAll(out["task_metrics"]).isEmpty()
    again = stages.selectExpr("concat('application_', app_id) AS app_id", "* EXCEPT (app_id)")
    assert out["stage_metrics"].exceptAll(again).isEmpty() and again.exceptAll(out["stage_metrics"]).isEmpty()
    apps = tasks.select("app_id").distinct().count()
    assert out["features"].count() == out["ground_truth"].count() == apps
    assert out["train"].count() + out["test"].count() == apps
    assert out["root_causes"].count() == stages.select("app_id").distinct().count()


def test_log_of_a_real_session(spark, tmp_path):
    """A log that Spark itself wrote parses into tasks, stages and a graph."""
    target = tmp_path / "baseline"
    target.mkdir()
    script = textwrap.dedent(
        f"""
        from pyspark.sql import SparkSession
        b = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
        b = b.config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1")
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://{target}")
        b = b.config("spark.eventLog.compress", "true")
        spark = b.getOrCreate()
        spark.range(1000).groupBy("id").count().count()
        spark.stop()
        """
    )
    subprocess.run([sys.executable, "-c", script], check=True, capture_output=True, timeout=120)
    lines = event_logs.scan_event_logs(spark, str(tmp_path))
    tasks, stages = event_logs.task_events(lines).collect(), event_logs.stage_events(lines).collect()
    assert tasks and stages
    assert {r.label for r in tasks} == {0}
    assert all(r.executor_run_time >= 0 and r.success for r in tasks)
    assert {r.status for r in stages} == {"COMPLETED"}


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    """No file index at the driver, and counts without a single packed file."""
    (tmp_path / "oom").mkdir()
    for k in range(300):
        (tmp_path / "oom" / f"application_{k}").write_text(text_of([task(k)]))
    found = event_logs.ScanCounts()
    lines = event_logs.scan_event_logs(spark, str(tmp_path), counts=found)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" not in plan and "FileScan binaryFile" not in plan
    assert lines.rdd.getNumPartitions() <= 16
    event_logs.parse_once(lines, found)
    totals = found.totals()
    assert (totals["files"], totals["lines"], totals["parsed"], totals["malformed"]) == (300, 900, 300, 300)
    report = event_logs.scan_report(spark, str(tmp_path))
    assert report.count() == 300 and report.filter("lines = 3").count() == 300
