import json
import os
import pathlib
import random
import shutil

import pytest
import zstandard

from faultlens.functions.constants import CLASS_LABELS
from faultlens.plans import incremental
from faultlens.plans.preprocess import OUTPUTS, preprocess
from tests.test_event_logs import completed, submitted, task

END = {"Event": "SparkListenerApplicationEnd", "Timestamp": 1}


def log(dice, stages):
    events = []
    for s in range(stages):
        parents = [p for p in range(max(0, s - 3), s) if dice.random() < 0.5]
        events += [submitted(s, parents), completed(s, 0, dice.choice([None, "java.lang.OutOfMemoryError", "Stage cancelled"]))]
        events += [task(s, Duration=dice.randrange(1, 99)) for _ in range(dice.randrange(4))]
    return events


def write(base, app, name, events, packed=False):
    folder = pathlib.Path(base, name)
    folder.mkdir(parents=True, exist_ok=True)
    data = "".join(json.dumps(e) + "\n" for e in events).encode()
    target = folder / (f"application_{app}" + (".zstd" if packed else ""))
    (folder / f".{app}").write_bytes(zstandard.compress(data) if packed else data)
    (folder / f".{app}").rename(target)
    return target


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def same(spark, store, full):
    for name in OUTPUTS:
        assert rows(incremental.result(spark, store, name)) == rows(full[name]), name


def parsed_files(monkeypatch):
    seen = []
    real = incremental.apply_lines
    monkeypatch.setattr(incremental, "apply_lines", lambda lines, *a: seen.append({r.file for r in lines.select("file").distinct().collect()}) or real(lines, *a))
    return seen


def test_only_new_and_changed_files_are_parsed(spark, tmp_path, monkeypatch):
    """New, grown and removed logs, one after the other: all tables equal a run over everything."""
    dice = random.Random(1)
    logs, store = f"{tmp_path}/logs", f"{tmp_path}/store"
    classes = list(CLASS_LABELS)
    for k in range(12):
        write(logs, k, classes[k % 3], [*log(dice, dice.randrange(1, 9)), END], packed=k % 2)
    seen = parsed_files(monkeypatch)
    assert incremental.update(spark, logs, store, buckets=8) == 12 and len(seen[-1]) == 12
    assert incremental.update(spark, logs, store, buckets=8) == 0 and len(seen) == 1
    others = {p: os.stat(p).st_mtime_ns for p in pathlib.Path(store, "features.parquet").rglob("*.parquet")}

    new = write(logs, 50, classes[4], [*log(dice, 5), END])
    assert incremental.update(spark, logs, store, buckets=8) == 1 and seen[-1] == {f"file:{new}"}
    untouched = {p for p, t in others.items() if p.exists() and os.stat(p).st_mtime_ns == t}
    assert untouched and len(others) - len(untouched) <= 1 + 12 // 8 + 1

    grown = write(logs, 3, classes[0], [*log(dice, 12), END], packed=True)
    os.remove(pathlib.Path(logs, classes[1], "application_4"))
    assert incremental.update(spark, logs, store, buckets=8) == 1 and seen[-1] == {f"file:{grown}"}
    same(spark, store, preprocess(spark, logs, f"{tmp_path}/full"))


def test_a_lost_update_is_done_again(spark, tmp_path, monkeypatch):
    dice = random.Random(2)
    logs, store = f"{tmp_path}/logs", f"{tmp_path}/store"
    for k in range(6):
        write(logs, k, "oom", [*log(dice, 4), END])
    incremental.update(spark, logs, store, buckets=4)
    for k in range(6, 9):
        write(logs, k, "disk", [*log(dice, 4), END])
    real = incremental._write
    calls = []

    def failing(df, path):
        calls.append(path)
        if len(calls) == 5:
            raise RuntimeError("lost")
        real(df, path)

    monkeypatch.setattr(incremental, "_write", failing)
    with pytest.raises(RuntimeError):
        incremental.update(spark, logs, store, buckets=4)
    monkeypatch.setattr(incremental, "_write", real)
    assert incremental.update(spark, logs, store, buckets=4) == 3
    same(spark, store, preprocess(spark, logs, f"{tmp_path}/full"))


def test_stream_in_any_order_with_a_restart(spark, tmp_path):
    """Rolled parts before and after the end event, files in any order, a stop in between: the tables of a batch run."""
    dice = random.Random(3)
    staged, logs, store = f"{tmp_path}/staged", f"{tmp_path}/logs", f"{tmp_path}/store"
    files = []
    for k in range(5):
        files.append(write(staged, k, "skew", [*log(dice, 6), END], packed=k % 2))
    rolled = log(dice, 9)
    for n, part in enumerate((rolled[:5], rolled[5:], [END])):
        folder = pathlib.Path(staged, "network", "eventlog_v2_application_77")
        folder.mkdir(parents=True, exist_ok=True)
        files.append(folder / f"events_{n}_application_77")
        files[-1].write_text("".join(json.dumps(e) + "\n" for e in part))
    open_log = write(staged, 99, "oom", log(dice, 3))
    files.append(open_log)
    dice.shuffle(files)
    pathlib.Path(logs).mkdir()

    def arrive(some):
        for f in some:
            target = pathlib.Path(logs, f.relative_to(staged))
            target.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy(f, target)

    for some in (files[:5], files[5:]):
        arrive(some)
        query = incremental.follow(spark, logs, store, f"{tmp_path}/checkpoint", buckets=4, files_at_once=4)
        query.awaitTermination(300)
        assert query.exception() is None
    os.remove(pathlib.Path(logs, open_log.relative_to(staged)))
    same(spark, store, preprocess(spark, logs, f"{tmp_path}/full"))
    assert "application_99" not in {r.app_id for r in incremental.result(spark, store, "features").collect()}


def test_no_logs(spark, tmp_path):
    assert incremental.update(spark, f"{tmp_path}/none", f"{tmp_path}/store") == 0
    with pytest.raises(ValueError, match="no such table"):
        incremental.result(spark, f"{tmp_path}/store", "other")
