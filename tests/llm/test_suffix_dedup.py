import hashlib
import os
import random
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultlens.llm import suffix_dedup
from tests.llm import samples


def brute(rows, length):
    """Bytes, removed bytes, spans and digest of every distinct document, in order."""
    seen, found = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        runs = bytes(gone).replace(b"\0", b" ").split()
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        found[key] = (len(data), sum(gone), len(runs), hashlib.sha256(kept).hexdigest())
    return found


def got(df, **options):
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.deduplicated(df, **options).collect()]


@pytest.mark.parametrize(
    ("run_bytes", "anchors", "hot", "windows"), [(1 << 20, 50_000, 16_384, 200_000), (3_000, 40, 16_384, 200_000), (3_000, 400, 5, 100), (3_000, 4_000, 1, 200_000)]
)
def test_matches_all_windows(spark, monkeypatch, run_bytes, anchors, hot, windows):
    """Shared passages, overlaps, short periods; with small limits many runs and ranges are merged, and anchors are dealt out by windows."""
    for name, value in (("RUN_BYTES", run_bytes), ("RANGE", anchors), ("HOT", hot), ("WINDOWS", windows)):
        monkeypatch.setattr(suffix_dedup, name, value)
    dice = random.Random(8)
    passages = [samples.sentence(dice, 40) for _ in range(5)]
    texts = []
    for k in range(60):
        parts = [samples.sentence(dice, dice.randrange(1, 40)), dice.choice(passages)[dice.randrange(30) :], samples.sentence(dice, 8)]
        if k % 7 == 0:
            parts.insert(1, "ab" * 90 + "c" * 300)
        if k % 5 == 0:
            parts = [texts[k // 2], *parts] if k else parts
        texts.append(" ü ".join(parts))
    assert dict(got(samples.plain(spark, texts).repartition(4))) == brute(list(enumerate(texts)), 100)


def test_settled_by_shared_prefixes():
    """Groups of two and of many entries, cut at random and repeated, against all windows."""
    dice = random.Random(3)
    for trial in range(400):
        text = [b"".join(dice.choice((b"a", b"b")) if dice.random() < 0.1 else b"a" for _ in range(30)) for _ in range(dice.choice((2, 2, 3, 9)))]
        group = []
        for k, data in enumerate(text):
            low = dice.randrange(4)
            high = low + dice.randrange(5)
            # The anchor is at 10, windows have 12 bytes.
            entry = (data[10 : 10 + 12 - low], data[10 - high : 10], low, high, dice.randrange(4) if trial % 2 else k, 0, 10)
            group += [entry] * dice.choice((1, 1, 1, 2))
        group.sort()
        shares = [0] + [len(os.path.commonprefix([a[0], b[0]])) for a, b in zip(group, group[1:], strict=False)]
        settled = suffix_dedup.settle(group, shares, 12)
        assert [x for x, _ in settled] == group
        first, got, want = {}, set(), set()
        windows = [(j, left[high - j :], right[: 12 - j], place) for right, left, low, high, *place in group for j in range(low, high + 1)]
        for *window, place in windows:
            first[tuple(window)] = min(place, first.get(tuple(window), place))
        for (right, left, low, high, *place), bits in settled:
            assert bits >> (high + 1) == 0 and bits & ((1 << low) - 1) == 0
            got |= {(*place, j) for j in range(low, high + 1) if bits >> j & 1}
        for j, left, right, place in windows:
            if first[j, left, right] != place:
                want.add((*place, j))
        assert got == want


def test_passage_of_a_third_is_dealt_out(spark, monkeypatch):
    """Its edges have a hot anchor in a third of the documents; no range gets much more than another."""
    monkeypatch.setattr(suffix_dedup, "HOT", 200)
    monkeypatch.setattr(suffix_dedup, "RANGE", 2_000)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 100_000)
    dice = random.Random(6)
    passage = samples.sentence(dice, 60)
    texts = [" ".join([samples.sentence(dice, 25), *([passage] if k % 3 == 0 else []), samples.sentence(dice, 25)]) for k in range(3_000)]
    sizes = []
    real = suffix_dedup.store

    def store(df, name):
        stored = real(df, name)
        if name == "runs":
            rows = stored.filter("part IS NOT NULL").groupBy("part").agg(F.sum(F.length("meta")).alias("n")).collect()
            sizes.extend(sorted(r.n for r in rows))
        return stored

    monkeypatch.setattr(suffix_dedup, "store", store)
    found = dict(got(samples.plain(spark, texts).repartition(4)))
    assert found == brute(list(enumerate(texts)), 100)
    assert sum(1 for k, x in found.items() if k % 3 == 0 and x[1] >= len(passage)) == 999
    hot = sizes[len(sizes) // 2]
    assert len(sizes) > 10 and sizes[-1] < 3 * hot, sizes


def test_other_lengths(spark):
    dice = random.Random(1)
    texts = [samples.edited(dice, samples.sentence(random.Random(k % 3), 30), 0.1) for k in range(20)]
    assert dict(got(samples.plain(spark, texts), length=24, anchor=8)) == brute(list(enumerate(texts)), 24)


def test_awkward_rows(spark):
    """Equal rows are one document; a null doc_id comes first."""
    rows = samples.awkward_rows()
    keyed = {(i, t or ""): t for i, t, *_ in rows if i is not None}
    found = got(samples.awkward(spark))
    assert len(found) == len(rows)
    ordered = sorted(keyed, key=lambda k: k[0])
    nulls = [r for r in rows if r[0] is None and r[1]]
    want = brute([("null", nulls[0][1]), *[(k, keyed[k]) for k in ordered]], 100)
    for doc_id, result in found:
        if doc_id is not None:
            assert result == want[next(k for k in ordered if k[0] == doc_id)], doc_id
    assert sorted(r for i, r in found if i is None)[-1] == want["null"]


def test_empty(spark):
    assert suffix_dedup.deduplicated(samples.empty(spark)).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 7])
def test_merge_never_compares_known_prefixes(monkeypatch, count):
    dice = random.Random(count)
    words = [bytes(dice.choice(b"ab") for _ in range(dice.randrange(1, 30))) for _ in range(400)]
    runs = [sorted(words[k::count]) for k in range(count)]
    looked = []
    real = suffix_dedup.shared_prefix
    monkeypatch.setattr(suffix_dedup, "shared_prefix", lambda a, b, known: looked.append((a, b, known)) or real(a, b, known))

    def feed(run):
        before = b""
        for word in run:
            yield len(os.path.commonprefix([before, word])), word, None
            before = word

    merged = list(suffix_dedup.merged([feed(r) for r in runs]))
    assert [w for _, w, _ in merged] == sorted(words)
    for (_, a, _), (share, b, _) in zip(merged, merged[1:], strict=False):
        assert share == len(os.path.commonprefix([a, b]))
    assert all(a[:known] == b[:known] for a, b, known in looked)


def test_runs_round_trip():
    entries = sorted((bytes([97 + i % 3]) * (i % 9 + 1), b"l" * (i % 4), i % 5, i % 5 + i % 4, i, -i, i * 7) for i in range(50))
    back = [e for _, _, e in suffix_dedup.decoded(*suffix_dedup.coded(entries))]
    assert back == entries


def test_shuffles_of_stored_tables_are_removed(spark):
    """Once a table is stored no shuffle of its making is left on disk, and the setting is as before."""

    def shuffles():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f.name for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*")}

    setting, before = spark.conf.get(suffix_dedup.CLEANUP), shuffles()
    table = suffix_dedup._stored(spark.range(1_000).groupBy((F.col("id") % 10).alias("k")).count(), "kept")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(suffix_dedup.CLEANUP) == setting and table.count() == 10


def test_equal_entries_of_a_run_are_not_compared(monkeypatch):
    """Forty copies of a text in one run: prefixes are sought between different entries only."""
    text = samples.sentence(random.Random(2), 60).encode()
    held = [(d, text) for d in range(40)]
    hashes = suffix_dedup._anchors_of(batch_of(held), 100, 32)[5].view("int64").tolist()
    batch = batch_of(held).append_column("repeated", pa.array([hashes] * 40)).append_column("hot", pa.array([[]] * 40, pa.list_(pa.int64())))
    monkeypatch.setattr(suffix_dedup, "expanded", lambda batches, limit: batches)
    calls, real = [], suffix_dedup.shared_prefix
    monkeypatch.setattr(suffix_dedup, "shared_prefix", lambda *x: calls.append(x) or real(*x))

    class Texts:
        mapInArrow = staticmethod(lambda run, schema: list(run(iter([batch]))))

    sent = pa.Table.from_batches(suffix_dedup._runs(Texts, 2, 100, 32)).to_pylist()
    assert sorted((r["d"], r["first"], r["last"]) for r in sent if r["part"] is None) == [(d, 0, len(text)) for d in range(1, 40)]
    assert len(calls) <= len(set(hashes))


def batch_of(held):
    ids = pa.array([d for d, _ in held], pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, pa.array([t for _, t in held], pa.large_binary())], names=["d", "e", "text"])
