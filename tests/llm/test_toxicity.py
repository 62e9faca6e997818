import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultlens.llm import toxicity
from tests.llm import samples

BAD = ("vile", "rotten", "grubby")


def labelled(count, seed=1):
    dice = random.Random(seed)
    rows = []
    for k in range(count):
        words = samples.sentence(dice, dice.randrange(8, 250)).split(" ")
        toxic = int(dice.random() < 0.3)
        for _ in range(3 * toxic):
            words[dice.randrange(len(words))] = dice.choice(BAD)
        rows.append((k, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def network():
    rows = [r for r in labelled(500) if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    return toxicity.train([r[1] for r in rows], [r[2] for r in rows], rounds=3)


def test_gradient_matches_differences():
    texts = ["you are vile and bad", "what a day it is", "", "vile", "ü " * 70]
    words = toxicity.read_words(pa.array(texts, pa.large_string()))
    network = toxicity.Network((words.hashes[:5], np.zeros(5, np.float32)), (np.sort(words.affixes[:4, 0]), np.zeros(4, np.float32)))
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    document, first, lengths = toxicity.windows(words.counts)
    index = toxicity.window_index(words, first, lengths)
    target = np.array([1.0, 0, 0, 1, 0, 1])[: len(document)]

    def loss():
        value = network.forward(network.inputs(words)[2], index, lengths).astype(np.float64)
        return np.mean(np.log1p(np.exp(value)) - target * value)

    found = network.gradient(words, index, lengths, target)
    dice = np.random.default_rng(0)
    for name, weights in network.weights.items():
        for at in {tuple(dice.integers(0, s) for s in weights.shape) for _ in range(4)} | {np.unravel_index(abs(found[name]).argmax(), weights.shape)}:
            kept, step = weights[at], 1e-2
            weights[at] = kept + step
            up = loss()
            weights[at] = kept - step
            down = loss()
            weights[at] = kept
            assert abs((up - down) / (2 * step) - found[name][at]) < 1e-4 + 0.02 * abs(found[name][at]), (name, at)


def test_held_out_accuracy(network):
    rows = [r for r in labelled(500) if zlib.crc32(str(r[0]).encode()) % 4 == 2] + labelled(200, seed=9)
    score, _ = network.document_scores(pa.array([r[1] for r in rows]))
    right = (score >= toxicity.THRESHOLD) == np.array([r[2] for r in rows], bool)
    assert right.mean() > 0.95


def test_toxic_word_anywhere_in_a_long_text(network):
    dice = random.Random(5)
    words = samples.sentence(dice, 5_000).split(" ")
    clean, _ = network.document_scores(pa.array([" ".join(words)]))
    for place in (0, 63, 64, 2_500, 4_999):
        changed = [*words]
        for k, bad in enumerate(BAD):
            changed[min(place + k, 4_999)] = bad
        score, count = network.document_scores(pa.array([" ".join(changed)]))
        assert score[0] > 0.5 > clean[0] and count[0] == 1 + -(-(5_000 - toxicity.WINDOW) // toxicity.STRIDE)


def test_texts_read_in_parts_are_the_same():
    texts = [r[1] for r in labelled(60)] + ["", "ü"]
    whole, parts = toxicity.read_words(pa.array(texts)), toxicity.read_texts(texts, limit=300, at_once=3)
    for one, two in zip(vars(whole).values(), vars(parts).values(), strict=True):
        assert np.array_equal(one, two)
    ranges = list(toxicity.in_parts(parts, limit=200))
    assert [r[0] for r in ranges] == [0, *[r[1] for r in ranges[:-1]]] and ranges[-1][1] == len(texts) and ranges[-1][3] == len(parts.numbers)


def test_training_memory_at_the_documented_bound():
    """3,000 texts of 20,000 characters: training in a process of its own stays below 500 MB, the texts included."""
    code = """
import random, resource
from faultlens.llm import toxicity
dice = random.Random(1)
words = ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(dice.randrange(2, 12))) for _ in range(100_000)]
texts = [" ".join(dice.choices(words, k=3_000))[: toxicity.SAMPLE_CHARS - 5] + (" vile" if k % 2 else " kind") for k in range(2 * toxicity.SAMPLE)]
assert sum(map(len, texts)) > 55e6
toxicity.STEPS = 1
toxicity.train(texts, [k % 2 for k in range(len(texts))], rounds=1)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 500


def test_windows_cover_every_word():
    counts = np.array([0, 1, 64, 65, 112, 113, 1000])
    document, first, lengths = toxicity.windows(counts)
    starts = np.cumsum(counts) - counts
    for d, n in enumerate(counts):
        held = [(f - starts[d], k) for f, k in zip(first[document == d], lengths[document == d], strict=True)]
        assert {w for f, k in held for w in range(f, f + k)} == set(range(n)) and len(held) >= 1
        assert all(k == min(n, toxicity.WINDOW) for _, k in held)


def test_batches_do_not_change_scores(network):
    texts = [r[1] for r in labelled(40)]
    whole, _ = network.document_scores(pa.array(texts))
    single = [network.document_scores(pa.array([t]))[0][0] for t in texts]
    assert np.allclose(whole, single, atol=1e-5)


def test_query_uses_no_held_out_label(spark):
    """Turning round the labels of held-out rows changes no score; the folds are those of CRC-32."""
    rows = labelled(160)
    docs = samples.plain(spark, [r[1] for r in rows])
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id LONG, quality INT, toxic INT")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    two = {r.doc_id: r.score for r in toxicity.toxicity(docs, turned).collect()}
    assert {i: r.score for i, r in one.items()} == two
    for i, r in one.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)


def test_awkward_rows(spark):
    docs = samples.awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 0), (None, 1), (101, None), (102, 0), (999, 1)], "doc_id LONG, toxic INT")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(samples.awkward_rows())
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    kept = toxicity.without_toxic(docs, toxicity.train(["a b", "vile"], [0, 0]))
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id LONG, toxic INT")
    assert toxicity.toxicity(samples.empty(spark), labels).count() == 0
    assert all(r.predicted in (0, 1) for r in toxicity.toxicity(samples.plain(spark, ["a"]), labels).collect())


def test_a_rare_class_is_thinned_by_its_own_number(spark):
    """Of 4,000 labels 1 in 200 is toxic; each class still gives as many examples as asked for, the first by hash."""
    docs = samples.plain(spark, [f"text {k}" for k in range(4_000)])
    labels = spark.range(4_000).selectExpr("id AS doc_id", "CAST(id % 200 = 0 AS INT) AS toxic")
    texts, toxic = toxicity.training_sample(docs, labels, size=4)
    eligible = labels.filter(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).collect()
    want = {f"text {r.doc_id}": c for c in (0, 1) for r in [r for r in eligible if r.toxic == c][:4]}
    assert dict(zip(texts, toxic, strict=True)) == want and sum(toxic) == 4 == len(toxic) - 4
