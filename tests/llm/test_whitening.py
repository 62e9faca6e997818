from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.llm import whitening

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"


def table(spark, vectors):
    rows = [(k, None if v is None else [None if c is None else float(c) for c in v], 1) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, wanted=16):
    """Exact sums in fractions, LAPACK's eigenvectors."""
    x = [tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(dims)]
    centred = [[Fraction(n * v[i] - sums[i], n) for i in range(dims)] for v in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(dims)] for i in range(dims)])
    values, vectors_ = np.linalg.eigh(cov)
    order = np.argsort(-values)[:wanted]
    order = order[values[order] > dims * np.finfo(float).eps * values.sum()]
    rows = [[float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)] for v in x]
    white = np.array(rows) @ vectors_[:, order] / np.sqrt(values[order])
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    deviation = [d if d < 1 << 63 else None for d in deviation]
    return n, deviation, white, values[order] / values.sum()


def check(df, vectors, ids=None, wanted=16):
    n, deviation, white, explained = brute(vectors, wanted)
    ids = list(range(len(vectors))) if ids is None else ids
    rows = sorted(df.collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in rows] == [(i, c) for i in ids for c in range(1, len(explained) + 1)]
    assert all(r.n == n and r.deviation == deviation[k // len(explained)] for k, r in enumerate(rows))
    got = np.array([r.whitened for r in rows]).reshape(len(ids), -1)
    signs = np.sign((got * white).sum(0))
    assert np.abs(got - white * signs).max() < 1e-7
    assert np.allclose([r.explained for r in rows[: len(explained)]], explained, rtol=1e-10)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10


def test_matches_exact_covariance_and_lapack(spark):
    dice = np.random.default_rng(1)
    vectors = (dice.standard_normal((300, 24)) * np.linspace(0.2, 3, 24)).tolist()
    vectors += [vectors[3]] * 200 + vectors[:20]
    check(whitening.whitened_embeddings(table(spark, vectors).repartition(5)), vectors)


def test_few_dimensions_and_little_rank(spark):
    dice = np.random.default_rng(2)
    line = [[k, 2 * k, 0] for k in range(-9, 9)]
    check(whitening.whitened_embeddings(table(spark, line)), line)
    plane = (dice.integers(-9, 9, (80, 2)) @ dice.integers(-4, 4, (2, 30))).tolist()
    df = whitening.whitened_embeddings(table(spark, plane))
    assert df.agg(F.max("component")).first()[0] == 2
    check(df, plane)


def test_unusable_vectors(spark):
    dice = np.random.default_rng(3)
    good = dice.standard_normal((40, 5)).tolist()
    bad = [None, [], [1, 2], [1, 2, None, 4, 5], [1, 2, float("nan"), 4, 5], [1, float("inf"), 3, 4, 5], [-float("inf"), 1, 1, 1, 1], [1, 1, 1, 1, 1e30]]
    df = table(spark, good + bad).withColumns({c: F.lit("other") for c in ("x", "component", "n", "whitened")})
    check(whitening.whitened_embeddings(df), good)
    check(whitening.whitened_embeddings(df, wanted=2), good, wanted=2)


def test_null_ids_and_repeated_rows(spark):
    dice = np.random.default_rng(4)
    good = dice.standard_normal((30, 4)).tolist()
    df = table(spark, good)
    twice = df.unionByName(df).unionByName(df.limit(3).withColumn("vec_id", F.lit(None).cast("long")))
    rows = whitening.whitened_embeddings(twice).collect()
    assert len(rows) == 63 * 4 and {r.n for r in rows} == {30} and sum(r.vec_id is None for r in rows) == 12


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, None], [[], []]])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whitened_embeddings(table(spark, vectors)).count() == 0


def test_large_entries_stay_exact(spark):
    dice = np.random.default_rng(5)
    for scale in (1e4, 3e5, 1e7):
        vectors = [[float(np.float32(c)) for c in v] for v in dice.standard_normal((50, 6)) * scale]
        check(whitening.whitened_embeddings(table(spark, vectors)), vectors)
    huge = np.array([[1 << 50, -(1 << 49)], [3, 1 << 51]])
    assert whitening.products(huge).tolist() == (huge.astype(object).T @ huge.astype(object)).tolist()


def test_any_partitioning_gives_the_same_components(spark):
    vectors = (np.random.default_rng(6).standard_normal((200, 20)) * 3).tolist()
    seen = set()
    for parts in (1, 3, 16):
        rows = whitening.whitened_embeddings(table(spark, vectors).repartition(parts)).drop("identity_error").collect()
        seen.add(tuple(sorted(map(tuple, rows))))
    assert len(seen) == 1


@pytest.mark.parametrize("case", ["spread", "equal", "groups", "tiny", "shift on an eigenvalue"])
def test_spectral_divide_and_conquer(case):
    dice = np.random.default_rng(7)
    basis = np.linalg.qr(dice.standard_normal((40, 40)))[0]
    values = {
        "spread": np.linspace(1, 40, 40),
        "equal": np.full(40, 3.0),
        "groups": np.repeat([9.0, 4.0, 1.0, 0.0], 10),
        "tiny": 10.0 ** -np.arange(0, 10, 0.25),
        "shift on an eigenvalue": np.r_[np.arange(-20, 0), 0, np.arange(1, 20)] + 50.0,
    }[case]
    a = basis * values @ basis.T
    a = (a + a.T) / 2
    found = whitening.components(a, 16)
    assert found.shape == (40, 16) and np.abs(found.T @ found - np.eye(16)).max() < 1e-13
    inner = found.T @ a @ found
    assert np.abs(inner - np.diag(np.diag(inner))).max() < 1e-13 * np.abs(values).max() * 40
    assert np.allclose(sorted(np.diag(inner), reverse=True), sorted(values, reverse=True)[:16], atol=1e-12 * np.abs(values).max())


def test_polar_factor():
    dice = np.random.default_rng(8)
    a = dice.standard_normal((30, 30))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.orthogonal_factor(a) - vectors * np.sign(values) @ vectors.T).max() < 1e-12
    assert whitening.orthogonal_factor(np.zeros((4, 4))) is None and whitening.orthogonal_factor(np.diag([1.0, 0.0])) is None
