import random
import re

import numpy as np
import pytest

from faultlens.llm import minmax
from tests.llm import samples


def brute(rows, size=4, percent=80):
    sets = {}
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
        sets[doc_id] = grams or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("few", "block"), [(32, 1 << 20), (1, 500)])
def test_matches_all_pairs(spark, monkeypatch, few, block):
    """Groups of copies around the threshold; with small limits large buckets go through blocks."""
    monkeypatch.setattr(minmax, "FEW", few)
    monkeypatch.setattr(minmax, "BLOCK", block)
    dice = random.Random(5)
    texts = []
    for _ in range(6):
        base = samples.sentence(dice, 120)
        texts += [samples.edited(dice, base, dice.choice((0, 0.01, 0.02, 0.03, 0.05))) for _ in range(14)]
    dice.shuffle(texts)
    rows = minmax.near_duplicates(samples.plain(spark, texts)).collect()
    want = brute(list(enumerate(texts)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert 6 <= sum(r.kept for r in rows) < len(rows)


def test_awkward_rows(spark):
    given = samples.awkward_rows()
    rows = minmax.near_duplicates(samples.awkward(spark)).collect()
    assert len(rows) == len(given)
    want = brute([r for r in given if r[0] is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)


def test_ids_with_several_texts(spark):
    """Whatever the order of the rows, each text of a repeated id keeps its own links."""
    dice = random.Random(8)
    one, two, three = (samples.sentence(dice, 80) for _ in range(3))
    rows = [(1, one), (1, two), (2, samples.edited(dice, two, 0.01)), (3, samples.edited(dice, one, 0.01)), (3, three), (4, three), (2, two), (5, one)]
    texts = brute([(k, text) for k, (_, text) in enumerate(rows)])
    want = []
    for k, (doc_id, _) in enumerate(rows):
        group = min(rows[j][0] for j in texts if texts[j][1] == texts[k][1])
        want.append((doc_id, texts[k][0], group, doc_id == group))
    for order in range(6):
        dice.shuffle(rows)
        df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], samples.SCHEMA).repartition(1 + order % 3)
        assert sorted(tuple(r) for r in minmax.near_duplicates(df).collect()) == sorted(want)


def test_empty(spark):
    assert minmax.near_duplicates(samples.empty(spark)).count() == 0


def test_agreement_of_extremes_is_unbiased():
    """Over many sets the share of equal minima and maxima is the similarity."""
    dice = np.random.default_rng(1)
    shares = []
    for _ in range(60):
        common = dice.integers(0, 1 << 63, 80).astype(np.uint64)
        one, two = (np.sort(np.r_[common, dice.integers(0, 1 << 63, 10).astype(np.uint64)]) for _ in range(2))
        a, b = minmax.band_hashes(np.r_[one, two], np.array([90, 90]), permutations=64, band=1)
        shares.append((a == b).mean())
    # Both extremes of a permutation agree with about the squared similarity.
    assert abs(np.mean(shares) - 0.8**2) < 0.03


def test_a_block_gives_no_more_links_than_join_its_components(spark):
    """Forty similar texts of forty components, in two cells: fewer than 40 links each, not 780."""
    shingles = np.arange(100, dtype=np.uint64)
    members = spark.createDataFrame([(1, d, 100, d, 40) for d in range(40)], "bucket long, doc_id long, n_shingles long, component long, members long")
    sets = spark.createDataFrame([(d, bytearray(shingles.tobytes())) for d in range(40)], "doc_id long, shingles binary")
    links = [(r.a, r.b) for r in minmax._many(members, sets, 80).collect()]
    assert 39 <= len(links) < 2 * 40
    seen = {0}
    for _ in links:
        seen |= {x for pair in links if seen & set(pair) for x in pair}
    assert seen == set(range(40))
