import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from faultlens.llm import simhash
from tests.llm import samples


def test_fields_and_search(spark):
    dice = random.Random(2)
    texts = [samples.sentence(dice, dice.randrange(1, 120)) for _ in range(120)]
    texts[50], texts[100] = texts[7], samples.edited(dice, texts[3], 0.02)
    df = samples.plain(spark, texts).repartition(3)
    rows = {r.doc_id: r for r in simhash.document_fingerprints(df).collect()}
    prints = {i: int(r.fingerprint, 16) for i, r in rows.items()}
    for i, text in enumerate(texts):
        third = len(text) // 3
        following = texts[i - 1]
        edited = text[: len(text) - third] + following[:third]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(text)
        apart = (prints[i] ^ prints[(i - 1) % 120]).bit_count()
        assert abs(rows[i].near_next - max(0, np.cos(np.pi * apart / 128))) < 1e-12
        if i % 50 == 0:
            others = {j: (prints[i] ^ p).bit_count() for j, p in prints.items() if j != i}
            close = {j: bits for j, bits in others.items() if bits <= simhash.RADIUS}
            assert rows[i].n_copies == sum(bits == 0 for bits in others.values())
            assert rows[i].n_prints == len({prints[j] for j, bits in close.items() if bits})
            best = min(((bits, prints[j], j) for j, bits in close.items()), default=(None, None, None))
            assert (rows[i].nearest_bits, rows[i].nearest_id) == (best[0], best[2])
        else:
            assert rows[i].n_copies is rows[i].n_prints is rows[i].nearest_id is None
    assert rows[50].fingerprint == rows[7].fingerprint and (rows[50].n_copies, rows[50].nearest_id) == (1, 7)
    assert (rows[100].nearest_id, rows[0].nearest_id) == (3, None)
    long = [r for r in rows.values() if r.n_chars > 250]
    assert np.mean([r.near_edited for r in long]) > 0.5 > 0.3 > np.mean([r.near_next for r in long])


def test_within_radius_matches_all_pairs(spark, monkeypatch):
    dice = random.Random(3)
    base = [dice.getrandbits(128) for _ in range(20)]
    values = base + [b ^ sum(1 << k for k in dice.sample(range(128), dice.randrange(16))) for b in base for _ in range(8)]
    known = spark.createDataFrame([(f"{v:032x}",) for v in values] + [(None,)], "fingerprint STRING")
    probes = spark.createDataFrame([(f"{v:032x}",) for v in base] + [(None,)], "fingerprint STRING")
    for radius, packed, short in ((4, 1 << 12, 1 << 24), (12, 3, 1 << 24), (12, 1 << 12, 5), (0, 2, 1 << 24)):
        monkeypatch.setattr(simhash, "PACKED", packed)
        monkeypatch.setattr(simhash, "SHORT_BLOCKS", short)
        rows = [(int(r.probe, 16), int(r.near, 16), r.distance) for r in simhash.within_radius(probes, known, radius).collect()]
        assert sorted(rows) == sorted((b, v, (b ^ v).bit_count()) for b in set(base) for v in set(values) if (b ^ v).bit_count() <= radius)
        near = {int(r.fingerprint, 16): (int(r.near, 16), r.bits, r.n) for r in simhash.nearest(probes, known, radius).collect()}
        others = {b: sorted(((b ^ v).bit_count(), v) for v in set(values) if 0 < (b ^ v).bit_count() <= radius) for b in set(base)}
        assert near == {b: (found[0][1], found[0][0], len(found)) for b, found in others.items() if found}


@pytest.mark.parametrize(("words", "changed"), [(100, 1), (300, 2), (1000, 5)])
def test_recall_of_edited_copies_at_the_production_radius(words, changed):
    """Few words changed: nine in ten copies at least are within the radius, and other texts are not."""
    dice = random.Random(words)
    near, far, before = 0, 0, None
    for _ in range(120):
        text = [dice.choice(samples.WORDS) + dice.choice(samples.WORDS) for _ in range(words)]
        edited = list(text)
        for place in dice.sample(range(words), changed):
            edited[place] = dice.choice(samples.WORDS) + "x"
        one, two = simhash.fingerprints(pa.array([" ".join(text), " ".join(edited)]))
        near += int(np.bitwise_count(one ^ two).sum()) <= simhash.RADIUS
        far += before is not None and int(np.bitwise_count(one ^ before).sum()) <= simhash.RADIUS
        before = one
    assert near >= 0.9 * 120 and far == 0, near


def test_votes_match_a_plain_count():
    text = "a b c a b d a b"
    row = simhash.fingerprints(pa.array([text, None, "x", text]))
    assert (row[0] == row[3]).all() and not row[1].any() and row[2].any()


def test_awkward_rows(spark):
    rows = simhash.document_fingerprints(samples.awkward(spark)).collect()
    given = samples.awkward_rows()
    assert sorted(r.n_chars for r in rows) == sorted(len(t or "") for _, t, *_ in given)
    by_text = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in (1, 2):
            by_text[r.fingerprint] = r
    assert len(by_text) == 1
    assert all(r.near_next == 0 for r in rows if r.doc_id is None)


def test_single_and_no_document(spark):
    row = simhash.document_fingerprints(samples.plain(spark, ["one two three four five six"])).first()
    assert row.near_next == 1.0 and (row.n_copies, row.n_prints, row.nearest_id) == (0, 0, None)
    assert simhash.document_fingerprints(samples.empty(spark)).count() == 0
