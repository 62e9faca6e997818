import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultlens.llm import packing
from tests.llm import samples


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_same_ids_as_the_tokenizer_file(tokenizer):
    dice = random.Random(4)
    alphabet = "ab cD.\n\t  '’s12éß中\U0001f600<|endoftext|>  \x1c_-"
    encode = packing.encoder(packing.vocabulary())
    texts = ["", " ", "\n\n", "<|endoftext|>", "don't we'll", "a" * 3000, " " * 3000]
    texts += ["".join(dice.choice(alphabet) for _ in range(dice.randrange(1, 80))) for _ in range(800)]
    for text in texts:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("text", [" " * 3_000_000, "a" + "\n" * 3_000_000 + "b", "x \t" * 5 + " \r\n" * 1_000_000, "<|endoftext|>" + " " * 20_000 + "<|endoftext|>", "a" * 3_000_000])
def test_long_runs(tokenizer, text):
    assert packing.encoder(packing.vocabulary())(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_strings_and_long_blanks_through_spark(spark, tokenizer):
    texts = ["a<|endoftext|>b", "<|endoftext|>", " " * 1_200_000, "x" + "\n" * 1_200_000 + "y <|endoftext|>"]
    rows = packing.packed_documents(samples.plain(spark, texts)).collect()
    _check(rows, list(enumerate(texts)), tokenizer, packing.CAPACITY)
    assert {r.length for r in rows if r.doc_id == 1} == {2}


def test_few_tasks_for_many_leaves(spark, monkeypatch):
    """More leaves than tasks: a task packs several, and nothing is lost."""
    monkeypatch.setattr(packing, "LEAF", 10)
    monkeypatch.setattr(packing, "SHARES", 3)
    found = spark.range(900).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1 + id % 200 AS length", "id AS ids_crc32")
    rows = packing.pack(found, capacity=256).collect()
    assert sorted(r.doc_id for r in rows) == list(range(900))
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 256 and len(used) <= 1.1 * sum(used.values()) / 256 + 1


def _check(rows, given, tokenizer, capacity):
    want = {}
    for doc_id, text, *_ in given:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        want.setdefault((doc_id, len(ids), zlib.crc32(ids)), []).append(ids)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == list(np.cumsum([0, *[r.length for r in held]])[:-1])
        assert sum(r.length for r in held) <= capacity
    assert sum(r.length for r in rows) == sum(len(i) for found in want.values() for i in found)
    ids_of = {}
    for (doc_id, *_), found in want.items():
        ids_of.setdefault(doc_id, []).extend(found)
    for r in rows:
        assert any(zlib.crc32(i[r.start : r.start + r.length]) == r.ids_crc32 and r.start + r.length <= len(i) for i in ids_of[r.doc_id])
        assert r.length == capacity or r.piece == 0


def test_awkward_rows_round_trip(spark, tokenizer):
    rows = packing.packed_documents(samples.awkward(spark)).collect()
    _check(rows, samples.awkward_rows(), tokenizer, packing.CAPACITY)


def test_rounds_of_a_tree(spark, tokenizer, monkeypatch):
    """Many small leaves: the rounds lose nothing and end close to the least number of sequences."""
    monkeypatch.setattr(packing, "LEAF", 20)
    dice = random.Random(9)
    texts = [samples.sentence(dice, min(200, int(dice.expovariate(0.04)) + 1)) for _ in range(500)]
    rows = packing.packed_documents(samples.plain(spark, texts), capacity=256).collect()
    _check(rows, list(enumerate(texts)), tokenizer, 256)
    least = -(-sum(r.length for r in rows) // 256)
    assert len({r.sequence_id for r in rows}) <= 1.05 * least + 1


def test_items_that_fill_no_bin(spark):
    """Bins that nothing fits into are not carried along without bound."""
    found = spark.range(400).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "150L AS length", "0L AS ids_crc32")
    rows = packing.pack(found, capacity=256).collect()
    assert len(rows) == len({r.sequence_id for r in rows}) == 400


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_matches_a_plain_search(seed):
    dice = random.Random(seed)
    lengths = [dice.randrange(1, 60) for _ in range(300)]
    free = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, f in enumerate(free) if f >= length]
        if fitting:
            free[min(fitting, key=lambda i: free[i])] -= length
        else:
            free.append(60 - length)
    bins = packing.best_fit(np.array(lengths), 60)
    assert bins.max() + 1 == len(free)
    assert sorted(60 - np.bincount(bins, weights=lengths)) == sorted(free)


def test_empty(spark):
    assert packing.packed_documents(samples.empty(spark)).count() == 0
