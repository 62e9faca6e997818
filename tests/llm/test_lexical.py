import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from faultlens.llm import lexical
from tests.llm import samples

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, top=10):
    """(item number, rank, doc_id, score) by the formula, one document after the other."""
    bags = [(r[0], Counter(terms(r[1]))) for r in rows]
    count = sum(bool(b) for _, b in bags)
    length = sum(sum(b.values()) for _, b in bags)
    holders = Counter(t for _, b in bags for t in b)
    found = []
    for item_id, text in items:
        scored = []
        for doc_id, bag in bags:
            score = 0
            for term, times in Counter(terms(text)).items():
                if tf := bag.get(term):
                    m = 100 - 75 + 75 * sum(bag.values()) * count // length
                    score += times * math.floor(1000 * math.log((2 * count + 2) / (2 * holders[term] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        found += [(item_id, rank, doc, -less) for rank, (less, _, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return Counter(found)


def table(spark, items):
    return spark.createDataFrame(items, "item_id LONG, text STRING")


def got(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def items_of(dice, rows, count):
    picked = [dice.choice([r for r in rows if r[1]]) for _ in range(count)]
    return [(k, " ".join(dice.sample(r[1].split(), min(len(r[1].split()), dice.randrange(1, 90))))) for k, r in enumerate(picked)]


def test_awkward_rows(spark):
    rows = samples.awkward_rows()
    items = items_of(random.Random(1), rows, 12) + [(50, None), (51, ""), (52, "?!"), (53, "One one ONE spam"), (54, samples.sentence(random.Random(5), 900)), (55, "zzz")]
    found = got(lexical.search(samples.awkward(spark), table(spark, items).selectExpr("*", "1 AS score", "2 AS rank")))
    assert found == brute(rows, items)
    assert not {50, 51, 52, 55} & {k[0] for k in found} and {53, 54} <= {k[0] for k in found}


def test_items_in_blocks_shared_and_missing_ids(spark):
    dice = random.Random(2)
    rows = [(k, samples.sentence(dice, dice.randrange(1, 80)), "en", "a", 1) for k in range(300)]
    items = [*items_of(dice, rows, 20), (3, "sta ste"), (None, "sta eril"), (None, "sta eril")]
    df = spark.createDataFrame(rows, samples.SCHEMA).repartition(5)
    one = got(lexical.search(df, table(spark, items)))
    assert one == got(lexical.search(df, table(spark, items), item_terms_at_once=60)) == brute(rows, list(dict.fromkeys(items)))


def test_small_blocks_of_documents_and_ties(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 400)
    dice = random.Random(3)
    texts = [samples.sentence(dice, 12) for _ in range(40)]
    rows = [(k, texts[k % 40] if k % 3 else texts[7], "en", "a", 1) for k in range(400)]
    items = items_of(dice, rows, 15)
    df = spark.createDataFrame(rows, samples.SCHEMA).repartition(3)
    held = lexical.document_terms(df, next(lexical.item_blocks(table(spark, items))).hashes)
    assert got(lexical.ranked(held, next(lexical.item_blocks(table(spark, items)))).drop("item")) == brute(rows, items)


def test_groups_left_out_cannot_rank():
    """Evaluation stops early, and what it leaves out scores less than what it gives."""
    dice = random.Random(4)
    texts = [samples.sentence(dice, dice.randrange(3, 200)) for _ in range(600)]
    known, times_all = np.unique(lexical.term_hashes(pa.array([samples.sentence(dice, 30)]))[0], return_counts=True)
    found, owners = lexical.term_hashes(pa.array(texts))
    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
    held = np.flatnonzero(known[place] == found)
    terms_, holders, counts = lexical.counted(place[held], owners[held])
    each = np.bincount(holders, minlength=600)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(600)), pa.array(np.bincount(owners, minlength=600)), *[lexical.binary_column(v.astype(np.int32), each) for v in (terms_, counts)]], names=["doc_id", "n", "terms", "counts"]
    )
    weight = lexical.weights(600, np.bincount(terms_, minlength=len(known)))
    block = lexical.Block(batch, 600, len(found), weight)
    numbers = np.arange(len(known))
    docs, scores = lexical.best(block, numbers, times_all, times_all, 0, 10)
    every = np.flatnonzero(each)
    full = block.scores(every, times_all)
    border = np.sort(full)[-10]
    assert set(every[full >= border]) <= set(docs) and len(lexical.Block.groups(block, numbers, times_all)[0]) == len(every)
    docs, group, most = block.groups(numbers, times_all)
    assert (block.scores(docs, times_all) <= most[group]).all() and len(most) < len(docs)
    assert len(lexical.best(block, numbers, times_all, times_all, int(full.max()) + 1, 10)[0]) == 0


def test_empty_tables(spark):
    none = table(spark, [])
    assert lexical.search(samples.empty(spark), none).count() == 0
    assert lexical.search(samples.plain(spark, ["a b"]), none).count() == 0
    assert lexical.search(samples.empty(spark), table(spark, [(1, "a b")])).count() == 0
    assert lexical.search(samples.empty(spark), none).columns == ["item_id", "rank", "doc_id", "score"]
