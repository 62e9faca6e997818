"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

The word n-grams of all benchmark items are looked up in every document. A
gram weighs the logarithm of how rare it is among all documents. Where the
distinct seeds of one item within a passage weigh enough, the passage is
aligned with the item word by word, which finds edited copies and scores them.

Items and documents are joined by an item's rare seeds alone: its seeds from
the rarest on, until those that remain weigh less than enough together. A
passage without any of the former cannot reach it, so nothing is lost, and a
gram that many items and very many documents share makes no pairs. Nothing is
dropped for being frequent either: an item that a third of all documents copy
has light seeds, which are then its rarest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import (
    IS_ALPHANUMERIC,
    byte_offsets,
    list_column,
    lower_bytes,
    mix,
    slices,
    span_hashes,
    store,
    word_spans,
)

#: Words of a seed.
SEED = 3
#: A passage's seeds must weigh this share of the rarest possible seed, or that share of all seeds of the item.
RARE, SHARE = 0.6, 0.35
#: Points of an alignment for an equal word, another word, and a word without partner.
EQUAL, OTHER, GAP = 2, -1, -1
#: Of the points of a full copy, those that make a document contaminated.
THRESHOLD = 0.5
#: Seeds up to which they are sent to all tasks (8 bytes each); beyond, documents and seeds are joined by shuffling.
SENT = 1 << 20


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word: runs of letters and digits, A-Z lower-cased."""
    data, offsets = byte_offsets(texts)
    starts, ends, owners = word_spans(data, offsets, IS_ALPHANUMERIC)
    return span_hashes(lower_bytes(data), starts, ends), owners


def _grams(words: np.ndarray, owners: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word (in its text) of every ``size`` words in a row."""
    full = max(0, len(words) - size + 1)
    sums = np.zeros(full, np.uint64)
    for k in range(size):
        sums += words[k : k + full] * np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
    whole = np.flatnonzero(owners[:full] == owners[size - 1 :]) if full else np.zeros(0, np.int64)
    firsts = np.searchsorted(owners, owners[whole])
    return mix(sums[whole]), owners[whole], whole - firsts


def item_seeds(benchmark: DataFrame, size: int = SEED) -> DataFrame:
    """item_id, words and grams (hashes, in order) of every item; one of fewer than ``size`` words has no gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, owners = _words(batch.column(1))
            grams, holders, _ = _grams(words, owners, size)
            lists = [list_column(v.view(np.int64), np.bincount(o, minlength=batch.num_rows), pa.int64()) for v, o in ((words, owners), (grams, holders))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["item_id", "words", "grams"])

    rows = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id long, words array<long>, grams array<long>").dropDuplicates(["item_id", "words"])


def seed_hits(documents: DataFrame, seeds: DataFrame, size: int = SEED, sent: int = SENT) -> DataFrame:
    """(doc_id, at, gram): where a document has a gram of ``seeds`` (gram, distinct)."""
    few = seeds.limit(sent + 1).count() <= sent
    known = np.sort(np.array([r[0] for r in seeds.collect()], np.int64)) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            grams, owners, at = _grams(*_words(batch.column(1)), size)
            grams = grams.view(np.int64)
            if known is not None:
                found = np.searchsorted(known, grams)
                held = np.flatnonzero(known[np.minimum(found, len(known) - 1)] == grams) if len(known) else np.zeros(0, np.int64)
                grams, owners, at = grams[held], owners[held], at[held]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids[owners], pa.int64()), pa.array(at, pa.int64()), pa.array(grams)], names=["doc_id", "at", "gram"])

    rows = documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = rows.mapInArrow(run, "doc_id long, at long, gram long")
    return hits if few else hits.join(seeds, "gram", "left_semi").select("doc_id", "at", "gram")


def passages(hits: list[tuple[int, int, float]], length: int, enough: float) -> list[tuple[int, int]]:
    """Word ranges of a document whose seeds (place, gram, weight) of one item weigh ``enough`` together.

    Seeds further apart than the item is long are of different passages.
    """
    found, cluster = [], []
    for hit in [*sorted(hits), None]:
        if hit is not None and (not cluster or hit[0] - cluster[-1][0] <= length):
            cluster.append(hit)
            continue
        if cluster and sum({gram: weight for _, gram, weight in cluster}.values()) >= enough:
            found.append((max(0, cluster[0][0] - length), cluster[-1][0] + SEED + length))
        cluster = [hit]
    return found


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: points, equal words, and first and one past the last word of the passage in it.

    A row of the table is computed at once: with a fixed price for each gap
    the best way along a row is a running maximum.
    """
    width = len(passage)
    price = -GAP * np.arange(width + 1)
    table = np.zeros((len(item) + 1, width + 1), np.int64)
    for i, word in enumerate(item, 1):
        row = np.zeros(width + 1, np.int64)
        row[1:] = table[i - 1, :-1] + np.where(passage == word, EQUAL, OTHER)
        row = np.maximum(np.maximum(row, table[i - 1] + GAP), 0)
        table[i] = np.maximum.accumulate(row + price) - price
    i, j = np.unravel_index(table.argmax(), table.shape)
    points, last, equal = int(table[i, j]), int(j), 0
    while i and j and table[i, j] > 0:
        same = item[i - 1] == passage[j - 1]
        if table[i, j] == table[i - 1, j - 1] + (EQUAL if same else OTHER):
            equal, i, j = equal + int(same), i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return points, equal, int(j), last


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, size: int = SEED, sent: int = SENT) -> DataFrame:
    """doc_id, item_id, score, equal_words, item_words, first_word, last_word: each document with each item it has a copy of.

    ``score`` is the best alignment's points in those of a full copy, and at
    least ``threshold``. Words are numbered in the document, last exclusive.
    Rows with a null doc_id or item_id, null or empty texts and items of fewer
    than ``size`` words give nothing. Rows of equal ids count as one document
    or item with the texts of all. Other columns are not looked at.
    """
    items = item_seeds(benchmark, size).withColumn("item", F.xxhash64("item_id", "words"))
    items = store(items, "items")
    seeds = items.select("item", F.explode("grams").alias("gram")).distinct()
    hits = store(seed_hits(documents, seeds.select("gram").distinct(), size, sent), "hits")
    rarest = F.log(F.lit(documents.count() + 1.0))
    spread = hits.select("doc_id", "gram").distinct().groupBy("gram").agg(F.count("*").alias("documents"))
    weights = seeds.select("gram").distinct().join(spread, "gram", "left").select("gram", (rarest - F.log(F.coalesce("documents", F.lit(1)).cast("double"))).alias("weight"))
    weighed = seeds.join(weights, "gram")
    mass = weighed.groupBy("item").agg(F.sum("weight").alias("mass"))
    mass = mass.select("item", F.least(rarest * RARE, F.col("mass") * SHARE).alias("enough"))
    # The seeds of one item: as many as it has words.
    rest = F.sum("weight").over(Window.partitionBy("item").orderBy(F.desc("weight"), "gram").rowsBetween(0, Window.unboundedFollowing))
    weighed = store(weighed.join(mass, "item").withColumn("rare", rest >= F.col("enough") * (1 - 1e-9)), "seeds")
    pairs = hits.select("doc_id", "gram").join(weighed.filter("rare").select("gram", "item"), "gram").select("doc_id", "item").distinct()
    # All seeds of an item in the documents that it is held against.
    found = hits.join(pairs, "doc_id").join(weighed, ["item", "gram"])
    # A cheap bound first: all seeds of the item in the document.
    each = found.groupBy("doc_id", "item").agg(F.sum("weight").alias("sum"), F.max("enough").alias("enough"), F.collect_list(F.struct("at", "gram", "weight")).alias("hits"))
    each = each.filter(F.col("sum") >= F.col("enough") * (1 - 1e-9)).join(items.select("item", "item_id", "words"), "item")
    wanted = store(each.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "words", "enough", "hits")).alias("items")), "candidates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "score", "equal_words", "item_words", "first_word", "last_word"]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for batch in slices(batches, "text"):
            words, owners = _words(batch.column(1))
            words = words.view(np.int64)
            borders = np.searchsorted(owners, np.arange(batch.num_rows + 1))
            rows = []
            for i, (doc_id, wanted_) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text = words[borders[i] : borders[i + 1]]
                for item in wanted_:
                    body = np.array(item["words"], np.int64)
                    places = [(h["at"], h["gram"], h["weight"]) for h in item["hits"]]
                    best = None
                    for first, last in passages(places, len(body), item["enough"]):
                        points, equal, a, b = align(body, text[first:last])
                        best = max(best or (-1,), (points, equal, first + a, first + b))
                    if best and best[0] >= threshold * EQUAL * len(body):
                        rows.append((doc_id, item["item_id"], best[0] / (EQUAL * len(body)), best[1], len(body), best[2], best[3]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, item_id long, score double, equal_words long, item_words long, first_word long, last_word long"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    aligned = texts.mapInArrow(run, schema)
    best = F.max(F.struct("score", "equal_words", "item_words", "first_word", "last_word")).alias("best")
    return aligned.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
