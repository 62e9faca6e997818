"""Ranked lexical search by grouping documents by the terms they hold.

Every document becomes a row of the query terms it holds, with counts; that
table, the document counts of the terms and the corpus totals come from whole
texts. Then each task works on blocks of documents: for an item the bitmaps of
its terms mark every document with a presence mask, documents with equal masks
form a group, and a group's score cannot exceed the sum of the block's best
contributions of the mask's terms. Groups are evaluated by descending maximum
until no group left can reach the task's tenth score. What tasks keep is
ranked together.

Items are worked through in blocks of bounded size, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import IS_ALPHANUMERIC, binary_column, byte_offsets, list_column, lower_bytes, slices, span_hashes, store, word_spans

TOP = 10
#: Terms of the items that are searched for at a time, about.
ITEM_TERMS = 1 << 18
#: Bytes of term numbers (4 each) of a block of documents.
BLOCK_BYTES = 1 << 21
#: Groups evaluated first; twice as many each time.
FIRST_GROUPS = 16


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every term: letters, digits and all beyond ASCII, A-Z lower-cased."""
    data, offsets = byte_offsets(texts)
    starts, ends, owners = word_spans(data, offsets, IS_ALPHANUMERIC)
    return span_hashes(lower_bytes(data), starts, ends).view(np.int64), owners


def counted(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values of every owner, owners ascending, with their counts."""
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    firsts = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[firsts], owners[firsts], np.diff(np.r_[firsts, len(hashes)])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (hashes) and counts of every different item that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            terms, owners, counts = counted(*term_hashes(batch.column(1)))
            each = np.bincount(owners, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), list_column(terms, each, pa.int64()), list_column(counts, each, pa.int64())], names=["item_id", "terms", "counts"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return rows.mapInArrow(run, "item_id long, terms array<long>, counts array<long>").filter("size(terms) > 0")


class Items(NamedTuple):
    """A block of items: their ids, the sorted hashes of all their terms, and each one's term numbers and counts."""

    ids: list[int | None]
    hashes: np.ndarray
    terms: list[np.ndarray]
    counts: list[np.ndarray]


def item_blocks(items: DataFrame, size: int = ITEM_TERMS) -> Iterator[Items]:
    """All items in blocks of about ``size`` terms, dealt by a hash."""
    found = store(item_terms(items), "items")
    total = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // size)
    for block in range(blocks):
        mine = found.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block)
        # About ``size`` terms, so what comes to the driver has a bound.
        rows = sorted(mine.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["terms"]))
        if rows:
            hashes = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in rows]))
            yield Items([r["item_id"] for r in rows], hashes, [np.searchsorted(hashes, r["terms"]) for r in rows], [np.array(r["counts"], np.int64) for r in rows])


def document_terms(documents: DataFrame, hashes: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats) and the numbers and counts (32-bit, ascending) of the sought terms of every document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, owners = term_hashes(batch.column(1))
            lengths = np.bincount(owners, minlength=batch.num_rows)
            place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            held = np.flatnonzero(hashes[place] == found)
            terms, holders, counts = counted(place[held], owners[held])
            each = np.bincount(holders, minlength=batch.num_rows)
            columns = [binary_column(v.astype(np.int32), each) for v in (terms, counts)]
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *columns], names=["doc_id", "n", "terms", "counts"])
            yield made.filter(pa.array(lengths > 0))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def document_counts(held: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and the documents that hold each sought term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 2, np.int64)
        for batch in batches:
            total[:terms] += np.bincount(byte_offsets(batch.column(1))[0].view(np.int32), minlength=terms)
            total[terms:] += batch.num_rows, batch.column(0).to_numpy().sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["at", "total"])

    found = np.zeros(terms + 2, np.int64)
    # A row for each sought term, a bounded number.
    for r in held.select("n", "terms").mapInArrow(run, "at int, total long").groupBy("at").agg(F.sum("total").alias("total")).collect():
        found[r["at"]] = r["total"]
    return int(found[terms]), int(found[terms + 1]), found[:terms]


def weights(documents: int, holders: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holders], np.int64)


class Block:
    """Documents of a task with their sought terms, by document and by term, and what each adds to a score."""

    def __init__(self, batch: pa.RecordBatch, documents: int, length: int, weight: np.ndarray):
        (terms, ends), counts = byte_offsets(batch.column(2)), byte_offsets(batch.column(3))[0]
        self.ids, self.terms, self.starts = batch.column(0), terms.view(np.int32), ends // 4
        n, tf = batch.column(1).to_numpy(), counts.view(np.int32).astype(np.int64)
        wide = n.astype(object) if 75 * int(n.max(initial=0)) * documents >= 1 << 63 else n
        m = (25 + 75 * wide * documents // max(length, 1)).astype(np.int64)
        self.docs = np.repeat(np.arange(len(n)), np.diff(self.starts))
        self.adds = weight[self.terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs]))
        order = np.argsort(self.terms, kind="stable")
        self.by_term, self.firsts = self.docs[order], np.searchsorted(self.terms[order], np.arange(len(weight) + 1))
        self.most = np.zeros(len(weight), np.int64)
        some = np.flatnonzero(np.diff(self.firsts))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.adds[order], self.firsts[some])

    def groups(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents that hold one of ``terms``, the group of each, and the greatest score that each group allows."""
        words = -(-len(terms) // 64)
        masks = np.zeros((words, len(self.ids)), np.uint64)
        for bit, term in enumerate(terms.tolist()):
            masks[bit >> 6, self.by_term[self.firsts[term] : self.firsts[term + 1]]] |= np.uint64(1 << (bit & 63))
        docs = np.flatnonzero(masks.any(0))
        masks, group = masks[:, docs], np.zeros(len(docs), np.int64)
        for word in masks:
            one = np.unique(word, return_inverse=True)[1]
            group = np.unique(group * len(docs) + one, return_inverse=True)[1]
        sample = np.zeros(int(group.max(initial=-1)) + 1, np.int64)
        sample[group] = np.arange(len(docs))
        bits = np.unpackbits(np.ascontiguousarray(masks[:, sample].T).view(np.uint8), axis=1, bitorder="little")[:, : len(terms)]
        return docs, group, bits.astype(np.int64) @ (counts * self.most[terms])

    def scores(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Scores of ``docs`` for an item, whose counts ``times`` has by term number."""
        each = self.starts[docs + 1] - self.starts[docs]
        before = np.cumsum(each) - each
        at = np.repeat(self.starts[docs] - before, each) + np.arange(int(each.sum()))
        return np.add.reduceat(self.adds[at] * times[self.terms[at]], before) if len(docs) else np.zeros(0, np.int64)


def best(block: Block, terms: np.ndarray, counts: np.ndarray, times: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block among which are all that rank, with their scores.

    ``least`` is a score that ``top`` documents elsewhere reach already.
    """
    docs, group, most = block.groups(terms, counts)
    ranked = np.argsort(-most, kind="stable")
    by_group = np.argsort(group, kind="stable")
    firsts = np.searchsorted(group[by_group], np.arange(len(most) + 1))
    found, scores, done, take = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST_GROUPS
    while done < len(ranked) and most[ranked[done]] >= max(least, 1):
        now = ranked[done : done + take]
        now = now[most[now] >= max(least, 1)]
        new = docs[np.concatenate([by_group[firsts[g] : firsts[g + 1]] for g in now])]
        found, scores = np.r_[found, new], np.r_[scores, block.scores(new, times)]
        if len(scores) >= top:
            least = max(least, int(np.partition(scores, -top)[-top]))
        done, take = done + len(now), 2 * take
    kept = scores >= max(least, 1)
    return found[kept], scores[kept]


def _leading(rows: list[tuple[int, bool, int]], top: int) -> list[tuple[int, bool, int]]:
    """The first ``top`` of (-score, doc_id is null, doc_id)."""
    return sorted(rows)[:top]


def ranked(held: DataFrame, items: Items, top: int = TOP) -> DataFrame:
    """item (number in the block), item_id, rank, doc_id and score over documents from ``document_terms``."""
    documents, length, holders = document_counts(held, len(items.hashes))
    weight = weights(documents, holders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leading: list[list[tuple[int, bool, int]]] = [[] for _ in items.ids]
        times = np.zeros(len(weight), np.int64)
        for batch in slices(batches, "terms", BLOCK_BYTES):
            block = Block(batch, documents, length, weight)
            for k, (terms, counts) in enumerate(zip(items.terms, items.counts, strict=True)):
                least = -leading[k][-1][0] if len(leading[k]) == top else 0
                times[terms] = counts
                docs, scores = best(block, terms, counts, times, least, top)
                times[terms] = 0
                if len(docs):
                    ids = block.ids.take(pa.array(docs)).to_pylist()
                    leading[k] = _leading(leading[k] + [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids, strict=True)], top)
        rows = [(k, items.ids[k], None if gone else doc, -less) for k, found in enumerate(leading) for less, gone, doc in found]
        kinds = {"item": pa.int32(), "item_id": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds.values())], names=list(kinds))

    found = held.mapInArrow(run, "item int, item_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= top).select("item", "item_id", "rank", "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, top: int = TOP, item_terms_at_once: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` highest-scoring rows of ``documents`` for every item.

    A null or empty text has no terms; such an item finds nothing and such a
    document is not found. Every row of ``documents`` is a document of its own,
    repeated ones too, and ranks as such; a null doc_id comes after all others
    of its score. Equal rows of ``items`` are one item; items that share an id
    have ranks of their own; a null item_id stays null. Empty tables give
    no rows. Other columns are not looked at. Terms are told apart by 64-bit hashes.
    """
    parts = []
    for block in item_blocks(items, item_terms_at_once):
        held = store(document_terms(documents, block.hashes), "terms")
        parts.append(store(ranked(held, block, top).drop("item"), "ranked"))
    if not parts:
        return documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)
