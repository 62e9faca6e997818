"""Best-fit packing of tokenized documents, by a tree of rounds.

Every leaf packs a share of the pieces by best fit, longest first. A bin that
is nearly full is emitted; the others are items of the next round, in which
the bins of ``fan_in`` leaves meet and best fit runs again, up to one root.

After best fit no two bins of a share fit into one, so at most one of them is
up to half full. A round therefore brings together at most ``fan_in`` bins
that can be put into others, and no more than ``fan_in`` bins of one free size
can be of use: the rest are emitted. What is carried is thus bounded by the
capacity, not by the data, and no round sees more than its leaves carry.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultlens.llm.common import slices, store

CAPACITY = 2048
#: Ends every document.
END_ID = 0
#: Pieces of one leaf.
LEAF = 1 << 15
FAN_IN = 8
#: Leaves of a first round are shared by no more tasks than this; a task packs its leaves one after the other.
SHARES = 1 << 12
#: Texts with so much white space in a row go through the slower encoder, since the faster one's pattern needs stack for it.
BLANKS = 10_000
#: A bin with no more free places than this is full.
TOLERANCE = 4

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    """The tokenizer file whose ids count."""
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to the ids of the tokenizer file, without special tokens added; those that stand in the text have their own ids.

    The merges beside the file (``.tiktoken``) make a much faster encoder of the same ids.
    """
    special = {token["content"]: token["id"] for token in json.loads(Path(path).read_text(encoding="utf-8"))["added_tokens"]}
    with open(Path(path).with_suffix(".tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow: list[Tokenizer] = []
    blanks = re.compile(r"\s+")

    def encode(text: str) -> list[int]:
        if len(text) > BLANKS and any(m.end() - m.start() > BLANKS for m in blanks.finditer(text)):
            if not slow:
                slow.append(Tokenizer.from_file(path))
            return slow[0].encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all", disallowed_special=())

    return encode


def pieces(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document.

    A document is its ids and one ``END_ID``; a null or empty text is the
    ``END_ID`` alone. A longer one than ``capacity`` is cut into full pieces,
    of which only the first may be shorter. A special token's string has the id
    of that token.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches, "text"):
            found: list[tuple[int | None, int, int, int, int]] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                ends = np.arange((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity).tolist()
                for number, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
                    found.append((doc_id, number, start, end - start, zlib.crc32(ids[start:end])))
            columns = zip(*found, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every item: longest first, each into the fullest bin that has room."""
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_sizes, count = 0, 0  # bit r is set if some bin has r places free
    order = np.argsort(-lengths, kind="stable")
    for item, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_sizes >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = free[room].pop()
            if not free[room]:
                open_sizes ^= 1 << room
        else:
            room, number = capacity, count
            count += 1
        bins[item] = number
        left = room - length
        if left:
            free[left].append(number)
            open_sizes |= 1 << left
    return bins


def _merged(items: pa.Table, capacity: int) -> tuple[np.ndarray, pa.Array]:
    """Used places and pieces of the bins into which best fit puts the items, which are bins themselves."""
    used = items.column("used").to_numpy()
    bins = best_fit(used, capacity)
    order = np.argsort(bins, kind="stable")
    contents = items.column("pieces").combine_chunks()
    held = pc.list_value_length(contents).to_numpy(zero_copy_only=False)
    offsets = np.r_[0, np.cumsum(np.bincount(bins, weights=held))].astype(np.int32)
    flat = contents.take(pa.array(order)).flatten()
    return np.bincount(bins, weights=used).astype(np.int64), pa.ListArray.from_arrays(pa.array(offsets), flat)


def _round(shares: DataFrame, capacity: int, fan_in: int, tolerance: int, last: bool) -> DataFrame:
    """One best-fit round over the partitions of ``shares`` (used, pieces); ``carried`` bins go on to the next."""

    def bins(items: pa.Table, final: bool) -> pa.Table:
        used, contents = _merged(items, capacity)
        room = capacity - used
        order = np.argsort(room, kind="stable")
        firsts = np.searchsorted(room[order], room[order])
        rank = np.empty(len(room), np.int64)
        rank[order] = np.arange(len(room)) - firsts
        carried = (room > tolerance) & (rank < fan_in) & (not final)
        return pa.table({"used": pa.array(used), "pieces": contents, "carried": pa.array(carried)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= LEAF:
                packed = bins(pa.Table.from_batches(waiting), False)
                yield from packed.filter(pc.invert(packed.column("carried"))).to_batches(LEAF)
                waiting = packed.filter(packed.column("carried")).drop_columns("carried").to_batches()
                rows = 0
        if waiting:
            yield from bins(pa.Table.from_batches(waiting), last).to_batches(LEAF)

    return shares.mapInArrow(run, f"used long, pieces array<struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>>, carried boolean")


def pack(found: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN, tolerance: int = TOLERANCE) -> DataFrame:
    """The stored pieces ``found`` with ``sequence_id`` and ``offset`` of each; no sequence exceeds ``capacity``."""
    items = found.select(F.col("length").alias("used"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("pieces"))
    full = items.filter(F.col("used") >= capacity)
    rest = items.filter(F.col("used") < capacity)
    shares = max(1, min(SHARES, -(-rest.count() // LEAF)))
    rest = rest.repartition(shares, F.xxhash64("pieces"))
    done = [full]
    while True:
        packed = store(_round(rest, capacity, fan_in, tolerance, shares == 1), "bins")
        done.append(packed.filter("NOT carried").select("used", "pieces"))
        if shares == 1:
            break
        shares = -(-shares // fan_in)
        rest = packed.filter("carried").select("used", "pieces").repartition(shares)
    sequences = done[0]
    for more in done[1:]:
        sequences = sequences.union(more)
    # The numbers are fixed by writing them once.
    return _placed(store(sequences.withColumn("sequence_id", F.monotonically_increasing_id()), "sequences"))


def _placed(sequences: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(0)
            held = pc.list_value_length(contents).to_numpy(zero_copy_only=False)
            flat = contents.flatten()
            lengths = flat.field("length").to_numpy()
            firsts = np.cumsum(held) - held
            before = np.cumsum(lengths) - lengths
            offset = before - np.repeat(before[firsts] if len(flat) else before, held)
            sequence = np.repeat(batch.column(1).to_numpy(), held)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*[flat.field(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    return sequences.select("pieces", "sequence_id").mapInArrow(run, f"{_PIECE}, sequence_id long, offset long")


def packed_documents(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``documents``.

    Rows with equal or null doc_id are packed like any others; an empty table
    gives no rows; columns besides doc_id and text are not looked at.
    """
    return pack(store(pieces(documents, capacity, path), "pieces"), capacity)
