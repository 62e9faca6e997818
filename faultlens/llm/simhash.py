"""Document fingerprints by SimHash, and the search for near ones.

Each distinct term of a text (two words in a row) votes on every bit of its
128-bit hash, with one plus the logarithm of its count; the sign of the sum is
the fingerprint's bit. Two fingerprints differ in about angle / pi of their
bits, where the angle is the one between the weighted term vectors.

Search: fingerprints are cut into blocks, so two within the radius differ in
one block by no more than ``radius // blocks`` bits. There is one table for
each block, keyed by its bits; a probe looks up its own bits and all that
differ from them by so few. Equal keys meet as packed lists of fingerprints,
which are held against each other inside a task. A pair counts in the first
block in which it is that close, so it counts once, and what leaves a task is
one row for each probe, not for each pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations
from math import pi

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import binary_column, byte_offsets, expanded, mix, shingle_hashes, squeezed, store, word_hashes
from faultlens.operators.prefix import running_before

BITS = 128
#: Words of a term.
TERM = 2
#: Bits by which near fingerprints differ at most: a cosine of 0.957, about one changed word in a hundred.
RADIUS = 12
#: Fingerprints up to which a block may differ by one bit; beyond, blocks are longer and may differ by two.
SHORT_BLOCKS = 1 << 24
#: Fingerprints of one packed list.
PACKED = 1 << 12

#: For each value of a byte, +1 or -1 for its bits, the highest first.
_SIGNS = 2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) - 1


def fingerprints(texts: pa.Array, term: int = TERM) -> np.ndarray:
    """One row of 16 bytes for each text; without a word all bits are 0."""
    data, offsets = byte_offsets(texts)
    hashes, owners = shingle_hashes(*word_hashes(data, offsets), term)
    count = len(offsets) - 1
    votes = np.zeros((count, BITS // 8, 8))
    if len(hashes):
        order = np.argsort(hashes)
        order = order[np.argsort(owners[order].astype(np.int32), kind="stable")]
        hashes, owners = hashes[order], owners[order]
        firsts = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])])
        weights = 1 + np.log(np.diff(np.r_[firsts, len(hashes)]))
        hashes, owners = hashes[firsts], owners[firsts]
        for half in range(2):
            pieces = mix(hashes + np.uint64(0x632BE59BD9B4E019 * half)).view(np.uint8).reshape(-1, 8)
            for k in range(8):
                seen = np.bincount(owners * 256 + pieces[:, k], weights=weights, minlength=count * 256)
                votes[:, 8 * half + k] = seen.reshape(count, 256) @ _SIGNS
    return np.packbits(votes.reshape(count, BITS) > 0, axis=1)


def hamming(one: Column, two: Column) -> Column:
    """Differing bits of two fingerprints in hexadecimal digits; null if one is null."""
    parts = [
        F.bit_count(F.conv(F.substring(one, k, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(two, k, 8), 16, 10).cast("long")))
        for k in range(1, BITS // 4, 8)
    ]
    return sum(parts[1:], parts[0])


def likeness(one: Column, two: Column) -> Column:
    """The cosine that the differing bits tell, 0 at least; 0 if one fingerprint is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), F.cos(hamming(one, two) * F.lit(pi / BITS))), F.lit(0.0))


def borders(radius: int, flips: int) -> list[int]:
    """Where the fewest blocks begin and end of which one differs by ``flips`` bits at most."""
    blocks = radius // (flips + 1) + 1
    return [BITS * b // blocks for b in range(blocks + 1)]


def _values(prints: np.ndarray, cuts: list[int]) -> np.ndarray:
    """The bits of every block (columns) of fingerprints given as rows of 16 bytes."""
    bits = np.unpackbits(prints, axis=1).astype(np.int64)
    return np.stack([bits[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64)) for a, b in zip(cuts, cuts[1:], strict=False)], axis=1)


def _changes(size: int, flips: int) -> np.ndarray:
    """All patterns of up to ``flips`` bits of ``size``."""
    return np.array([sum(1 << b for b in chosen) for k in range(flips + 1) for chosen in combinations(range(size), k)], np.int64)


def _bytes_of(column: pa.Array) -> np.ndarray:
    """Rows of 16 bytes from fingerprints in hexadecimal digits."""
    return np.frombuffer(bytes.fromhex("".join(column.to_pylist())), np.uint8).reshape(-1, BITS // 8)


def _keyed(prints: DataFrame, cuts: list[int], flips: int) -> DataFrame:
    """(key, print): the block keys of every fingerprint, and with ``flips`` all keys that near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1 << 10) for b in batches for k in range(0, b.num_rows, 1 << 10)):
            rows = _bytes_of(batch.column(0))
            values = _values(rows, cuts)
            for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                keys = values[:, n, None] ^ _changes(b - a, flips)[None, :]
                every = np.repeat(rows, keys.shape[1], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel() << 8 | n), binary_column(every.ravel(), np.full(len(every), BITS // 8))], names=["key", "print"])

    return prints.select("fingerprint").mapInArrow(run, "key long, print binary")


def _lists(keyed: DataFrame) -> DataFrame:
    """(key, prints): the fingerprints of every key in lists of up to about ``PACKED``."""
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > PACKED)
    part = F.pmod(F.xxhash64("print"), F.coalesce(F.ceil(F.col("n") / PACKED), F.lit(1)))
    return keyed.join(counts, "key", "left").groupBy("key", part.alias("part")).agg(F.collect_list("print").alias("prints")).drop("part")


def _close(one: np.ndarray, two: np.ndarray, block: int, cuts: list[int], flips: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b, bits) of rows of 16 bytes within the radius that are first close in ``block``."""
    a, b, bits = [], [], []
    wide = two.view(np.uint64)
    for k in range(0, len(one), max(1, (1 << 20) // len(two))):
        some = one[k : k + max(1, (1 << 20) // len(two))].view(np.uint64)
        apart = np.bitwise_count(some[:, None, :] ^ wide[None, :, :]).sum(2, dtype=np.int64)
        i, j = np.nonzero(apart <= radius)
        a, b, bits = [*a, i + k], [*b, j], [*bits, apart[i, j]]
    a, b, bits = (np.concatenate(x) for x in (a, b, bits))
    first = np.ones(len(a), bool)
    if block:
        x, y = _values(one, cuts), _values(two, cuts)
        for n in range(block):
            first &= np.bitwise_count((x[a, n] ^ y[b, n]).astype(np.uint64)) > flips
    return a[first], b[first], bits[first]


def _met(probes: DataFrame, known: DataFrame, radius: int) -> tuple[DataFrame, list[int], int]:
    """Lists of probes and of known fingerprints with a common key (key, probes, prints); both have distinct fingerprints."""
    flips = min(radius, 1 if known.count() <= SHORT_BLOCKS else 2)
    cuts = borders(radius, flips)
    lists = _lists(_keyed(probes, cuts, flips)).withColumnRenamed("prints", "probes")
    return lists.join(_lists(_keyed(known, cuts, 0)), "key"), cuts, flips


def _pairs(met: DataFrame, cuts: list[int], flips: int, radius: int, schema: str, give: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, probes, prints in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("key", "probes", "prints")), strict=True):
                one, two = (np.frombuffer(b"".join(x.as_py()), np.uint8).reshape(-1, BITS // 8) for x in (probes, prints))
                found = _close(one, two, key.as_py() & 255, cuts, flips, radius)
                if len(found[0]):
                    rows.append(give(one, two, *found))
            if rows:
                columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
                arrays = [binary_column(c.ravel(), np.full(len(c), BITS // 8)) if c.ndim == 2 else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=[part.split(" ")[0] for part in schema.split(", ")])

    return met.mapInArrow(run, schema)


def _distinct(df: DataFrame) -> DataFrame:
    return df.filter("fingerprint IS NOT NULL").select("fingerprint").distinct()


def _hex(column: str) -> Column:
    return F.lower(F.hex(column))


def within_radius(probes: DataFrame, known: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(probe, near, distance) for all distinct fingerprints of ``known`` within ``radius`` bits of those of ``probes``.

    Both have a column ``fingerprint``; nulls find nothing. Equal fingerprints
    are one row, so copies do not multiply. Pairs inside one large cluster are
    as many as asked for; ``nearest`` gives a row for each probe instead.
    """
    met, cuts, flips = _met(_distinct(probes), store(_distinct(known), "known"), radius)
    pairs = _pairs(met, cuts, flips, radius, "probe binary, near binary, distance long", lambda one, two, a, b, bits: (one[a], two[b], bits))
    return pairs.select(_hex("probe").alias("probe"), _hex("near").alias("near"), F.col("distance").cast("int").alias("distance"))


def nearest(probes: DataFrame, known: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, near, bits, n): for each distinct fingerprint of ``probes`` another one of ``known`` that is nearest, and how many within the radius.

    The fingerprint itself does not count; of equally near ones it is the smallest. Only probes that have any are given.
    """

    def give(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        other = bits > 0
        a, b, bits = a[other], b[other], bits[other]
        rank = np.empty(len(two), np.int64)
        rank[np.lexsort(two.T[::-1])] = np.arange(len(two))
        order = np.lexsort((rank[b], bits, a))
        first = order[np.r_[True, a[order][1:] != a[order][:-1]][: len(order)]]
        return one[a[first]], two[b[first]], bits[first], np.bincount(a, minlength=len(one))[a[first]]

    met, cuts, flips = _met(_distinct(probes), store(_distinct(known), "known"), radius)
    found = _pairs(met, cuts, flips, radius, "probe binary, near binary, bits long, n long", give)
    best = found.groupBy("probe").agg(F.min(F.struct("bits", "near")).alias("best"), F.sum("n").alias("n"))
    return best.select(_hex("probe").alias("fingerprint"), _hex("best.near").alias("near"), F.col("best.bits").cast("int").alias("bits"), "n")


def following_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next smaller doc_id, and for the smallest the largest."""
    ids = documents.select("doc_id").filter("doc_id IS NOT NULL").distinct().withColumn("all__", F.lit(1))
    before = running_before(ids, ["all__"], "doc_id", maxima={"next_id": F.col("doc_id")})
    ends = ids.agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("largest"))
    return before.join(F.broadcast(ends), "doc_id", "left").select("doc_id", F.coalesce("next_id", "largest").alias("next_id"))


def document_fingerprints(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_copies, n_prints, nearest_id, nearest_bits of every row of ``documents``.

    A null text is empty. The edited text has its last third replaced by the
    beginning of the next document (by descending doc_id, after the last one
    the first). Of several texts of one doc_id one is the next document,
    always the same. A row with a null doc_id has no next document: its third
    is dropped and ``near_next`` is 0. For the doc_ids divisible by 50
    ``n_prints`` is the number of other fingerprints within ``radius`` bits,
    ``n_copies`` that of other rows with the same one, and ``nearest_id`` and
    ``nearest_bits`` name the nearest other row: of equal fingerprints the
    smallest doc_id, of equally near ones the smallest fingerprint. All four
    are null for other rows, the last two also where nothing is near.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # The key is never null, so both joins below read the same shuffled texts; the stand-in for null is no doc_id.
    absent = F.lit(-(1 << 63))
    known = F.when(F.col("doc_id") != absent, F.col("doc_id"))
    rows = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), absent).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), text.alias("text")
    )
    order = store(following_documents(rows.select(known.alias("doc_id"))), "order")
    needed = rows.groupBy("doc_id").agg(F.max(F.col("n_chars") / 3).cast("long").alias("third")).join(order, "doc_id")
    needed = needed.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), "third")
    packed = squeezed(rows)

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in expanded(batches):
            texts = batch.column(batch.num_columns - 1).cast(pa.large_string()).to_pylist()
            lengths = [min(k, n) for k, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            heads = [squeeze(t[:k].encode()) for t, k in zip(texts, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], names=["doc_id", "head"])

    heads = packed.join(needed, "doc_id").select("for_id", "third", "n_chars", "packed").mapInArrow(beginnings, "doc_id long, head binary")
    both = packed.join(heads.groupBy("doc_id").agg(F.min("head").alias("head")), "doc_id", "left").select("doc_id", "n_chars", "head", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in expanded(batches):
            texts = batch.column(batch.num_columns - 1).cast(pa.large_string())
            edited = []
            for text, head in zip(texts.to_pylist(), batch.column(2), strict=True):
                third = len(text) // 3
                edited.append(text[: len(text) - third] + (expand(head.as_buffer()).decode()[:third] if head.is_valid else ""))
            digests = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited])
            prints = [pa.array([row.tobytes().hex() for row in fingerprints(t)]) for t in (texts, pa.array(edited, pa.large_string()))]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, *prints], names=names)

    found = both.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string")
    found = store(found.withColumn("doc_id", known), "fingerprints")

    first = found.groupBy("doc_id").agg(F.min("fingerprint").alias("next_fingerprint"))
    next_ = order.join(first.withColumnRenamed("doc_id", "next_id"), "next_id").select("doc_id", "next_fingerprint")
    # The two smallest ids of a fingerprint: one of them is another row than the one asked for.
    copies = found.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    second = found.join(copies.filter("copies > 1").select("fingerprint", "first"), "fingerprint").filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    copies = copies.join(second.groupBy("fingerprint").agg(F.min("doc_id").alias("second")), "fingerprint", "left")
    asked = found.filter("doc_id % 50 = 0").select("fingerprint")
    near = nearest(asked, found, radius)
    holders = copies.select(F.col("fingerprint").alias("near"), F.col("first").alias("near_id"))
    about = _distinct(asked).join(copies, "fingerprint").join(near.join(holders, "near"), "fingerprint", "left")
    joined = found.join(next_, "doc_id", "left").join(about, "fingerprint", "left")
    probe = F.col("doc_id") % 50 == 0
    twin = F.when(F.col("first") != F.col("doc_id"), F.col("first")).otherwise(F.coalesce("second", F.when(F.col("copies") > 1, F.col("first"))))
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.when(probe, F.col("copies") - 1).alias("n_copies"),
        F.when(probe, F.coalesce("n", F.lit(0).cast("long"))).alias("n_prints"),
        F.when(probe, F.when(F.col("copies") > 1, twin).otherwise(F.col("near_id"))).alias("nearest_id"),
        F.when(probe, F.when(F.col("copies") > 1, F.lit(0)).otherwise(F.col("bits"))).alias("nearest_bits"),
    )
