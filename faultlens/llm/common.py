"""Stored intermediate tables, and numpy views of Arrow text columns."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from faultlens.session import scratch_path

#: Text bytes that one numpy pass looks at; bounds a Python worker's memory.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch between Spark and Python, where the session has not chosen another number.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Later readers depend on files that every executor reaches, not on the
    tasks that made them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes in each; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = byte_offsets(batch.column(batch.schema.get_field_index(column)))[1][1:]
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def byte_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more entry than texts); null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on all others."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, count: int) -> np.ndarray:
    known = _POWERS.get(name)
    if known is None or len(known) < count:
        steps = np.full(max(count, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _POWERS[name] = known = np.multiply.accumulate(steps)
    return known[:count]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in every span [start, end), the same wherever they stand.

    Many bytes are worked through in parts, by where the spans begin.
    """
    if len(data) <= 2 * SLICE_BYTES or not len(starts):
        return _span_hashes(data, starts, ends)
    found = np.empty(len(starts), np.uint64)
    part = starts // SLICE_BYTES
    for k in np.unique(part).tolist():
        mine = np.flatnonzero(part == k)
        first, last = k * SLICE_BYTES, int(ends[mine].max())
        found[mine] = _span_hashes(data[first:last], starts[mine] - first, ends[mine] - first)
    return found


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _powers("up", _BASE, len(data)), out=total[1:])
    down = _powers("down", _BASE_INVERSE, len(data) + 1)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """``span_hashes`` of the ``width`` bytes from every position on that has as many."""
    count = max(0, len(data) - width + 1)
    if len(data) > 2 * SLICE_BYTES:
        at = np.arange(count)
        return span_hashes(data, at, at + width)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _powers("up", _BASE, len(data)), out=total[1:])
    sums = total[width:] - total[:count]
    sums *= _powers("down", _BASE_INVERSE, len(data) + 1)[:count]
    sums += np.uint64(width)
    return mix(sums)


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of letters and digits; those of other scripts count as letters.
IS_ALPHANUMERIC = np.zeros(256, bool)
IS_ALPHANUMERIC[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word: bytes that ``table`` marks (not ASCII white space), never across texts."""
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = inside[edges]
    lasts = edges[1:] - 1
    stops[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash (A-Z lower-cased) and text number of every word."""
    starts, ends, owners = word_spans(data, offsets)
    return span_hashes(_LOWER[data], starts, ends), owners


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingle_hashes(words: np.ndarray, owners: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row with their text numbers, in order.

    A text with fewer words has its whole sequence as one shingle.
    """
    if not len(words):
        return words, owners
    weights = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(size)]
    full = max(0, len(words) - size + 1)
    sums = np.zeros(full, np.uint64)
    for k, weight in enumerate(weights):
        sums += words[k : k + full] * weight
    whole = owners[:full] == owners[size - 1 :] if full else np.zeros(0, bool)
    hashes, holders = mix(sums[whole]), owners[:full][whole]

    firsts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    counts = np.diff(np.r_[firsts, len(owners)])
    short = counts < size
    if short.any():
        sequence = np.zeros(int(short.sum()), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            sequence[has] += words[firsts[short][has] + k] * weights[k]
        sequence = mix(sequence ^ mix(counts[short].astype(np.uint64)))
        hashes, holders = np.r_[hashes, sequence], np.r_[holders, owners[firsts[short]]]
        order = np.argsort(holders, kind="stable")
        hashes, holders = hashes[order], holders[order]
    return hashes, holders


def distinct_sorted(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of every text, ascending within it."""
    if not len(hashes):
        return hashes, owners
    order = np.argsort(hashes)
    order = order[np.argsort(owners[order].astype(np.int32), kind="stable")]
    hashes, owners = hashes[order], owners[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])]
    return hashes[new], owners[new]


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from the flat values and the number of values in every row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def binary_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column; row i has the next ``counts[i]`` items of ``values``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * values.itemsize, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def squeezed(df: DataFrame) -> DataFrame:
    """``df`` with its ``text`` compressed as ``packed``, so that it takes less room in shuffles."""
    rest = [f for f in df.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text"):
            data, offsets = byte_offsets(batch.column(batch.schema.get_field_index("text")))
            data = data.tobytes()
            packed = pa.array([squeeze(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            yield pa.RecordBatch.from_arrays([*kept, packed], names=[*[f.name for f in rest], "packed"])

    return df.mapInArrow(run, StructType([*rest, StructField("packed", BinaryType())]))


def expanded(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches with ``packed`` texts back as a last column ``text`` (bytes), a few at a time."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, "packed", 1 << 18):
        texts = pa.array([expand(x.as_buffer()) for x in batch.column(batch.schema.get_field_index("packed"))], pa.large_binary())
        yield from slices(iter([batch.append_column("text", texts)]), "text", limit)


def sampled(hash_: Column, rows: int, size: int, spare: int = 64) -> Column:
    """True for the rows of least hash: about ``spare * size`` of ``rows`` rows, or all if there are no more.

    What is then put in order to find the least ``size`` is bounded, however
    many rows and partitions there are.
    """
    share = min(1.0, spare * size / max(rows, 1))
    return hash_ <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))


def ship(spark: SparkSession) -> None:
    """Prepare a session for Python on its executors.

    Sends this package to them once, so that they need no copy of the
    repository, and makes Arrow batches small, so that a worker's memory
    follows from the longest texts and not from 10,000 rows of any length.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    if not getattr(context, "_faultlens_shipped", False):
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='faultlens-')}/faultlens", "zip", root_dir=root, base_dir="faultlens")
        context.addPyFile(archive)
        context._faultlens_shipped = True
