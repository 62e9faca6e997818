"""Removal of repeated byte strings by a distributed sort of suffixes.

A 100-byte string is removed where it also starts earlier. Not every suffix
has to be sorted for that. Among the 69 substrings of 32 bytes in a 100-byte
window the one with the least hash (the leftmost of equals) is the window's
anchor, so equal windows have equal anchors at equal places. Only the suffixes
that begin at anchors are sorted, and only those of anchors that occur more
than once in the corpus. An entry is one anchor with the bytes of all
windows that it stands for.

1. Each task sorts its entries by the suffix at the anchor, settles windows
   that repeat within its run, front-codes the rest (length of the prefix
   shared with the entry before, and the bytes after it) and sends it in
   ranges. A range is one of the anchor's hash, so suffixes with a common
   anchor meet and ranges need no sampled borders.
2. Each range merges its runs with a loser tree. The tree keeps for each run
   how many bytes its head shares with the last output, and looks at bytes
   only beyond what is known to be equal.
3. Neighbours that share the anchor's bytes form a group. Two windows of it
   are equal if the shared prefixes between them cover what follows the anchor
   and the same bytes precede it; of equal windows all but the first go.

An anchor found more than ``HOT`` times, such as one at the edge of a passage
of a third of all documents, has no range of its own: each of its windows is
sent alone, in a range of the window's hash, as the bytes from the anchor on
and then those before it backwards. There windows are equal if the whole of
them is a shared prefix, and the merge holds one place at a time. Since tasks
send a repeated window once a run, no window is hot either.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import byte_offsets, expanded, list_column, rolling_hashes, slices, squeezed, store

LENGTH = 100
#: Bytes of an anchor.
ANCHOR = 32
#: Text bytes of one numpy pass; its arrays stay in the processor's cache.
SLICE = 1 << 18
#: Text bytes whose entries make one sorted run.
RUN_BYTES = 16 << 20
#: Anchors that one range is planned for.
RANGE = 50_000
#: An anchor of more documents than this is dealt out by its windows.
HOT = 16_384
#: Windows of hot anchors that a task sends at once.
WINDOWS = 200_000

#: Spark's setting for removing the shuffles of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

Entry = tuple[bytes, bytes, int, int, int, int, int]  # right, left, fewest and most bytes before the anchor, document (2), position


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _hashed_anchors(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``window_anchors``, and the hash at every position."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = rolling_hashes(data, anchor)
    # The upper half of the hash gives the order, the position is in the lower one.
    order = hashes & np.uint64(0xFFFFFFFF00000000)
    order |= np.arange(len(order), dtype=np.uint64)
    least = _sliding_minimum(order, length - anchor + 1)
    whole = np.zeros(len(data) + 1, np.int32)
    whole[offsets[1:-1]] = 1
    crossed = np.cumsum(whole)
    starts = np.flatnonzero(crossed[length - 1 : len(data)] == crossed[: len(data) - length + 1])
    return starts, (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes


def window_anchors(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every ``length``-byte window that lies in one text, and the position of its anchor."""
    return _hashed_anchors(data, offsets, length, anchor)[:2]


def _anchors_of(batch: pa.RecordBatch, length: int, anchor: int):
    """Bytes and borders of the texts, start of each window and number of its anchor, and position and hash of every anchor."""
    data, offsets = byte_offsets(batch.column(batch.schema.get_field_index("text")))
    starts, chosen, hashes = _hashed_anchors(data, offsets, length, anchor)
    # The anchor moves on with the window, never back.
    new = np.r_[True, chosen[1:] != chosen[:-1]][: len(chosen)]
    places = chosen[new]
    return data, offsets, starts, np.cumsum(new) - 1, places, hashes[places]


def anchor_counts(documents: DataFrame, length: int, anchor: int) -> DataFrame:
    """d, e (the document) and the distinct anchor hashes of its windows; ``twice`` are those it has more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            _, offsets, _, _, places, hashes = _anchors_of(batch, length, anchor)
            owners = np.searchsorted(offsets, places, side="right") - 1
            order = np.lexsort((hashes, owners))
            hashes, owners = hashes[order], owners[order]
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])][: len(hashes)]
            firsts = np.flatnonzero(new)
            again = np.diff(np.r_[firsts, len(hashes)]) > 1
            once, held = firsts[~again], firsts[again]
            columns = [batch.column(0), batch.column(1)]
            for chosen in (once, held):
                columns.append(list_column(hashes[chosen].view(np.int64), np.bincount(owners[chosen], minlength=batch.num_rows), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["d", "e", "once", "twice"])

    return documents.mapInArrow(run, "d long, e long, once array<long>, twice array<long>")


def entries_of(batch: pa.RecordBatch, length: int, anchor: int) -> Iterator[tuple[int, Entry]]:
    """(anchor hash, entry) for all windows of the batch whose anchors repeat."""
    data, offsets, starts, chosen, places, hashes = _anchors_of(batch, length, anchor)
    # An anchor that repeats does so in all of its documents, so their lists are one.
    known = batch.column(batch.schema.get_field_index("repeated")).flatten().to_numpy().view(np.uint64)
    fit = np.isin(hashes, known)[chosen]
    starts, chosen = starts[fit], chosen[fit]
    if not len(starts):
        return
    cut = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
    low, high = starts[cut], starts[np.r_[cut[1:], len(starts)] - 1]
    at, value = places[chosen[cut]], hashes[chosen[cut]]
    owner = np.searchsorted(offsets, at, side="right") - 1
    base = offsets[owner]
    d, e = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    data = data.tobytes()
    for v, lo, hi, p, doc, b in zip(value.tolist(), low.tolist(), high.tolist(), at.tolist(), owner.tolist(), base.tolist(), strict=True):
        yield v, (data[p : hi + length], data[lo:p], p - hi, p - lo, int(d[doc]), int(e[doc]), p - b)


def settle(group: list[Entry], shares: list[int], length: int) -> list[tuple[Entry, int]]:
    """Entries of one anchor, with a bit for every window that has an equal one in an earlier document or place.

    ``group`` is in suffix order, ``shares`` are the prefixes shared with the
    entry before. Bit j stands for the window that begins j bytes before the
    anchor; two are equal if their entries share ``length - j`` bytes from the
    anchor on and the j bytes before it. The same place of the same document,
    as repeated rows give it, is not earlier than itself.
    """
    first: dict[tuple, tuple] = {}
    for entry in group:
        first[entry[:3]] = min(entry[4:], first.get(entry[:3], entry[4:]))
    found: list[list] = []
    distinct: list[tuple] = []
    between = length
    for share, entry in zip(shares, group, strict=True):
        between = min(between, share)
        right, left, low, high, *_ = entry
        place = first[right, left, low]
        found.append([entry, 0])
        if place != entry[4:]:
            found[-1][1] = (1 << (high + 1)) - (1 << low)
            continue
        distinct.append((between, left, low, high, place, found[-1]))
        between = length
    if len(distinct) == 2:
        (_, left, *one), (share, other, *two) = distinct
        low, high = max(one[0], two[0], length - share), min(one[1], two[1], shared_prefix(left[::-1], other[::-1], 0))
        if low <= high and one[2] != two[2]:
            max(one, two, key=lambda x: x[2])[3][1] |= (1 << (high + 1)) - (1 << low)
    elif len(distinct) > 2:
        for j in range(min(x[2] for x in distinct), max(x[3] for x in distinct) + 1):
            seen: dict[bytes, tuple] = {}
            for share, left, low, high, place, row in distinct:
                if share < length - j:
                    seen = {}
                if low <= j <= high:
                    before, earliest = seen.get(left[high - j :], (place, row))
                    if place > before:
                        row[1] |= 1 << j
                        continue
                    if place < before:
                        earliest[1] |= 1 << j
                    seen[left[high - j :]] = place, row
    return [(entry, bits) for entry, bits in found]


def _stretches(bits: int, low: int, high: int) -> Iterator[tuple[bool, int, int]]:
    """(set, first, last) for the runs of equal bits between ``low`` and ``high``."""
    j = low
    while j <= high:
        value, k = bits >> j & 1, j
        while k < high and bits >> (k + 1) & 1 == value:
            k += 1
        yield bool(value), j, k
        j = k + 1


def shared_prefix(one: bytes, two: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to be equal."""
    end = min(len(one), len(two))
    difference = int.from_bytes(one[known:end], "big") ^ int.from_bytes(two[known:end], "big")
    return end - (difference.bit_length() + 7) // 8


def merged(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """(shared prefix with the entry before, suffix, rest) of all sorted front-coded ``runs`` in order.

    A loser tree. Each inner node keeps the loser of its match and how many
    bytes it shares with the winner; the longer of two known prefixes decides
    without looking at a byte.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    sources = [*runs, *[iter(())] * (size - len(runs))]
    # Known prefixes are with the last output; before it there is none.
    known = [-1 if head is None else 0 for head in heads]
    losers = [0] * size

    def match(one: int, two: int) -> tuple[int, int]:
        a, b = known[one], known[two]
        if a > b:
            return one, two
        if a < b:
            return two, one
        if a < 0:
            return one, two
        x, y = heads[one][1], heads[two][1]
        common = shared_prefix(x, y, a)
        if x[common : common + 1] <= y[common : common + 1]:
            known[two] = common
            return one, two
        known[one] = common
        return two, one

    level = [(size + i, i) for i in range(size)]
    while len(level) > 1:
        upper = []
        for (place, one), (_, two) in zip(level[::2], level[1::2], strict=True):
            winner, loser = match(one, two)
            losers[place // 2] = loser
            upper.append((place // 2, winner))
        level = upper
    winner = level[0][1]
    while heads[winner] is not None:
        _, suffix, rest = heads[winner]
        yield known[winner], suffix, rest
        heads[winner] = following = next(sources[winner], None)
        known[winner] = -1 if following is None else following[0]
        place = (size + winner) // 2
        while place:
            winner, losers[place] = match(winner, losers[place])
            place //= 2


#: Shared prefix, bytes of the suffix and of the left side, fewest and most bytes before the anchor, document (2), position.
_META = struct.Struct("<HHHHHqqq")


def coded(entries: list[Entry]) -> tuple[bytes, bytes]:
    """A sorted run: fixed-size fields, and for each entry the bytes of its suffix beyond the shared prefix and its left side."""
    meta, tails = [], []
    before = b""
    for right, left, low, high, d, e, at in entries:
        share = shared_prefix(before, right, 0)
        meta.append(_META.pack(share, len(right), len(left), low, high, d, e, at))
        tails += (right[share:], left)
        before = right
    return b"".join(meta), b"".join(tails)


def decoded(meta: bytes, tails: bytes) -> Iterator[tuple[int, bytes, Entry]]:
    right, at = b"", 0
    for share, size, left, low, high, d, e, place in _META.iter_unpack(meta):
        right = right[:share] + tails[at : at + size - share]
        at += size - share
        yield share, right, (right, tails[at : at + left], low, high, d, e, place)
        at += left


def _window(entry: Entry, j: int, length: int) -> Entry:
    """The window that begins ``j`` bytes before the anchor: its bytes from the anchor on, then those before it backwards, then j."""
    right, left, _, high, *place = entry
    return (right[: length - j] + left[high - j :][::-1] + j.to_bytes(2, "big"), b"", j, j, *place)


def _runs(texts: DataFrame, ranges: int, length: int, anchor: int) -> DataFrame:
    """Front-coded sorted runs by range (``part``; from ``ranges`` on, windows of hot anchors), and removals settled inside a run (``part`` is null)."""

    def sent(parts: dict[int, list[Entry]], gone: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        rows = [(number, *coded(sorted(part)), None, None, None, None) for number, part in sorted(parts.items())]
        rows += [(None, None, None, *x) for x in joined(gone)]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["part", "meta", "tails", "d", "e", "first", "last"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def cut(held: dict[int, list[Entry]], hot: set[int]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[Entry]] = {}
        gone: list[tuple[int, int, int, int]] = []
        windows = 0
        for value, found in held.items():
            found.sort()
            # Of equal entries the earliest comes first; the others go as a whole, before prefixes are looked at.
            group = [found[0]]
            for entry in found[1:]:
                if entry[:3] != group[-1][:3]:
                    group.append(entry)
                elif entry[4:] != group[-1][4:]:
                    _, _, low, high, d, e, at = entry
                    gone.append((d, e, at - high, at - low + length))
            shares = [0, *(shared_prefix(a[0], b[0], 0) for a, b in zip(group, group[1:], strict=False))]
            for entry, bits in settle(group, shares, length) if len(group) > 1 else [(group[0], 0)]:
                right, left, low, high, d, e, at = entry
                for repeated, one, two in _stretches(bits, low, high) if bits else [(False, low, high)]:
                    if repeated:
                        gone.append((d, e, at - two, at - one + length))
                    elif value in hot:
                        for j in range(one, two + 1):
                            window = _window(entry, j, length)
                            parts.setdefault(ranges + zlib.crc32(window[0]) % ranges, []).append(window)
                        windows += two + 1 - one
                    else:
                        parts.setdefault(value % ranges, []).append((right[: length - one], left[high - two :], one, two, d, e, at))
                if windows >= WINDOWS:
                    yield sent(parts, gone)
                    parts, gone, windows = {}, [], 0
        if parts or gone:
            yield sent(parts, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Entry]] = {}
        hot: set[int] = set()
        size = 0
        for batch in expanded(batches, SLICE):
            found = batch.column(batch.schema.get_field_index("hot")).flatten().to_numpy().view(np.uint64)
            hot.update(np.unique(found).tolist())
            for value, entry in entries_of(batch, length, anchor):
                held.setdefault(value, []).append(entry)
                size += len(entry[0]) + len(entry[1])
            if size >= RUN_BYTES:
                yield from cut(held, hot)
                held, hot, size = {}, set(), 0
        yield from cut(held, hot)

    return texts.mapInArrow(run, "part int, meta binary, tails binary, d long, e long, first long, last long")


def joined(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping or touching spans of one document as one."""
    found: list[tuple[int, int, int, int]] = []
    for d, e, first, last in sorted(spans):
        if found and found[-1][:2] == (d, e) and first <= found[-1][3]:
            found[-1] = (d, e, found[-1][2], max(last, found[-1][3]))
        else:
            found.append((d, e, first, last))
    return found


def _merge_range(ranges: int, length: int, anchor: int):
    def anchors(runs: list) -> Iterator[tuple[int, int, int, int]]:
        def close() -> Iterator[tuple[int, int, int, int]]:
            if len(group) > 1:
                for (_, _, low, high, d, e, at), bits in settle(group, shares, length):
                    if bits:
                        yield from ((d, e, at - two, at - one + length) for repeated, one, two in _stretches(bits, low, high) if repeated)

        group: list[Entry] = []
        shares: list[int] = []
        for share, _, entry in merged(runs):
            if share < anchor:
                yield from close()
                group.clear()
                shares.clear()
            group.append(entry)
            shares.append(share)
        yield from close()

    def windows(runs: list) -> Iterator[tuple[int, int, int, int]]:
        first: tuple = ()
        for share, window, (_, _, j, _, *place) in merged(runs):
            if share < len(window):
                first = place
            elif place != first:
                first, (d, e, at) = sorted((first, place))
                yield d, e, at - j, at - j + length

    def run(table: pa.Table) -> pa.Table:
        runs = [decoded(m.as_py(), t.as_py()) for m, t in zip(table.column("meta"), table.column("tails"), strict=True)]
        gone = list(windows(runs) if table.column("part")[0].as_py() >= ranges else anchors(runs))
        columns = list(zip(*joined(gone), strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["d", "e", "first", "last"])

    return run


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``store``, and Spark removes the write's shuffles at its end; else they lie beside the table until the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return store(df.select("*"), name)
    finally:
        conf.set(CLEANUP, before)


def removals(keyed: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(d, e, first, last): byte spans to remove; they may overlap."""
    counted = _stored(anchor_counts(keyed, length, anchor), "anchors")
    each = counted.select("d", "e", F.explode(F.concat("once", "twice")).alias("h"))
    total = counted.select(F.explode("once").alias("h"), F.lit(1).alias("n")).union(counted.select(F.explode("twice").alias("h"), F.lit(2).alias("n")))
    repeated = total.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h", F.when(F.col("n") > HOT, F.col("h")).alias("hot"))
    found = each.join(repeated, "h").groupBy("d", "e").agg(F.collect_list("h").alias("repeated"), F.collect_list("hot").alias("hot"))
    held = _stored(found, "repeated")
    # As each anchor is that of half of the windows that could have it.
    windows = F.size("repeated") + F.size("hot") * ((length - anchor) // 2)
    ranges = max(1, -(-(held.agg(F.sum(windows)).first()[0] or 0) // RANGE))
    texts = squeezed(keyed).join(held, ["d", "e"]).select("d", "e", "repeated", "hot", "packed")
    runs = _stored(_runs(texts, ranges, length, anchor), "runs")
    merges = runs.filter("part IS NOT NULL").select("part", "meta", "tails").groupBy("part")
    across = merges.applyInArrow(_merge_range(ranges, length, anchor), "d long, e long, first long, last long")
    return runs.filter("part IS NULL").select("d", "e", "first", "last").union(across)


def deduplicated(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed ``spans`` of every row of ``documents``.

    Every byte covered by a ``length``-byte string that also starts earlier
    (smaller doc_id, or earlier in the same document) is removed; strings are
    judged on the input. A null text is empty. Rows equal in doc_id and text
    are one document and give equal results; different texts of one doc_id are
    ordered by a hash. A null doc_id comes before all others. Columns besides
    doc_id and text are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("e"), text.alias("text")
    )
    spans = removals(keyed, length, anchor)
    spans = _stored(spans.groupBy("d", "e").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")), "removals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in expanded(batches, SLICE):
            data, offsets = byte_offsets(batch.column(batch.schema.get_field_index("text")))
            data = data.tobytes()
            rows = []
            for spans_, begin, end in zip(batch.column(3).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = data[begin:end]
                gone = [(x[2], x[3]) for x in joined([(0, 0, s["first"], s["last"]) for s in spans_])]
                digest, at = hashlib.sha256(), 0
                for first, last in gone:
                    digest.update(text[at:first])
                    at = last
                digest.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in gone), len(gone), digest.hexdigest(), [{"first": a, "last": b} for a, b in gone]))
            n_bytes, n_removed, n_spans, sha, lists = zip(*rows, strict=True)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(sha), pa.array(lists, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>"
    cut = squeezed(keyed).join(spans, ["d", "e"]).select("d", "e", "packed", "spans").mapInArrow(run, schema)
    plain = keyed.select("d", "e", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("kept_sha256"))
    plain = plain.join(spans.select("d", "e"), ["d", "e"], "left_anti").select(
        "d", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256",
        F.array().cast("array<struct<first:long,last:long>>").alias("spans"),
    )
    doc_id = F.when(F.col("d") != -(1 << 63), F.col("d")).alias("doc_id")
    return cut.union(plain).select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
