"""Near-duplicate documents by min-max hashing.

Each of ``permutations`` random permutations gives two values of a document's
shingle set, its minimum and its maximum, so a signature needs half as many
hash evaluations as values. Every agreement of two values is an unbiased sign
of the Jaccard similarity, and the pair of extremes varies less than two
independent minima. Bands of such values bring similar documents into common
buckets.

A pair of similarity 0.8 misses every one of the 32 bands with a chance of
about 5e-8. Which links hold is then decided on the full shingle sets. A bucket
never emits all its pairs: its members are held against its first member, and
links found so far join members into components. Only pairs between components
of one bucket are left. Small buckets give them out; larger ones are worked
through block by block inside tasks, which give out links alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import (
    binary_column,
    byte_offsets,
    distinct_sorted,
    list_column,
    mix,
    shingle_hashes,
    slices,
    store,
    word_hashes,
)
from faultlens.llm.components import connected_components

#: Permutations; each gives a minimum and a maximum.
PERMUTATIONS = 64
#: Permutations in a band, so twice as many values.
BAND = 2
#: Buckets of up to so many members give pairs; larger ones are worked through in blocks.
FEW = 32
#: Shingles of a block.
BLOCK = 1 << 20


def _document_sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shingle hashes, ascending within each document, and how many each has."""
    data, offsets = byte_offsets(batch.column(batch.schema.get_field_index("text")))
    hashes, owners = distinct_sorted(*shingle_hashes(*word_hashes(data, offsets), size))
    return hashes, np.bincount(owners, minlength=batch.num_rows)


def band_hashes(hashes: np.ndarray, counts: np.ndarray, permutations: int = PERMUTATIONS, band: int = BAND) -> np.ndarray:
    """One row of ``permutations // band`` band hashes for each document that has shingles."""
    firsts = (np.cumsum(counts) - counts)[counts > 0]
    bands = np.zeros((len(firsts), permutations // band), np.uint64)
    factors = mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    for p in range(permutations if len(firsts) else 0):
        values = (hashes ^ factors[2 * p]) * (factors[2 * p + 1] | np.uint64(1))
        b = p // band
        for extreme in (np.minimum, np.maximum):
            bands[:, b] = mix(bands[:, b] * np.uint64(0x9FB21C651E98DF25) + extreme.reduceat(values, firsts) + np.uint64(b + 1))
    return bands


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, set_key (equal for equal sets), bands of every document; no set_key or bands without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, counts = _document_sets(batch, size)
            filled = counts > 0
            firsts = (np.cumsum(counts) - counts)[filled]
            keys = np.zeros((len(firsts), 2), np.uint64)
            if len(firsts):
                keys[:, 0] = np.add.reduceat(hashes, firsts)
                keys[:, 1] = np.add.reduceat(mix(hashes), firsts)
            bands = band_hashes(hashes, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    batch.column(batch.schema.get_field_index("text_key")),
                    pa.array(counts, pa.int64()),
                    binary_column(keys.reshape(-1), filled.astype(np.int64) * 2),
                    list_column(bands.reshape(-1), filled * (PERMUTATIONS // BAND), pa.int64()),
                ],
                names=["doc_id", "text_key", "n_shingles", "set_key", "bands"],
            )

    return _keyed(documents).mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>")


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def shingle_sets(documents: DataFrame, size: int) -> DataFrame:
    """doc_id and its shingle hashes, ascending, as one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, counts = _document_sets(batch, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), binary_column(hashes, counts)], names=["doc_id", "shingles"]
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
                at = np.searchsorted(two, one)
                shared = int(np.count_nonzero(two[np.minimum(at, len(two) - 1)] == one))
                keep.append(100 * shared >= percent * (len(one) + len(two) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``documents``.

    Documents are linked if their sets of ``size``-word shingles have
    ``100 * intersection >= percent * union``. ``component_id`` is the smallest
    doc_id reachable over links, ``kept`` says whether it is the document's
    own. Documents without a word (or a null text) are linked with nothing.
    Repeated rows give repeated results. Rows that share a doc_id but not the
    text are linked each by its own text, and not because of the id, which they
    may have in common as component_id. A row with a null doc_id is in no link; its component_id is null and it is kept. Columns other than doc_id
    and text are not looked at.
    """
    known = store(signatures(documents, size), "signatures")
    filled = known.filter("n_shingles > 0 AND doc_id IS NOT NULL")

    # Equal sets are one class, numbered by writing it once; a text of its smallest document stands for it.
    # From here on to the labels doc_id is the number of a class, since a document's id may have several texts.
    classes = filled.groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("text_key", "doc_id").alias("text_key"))
    classes = store(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    named = ["set_key", "doc_id", "text_key"]
    reps = filled.join(classes.select("set_key", F.col("rep").alias("doc_id"), "text_key", "class"), named).dropDuplicates(named)
    entries = reps.select(F.col("class").alias("doc_id"), "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    entries = entries.select("doc_id", "n_shingles", F.xxhash64("band", "bucket").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members"), F.min("doc_id").alias("first")).filter("members > 1")
    members = store(entries.join(shared, "bucket").select("bucket", "doc_id", "n_shingles", "first"), "buckets")

    wanted = classes.join(members.select(F.col("doc_id").alias("class")).distinct(), "class").select(F.col("rep").alias("doc_id"), "text_key", "class")
    texts = _keyed(documents).join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    sets = store(shingle_sets(texts.select(F.col("class").alias("doc_id"), "text"), size), "sets")

    first = members.select("bucket", F.col("first").alias("a"), F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"))
    first = first.filter("a <> b").join(members.select("bucket", F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a")), ["bucket", "a"])
    sizes = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    pairs = store(first.filter(sizes).select("a", "b").distinct(), "pairs")
    links = store(_verified(pairs, sets, percent), "verified")
    components = store(connected_components(links, "a", "b"), "components")

    # What is left are pairs between components that share a bucket.
    open_members = store(_open_members(members, components), "open-buckets")
    few = _few(open_members, sizes).join(pairs, ["a", "b"], "left_anti")
    found = store(_verified(few, sets, percent).union(_many(open_members, sets, percent)).distinct(), "verified")
    if not found.isEmpty():
        components = store(connected_components(links.union(found), "a", "b"), "components")

    linked = classes.join(components.withColumnRenamed("node", "class"), "class", "left").select("set_key", "rep", F.coalesce("component", "class").alias("component"))
    lowest = linked.groupBy("component").agg(F.min("rep").alias("lowest"))
    labels = linked.join(lowest, "component").select("set_key", F.col("lowest").alias("component"))
    # One row for each component and class, so the join back is by the class and Spark may split hot ones.
    placed = known.join(labels, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def _open_members(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of the buckets that span several components, with their component and the bucket's size."""
    placed = members.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "bucket", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")
    )
    spans = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
    return placed.join(spans.filter("low < high").select("bucket", "members"), "bucket")


def _few(open_members: DataFrame, sizes: Column) -> DataFrame:
    """Pairs (a, b) between components in buckets of up to ``FEW`` members."""
    few = open_members.filter(F.col("members") <= FEW)
    one, two = (
        few.select("bucket", *[F.col(c).alias(n + s) for c, n in (("doc_id", ""), ("n_shingles", "n_"), ("component", "c_"))]) for s in "ab"
    )
    return one.join(two, "bucket").filter((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & sizes).select("a", "b").distinct()


def _many(open_members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components in larger buckets.

    A bucket's largest component and its other members are cut into blocks of
    so many shingles; every two blocks whose members may be of different
    components meet in one task. It counts common shingles through an index of
    one block's shingles, and gives out no more links than join its components.
    """
    many = open_members.filter(F.col("members") > FEW)
    sizes = many.groupBy("bucket", "component").agg(F.sum("n_shingles").alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all"))
    block = lambda size: F.greatest(F.lit(1), F.ceil(size / F.lit(BLOCK))).cast("int")
    largest = largest.select(
        "bucket", F.col("top.component").alias("top"), block(F.col("top.size")).alias("own"), block(F.col("all") - F.col("top.size")).alias("others")
    )
    rows = many.join(largest, "bucket").withColumn("is_top", F.col("component") == F.col("top"))
    mine = F.pmod(F.xxhash64("doc_id"), F.when(F.col("is_top"), F.col("own")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("mine", mine)
    # Cell (i, j): block i of the others against block j of the others (j >= i) or, as j = -1 - k, block k of the largest.
    with_top = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("mine")).alias("j"), F.lit(1).alias("side")))
    to_top = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda k: F.struct(F.col("mine").alias("i"), (-1 - k).alias("j"), F.lit(0).alias("side")))
    to_others = F.transform(
        F.sequence(F.lit(0), F.col("others") - 1),
        lambda k: F.struct(F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j"), (k < F.col("mine")).cast("int").alias("side")),
    )
    cells = F.when(F.col("is_top"), with_top).otherwise(F.concat(to_top, to_others))
    rows = rows.join(sets, "doc_id").select("bucket", "doc_id", "component", "shingles", F.explode(cells).alias("cell"))
    rows = rows.select("bucket", "cell.i", "cell.j", "cell.side", "doc_id", "component", "shingles")

    def run(table: pa.Table) -> pa.Table:
        doc, component, side = (table.column(c).to_numpy() for c in ("doc_id", "component", "side"))
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        alone = table.column("i")[0] == table.column("j")[0]
        one = np.flatnonzero(side == 0)
        two = one if alone else np.flatnonzero(side == 1)
        # Of the links between the same components, some of them joined by links of this very cell, one is enough.
        place = np.unique(component, return_inverse=True)[1].tolist()
        above = list(range(len(place)))
        found = []
        for a, b in _index_links(held, one, two, percent):
            low, high = sorted((_top(above, place[a]), _top(above, place[b])))
            if low != high:
                above[high] = low
                found.append((doc[a], doc[b]))
        ends = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _top(above: list[int], node: int) -> int:
    while above[node] != node:
        above[node] = above[above[node]]
        node = above[node]
    return node


def _index_links(held: list[np.ndarray], one: np.ndarray, two: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a set of ``one`` and a set of ``two`` that are similar, by an index of the shingles of ``one``."""
    if not len(one):
        return
    sizes = np.array([len(held[a]) for a in one])
    shingles = np.concatenate([held[a] for a in one])
    order = np.argsort(shingles, kind="stable")
    shingles, owners = shingles[order], np.repeat(np.arange(len(one)), sizes)[order]
    for b in two:
        first = np.searchsorted(shingles, held[b], side="left")
        count = np.searchsorted(shingles, held[b], side="right") - first
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(owners[at], minlength=len(one))
        for a in np.flatnonzero(100 * shared >= percent * (sizes + len(held[b]) - shared)):
            yield one[a], b
