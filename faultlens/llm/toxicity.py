"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is cut into overlapping windows of words. A word enters as the
embedding of its identity (words of the training sample; all others share one)
joined with the sum of embeddings of its characters at their places and of its
first and last few. Gated
units read the window in both directions, attention weighs their states, and a
document is as toxic as its most toxic window.

The network is trained in numpy on a bounded sample of labelled documents; in
each round a document is learned from the windows that now score highest.
Scoring is one pass over all texts with all their windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import IS_ALPHANUMERIC, byte_offsets, lower_bytes, mix, sampled, slices, span_hashes, store, word_spans

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 48
#: The training sample: documents of each class at most, and the characters of the longest.
SAMPLE, SAMPLE_CHARS = 1500, 20_000
#: Units of one direction, sizes of the word and character embeddings, characters of a word that are looked at.
UNITS, WORD_SIZE, CHAR_SIZE, CHARS = 8, 16, 8, 12
VOCABULARY = 8192
#: Standard errors by which a word's presence must differ between the classes to be known by itself,
#: at least; this share of the largest such difference, if that is more.
CHANCE, SHARE = 2.5, 0.15
#: Bytes of the beginnings and of the ending of a word that have embeddings.
BEGINNINGS, ENDING = (4, 5, 6, 7, 8, 9), 5
#: Rounds over the sample; a small sample takes more, until about so many steps are made.
ROUNDS, STEPS = 5, 130
THRESHOLD = 0.3
#: How many more texts are clean than toxic, when the border between them is found.
CLEAN_WEIGHT = 8.0
#: Toxic texts that are enough to find it.
ENOUGH = 50
#: Bytes of text, and words of whole documents, that training looks at together.
PART_BYTES, PART_WORDS = 1 << 18, 1 << 15


@dataclass
class Words:
    """The words of some texts: distinct hashes, characters and hashes of their ends, and each text's words as numbers into them."""

    hashes: np.ndarray
    chars: np.ndarray
    affixes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray


def read_words(texts: pa.Array) -> Words:
    data, offsets = byte_offsets(texts)
    starts, ends, owners = word_spans(data, offsets, IS_ALPHANUMERIC)
    low = lower_bytes(data)
    hashes, firsts, numbers = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
    at = starts[firsts, None] + np.arange(CHARS)
    chars = np.where(at < ends[firsts, None], low[np.minimum(at, max(len(low) - 1, 0))] if len(low) else 0, 0)
    first, last = starts[firsts], ends[firsts]
    # What a word begins and ends with; a short word is both as a whole.
    affixes = [span_hashes(low, first, np.minimum(first + k, last)) for k in BEGINNINGS] + [span_hashes(low, np.maximum(last - ENDING, first), last)]
    affixes = np.stack([mix(a + np.uint64(k)) for k, a in enumerate(affixes)], axis=1)
    return Words(hashes, chars.astype(np.int16), affixes, numbers.reshape(-1).astype(np.int32), np.bincount(owners, minlength=len(offsets) - 1))


def _together(parts: list[Words]) -> Words:
    """The texts of all parts in a row, each distinct word once."""
    hashes = np.unique(np.concatenate([p.hashes for p in parts]))
    chars = np.empty((len(hashes), parts[0].chars.shape[1]), np.int16)
    affixes = np.empty((len(hashes), parts[0].affixes.shape[1]), np.uint64)
    numbers = []
    for part in parts:
        at = np.searchsorted(hashes, part.hashes).astype(np.int32)
        chars[at], affixes[at] = part.chars, part.affixes
        numbers.append(at[part.numbers])
    return Words(hashes, chars, affixes, np.concatenate(numbers), np.concatenate([p.counts for p in parts]))


def read_texts(texts: list[str], limit: int = PART_BYTES, at_once: int = 16) -> Words:
    """``read_words`` of many texts, read a few at a time."""
    parts, first, size = [], 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= limit or k + 1 == len(texts):
            parts.append(read_words(pa.array(texts[first : k + 1], pa.large_string())))
            first, size = k + 1, 0
            if len(parts) == at_once:
                parts = [_together(parts)]
    return _together(parts or [read_words(pa.array([], pa.large_string()))])


def in_parts(words: Words, limit: int = PART_WORDS) -> Iterator[tuple[int, int, int, int]]:
    """First and one past the last document, and the same of their words, so that parts have about ``limit`` words."""
    ends = np.r_[0, np.cumsum(words.counts)]
    first = 0
    while first < len(words.counts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        yield first, last, int(ends[first]), int(ends[last])
        first = last


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word (in all words) and length of every window; a text without words has one empty window."""
    each = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
    document = np.repeat(np.arange(len(counts)), each)
    turn = np.arange(len(document)) - np.repeat(np.cumsum(each) - each, each)
    # The last window ends with the text.
    start = np.minimum(turn * STRIDE, np.maximum(counts[document] - WINDOW, 0))
    first = np.cumsum(counts) - counts
    return document, first[document] + start, np.minimum(counts[document], WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Weights, the forward pass and the gradient."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], affixes: tuple[np.ndarray, np.ndarray], seed: int = 7):
        random = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (random.standard_normal(shape) * scale).astype(np.float32)

        size = WORD_SIZE + CHAR_SIZE
        #: Hashes of the known words and affixes, ascending; number 0 of an embedding is any other.
        self.vocabulary, self.affixes = words[0], affixes[0]
        self.weights = {
            "word": normal(len(words[0]) + 1, WORD_SIZE, scale=0.1),
            "affix": normal(len(affixes[0]) + 1, CHAR_SIZE, scale=0.1),
            "char": normal(CHARS * 256, CHAR_SIZE, scale=0.05),
            "input": normal(size, 6 * UNITS, scale=size**-0.5),
            "input_bias": np.zeros(6 * UNITS, np.float32),
            "gates": normal(2, UNITS, 2 * UNITS, scale=UNITS**-0.5),
            "state": normal(2, UNITS, UNITS, scale=UNITS**-0.5),
            "attention": normal(2 * UNITS, UNITS, scale=0.3),
            "attention_bias": np.zeros(UNITS, np.float32),
            "attend": normal(UNITS, scale=0.3),
            "out": normal(2 * UNITS, scale=0.3),
            "out_bias": np.full(1, -1, np.float32),
        }
        # A start for the search: how much more frequent they are in one class of the sample.
        self.weights["word"][1:, 0] = words[1]
        self.weights["affix"][1:, 0] = affixes[1]
        #: Slope and offset from the highest window's value to the log-odds of a document.
        self.scale = (1.0, 0.0)

    def inputs(self, words: Words) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """For distinct words: their and their affixes' numbers, embeddings, and what the gates see of them."""
        w = self.weights
        number, ends = _numbers(self.vocabulary, words.hashes), _numbers(self.affixes, words.affixes)
        x = np.empty((len(number), WORD_SIZE + CHAR_SIZE), np.float32)
        x[:, :WORD_SIZE] = w["word"][number]
        x[:, WORD_SIZE:] = w["char"][words.chars[:, 0]]
        for k in range(1, CHARS):
            x[:, WORD_SIZE:] += w["char"][words.chars[:, k] + 256 * k]
        for k in range(ends.shape[1]):
            x[:, WORD_SIZE:] += w["affix"][ends[:, k]]
        seen = x @ w["input"] + w["input_bias"]
        return (number, ends), x, np.concatenate([seen, np.zeros((1, 6 * UNITS), np.float32)])

    def forward(self, seen: np.ndarray, index: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The value of every window. ``index`` (windows, WINDOW) numbers the words; places past the length are not read."""
        w = self.weights
        steps = int(lengths.max(initial=0))
        both = seen.reshape(len(seen), 2, 3 * UNITS)
        state = np.zeros((2, len(index), UNITS), np.float32)
        states = np.zeros((steps, 2, len(index), UNITS), np.float32)
        for t in range(steps):
            # Forward reads place t; backward reads the same distance from the window's end.
            back = np.maximum(lengths - 1 - t, 0)
            a = np.stack([both[index[:, t], 0], both[index[np.arange(len(index)), back], 1]])
            gates = _sigmoid(a[:, :, : 2 * UNITS] + state @ w["gates"])
            update, reset = gates[:, :, :UNITS], gates[:, :, UNITS:]
            held = reset * state
            new = np.tanh(a[:, :, 2 * UNITS :] + held @ w["state"])
            following = new + update * (state - new)
            live = (lengths > t)[None, :, None]
            following = np.where(live, following, state)
            if keep is not None:
                keep.append((state, gates, held, new, live, back))
            state = states[t] = following
        return self._pooled(states, lengths, keep)

    def _pooled(self, states: np.ndarray, lengths: np.ndarray, keep: list | None) -> np.ndarray:
        w = self.weights
        steps, _, count, _ = states.shape
        if not steps:
            return np.full(count, w["out_bias"][0], np.float32)
        # Both directions' states of one place side by side.
        place = np.maximum(lengths[None, :] - 1 - np.arange(steps)[:, None], 0)
        h = np.concatenate([states[:, 0], np.take_along_axis(states[:, 1], place[:, :, None], 0)], axis=2)
        u = np.tanh(h @ w["attention"] + w["attention_bias"])
        e = u @ w["attend"]
        inside = np.arange(steps)[:, None] < lengths[None, :]
        e = np.where(inside, e, np.float32(-1e9))
        e = np.exp(e - e.max(0)) * inside
        share = e / np.maximum(e.sum(0), np.float32(1e-9))
        pooled = (share[:, :, None] * h).sum(0)
        if keep is not None:
            keep.append((h, u, share, pooled, place))
        return pooled @ w["out"] + w["out_bias"][0]

    def gradient(self, words: Words, index: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the windows."""
        w, keep = self.weights, []
        (number, ends), x, seen = self.inputs(words)
        value = self.forward(seen, index, lengths, keep)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        d_value = ((_sigmoid(value) - target) / len(target)).astype(np.float32)
        if len(keep) <= 1:
            g["out_bias"][0] = d_value.sum()
            return g
        h, u, share, pooled, place = keep.pop()
        steps = len(keep)
        g["out"], g["out_bias"][0] = pooled.T @ d_value, d_value.sum()
        d_pooled = d_value[:, None] * w["out"]
        d_share = (h * d_pooled).sum(2)
        d_e = share * (d_share - (share * d_share).sum(0))
        g["attend"] = np.einsum("tbu,tb->u", u, d_e)
        d_u = d_e[:, :, None] * w["attend"] * (1 - u * u)
        g["attention"] = np.einsum("tbh,tbu->hu", h, d_u)
        g["attention_bias"] = d_u.sum((0, 1))
        d_h = share[:, :, None] * d_pooled + d_u @ w["attention"].T
        live = np.arange(steps)[:, None, None] < lengths[None, :, None]
        d_h = d_h * live
        d_states = np.zeros((steps, 2, len(index), UNITS), np.float32)
        d_states[:, 0] = d_h[:, :, :UNITS]
        # Within a window the places run the other way, one to one.
        d_states[:, 1] = np.take_along_axis(d_h[:, :, UNITS:], place[:, :, None], 0) * live
        d_seen = np.zeros((len(seen), 2, 3 * UNITS), np.float32)
        carried = np.zeros((2, len(index), UNITS), np.float32)
        rows = np.arange(len(index))
        for t in reversed(range(steps)):
            state, gates, held, new, alive, back = keep[t]
            update, reset = gates[:, :, :UNITS], gates[:, :, UNITS:]
            d = carried + d_states[t]
            d_live = d * alive
            d_new = d_live * (1 - update) * (1 - new * new)
            d_update = d_live * (state - new)
            d_held = d_new @ w["state"].transpose(0, 2, 1)
            g["state"] += held.transpose(0, 2, 1) @ d_new
            d_gates = np.concatenate([d_update, d_held * state], axis=2) * gates * (1 - gates)
            g["gates"] += state.transpose(0, 2, 1) @ d_gates
            carried = np.where(alive, d_live * update + d_held * reset + d_gates @ w["gates"].transpose(0, 2, 1), d)
            d_a = np.concatenate([d_gates, d_new], axis=2)
            np.add.at(d_seen[:, 0], index[:, t], d_a[0])
            np.add.at(d_seen[:, 1], index[rows, back], d_a[1])
        d_seen = d_seen[:-1].reshape(-1, 6 * UNITS)
        g["input"], g["input_bias"] = x.T @ d_seen, d_seen.sum(0)
        d_x = d_seen @ w["input"].T
        np.add.at(g["word"], number, d_x[:, :WORD_SIZE])
        for k in range(ends.shape[1]):
            np.add.at(g["affix"], ends[:, k], d_x[:, WORD_SIZE:])
        for k in range(CHARS):
            np.add.at(g["char"], words.chars[:, k] + 256 * k, d_x[:, WORD_SIZE:])
        return g

    def window_values(self, words: Words, batch: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word, length and value of every window of some texts."""
        document, first, lengths = windows(words.counts)
        values = np.empty(len(document), np.float32)
        for one, last, begin, end in in_parts(words):
            # Only what the words of these documents look like is held.
            kinds, numbers = np.unique(words.numbers[begin:end], return_inverse=True)
            some = Words(words.hashes[kinds], words.chars[kinds], words.affixes[kinds], numbers.reshape(-1), words.counts[one:last])
            seen = self.inputs(some)[2]
            mine = np.arange(*np.searchsorted(document, [one, last]))
            mine = mine[np.argsort(lengths[mine], kind="stable")]
            for part in np.split(mine, range(batch, len(mine), batch)):
                values[part] = self.forward(seen, window_index(some, first[part] - begin, lengths[part]), lengths[part])
        return document, first, lengths, values

    def document_scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probability of every text, and how many windows it has."""
        words = read_words(texts)
        document, _, _, values = self.window_values(words)
        borders = np.flatnonzero(np.r_[True, document[1:] != document[:-1]])
        best = np.maximum.reduceat(values, borders).astype(np.float64)
        slope, offset = self.scale
        return 1 / (1 + np.exp(-np.clip(slope * best + offset, -60, 60))), np.diff(np.r_[borders, len(document)])


def _numbers(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes in ``known``, from 1; 0 for any other."""
    if not len(known):
        return np.zeros(hashes.shape, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 1, 0)


def window_index(words: Words, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of each window's words; past its end the number of the word that is none."""
    none = len(words.hashes)
    if not len(words.numbers):
        return np.full((len(first), WINDOW), none)
    at = np.minimum(first[:, None] + np.arange(WINDOW), len(words.numbers) - 1)
    return np.where(np.arange(WINDOW) < lengths[:, None], words.numbers[at], none)


def _vocabulary(words: Words, features: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features (hashes of each distinct word) whose presence differs most between the classes, and by how much (log-odds, shrunk)."""
    names = np.unique(features)
    columns = (features if features.ndim == 2 else features[:, None]).T
    which = [np.searchsorted(names, column).astype(np.int32) for column in columns]
    size = max(len(names), 1)
    bad, all_ = np.zeros(len(names)), np.zeros(len(names), np.int64)
    for first, last, begin, end in in_parts(words):
        owners = np.repeat(np.arange(first, last), words.counts[first:last])
        pairs = np.unique(np.concatenate([np.unique(owners * size + w[words.numbers[begin:end]]) for w in which]))
        holder, number = pairs // size, pairs % size
        np.add.at(bad, number, toxic[holder])
        np.add.at(all_, number, 1)
    n_bad, n = max(toxic.sum(), 1), max(len(toxic), 2)
    p, q = (bad + 0.5) / (n_bad + 1), (all_ - bad + 0.5) / (n - n_bad + 1)
    strength = np.abs(p - q) / np.sqrt(p * (1 - p) / n_bad + q * (1 - q) / max(n - n_bad, 1))
    strength[all_ < 3] = 0
    # Below this many standard errors a difference is chance, of which a large vocabulary has much.
    chosen = np.sort(np.argsort(-strength, kind="stable")[:VOCABULARY])
    least = max(CHANCE, SHARE * strength.max(initial=0))
    chosen = chosen[strength[chosen] > least]
    sure = np.clip((strength[chosen] - least) / max(0.3 * strength.max(initial=0), 1), 0, 1)
    shrunk = np.clip(np.log(p[chosen] / q[chosen]), -4, 4) * sure
    return names[chosen], shrunk.astype(np.float32)


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = 7, batch: int = 128) -> Network:
    """A network from labelled texts. With no text or only one class it gives every text that class's share; without any label nothing is toxic."""
    toxic = np.asarray(labels, np.float64)
    words = read_texts(texts)
    network = Network(_vocabulary(words, words.hashes, toxic), _vocabulary(words, words.affixes, toxic), seed=seed)
    if len(set(labels)) < 2:
        share = (toxic.sum() + 0.25) / (len(toxic) + 1)
        network.scale = (0.0, float(np.log(share / (1 - share))))
        return network
    # Every fourth text teaches nothing but where the border lies, if that leaves enough toxic ones.
    border = np.arange(len(toxic)) % 4 == 3
    if toxic[border].sum() < ENOUGH or toxic[border].all():
        border[:] = False
    random = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in network.weights.items()}
    square = {k: np.zeros_like(v) for k, v in network.weights.items()}
    step = 0
    a_round = max(1, int((2 - toxic[~border]).sum()) // batch)
    for _ in range(max(rounds, -(-STEPS // a_round))):
        document, first, lengths, values = network.window_values(words)
        order = np.lexsort((-values, document))
        rank = np.arange(len(order)) - np.searchsorted(document[order], document[order])
        # The best window of a toxic text is toxic; no window of a clean one is.
        chosen = order[(rank < np.where(toxic[document[order]] > 0, 1, 2)) & ~border[document[order]]]
        random.shuffle(chosen)
        for part in np.split(chosen, range(batch, len(chosen), batch)):
            index = window_index(words, first[part], lengths[part])
            kinds, index = np.unique(index, return_inverse=True)
            kinds = kinds[kinds < len(words.hashes)]
            used = Words(words.hashes[kinds], words.chars[kinds], words.affixes[kinds], words.numbers, words.counts)
            index = index.reshape(len(part), WINDOW)
            step += 1
            for k, d in network.gradient(used, index, lengths[part], toxic[document[part]].astype(np.float32)).items():
                mean[k] += (d - mean[k]) * np.float32(0.1)
                square[k] += (d * d - square[k]) * np.float32(0.01)
                rate = 0.01 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                network.weights[k] -= np.float32(rate) * mean[k] / (np.sqrt(square[k]) + np.float32(1e-7))
    document, _, _, values = network.window_values(words)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, document, values)
    unseen = border if border.any() else ~border
    network.scale = _logistic(best[unseen], toxic[unseen], CLEAN_WEIGHT if border.any() else 1.0)
    return network


def _logistic(value: np.ndarray, target: np.ndarray, clean_weight: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a light prior.

    Clean texts weigh ``clean_weight`` times. The values are brought to one
    scale first.
    """
    middle, spread = value.mean(), max(value.std(), 1e-6)
    x = np.c_[(value - middle) / spread, np.ones(len(value))]
    weight = np.where(target > 0, 1.0, clean_weight)
    beta = np.array([1.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - target)) + 0.02 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta - step * min(1, 2 / max(np.abs(step).max(), 1e-9))
    slope = max(float(beta[0]), 1e-3) / spread
    return slope, float(beta[1]) - slope * middle


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels of up to ``size`` documents of each class, in the order of a hash of their id.

    Only rows that are not held out. Of several labels of a document the
    highest counts, of several texts the least. A text longer than
    ``SAMPLE_CHARS`` characters is no sample, nor is a row without doc_id.
    Each class is thinned by its own number of rows, so a rare one keeps all it needs.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    short = documents.filter(F.length("text") <= SAMPLE_CHARS).select("doc_id")
    known = store(known.join(short, "doc_id", "left_semi"), "labelled")
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    thinned = [known.filter((F.col("toxic") == c) & sampled(F.xxhash64("doc_id"), count.get(c, 0), size)) for c in (0, 1)]
    ids = [rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for rows in thinned]
    # 2 * size rows at most, so the broadcast has a bound.
    sample = documents.select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1])), "doc_id").filter(F.length("text") <= SAMPLE_CHARS)
    rows = sorted(sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect(), key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def scored(documents: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and n_windows of every row of ``documents``.

    Only the text decides the score; a null or empty text has one empty
    window. Repeated rows give repeated results, an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            score, count = network.document_scores(batch.column(2))
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "n_windows"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_windows long")


def without_toxic(documents: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that score below ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            score, _ = network.document_scores(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(score < threshold))

    return documents.mapInArrow(run, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labelled sample, then score all of ``documents``.

    Rows are scored one by one by their text, so repeated rows and ids give
    repeated results; a null doc_id stays null and is not held out; a null text
    is empty. Without a usable label nothing is toxic. Other columns are not looked at.
    """
    return scored(documents, train(*training_sample(documents, labels)), threshold)
