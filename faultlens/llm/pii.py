"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

Around digits and at-signs a text is cut into tokens. The field scores whole
candidate spans (their shape, digit count, check digit, borders) under four
types, and a dynamic program over at most ``REACH`` tokens for a span chooses
borders and types of a region together; of that reading the spans stay that are
certain by themselves. Long regions are read in overlapping stretches. It learns from regions whose spans the
patterns know and from rewritten copies of them (other separators, missing
country code). Pattern spans always stay; the field adds spans that touch none.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import sampled, slices

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
#: Tokens of the longest span.
REACH = 16
#: Documents of the training sample, and the characters of the longest.
SAMPLE, SAMPLE_CHARS = 600, 20_000
#: Least probability of a span over all readings of its region.
CERTAIN = 0.9
#: Tokens of a region that are read at a time, and tokens on either side that are read along.
STRETCH, BESIDE = 256, 4 * REACH

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A number is read from its first digit on and as a whole, which gives the same matches and no second try inside it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _octets(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping. Each at-sign is looked at once: before it stands the longest run of local characters."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, by kind and start; code points, end exclusive."""
    found = [("email", *x) for x in emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0]))]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


_MARK = re.compile("[0-9@]+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and at-signs: their words, and one word more at most between two of them."""
    first = last = None
    for mark in _MARK.finditer(text):
        if first is not None and not re.search(r"\s\S*\s", text[last : mark.start()]):
            last = mark.end()
            continue
        if first is not None:
            yield _widened(text, first, last)
        first, last = mark.span()
    if first is not None:
        yield _widened(text, first, last)


def _widened(text: str, first: int, last: int) -> tuple[int, int]:
    """To the borders of the words, 64 characters at most."""
    stop = max(first - 64, 0)
    while first > stop and not text[first - 1].isspace():
        first -= 1
    stop = min(last + 64, len(text))
    while last < stop and not text[last].isspace():
        last += 1
    return first, last


def _class(char: str) -> str:
    return "0" if char.isdigit() else "a" if char.isalpha() else "_" if char.isspace() else char or "$"


def span_features(text: str, before: str, after: str) -> list[str]:
    """What the field sees of a candidate span and the characters beside it."""
    digits = _digits(text)
    shape = re.sub("[0-9]+", lambda m: str(min(len(m[0]), 9)), re.sub("[^0-9\\W_]+", "a", text))[:28]
    coarse = re.sub("[0-9]", "9", re.sub("(a[.-]?)+", "a", shape))
    found = ["span", f"shape {shape}", f"coarse {coarse}", f"digits {min(len(digits), 20)}", f"letters {'a' in shape} {len(digits) > 0}"]
    found += [f"left {_class(before)}", f"right {_class(after)}", f"edges {_class(text[:1])} {_class(text[-1:])}"]
    found += [f"in {_class(before) == _class(text[:1])} {_class(after) == _class(text[-1:])}", f"dots {text.count('.')} {'a' in shape}"]
    if "@" in text:
        found += [f"at {text.count('@')}", f"mail {bool(re.fullmatch(r'[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', text))}"]
    if 13 <= len(digits) <= 19 and "a" not in shape:
        found.append(f"luhn {luhn(digits)}")
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", text):
        found.append(f"octets {_octets(text)}")
    if text[:1] in "+(":
        found.append(f"begins {text[0]}")
    return found


class Field:
    """Weights of span features and of neighbouring types."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.weights = np.zeros((len(names), OTHER + 1))
        self.steps = np.zeros((OTHER + 1, OTHER + 1))

    def candidates(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[int]]]]:
        """Token borders, and every candidate (first token, one past the last, known features)."""
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        blank = [text[a:b].isspace() for a, b in tokens]
        marked = [text[a].isdigit() or text[a] == "@" for a, _ in tokens]
        get = self.names.get
        found = []
        for i, (start, end) in enumerate(tokens):
            found.append((i, i + 1, [n for f in ("token", f"token {_class(text[start])}") if (n := get(f)) is not None]))
            seen = False
            for j in range(i + 1, min(i + REACH, len(tokens)) + 1):
                seen = seen or marked[j - 1]
                if seen and not blank[i] and not blank[j - 1]:
                    end = tokens[j - 1][1]
                    # Numbers that follow one another are told apart from single tokens by their first index.
                    features = span_features(text[start:end], text[start - 1 : start], text[end : end + 1])
                    found.append((i, -j, [n for f in features if (n := get(f)) is not None]))
        return tokens, found

    def scores(self, found: list[tuple[int, int, list[int]]]) -> np.ndarray:
        """One row of five for each candidate: four types for a span, the fifth for a token outside."""
        rows = np.full((len(found), OTHER + 1), -np.inf)
        for r, (_, end, features) in enumerate(found):
            value = self.weights[features].sum(0)
            if end > 0:
                rows[r, OTHER] = value[OTHER]
            else:
                rows[r, :OTHER] = value[:OTHER]
        return rows

    def decode(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Spans (type, start, end) of the best reading, and those whose own probability over all readings is ``CERTAIN`` at least.

        The length of the text does not count: a doubtful span takes none beside it along.
        """
        tokens, found = self.candidates(text)
        rows = self.scores(found)
        ends = np.array([abs(end) for _, end, _ in found], np.int64)
        # Candidates stand in the order of their first token: the token outside first, then spans with different ends.
        blocks = np.searchsorted(np.array([start for start, _, _ in found], np.int64), np.arange(len(tokens) + 1))
        best = np.full((len(tokens) + 1, OTHER + 1), -np.inf)
        best[0, OTHER] = 0
        ahead, behind, into = best.copy(), np.full_like(best, -np.inf), np.full_like(best, -np.inf)
        came = np.zeros((len(tokens) + 1, OTHER + 1, 2), np.int64)
        for start in range(len(tokens)):
            way = best[start][:, None] + self.steps
            from_ = way.argmax(0)
            way, into[start] = way.max(0), _log_sum(ahead[start][:, None] + self.steps)
            first, last = blocks[start], blocks[start + 1]
            for mine in (slice(first, first + 1), slice(first + 1, last)):
                to = ends[mine]
                value = way + rows[mine]
                place, kind = np.nonzero(value > best[to])
                came[to[place], kind, 0], came[to[place], kind, 1] = start, from_[kind]
                best[to] = np.maximum(best[to], value)
                ahead[to] = np.logaddexp(ahead[to], into[start] + rows[mine])
        behind[-1] = 0
        whole = np.logaddexp.reduce(ahead[-1])
        certain = []
        for start in range(len(tokens) - 1, -1, -1):
            mine = slice(blocks[start], blocks[start + 1])
            after = rows[mine] + behind[ends[mine]]
            behind[start] = _log_sum((self.steps + _log_sum(after)).T)
            sure = (into[start] + after - whole)[:, :OTHER] >= np.log(CERTAIN)
            certain += [(kind, tokens[start][0], tokens[ends[mine][place] - 1][1]) for place, kind in np.argwhere(sure).tolist()]
        spans = []
        at, kind = len(tokens), int(best[-1].argmax())
        while at:
            start, before = came[at, kind].tolist()
            if kind != OTHER:
                spans.append((kind, tokens[start][0], tokens[at - 1][1]))
            at, kind = start, before
        return spans[::-1], certain[::-1]

    def learn(self, tokens: list, found: list, spans: list[tuple[int, int, int]], rate: float) -> bool:
        """One step up the likelihood of ``spans`` among candidates; False if they do not lie on token borders."""
        begins, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        if any(a not in begins or b not in ends for _, a, b in spans):
            return False
        right = {(begins[a], -ends[b]): kind for kind, a, b in spans}
        inside = {t for a, b in right for t in range(a, -b)}
        right |= {(t, t + 1): OTHER for t in range(len(tokens)) if t not in inside}
        if not right.keys() <= {(a, b) for a, b, _ in found}:
            return False
        rows = self.scores(found)
        size = len(tokens)
        ahead = np.full((size + 1, OTHER + 1), -np.inf)
        ahead[0, OTHER] = 0
        reach = []
        for (start, end, _), row in zip(found, rows, strict=True):
            reach.append(_log_sum(ahead[start][:, None] + self.steps) + row)
            ahead[abs(end)] = np.logaddexp(ahead[abs(end)], reach[-1])
        behind = np.full((size + 1, OTHER + 1), -np.inf)
        behind[size] = 0
        whole = np.logaddexp.reduce(ahead[size])
        d_steps = np.zeros_like(self.steps)
        for (start, end, features), row, way in zip(reversed(found), rows[::-1], reversed(reach), strict=True):
            after = row + behind[abs(end)]
            behind[start] = np.logaddexp(behind[start], _log_sum((self.steps + after).T))
            d_steps -= np.exp(ahead[start][:, None] + self.steps + after - whole)
            share = -np.exp(way + behind[abs(end)] - whole)
            kind = right.get((start, end))
            if kind is not None:
                share[kind] += 1
            self.weights[features] += rate * share
        before = OTHER
        for (_, _), kind in sorted(right.items()):
            d_steps[before, kind] += 1
            before = kind
        self.steps += rate * d_steps
        return True


def _log_sum(values: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over the first axis; minus infinity where all are."""
    top = values.max(0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(values - safe).sum(0)) + safe


def _rewritten(kind: str, text: str, dice: random.Random) -> str:
    """A way to write the same thing that the patterns do not know."""
    digits = _digits(text)
    if kind == "phone" and len(digits) >= 10:
        local = digits[-10:]
        forms = ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "00" + (digits[:-10] or "1") + " {} {} {}")
        return dice.choice(forms).format(local[:3], local[3:6], local[6:])
    if kind == "card":
        return dice.choice(".,/_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "email":
        return text.replace("@", dice.choice((" @ ", " @", "@ ")))
    return text


def _lookalikes(dice: random.Random) -> str:
    """Numbers that are no personal data."""
    n = lambda k: str(dice.randrange(10 ** (k - 1), 10**k))
    forms = (f"20{n(2)}-{n(2)}-{n(2)}", f"{n(2)}:{n(2)}:{n(2)}", f"{n(1)}.{n(5)}", f"{n(1)},{n(3)},{n(3)}", f"v{n(1)}.{n(1)}.{n(2)}", n(dice.randrange(1, 13)), f"{n(3)}-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{n(2)}.{n(2)}.{n(4)}", f"{n(4)}/{n(2)}", f"@{dice.choice(('word', 'all', 'here'))}", f"{n(3)} {n(3)} {n(2)}", f"{n(3)}.{n(3)}.{n(3)}.{n(3)[:1]}00{n(1)}")
    return dice.choice(forms)


def train(texts: list[str], rounds: int = 3, seed: int = 11) -> Field:
    """A field from the regions of some texts, labelled by the patterns, with rewritten copies and lookalikes."""
    dice = random.Random(seed)
    lessons: list[tuple[str, list[tuple[int, int, int]]]] = []
    for text in texts:
        spans = base_spans(text)
        for first, last in regions(text):
            inside = sorted((a - first, b - first, kind) for kind, a, b in spans if first <= a and b <= last)
            if last - first > 300 or any(b > c for (_, b, _), (c, _, _) in zip(inside, inside[1:], strict=False)):
                continue
            lessons.append((text[first:last], [(KINDS.index(kind), a, b) for a, b, kind in inside]))
            changed, moved, at = "", [], first
            for a, b, kind in inside:
                changed += text[at : first + a]
                form = _rewritten(kind, text[first + a : first + b], dice)
                moved.append((KINDS.index(kind), len(changed), len(changed) + len(form)))
                changed, at = changed + form, first + b
            if moved:
                lessons.append((changed + text[at:last], moved))
            fake = _lookalikes(dice)
            lessons.append((f"{fake} {dice.choice(('and', 'of', ''))} {_lookalikes(dice)}", []))
    dice.shuffle(lessons)
    names: dict[str, int] = {}
    collect = Field(_Collecting(names))
    known = [(*collect.candidates(text), spans) for text, spans in lessons[: 4 * SAMPLE]]
    field = Field(names)
    for turn in range(rounds):
        dice.shuffle(known)
        for tokens, found, spans in known:
            field.learn(tokens, found, spans, 0.2 / (1 + turn))
    return field


class _Collecting(dict):
    """Gives every new feature the next number."""

    def __init__(self, names: dict[str, int]):
        super().__init__()
        self.known = names

    def get(self, name: str, _: object = None) -> int:
        return self.known.setdefault(name, len(self.known))


def stretches(text: str, first: int, last: int) -> Iterator[tuple[int, int, int, int]]:
    """First and last character to read, and of the part that counts; a region of few tokens is read as a whole.

    Spans reach ``REACH`` tokens, so those that begin in the part lie in what is read, with all that bears on them.
    """
    starts = np.fromiter((m.start() for m in _TOKEN.finditer(text, first, last)), np.int64)
    count = len(starts)
    if count <= STRETCH + 2 * BESIDE:
        yield first, last, first, last
        return
    place = lambda k: int(starts[k]) if k < count else last
    for k in range(0, count, STRETCH):
        yield place(max(0, k - BESIDE)), place(k + STRETCH + BESIDE), place(k), place(k + STRETCH)


def added_spans(text: str, base: list[tuple[str, int, int]], decode) -> list[tuple[str, int, int]]:
    """The spans of the field's best reading that are certain of themselves and that no pattern span touches."""
    found = []
    for region in regions(text):
        for first, last, begin, end in stretches(text, *region):
            best, certain = decode(text[first:last])
            sure = set(certain)
            found += [(KINDS[kind], first + a, first + b) for kind, a, b in best if (kind, a, b) in sure and begin <= first + a < end]
    places = sorted((a, b) for _, a, b in base)
    ends = np.maximum.accumulate([b for _, b in places]) if places else np.zeros(0, np.int64)
    begins = np.array([a for a, _ in places], np.int64)
    # Pattern spans that begin before its end: one of them touches it if any reaches beyond its start.
    return [(k, a, b) for k, a, b in found if not (n := int(np.searchsorted(begins, b))) or ends[n - 1] <= a]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def training_texts(documents: DataFrame, size: int = SAMPLE) -> list[str]:
    """Up to ``size`` distinct texts with a digit or at-sign, none above ``SAMPLE_CHARS`` characters, in the order of their hash."""
    rows = documents.select("text", F.xxhash64("text").alias("hash")).filter(
        (F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]") & sampled(F.col("hash"), documents.count(), size)
    )
    # Only hashes are put in order; the texts of the chosen ones follow, ``size`` at most.
    chosen = rows.select("hash").distinct().orderBy("hash").limit(size)
    texts = rows.join(F.broadcast(chosen), "hash", "left_semi").dropDuplicates(["hash"])
    return [r["text"] for r in sorted(texts.collect(), key=lambda r: r["hash"])]


def _all_spans(text: str, decode) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, decode), key=lambda s: (KINDS.index(s[0]), s[1]))


def found_in(documents: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of every row of ``documents``.

    Counts and hash are those of the pattern spans; ``spans`` has all. A null
    text is empty and has none. Repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = lru_cache(maxsize=20_000)(field.decode)
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = _all_spans(text or "", decode)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def personal_data(documents: DataFrame) -> DataFrame:
    """Train on a bounded sample of ``documents``, then search all of them.

    Every row is searched by itself: repeated rows and ids give repeated
    results, a null doc_id stays null, a null text is empty. Other columns are
    not looked at; an empty table gives no rows.
    """
    return found_in(documents, train(training_texts(documents)))


def redacted(documents: DataFrame, field: Field) -> DataFrame:
    """``documents`` with every span in ``text`` replaced by its kind, as ``<EMAIL>``; all other columns as they are. A null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = lru_cache(maxsize=20_000)(field.decode)
        for batch in slices(batches, "text"):
            place = batch.schema.get_field_index("text")
            texts = []
            for text in batch.column(place).to_pylist():
                parts, at = [], 0
                for kind, first, last in sorted(_all_spans(text, decode)[1] if text else [], key=lambda s: (s[1], -s[2])):
                    # Of overlapping spans the first one's mark stands for all.
                    if first >= at:
                        parts += (text[at:first], f"<{kind.upper()}>")
                    at = max(at, last)
                texts.append("".join((*parts, text[at:])) if text else text)
            columns = [pa.array(texts, f.type) if i == place else batch.column(i) for i, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(run, documents.schema)
