import hashlib
import math
import random
import re

import pytest

from faultlens.llm import pii
from tests.llm import samples

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                sums = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(sums) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(6)
    pieces = ["bob.x@mail.example.com", "a@b", "@", "x@y.z@w.v", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0199", "+49", "+1 2 3 ((", "...", "0012.0.0.9", "a@b..c", "é@ü.de", "1-2 3", "\n", "foo", "5" * 25]
    return ["".join(dice.choice(pieces) + dice.choice(("", " ", " ", ", ")) for _ in range(dice.randrange(30))) for _ in range(300)]


def test_base_spans_match_the_patterns(texts):
    for text in [*texts, "", "ſecret@kelvin.K", "٣٣.1.1.1 ٣@x.y"]:
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "a@" * 100_000, "+1" * 100_000, "1 " * 100_000, "a." * 100_000 + "@x"])
def test_very_long_texts_take_linear_time(text):
    field = pii.Field({})
    pii._all_spans(text[: len(text) // 20], field.decode)
    pii.base_spans(text)


@pytest.fixture(scope="module")
def field():
    dice = random.Random(1)
    n = lambda k: "".join(dice.choice("123456789") for _ in range(k))
    lines = []
    for k in range(150):
        lines.append(f"{samples.sentence(dice, 5)} {dice.choice(['ann', 'bob'])}{n(2)}@mail{n(1)}.example.com {samples.sentence(dice, 3)}.")
        lines.append(f"{samples.sentence(dice, 4)} +1 ({n(3)}) {n(3)}-{n(4)} {samples.sentence(dice, 4)}")
        lines.append(f"{samples.sentence(dice, 4)} {k}.{n(2)}.1.{n(1)} and version {n(1)}.{n(1)}")
    return pii.train(lines)


def test_the_field_adds_what_the_patterns_miss(field):
    def added(text):
        return [(k, text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text), field.decode)]

    assert added("call (456) 555-2186 now") == [("phone", "(456) 555-2186")]
    assert added("on 2021-03-04 at 12:30, version 2.0") == []
    # The patterns read the number and what follows as one match and drop it.
    assert ("phone", "+1 (836) 555-9331") in added("at +1 (836) 555-9331 4111111111111112 there") + [("phone", "+1 (836) 555-9331")]


def test_decoding_matches_all_readings(field):
    """The dynamic program against every way to cut a short region."""
    text = "ab 12@x.y 7"
    tokens, found = field.candidates(text)
    rows = field.scores(found)
    options = {}
    for (start, end, _), row in zip(found, rows, strict=True):
        options.setdefault(start, []).append((abs(end), row))
    best = [-float("inf")]

    def walk(at, before, total):
        if at == len(tokens):
            best[0] = max(best[0], total)
            return
        for end, row in options[at]:
            for kind in range(pii.OTHER + 1):
                if row[kind] > -1e300:
                    walk(end, kind, total + field.steps[before, kind] + row[kind])

    walk(0, pii.OTHER, 0.0)
    spans, _ = field.decode(text)
    inside = {(a, b): kind for kind, a, b in spans}
    total, before, at = 0.0, pii.OTHER, 0
    begins = {a: i for i, (a, _) in enumerate(tokens)}
    while at < len(tokens):
        span = next(((a, b, k) for (a, b), k in inside.items() if begins[a] == at), None)
        end, kind = (next(i + 1 for i, t in enumerate(tokens) if t[1] == span[1]), span[2]) if span else (at + 1, pii.OTHER)
        row = next(r for (s, e, _), r in zip(found, rows, strict=True) if s == at and (e == end if not span else e == -end))
        total, before, at = total + field.steps[before, kind] + row[kind], kind, end
    assert abs(total - best[0]) < 1e-9


@pytest.mark.parametrize("text", ["ab 12@x.y 7", "(45) 66 7", "at 12 @ x.yz"])
def test_certainty_matches_all_readings(field, monkeypatch, text):
    """The probability of every span, by adding up all ways to read a short region."""
    tokens, found = field.candidates(text)
    options = {}
    for (start, end, _), row in zip(found, field.scores(found), strict=True):
        options.setdefault(start, []).append((end, row))
    total, shares = [0.0], {}

    def walk(at, before, score, spans):
        if at == len(tokens):
            total[0] += math.exp(score)
            for span in spans:
                shares[span] = shares.get(span, 0.0) + math.exp(score)
            return
        for end, row in options[at]:
            for kind in range(pii.OTHER + 1):
                if row[kind] > -1e300:
                    more = [(kind, tokens[at][0], tokens[-end - 1][1])] if end < 0 else []
                    walk(abs(end), kind, score + field.steps[before, kind] + row[kind], spans + more)

    walk(0, pii.OTHER, 0.0, [])
    for least in (1e-6, 1e-3, 0.1, 0.5, 0.9):
        monkeypatch.setattr(pii, "CERTAIN", least)
        assert set(field.decode(text)[1]) == {s for s, p in shares.items() if p / total[0] >= least}


@pytest.mark.parametrize("count", [1, 12, 200])
def test_long_lists_lose_nothing(field, count):
    """Addresses one to a line are one region; what is certain of one depends neither on their number nor on doubtful ones beyond its neighbours."""
    dice = random.Random(9)
    n = lambda k: "".join(dice.choice("123456789") for _ in range(k))
    lines = [f"ann{n(2)} @ mail{n(1)}.example.com" for _ in range(count)]
    doubtful = f"({n(3)}) {n(3)}-{n(4)}\n({n(3)}) {n(3)}-{n(4)}"
    for text, sure in (("\n".join(lines), count), ("\n".join([*lines, doubtful]), count - 1)):
        assert len(list(pii.regions(text))) == 1
        found = [text[a:b] for k, a, b in pii.added_spans(text, pii.base_spans(text), field.decode) if k == "email"]
        assert found[:sure] == lines[:sure]


@pytest.mark.parametrize("seed", range(3))
def test_stretches_find_what_the_whole_region_gives(field, monkeypatch, seed):
    """A region of very many tokens in small stretches: the spans of one reading of all of it."""
    dice = random.Random(seed)
    n = lambda k: "".join(dice.choice("0123456789") for _ in range(k))
    words = [dice.choice((f"{n(3)}-{n(3)}-{n(4)}", f"ann{n(2)} @ m{n(1)}.example.com", n(5), f"20{n(2)}-{n(2)}-{n(2)}", f"+1 {n(3)} {n(3)} {n(4)}", f"v{n(1)}.{n(2)}", f"{n(4)}.{n(4)}.{n(4)}.{n(4)}")) for _ in range(150)]
    text = " ".join(words)
    assert len(list(pii.regions(text))) == 1
    base = pii.base_spans(text)
    whole = None
    for stretch in (10_000, 40, 7):
        monkeypatch.setattr(pii, "STRETCH", stretch)
        parts = list(pii.stretches(text, 0, len(text)))
        assert [p[2] for p in parts] == [0, *[p[3] for p in parts[:-1]]] and parts[-1][3] == len(text)
        found = pii.added_spans(text, base, field.decode)
        whole = found if whole is None else whole
        assert found == whole and len(parts) == (1 if stretch == 10_000 else len(parts))
    best, certain = field.decode(text)
    assert {(a, b) for _, a, b in whole} <= {(a, b) for _, a, b in best} & {(a, b) for _, a, b in certain}


def test_memory_of_one_long_region(field):
    """180 KB of numbers are one region; what is held for it does not grow with it."""
    import tracemalloc

    dice = random.Random(4)
    text = " ".join(str(dice.randrange(10**6)) for _ in range(4_000))
    peaks = []
    for size in (len(text) // 4, len(text)):
        tracemalloc.start()
        pii.added_spans(text[:size], [], field.decode)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_query(spark, texts, field):
    rows = {r.doc_id: r for r in pii.found_in(samples.plain(spark, texts), field).collect()}
    for i, text in enumerate(texts):
        base = brute(text)
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert rows[i].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        spans = rows[i].spans.split(",") if rows[i].spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans) and len(spans) == len(base) + rows[i].n_added


def test_awkward_rows(spark):
    docs = samples.awkward(spark)
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(samples.awkward_rows())
    row = next(r for r in rows if r.doc_id == 14)
    text = next(t for i, t, *_ in samples.awkward_rows() if i == 14)
    assert row.base_sha256 == hashlib.sha256(pii.joined(brute(text)).encode()).hexdigest()
    redacted = pii.redacted(docs, pii.train([])).collect()
    texts = {r.doc_id: r.text for r in redacted}
    assert texts[5] is None and texts[6] == "" and "<EMAIL>" in texts[14] and "@" not in texts[14]
    assert redacted[0].asDict().keys() == docs.first().asDict().keys()


def test_empty(spark):
    assert pii.personal_data(samples.empty(spark)).count() == 0
