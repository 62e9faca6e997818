import random
import textwrap

import pytest

from faultlens.llm import licenses
from tests.llm import samples


def brute(text):
    """Licences of a text, by looking for every known sentence with another cut: all words in a row.

    A sentence inside a longer known one does not count.
    """
    words = licenses.normalised(text).split(" ")
    there = {}
    for name, sentence in licenses.SENTENCES.items():
        sought = licenses.normalised(sentence).split(" ")
        there[name] = [(k, k + len(sought)) for k in range(len(words)) if words[k : k + len(sought)] == sought]
    spans = [span for found in there.values() for span in found]
    alone = {name for name, found in there.items() if any(not any(c <= a and b <= d and d - c > b - a for c, d in spans) for a, b in found)}
    return {licence for licence, rule in licenses.RULES if len(rule) == 1 and rule[0] in alone}


def test_single_sentences_between_prose(spark):
    dice = random.Random(7)
    singles = [(licence, rule[0]) for licence, rule in licenses.RULES if len(rule) == 1]
    texts, want = [], []
    for k in range(60):
        licence, name = dice.choice(singles)
        place = dice.choice(("{0}\n{1}", "{1}\n{0}", "{1}\n{0}\n{1}", "{1}. {0} {1}"))
        prose = samples.sentence(dice, 20).capitalize() + "."
        texts.append(place.format(licenses.SENTENCES[name], prose) if k % 3 else prose)
        want.append({licence} if k % 3 else set())
    rows = {r.doc_id: r for r in licenses.licensed(samples.plain(spark, texts)).collect()}
    for i, text in enumerate(texts):
        assert set(filter(None, rows[i].licences.split(","))) == want[i] == brute(text), text
        assert all(text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in rows[i].spans.split(",") if s)


@pytest.mark.parametrize("gap", ["", "Some words.\n", "One. Two. Three. Four. Five.\n"])
def test_sequences(gap):
    rule = dict(licenses.RULES)["BSD-2-Clause"]
    assert rule[0] == "bsd-grant"
    text = ("\n" + gap).join(licenses.SENTENCES[n].upper().replace(" ", "  ") for n in rule)
    found = [m[0] for m in licenses.matches(licenses.identified(text))]
    assert found == ([] if "Five" in gap else ["BSD-2-Clause"])


def test_longer_rule_wins_and_order_counts():
    names = ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")
    text = "\n".join(licenses.SENTENCES[n] for n in names)
    assert [m[0] for m in licenses.matches(licenses.identified(text))] == ["BSD-3-Clause"]
    turned = "\n".join(licenses.SENTENCES[n] for n in reversed(names))
    assert licenses.matches(licenses.identified(turned)) == []


def test_awkward_rows(spark):
    rows = licenses.licensed(samples.awkward(spark)).collect()
    assert len(rows) == len(samples.awkward_rows())
    assert all((r.licences, r.n_matches) == ("", 0) for r in rows)
    assert licenses.licensed(samples.empty(spark)).count() == 0


def test_known_sentences_differ():
    assert len({licenses.normalised(t) for t in licenses.SENTENCES.values()}) == len(licenses.SENTENCES)
    assert {n for _, rule in licenses.RULES for n in rule} <= set(licenses.SENTENCES)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
"""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


@pytest.mark.parametrize(
    ("licence", "text"),
    [("MIT", MIT), ("GPL-3.0-or-later", GPL.format(":", ",", 3)), ("GPL-2.0-or-later", GPL.format(";", ";", 2)), ("BSD-3-Clause", BSD)],
)
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_texts(licence, text, mark):
    text = "Copyright (c) 2020 Somebody\n\n" + text + "\nint main;\n"
    text = "".join(mark + line for line in text.splitlines(keepends=True))
    found = licenses.matches(licenses.identified(text))
    assert [m[0] for m in found] == [licence]
    assert "\n" in text[found[0][1] : found[0][2]]


@pytest.mark.parametrize("others", [2, 3])
def test_gap_after_a_wrapped_sentence(others):
    """Only what stands between two sentences counts, however many lines each takes."""
    rule = dict(licenses.RULES)["BSD-2-Clause"]
    lines = [textwrap.fill(licenses.SENTENCES[n], 60) for n in rule]
    text = ("\n" + "Some words.\n" * others).join(lines)
    assert [m[0] for m in licenses.matches(licenses.identified(text))] == (["BSD-2-Clause"] if others == 2 else [])


@pytest.mark.parametrize("width", [20, 40, 56])
@pytest.mark.parametrize("between", ["\n", "\n *\n"])
def test_narrow_blocks(width, between):
    """A sentence of any number of lines, also with marks alone on a line between them, is one."""
    for name, sentence in licenses.SENTENCES.items():
        text = between.join(textwrap.wrap(sentence, width, break_long_words=False))
        whole = f"Words.\n{text}\nWords."
        assert [(k[2], whole[k[3] : k[4]]) for k in licenses.identified(whole)] == [(name, text)]
    text = between.join(line for part in MIT.split("\n\n") for line in textwrap.wrap(part, width))
    assert [m[0] for m in licenses.matches(licenses.identified(text))] == ["MIT"]


def _licences(text):
    return {m[0] for m in licenses.matches(licenses.identified(text))} | {m[0] for m in licenses.tagged(text)}


FULL = [(licence, rule) for licence, rule in licenses.RULES if len(rule) > 1 or len(licenses.SENTENCES[rule[0]]) > 60]


@pytest.mark.parametrize("form", ["plain", "narrow", "// ", "# ", " * ", "-- ", ";; "])
def test_notices_wrapped_and_commented(form):
    """Every text as it stands, in narrow lines, and in the comments of several languages."""
    assert len({licence for licence, _ in licenses.RULES} | set(licenses.NAMES)) >= 40
    for licence, rule in FULL:
        text = "\n\n".join(licenses.SENTENCES[name] for name in rule)
        if form != "plain":
            prefix = "" if form == "narrow" else form
            lines = textwrap.wrap(text, 44 if form == "narrow" else 70)
            text = "Copyright (c) 2020 Somebody\n" + "\n".join(prefix + line for line in lines)
        assert licence in _licences(text), (licence, form)


def test_named_licences():
    for licence, names in licenses.NAMES.items():
        for name in names:
            for notice in licenses.NOTICES:
                text = f"Some words before.\n{notice.format(name)}\nAnd some after."
                found = _licences(text)
                assert found and (licence in found or name in ("GNU General Public License, version 3",)), (text, found)


@pytest.mark.parametrize(
    ("tag", "want"),
    [
        ("// SPDX-License-Identifier: MIT", {"MIT"}),
        ("# SPDX-License-Identifier: Apache-2.0 OR MIT", {"Apache-2.0", "MIT"}),
        ("/* SPDX-License-Identifier: (GPL-2.0+ AND BSD-3-Clause) */", {"GPL-2.0-or-later", "BSD-3-Clause"}),
        ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note", {"GPL-2.0-only"}),
        ("spdx-license-identifier: lgpl-2.1-or-later.", {"LGPL-2.1-or-later"}),
        ("SPDX-License-Identifier: Unknown-1.0", set()),
        ("License-Identifier: MIT", set()),
    ],
)
def test_tags(spark, tag, want):
    text = f"#!/bin/sh\n{tag}\nrest of the text"
    assert _licences(text) == want
    row = licenses.licensed(samples.plain(spark, [text])).first()
    assert set(filter(None, row.licences.split(","))) == want and row.n_matches == len(want)
    for span in filter(None, row.spans.split(",")):
        licence, first, last = span.split(":")
        assert text[int(first) : int(last)].lower().rstrip("+").endswith(licence.lower().split("-")[0]) or "-" in licence
