"""Licence recognition by sentences.

A text is cut into sentences, each normalised (lower case, words only) and
looked up among the sentences of known licence texts and the notices that name
a licence. A licence rule is an ordered list of sentence identifiers; it holds
where its sentences follow one another with at most ``GAP`` other sentences
between neighbours. Tags (``SPDX-License-Identifier``) name licences directly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import slices

#: Other sentences allowed between two of a rule.
GAP = 2

# Sentences of public licence texts and notices, as they stand there.
SENTENCES = {
    "apache-grant": "Licensed under the Apache License, Version 2.0.",
    "apache-grant-the": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl21-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "epl1": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "wtfpl": "You just DO WHAT THE FUCK YOU WANT TO.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl11": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "cddl": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "beerware": "As long as you retain this notice you can do whatever you want with this stuff.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
# Licence identifiers as tags have them, and the names that notices use.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License", "MIT license (MIT)"),
    "MIT-0": ("MIT No Attribution License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License",),
    "0BSD": ("Zero-Clause BSD License",),
    "ISC": ("ISC License",),
    "GPL-2.0-only": ("GNU General Public License v2.0 only",),
    "GPL-2.0-or-later": ("GNU General Public License v2.0 or later",),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPLv3"),
    "GPL-3.0-or-later": ("GNU General Public License v3.0 or later",),
    "LGPL-2.1-only": ("GNU Lesser General Public License v2.1",),
    "LGPL-2.1-or-later": ("GNU Lesser General Public License v2.1 or later",),
    "LGPL-3.0-only": ("GNU Lesser General Public License v3.0",),
    "LGPL-3.0-or-later": ("GNU Lesser General Public License v3.0 or later",),
    "AGPL-3.0-only": ("GNU Affero General Public License v3.0",),
    "AGPL-3.0-or-later": ("GNU Affero General Public License v3.0 or later",),
    "MPL-1.1": ("Mozilla Public License 1.1",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0",),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "EUPL-1.2": ("European Union Public Licence 1.2",),
    "CDDL-1.0": ("Common Development and Distribution License 1.0",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License 1.0",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "OFL-1.1": ("SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL",),
    "PostgreSQL": ("PostgreSQL License",),
    "PSF-2.0": ("Python Software Foundation License 2.0",),
    "PHP-3.01": ("PHP License 3.01",),
    "Ruby": ("Ruby License",),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
    "UPL-1.0": ("Universal Permissive License v1.0",),
    "AFL-3.0": ("Academic Free License v3.0",),
    "OSL-3.0": ("Open Software License 3.0",),
    "MS-PL": ("Microsoft Public License",),
    "X11": ("X11 License",),
    "Beerware": ("Beerware License",),
    "CECILL-2.1": ("CeCILL 2.1",),
    "BlueOak-1.0.0": ("Blue Oak Model License 1.0.0",),
    "ODbL-1.0": ("Open Database License 1.0",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero v1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
}
#: Sentences that name a licence; all names go through them.
NOTICES = ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This project is licensed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.")

# Rules by licence identifier; the longer of two that begin alike comes first.
RULES = (
    ("Apache-2.0", ("apache-grant-the", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-grant-the",)),
    ("Apache-2.0", ("apache-grant",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-advert")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("MIT-0", ("mit0-grant",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl21-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope", "lgpl-see")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-see")),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("EPL-1.0", ("epl1",)),
    ("EPL-2.0", ("epl2",)),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-notice",)),
    ("OFL-1.1", ("ofl",)),
    ("WTFPL", ("wtfpl",)),
    ("MPL-1.1", ("mpl11",)),
    ("CDDL-1.0", ("cddl",)),
    ("PostgreSQL", ("postgresql",)),
    ("Beerware", ("beerware",)),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl2", "mpl2-copy")),
    ("MPL-2.0", ("mpl2",)),
    ("Unlicense", ("unlicense", "unlicense-anyone")),
    ("Unlicense", ("unlicense",)),
)
#: Tags of earlier versions of the list, by what they are now.
_OLD_TAGS = {f"{name}-{version}{old}": f"{name}-{version}{new}" for name, version in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")) for old, new in (("", "-only"), ("+", "-or-later"))}
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)", re.IGNORECASE)

#: A sentence ends at a line end that begins a new paragraph or list item, or at a stop before white space and a new beginning.
_CUT = re.compile(r"\n+|(?<=[.!?:;])[ \t]+(?=[\"'(A-Z0-9])")
_WORD = re.compile(r"[^\W_]+")


def normalised(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


@lru_cache(maxsize=1)
def _known() -> dict[str, str]:
    """Identifier of every normalised sentence, and of the parts into which the cut takes one.

    A notice that names a licence has the licence for its identifier; sentences of the texts come first.
    """
    found = {normalised(notice.format(name)): f"name:{licence}" for licence, names in NAMES.items() for name in names for notice in NOTICES}
    return found | {normalised(text): name for name, text in SENTENCES.items()}


@lru_cache(maxsize=1)
def _rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    return (*RULES, *((licence, (f"name:{licence}",)) for licence in NAMES))


def tagged(text: str) -> list[tuple[str, int, int]]:
    """(licence, first, last) of the known licences in tags; an expression of several names each of them."""
    known = {name.lower(): name for name in NAMES} | {old.lower(): new for old, new in _OLD_TAGS.items()}
    found = []
    for tag in _TAG.finditer(text):
        for word in re.finditer(r"[A-Za-z0-9.+-]+", tag[1]):
            if (licence := known.get(word[0].rstrip(".").lower())) is not None:
                found.append((licence, tag.start() if not found or found[-1][1] != tag.start() else tag.start(1) + word.start(), tag.start(1) + word.end()))
    return found


def sentences(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for cut in _CUT.finditer(text):
        if cut.start() > at:
            yield at, cut.start()
        at = cut.end()
    if at < len(text):
        yield at, len(text)


def identified(text: str) -> list[tuple[int, int, str, int, int]]:
    """(number of its first part, of its last part, identifier, first, last) of the known sentences.

    A known sentence may be cut by line ends or inner stops, so parts in a row
    are also tried as one, as long as some known sentence begins with them; of
    several the longest counts. Parts without words are not looked at.
    """
    known = _known()
    parts = [(a, b, words) for a, b in sentences(text) if (words := normalised(text[a:b]))]
    begins = _beginnings()
    found, i = [], 0
    while i < len(parts):
        joined, last = "", None
        for j in range(i, len(parts)):
            joined = f"{joined} {parts[j][2]}".strip()
            if joined in known:
                last = (j, known[joined])
            if not any(b.startswith(joined) for b in begins.get(joined[:8], ())):
                break
        if last:
            found.append((i, *last, parts[i][0], parts[last[0]][1]))
            i = last[0]
        i += 1
    return found


@lru_cache(maxsize=1)
def _beginnings() -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for text in _known():
        for k in range(1, 9):
            found.setdefault(text[:k], []).append(text)
    return found


def matches(known: list[tuple[int, int, str, int, int]], gap: int = GAP) -> list[tuple[str, int, int]]:
    """(licence, first, last) in text order; each sentence serves the first rule that holds with it."""
    used: set[int] = set()
    found = []
    there = {k[2] for k in known}
    for licence, rule in _rules():
        if rule[0] not in there:
            continue
        for start in range(len(known)):
            chain: list[int] = []
            for at in range(start, len(known)):
                # From the end of one sentence to the start of the next: the parts of a wrapped one are no other sentences.
                if chain and known[at][0] - known[chain[-1]][1] > gap + 1:
                    break
                if at not in used and known[at][2] == rule[len(chain)]:
                    chain.append(at)
                    if len(chain) == len(rule):
                        break
                if not chain:
                    break
            if len(chain) == len(rule):
                used.update(chain)
                found.append((licence, known[chain[0]][3], known[chain[-1]][4]))
    return sorted(found, key=lambda m: (m[1], m[0]))


def licensed(documents: DataFrame) -> DataFrame:
    """doc_id, licences (identifiers in order, comma-joined), n_sentences (known ones), n_matches and spans of every row of ``documents``.

    ``spans`` are licence:first:last in code points, end exclusive. A null or
    empty text has none of them. Repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                known = identified(text or "")
                tags = tagged(text or "")
                hits = sorted(matches(known) + tags, key=lambda m: (m[1], m[0]))
                spans = ",".join(f"{name}:{a}:{b}" for name, a, b in hits)
                rows.append((",".join(sorted({h[0] for h in hits})), len(known) + len(tags), len(hits), spans))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "licences", "n_sentences", "n_matches", "spans"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, licences string, n_sentences long, n_matches long, spans string")
