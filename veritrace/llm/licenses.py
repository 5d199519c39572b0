"""License scans by sentence rules.

A text is cut at ends of sentences and of lines; parts are normalised (lower case, letters
and digits only, single spaces) and looked up among known licence sentences, alone and
joined to the parts that follow while the words go on as in a known sentence, so that
wrapped lines count as the sentence they are. A known sentence may have one slot, such as a
holder's name, that up to SLOT words fill. The identifiers in text order are matched
against ordered rules: a rule is a sequence of identifiers, found with at most GAP unknown
sentences between two of them; an earlier rule takes its sentences first.

Odd inputs. Null and empty texts have no licence. Whole texts are scanned, in time that is
linear in them; a text without any of the key words that every known sentence has is passed
over. Of two known sentences that begin at one place the longer counts; matches of equal
rules are taken from the first sentence on and never share one. Repeated rows get a row
each, an empty table gives an empty one, extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

GAP, SLOT = 3, 12

# Sentences of public licence texts; {} is a version, * a slot.
_TEXTS: dict[str, list[str]] = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD-HEAD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-SOURCE": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BSD-BINARY": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-AD": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "BSD-NAME": ["Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD-AS-IS": ["THIS SOFTWARE IS PROVIDED BY * \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "BSD-LIABLE": ["IN NO EVENT SHALL * BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "APACHE-HEAD": ["Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "APACHE-FILE": ["you may not use this file except in compliance with the License."],
    "APACHE-COPY": ["You may obtain a copy of the License at"],
    "APACHE-AS-IS": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "APACHE-SEE": ["See the License for the specific language governing permissions and limitations under the License."],
    "APACHE-TERMS": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "APACHE-GRANT": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
    "MPL-FORM": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "MPL-COPY": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "GPL-FREE": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.",
        "* is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.",
    ],
    "LGPL-FREE": ["* is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."],
    "AGPL-FREE": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."],
    "GPL-HOPE": ["This * is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "GPL-SEE": ["See the GNU General Public License for more details."],
    "LGPL-SEE": ["See the GNU Lesser General Public License for more details."],
    "AGPL-SEE": ["See the GNU Affero General Public License for more details."],
    "UNLICENSE": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "ZLIB": ["This software is provided 'as-is', without any express or implied warranty.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BOOST": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "IS-MIT": ["The code is MIT licensed.", "* is MIT licensed.", "* is licensed under the MIT license."],
}
#: Versions that a sentence with {} is known in.
_VERSIONS = {"GPL-FREE": ("2", "3"), "LGPL-FREE": ("2.1", "3"), "AGPL-FREE": ("3",)}

# SPDX identifiers and the names by which notices call them.
_NAMES: dict[str, list[str]] = {
    "MIT": ["the MIT License", "the MIT licence", "MIT License", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the BSD License", "BSD-3-Clause"],
    "ISC": ["the ISC License", "ISC"],
    "MPL-2.0": ["the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "LGPL-2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPL-3.0"],
    "CC0-1.0": ["CC0 1.0", "CC0", "Creative Commons Zero 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
}
_OPENINGS = ["Licensed under", "This work is licensed under", "This file is licensed under", "This software is licensed under", "This project is licensed under", "Released under", "This work is released under", "This software is released under", "Distributed under", "This software is distributed under", "Available under", "Published under", "License:", "SPDX-License-Identifier:"]
#: Every known sentence has one of these.
_KEYS = ("licen", "permission", "redistribut", "warrant", "liab", "public domain", "free to copy", "advertising materials", "mozilla", "terms and conditions", "released under", "distributed under", "available under", "published under")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n+")
_PLAIN = re.compile(r"[^a-z0-9]+")


def normalised(sentence: str) -> str:
    return _PLAIN.sub(" ", sentence.lower()).strip()


@dataclass(frozen=True)
class Rule:
    licence: str
    sequence: tuple[str, ...]


@dataclass
class Rules:
    #: normalised sentence -> identifier
    sentences: dict[str, str] = field(default_factory=dict)
    #: normalised words before and after a slot -> identifier
    slotted: dict[tuple[str, str], str] = field(default_factory=dict)
    #: in order of precedence
    rules: list[Rule] = field(default_factory=list)

    def add(self, sentence: str, name: str) -> None:
        if "*" in sentence:
            self.slotted.setdefault(tuple(normalised(x) for x in sentence.split("*")), name)
        else:
            self.sentences.setdefault(normalised(sentence), name)

    @cached_property
    def openings(self) -> frozenset[str]:
        """The first words of every known sentence (up to its slot), at every length."""
        known = [*self.sentences, *(x for x, _ in self.slotted)]
        return frozenset(" ".join(words[: n + 1]) for words in map(str.split, known) for n in range(len(words)))

    @cached_property
    def _slots(self) -> list[tuple[str, str, int, str]]:
        return [(a and a + " ", " " + b, len(a.split()) + len(b.split()) + SLOT, name) for (a, b), name in self.slotted.items()]

    def known(self, joined: str) -> tuple[str | None, bool]:
        """The identifier of these words, if they are a known sentence, and whether more words may make them one."""
        name, more = self.sentences.get(joined), joined in self.openings
        for before, after, most, slotted in self._slots:
            if joined.startswith(before):
                words = joined.count(" ") + 1
                if words < most:
                    # without words before the slot, those after it must have begun in time
                    more = more or bool(before) or words <= SLOT or after[: 1 + after.find(" ", 1)] in joined
                if name is None and words <= most and joined.endswith(after) and len(joined) > len(before) + len(after):
                    name = slotted
        return name, more


@lru_cache(maxsize=1)
def default_rules() -> Rules:
    out = Rules()
    for name, lines in _TEXTS.items():
        one = len({"{}" in x for x in lines}) == 1 and name in ("GPL-FREE", "IS-MIT")  # its lines are spellings of one sentence
        for k, line in enumerate(lines, 1):
            for version in _VERSIONS.get(name, ("",)):
                out.add(line.format(version), f"{name}{version}/{1 if one else k}")
    for licence, names in _NAMES.items():
        for opening in _OPENINGS:
            for name in names:
                for end in ("", " or any later version", " or later"):
                    out.add(f"{opening} {name}{end}", f"{licence}/notice")
    bsd = ("BSD-HEAD/1", "BSD-SOURCE/1", "BSD-BINARY/1")
    as_is = ("BSD-AS-IS/1", "BSD-LIABLE/1")
    gpl = [(f"{kind}-{v}" + ".0" * ("." not in v), f"{kind}-FREE{v}/1", f"{kind}-SEE/1") for kind in ("GPL", "LGPL", "AGPL") for v in _VERSIONS[f"{kind}-FREE"]]
    out.rules = [
        Rule("MIT", ("MIT/1", "MIT/2", "MIT/3", "MIT/4")),
        Rule("MIT", ("MIT/1", "MIT/2", "MIT/3")),
        Rule("ISC", ("ISC/1", "ISC/2", "ISC/3")),
        Rule("BSD-4-Clause", (*bsd, "BSD-AD/1", "BSD-NAME/1", *as_is)),
        Rule("BSD-3-Clause", (*bsd, "BSD-NAME/1", *as_is)),
        Rule("BSD-2-Clause", (*bsd, *as_is)),
        Rule("BSD-3-Clause", (*bsd, "BSD-NAME/1")),
        Rule("BSD-2-Clause", bsd),
        Rule("Apache-2.0", ("APACHE-HEAD/1", "APACHE-FILE/1", "APACHE-COPY/1", "APACHE-AS-IS/1", "APACHE-SEE/1")),
        Rule("Apache-2.0", ("APACHE-HEAD/1", "APACHE-FILE/1", "APACHE-COPY/1")),
        Rule("Apache-2.0", ("Apache-2.0/notice", "APACHE-FILE/1", "APACHE-COPY/1")),
        Rule("Apache-2.0", ("APACHE-HEAD/1",)),
        Rule("Apache-2.0", ("APACHE-TERMS/1",)),
        Rule("Apache-2.0", ("APACHE-GRANT/1",)),
        Rule("MPL-2.0", ("MPL-FORM/1", "MPL-COPY/1")),
        Rule("MPL-2.0", ("MPL-FORM/1",)),
        *(Rule(licence, (free, "GPL-HOPE/1", see)) for licence, free, see in gpl),
        *(Rule(licence, (free,)) for licence, free, _ in gpl),
        Rule("Unlicense", ("UNLICENSE/1", "UNLICENSE/2")),
        Rule("Unlicense", ("UNLICENSE/1",)),
        Rule("Zlib", ("ZLIB/1", "ZLIB/2")),
        Rule("BSL-1.0", ("BOOST/1",)),
        Rule("MIT", ("MIT/1", "MIT/2")),
        Rule("MIT", ("MIT/1",)),
        Rule("MIT", ("IS-MIT/1",)),
        Rule("ISC", ("ISC/1",)),
        *(Rule(licence, (f"{licence}/notice",)) for licence in _NAMES),
    ]
    return out


def recognised(text: str, rules: Rules) -> list[tuple[int, str]]:
    """(sentence number, identifier) of the known sentences of a text, in order; of two that begin at one place the longer."""
    plain = normalised(text)
    if not any(k in plain for k in _KEYS):
        return []
    cuts = _SENTENCE.split(text)
    parts = [normalised(x) for x in cuts]
    found, at, number = [], 0, 0
    while at < len(parts):
        joined, name, after, nxt = "", None, at, at
        while parts[at] and nxt < len(parts):
            if parts[nxt]:
                joined = f"{joined} {parts[nxt]}" if joined else parts[nxt]
                this, more = rules.known(joined)
                if this:
                    name, after = this, nxt
                if not more:
                    break
            nxt += 1
        if name:
            found.append((number, name))
            at, number = after + 1, number + 1
        else:
            at, number = at + 1, number + bool(parts[at])
    return found


def matched(found: list[tuple[int, str]], rules: Rules) -> list[tuple[int, str]]:
    """(first sentence number, licence) of each rule's match; a sentence serves one match."""
    free = dict(found)
    at: dict[str, list[int]] = {}
    for k, name in found:
        at.setdefault(name, []).append(k)
    out = []
    for rule in rules.rules:
        for start in at.get(rule.sequence[0], ()):
            if start not in free:
                continue
            used, last = [start], start
            for name in rule.sequence[1:]:
                places = at.get(name, ())
                near = places[(i := bisect_right(places, last)) : i + 1 + GAP]  # what lies further on is too far, as places differ
                nxt = next((k for k in near if k <= last + 1 + GAP and k in free), None)
                if nxt is None:
                    break
                used.append(nxt)
                last = nxt
            else:
                out.append((start, rule.licence))
                for k in used:
                    del free[k]
    return sorted(out)


def scan(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row for each document: doc_id, the identifiers of known sentences and the licences, both in text order."""
    rules = rules or default_rules()

    @lean
    def run(batches):
        for b in batches:
            seen = [recognised(t or "", rules) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[n for _, n in s] for s in seen], pa.list_(pa.string())), pa.array([[x for _, x in matched(s, rules)] for s in seen], pa.list_(pa.string()))],
                ["doc_id", "sentences", "licences"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sentences array<string>, licences array<string>")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        F.size("licences").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("licences")), ",").alias("licences"),
    )
