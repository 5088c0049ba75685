"""License scan by patience alignment of texts with templates.

Regions first: a license in a text is a stretch where template words are dense, so only stretches of
`2 * len(template)` words with at least `coverage * len(template)` template words can hold one; running sums over all
words find them, whole texts, nothing skipped. In each region the words are aligned with the template: equal ends
are matched, then words that occur once in both are anchors, the longest increasing subsequence of anchors is kept,
and the gaps between them are aligned in the same way. Whole copies are taken out
before; where the alignment finds too little, as with edited notices that stand twice in a region, windows that can
hold a single copy are aligned. Coverage is the share of template words in the densest
stretch of the alignment: the stretch with the most matched words of which at least `DENSITY` of its words match.

Licenses whose notices differ in a word or two are told apart by those words: a finding counts only if the words between its
ends hold all of the template's REQUIRED words (name and version) and none of its CONTRARY ones ("Lesser",
"NonCommercial"). A finding inside one of another template that matches more words is part of that notice and goes.

Defined results: words are those of words.ALNUM; a null or empty text has no license; of findings inside each other the
one with more matched words stays (ties: the longer, then the first name), findings that merely overlap all count, and those
of one template never overlap;
every row gives one row, repeated rows and null doc_ids too; no rows give no rows; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.words import ALNUM, slices, split_words

COVERAGE = 0.8
DENSITY = 0.6

# Names and texts of license notices.
TEMPLATES = {
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}
# Words that a finding of a template must hold, and words that make its text another license's.
REQUIRED = {
    "AGPL-3.0 header": "affero general public 3",
    "AGPL-3.0 notice": "affero general public 3",
    "Apache-2.0 header": "apache 2 0",
    "Apache-2.0 notice": "apache 2 0",
    "BSD-3-Clause": "neither endorse promote",
    "BSL-1.0": "boost 1 0",
    "CC-BY-4.0 notice": "creative commons attribution 4 0",
    "CC-BY-4.0 short": "cc by 4 0",
    "CC-BY-NC-4.0": "creative commons attribution noncommercial 4 0",
    "CC-BY-NC-4.0 notice": "cc by nc 4 0",
    "CC-BY-ND-4.0 notice": "cc by nd 4 0",
    "CC-BY-SA-4.0": "creative commons attribution sharealike 4 0",
    "CC-BY-SA-4.0 notice": "cc by sa 4 0",
    "CC0-1.0 notice": "waived cc0 1 0",
    "GPL-2.0 header": "general public 2",
    "GPL-2.0 notice": "general public 2",
    "GPL-3.0 header": "general public 3",
    "GPL-3.0 notice": "general public 3",
    "LGPL-2.1 header": "lesser general public 2 1",
    "LGPL-3.0 notice": "lesser general public 3",
    "MIT notice": "mit",
    "MPL-2.0 header": "mozilla public 2 0",
    "Unlicense": "unencumbered public domain",
}
_GNU, _SHARE = "lesser library affero", "nc nd sa noncommercial noderivatives noderivs sharealike"
CONTRARY = {
    "AGPL-3.0 header": "lesser library",
    "AGPL-3.0 notice": "lesser library 1 2",
    "Apache-2.0 notice": "1",
    "CC-BY-4.0 notice": _SHARE,
    "CC-BY-4.0 short": _SHARE,
    "CC-BY-NC-4.0": "noderivatives noderivs sharealike",
    "CC-BY-NC-4.0 notice": "nd sa",
    "CC-BY-ND-4.0 notice": "nc sa",
    "CC-BY-SA-4.0": "noncommercial noderivatives noderivs",
    "CC-BY-SA-4.0 notice": "nc nd",
    "GPL-2.0 header": _GNU,
    "GPL-2.0 notice": _GNU + " 3",
    "GPL-3.0 header": _GNU,
    "GPL-3.0 notice": _GNU + " 2",
    "LGPL-2.1 header": "affero",
    "LGPL-3.0 notice": "affero 2 1",
}


class Rule:
    """The words that tell a template apart: `required` ones a finding holds, `contrary` ones it does not."""

    def __init__(self, required: Iterable = (), contrary: Iterable = ()) -> None:
        self.required, self.contrary = Counter(required), frozenset(contrary)

    def possible(self, held: Counter) -> bool:
        return all(held[w] >= n for w, n in self.required.items())

    def holds(self, words: list) -> bool:
        return self.contrary.isdisjoint(words) and self.possible(Counter(words))


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        before[i] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(text: list, template: list) -> list[tuple[int, int]]:
    """Matched (text place, template place) pairs, increasing in both."""
    found: list[tuple[int, int]] = []
    stack = [(0, len(text), 0, len(template))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        once = {w for w, n in Counter(text[a:b]).items() if n == 1} & {w for w, n in Counter(template[c:d]).items() if n == 1}
        if not once:
            continue
        place = {template[j]: j for j in range(c, d) if template[j] in once}
        anchors = [(i, place[text[i]]) for i in range(a, b) if text[i] in once]
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        found += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        stack += [(i + 1, p, j + 1, q) for (i, j), (p, q) in zip(edges[:-1], edges[1:], strict=True) if i + 1 < p and j + 1 < q]
    return sorted(found)


def densest(places: list[int], density: float = DENSITY) -> tuple[int, int, int]:
    """(matched, start, end) of the stretch with the most matched words and at least the density; shorter, then earlier on ties."""
    best = (0, 0, 0)
    for i in range(len(places)):
        for j in range(len(places) - 1, i - 1 + best[0], -1):
            if (j - i + 1) / (places[j] - places[i] + 1) >= density:
                n, width = j - i + 1, places[j] - places[i] + 1
                if n > best[0] or n == best[0] and width < best[2] - best[1]:
                    best = (n, places[i], places[j] + 1)
                break
    return best


def regions(inside: np.ndarray, bounds: np.ndarray, width: int, need: int) -> list[tuple[int, int]]:
    """Joined stretches, none across texts, of `width` places of which at least `need` are inside."""
    if not len(inside):
        return []
    sums = np.concatenate([[0], np.cumsum(inside)])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ends = np.minimum(np.arange(len(inside)) + width, bounds[text + 1])
    first = np.flatnonzero((sums[ends] - sums[:-1] >= need) & inside)
    out: list[tuple[int, int]] = []
    for a, b in zip(first.tolist(), ends[first].tolist(), strict=True):
        if out and a <= out[-1][1] and text[a] == text[out[-1][0]]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def exact(words: list, template: list) -> list[int]:
    """Starts of copies of the whole template that do not overlap, from the left."""
    times = Counter(template)
    rarest = min(range(len(template)), key=lambda j: times[template[j]])
    found: list[int] = []
    for i, w in enumerate(words):
        at = i - rarest
        if w == template[rarest] and at >= (found[-1] + len(template) if found else 0) and words[at : at + len(template)] == template:
            found.append(at)
    return found


def windows(words: list, template: list, need: float, rule: Rule) -> list[tuple[int, int, int]]:
    """(matched, start, end) of findings in windows that can hold a single copy, from the left.

    A finding has at most len(template) / DENSITY words and begins and ends with words of the template, and no alignment
    matches more words than the two have in common, repeats counted; so every window left out has no finding."""
    wanted, width = Counter(template), int(len(template) / DENSITY + 1e-9)
    found: list[tuple[int, int, int]] = []
    held: Counter = Counter()  # of words[i:to]
    i = to = common = 0
    while i < len(words):
        while to < min(len(words), i + width):
            held[words[to]] += 1
            common += held[words[to]] <= wanted[words[to]]
            to += 1
        step = 1
        if common >= need and words[i] in wanted and rule.possible(held):
            best = (0, 0, 0)
            own: Counter = Counter()
            shared = 0
            for end in range(i + 1, to + 1):
                w = words[end - 1]
                own[w] += 1
                shared += own[w] <= wanted[w]
                if shared < need or w not in wanted:
                    continue
                matched, a, b = densest([p for p, _ in patience(words[i:end], template)])
                if matched >= need and (matched, a - b) > (best[0], best[1] - best[2]) and rule.holds(words[i + a : i + b]):
                    best = (matched, i + a, i + b)
            if best[0]:
                found.append(best)
                step = best[2] - i
        for w in words[i : i + step]:
            common -= held[w] <= wanted[w]
            held[w] -= 1
        i += step
    return found


def find(words: list, template: list, coverage: float = COVERAGE, rule: Rule = Rule()) -> list[tuple[float, int, int]]:  # noqa: B008
    """(coverage, start, end) of findings in a region; what lies before and after a finding is searched too.

    Whole copies are taken out first. Words of a notice that stands there twice are no anchors of the region, so where
    its alignment finds too little, windows that can hold a single copy are searched."""
    found, stack = [], [(0, len(words))]
    need = coverage * len(template)
    while stack:
        a, b = stack.pop()
        if b - a < need or not rule.possible(Counter(words[a:b])):
            continue
        if copies := exact(words[a:b], template):
            found += [(1.0, a + i, a + i + len(template)) for i in copies]
            edges = [0, *(x for i in copies for x in (i, i + len(template))), b - a]
            stack += [(a + x, a + y) for x, y in zip(edges[::2], edges[1::2], strict=True)]
            continue
        matched, start, end = densest([i for i, _ in patience(words[a:b], template)])
        if matched >= need and rule.holds(words[a + start : a + end]):
            found.append((matched / len(template), a + start, a + end))
            stack += [(a, a + start), (a + end, b)]
        else:
            found += [(n / len(template), a + i, a + j) for n, i, j in windows(words[a:b], template, need, rule)]
    return sorted(found, key=lambda x: x[1])


def outermost(found: list[tuple]) -> list[tuple]:
    """A text's findings (row, name, coverage, start, end, matched words) less those inside one of more matched words."""
    kept: list[tuple] = []
    spans: dict[str, list[tuple[int, int]]] = {}  # of the kept findings, in order; those of a template never overlap
    for x in sorted(found, key=lambda x: (-x[5], x[3] - x[4], x[1], x[3])):
        _, name, _, start, end, _ = x
        before = (own[bisect_right(own, start, key=lambda s: s[0]) - 1] for other, own in spans.items() if other != name and own[0][0] <= start)
        if not any(end <= last for _, last in before):
            kept.append(x)
            insort(spans.setdefault(name, []), (start, end))
    return sorted(kept, key=lambda x: (x[3], x[1]))


def rule_of(name: str, text: str) -> Rule:
    """The rule of a template of this module; templates of others have none."""
    if TEMPLATES.get(name) != text:
        return Rule()
    return Rule(*(table.get(name, "").encode().split() for table in (REQUIRED, CONTRARY)))


SCANNED = "doc_id long, licenses array<struct<name:string,coverage:double,start:int,end:int>>"


def _scan(batches: Iterator[pa.RecordBatch], templates: dict[str, str], coverage: float) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    split, rules = {}, {name: rule_of(name, text) for name, text in templates.items()}
    for name in sorted(templates):
        codes, _, vocabulary = split_words(pa.array([templates[name]]), ALNUM)
        if len(codes):
            split[name] = [vocabulary[c].as_py() for c in codes.tolist()]
    for block in slices(batches, "text", 8 << 20):
        codes, bounds, words = split_words(block.column(1), ALNUM)
        found: list[tuple[int, str, float, int, int]] = []
        for name, template in split.items():
            held = pc.is_in(words, value_set=pa.array(sorted(set(template)), pa.large_binary())).to_numpy(zero_copy_only=False).astype(bool)
            if not held.any():
                continue
            need = int(np.ceil(coverage * len(template) - 1e-9))
            for a, b in regions(held[codes], bounds, 2 * len(template), need):
                own = [words[c].as_py() for c in codes[a:b].tolist()]
                row = int(np.searchsorted(bounds, a, "right")) - 1
                found += [(row, name, c, a + i - int(bounds[row]), a + j - int(bounds[row]), round(c * len(template))) for c, i, j in find(own, template, coverage, rules[name])]
        found = [x for _, own in groupby(sorted(found), key=lambda x: x[0]) for x in outermost(list(own))]
        rows = np.array([x[0] for x in found], np.int64)
        values = pa.array([{"name": x[1], "coverage": x[2], "start": x[3], "end": x[4]} for x in found], pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        edges = np.searchsorted(rows, np.arange(block.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(edges), values)], names=["doc_id", "licenses"])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id and licenses (name, coverage, word places start and end, by start) of every row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = templates or TEMPLATES
    return rows.mapInArrow(lambda it: _scan(it, held, coverage), SCANNED)
