"""Licence scans: segments of texts compared to templates by the Dice coefficient of their word bigrams.

Text is normalised to lower-case runs of letters and digits. A segment is any run of neighbouring lines with words: a
line alone, a wrapped licence, or the whole text. Where no such run matches a template, runs of neighbouring words that
share lines with other words are searched too (`within`). With a and b bigrams, Dice is 2 |shared| / (a + b),
so a coefficient of t needs a between b t / (2 - t) and b (2 - t) / t: only templates in these bounds are compared, and
those sizes bound the runs of a text that a template is compared with. A run shares no more bigrams than the places in it
whose bigram the template has, which one pass over the text's bigrams finds; runs with too few are not counted out. Most
texts lack all of some words and bigrams one of which every segment within the threshold provably has: one search.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


THRESHOLD = 0.8

#: Short notices of public licences and the permission texts of three of them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Released under the MIT License.",
    "mit-notice": "This project is licensed under the terms of the MIT license.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gnu-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_word = re.compile(r"[^\W_]+")


def bigrams(text: str) -> Counter:
    """The bigrams of a text's normalised words, with their numbers; a single word stands for itself."""
    words = _word.findall(text.lower())
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter((w,) for w in words)


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Words:
    """A text's normalised words in order, their places, and its lines that hold words: (start, end, first word, last word + 1)."""

    def __init__(self, text: str):
        self.words, self.begins, self.ends, self.lines, at = [], [], [], [], 0
        for line in text.split("\n"):
            first = len(self.words)
            for m in _word.finditer(line):
                for w in _word.findall(m.group().lower()):
                    self.words.append(w)
                    self.begins.append(at + m.start())
                    self.ends.append(at + m.end())
            if len(self.words) > first:
                self.lines.append((at, at + len(line), first, len(self.words)))
            at += len(line) + 1
        self.pairs = list(zip(self.words, self.words[1:], strict=False))


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.templates = sorted((sum(g.values()), name, g) for name, g in ((n, bigrams(t)) for n, t in templates.items()) if g)
        self.threshold = threshold
        self.of: dict[tuple, list[int]] = {}
        for k, (_, _, grams) in enumerate(self.templates):
            for g in grams:
                self.of.setdefault(g, []).append(k)
        self.must = self._pattern(self._must())

    def _must(self) -> set[tuple[str, ...]]:
        """Words and bigrams one of which each segment within the threshold holds: a segment shares at least
        b t / (2 - t) of a template's b bigrams, so it cannot do without some that more than the rest of them are.
        Long words first, as they are rare; then bigrams."""
        chosen: set[tuple[str, ...]] = set()
        common = Counter(w for _, _, g in self.templates for w in {x for pair in g for x in pair})
        covered = lambda gram: gram in chosen or any((w,) in chosen for w in gram)
        for size, _, grams in self.templates:
            spare = size - size * self.threshold / (2 - self.threshold) + 1e-9
            while sum(n for g, n in grams.items() if not covered(g)) > spare:
                left = sorted(g for g in grams if not covered(g))
                long = [w for g in left for w in g if len(w) > 8]
                chosen.add((max(sorted(set(long)), key=lambda w: (common[w], long.count(w))),) if long else max(left, key=lambda g: (sum(map(len, g)), grams[g])))
        return chosen

    @staticmethod
    def _pattern(must: set[tuple[str, ...]]) -> str:
        """What a lower-cased text with one of them matches; words of other scripts around them do no harm."""
        return "(?:^|[^a-z0-9])(?:" + "|".join(sorted("[^a-z0-9]+".join(map(re.escape, m)) for m in must)) + ")(?:[^a-z0-9]|$)"

    def hits(self, text: Words) -> list[tuple[int, list[int]]]:
        """(template, places whose bigram it has) of the templates that have enough of them in the text."""
        found: dict[int, list[int]] = {}
        grams = [*enumerate(text.pairs), *((i, (w,)) for i, w in enumerate(text.words))]
        for i, g in grams:
            for k in self.of.get(g, ()):
                found.setdefault(k, []).append(i)
        return sorted((k, at) for k, at in found.items() if len(at) >= self._need(k))

    def _need(self, k: int) -> float:
        return self.templates[k][0] * self.threshold / (2 - self.threshold) - 1e-9

    def _most(self, k: int) -> float:
        return self.templates[k][0] * (2 - self.threshold) / self.threshold + 1e-9

    def scan(self, text: Words, hits: list[tuple[int, list[int]]]) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, start, end) of each run of lines and template that match, by start, end, then best first."""
        out, t = [], self.threshold
        for k, at in hits:
            size, name, grams = self.templates[k]
            need, most, single = self._need(k), self._most(k), len(next(iter(grams))) == 1
            for i, (start, _, first, _) in enumerate(text.lines):
                low = bisect_left(at, first)
                if len(at) - low < need:
                    break
                for _, end, _, last in text.lines[i:]:
                    n = last - first - 1
                    if single or not n:
                        if n or not single:
                            if n > 0:
                                break
                            continue  # a single word has no bigram
                        here = [(text.words[first],)]
                    else:
                        if n > most:
                            break
                        shared = bisect_left(at, last - 1) - low  # at most
                        if n < need or 2 * shared < t * (size + n) - 1e-9:
                            continue
                        here = text.pairs[first : last - 1]
                    score = dice(Counter(here), grams)
                    if score >= t:
                        out.append((name, score, start, end))
        return sorted(out, key=lambda x: (x[2], x[3], -x[1], x[0]))

    def within(self, text: Words, hits: list[tuple[int, list[int]]], found: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, start, end) of runs of words, wherever lines break, that match; per template the
        best first, then the earliest and shortest, none that overlaps another or one that is already found.

        A best run starts and ends with bigrams of the template, so only those places are tried.
        """
        out, t = [], self.threshold
        for k, at in hits:
            size, name, grams = self.templates[k]
            span, need, most = len(next(iter(grams))), self._need(k), self._most(k)
            taken = [(a, b) for other, _, a, b in found if other == name]
            runs = []
            for x, i in enumerate(at):
                if x + need > len(at):
                    break
                left, shared = dict(grams), 0
                for j in at[x:]:
                    if j - i + 1 > most:
                        break
                    g = text.pairs[j] if span == 2 else (text.words[j],)
                    if left[g]:
                        left[g] -= 1
                        shared += 1
                        score = 2 * shared / (size + j - i + 1)
                        if score >= t:
                            runs.append((-score, i, j + span))
            for score, i, end in sorted(runs):
                a, b = text.begins[i], text.ends[end - 1]
                if all(b <= c or d <= a for c, d in taken):
                    taken.append((a, b))
                    out.append((name, -score, a, b))
        return out

    def find(self, text: str, within: bool) -> list[tuple[str, float, int, int]]:
        """All matches of a text by start, then end."""
        words = Words(text)
        hits = self.hits(words)
        found = self.scan(words, hits) if hits else []
        more = self.within(words, hits, found) if hits and within else []
        return sorted(found + more, key=lambda x: x[2:]) if more else found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD, within: bool = False) -> DataFrame:
    """Per row: id, license (the best match of the text, null if none), dice (of it), matches: array of all matches.

    With `within`, notices that share lines with other words are found too; matches stay ordered by start, then end.
    Best is the largest coefficient, then the earliest start, then the template's name. Null and empty texts match
    nothing; repeated rows are each returned; an empty table gives an empty one; other columns are not read. Start and
    end are places in the text by code points.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, threshold)
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            # one search over all texts leaves few; lower case here may only find more
            maybe = np.flatnonzero(pc.match_substring_regex(pc.utf8_lower(texts), scanner.must).to_numpy(zero_copy_only=False))
            found: list = [[]] * len(texts)
            for i in maybe.tolist():
                found[i] = scanner.find(texts[i].as_py(), within)
            best = [min(f, key=lambda x: (-x[1], x[2], x[0]))[:2] if f else (None, None) for f in found]
            matches = [[dict(zip(("license", "dice", "start", "end"), m, strict=True)) for m in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array(matches, kind)], ["id", "license", "dice", "matches"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "id long, license string, dice double, matches array<struct<license:string,dice:double,start:long,end:long>>").withColumnRenamed("id", id_col)
