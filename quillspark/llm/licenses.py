"""License scans by patience alignment."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeps_names, with_columns

#: Short licenses whole (MIT, BSD, ISC), their permission or list of conditions alone, the notices by which files name the long ones
#: (Apache-2.0, GPL-3.0-notice), and short lines. The whole texts of long licenses come from files, by read_templates.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-short": "Licensed under CC BY-NC 4.0.",
    "BSD-line": "Licensed under the BSD 3-Clause License.",
    "GPL-line": "Licensed under the GNU General Public License, version 3.",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0-or-later",
}
WORD = re.compile(r"[a-z0-9]+")
FOUND = "array<struct<license:string,first_word:int,last_word:int,coverage:double>>"


def license_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by their first place, whose second places increase (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists: words unique to both are anchors, their longest increasing run stays, gaps recur.

    Equal words next to an anchor or at a gap's ends extend it. A gap without anchors or equal ends is not aligned.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        where = {w: j for j, w in enumerate(template[c:d], c) if theirs[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(text[a:b], a) if ours[w] == 1 and w in where]
        x, y = a, c
        for i, j in increasing(pairs):
            out.append((i, j))
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
        if x > a or y > c:
            todo.append((x, b, y, d))
    return sorted(out)


def apart(spans: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Of spans (name, first, last, aligned words) that overlap, the one that aligns most words, then the name that comes first."""
    kept: list[tuple[str, int, int, int]] = []
    cluster: list[tuple[str, int, int, int]] = []
    reach = -1
    for span in [*sorted(spans, key=lambda s: (s[1], s[2])), None]:
        if span is None or span[1] > reach:
            best: list[tuple[str, int, int, int]] = []
            for c in sorted(cluster, key=lambda s: (-s[3], s[0], s[1])):
                if all(c[2] < b[1] or c[1] > b[2] for b in best):
                    best.append(c)
            kept += sorted(best, key=lambda s: s[1])
            cluster, reach = [], -1
        if span is not None:
            cluster.append(span)
            reach = max(reach, span[2])
    return kept


def find_licenses(words: list[str], templates: dict[str, list[str]], least: float) -> list[tuple[str, int, int, float]]:
    """Spans of templates in a text, by name, with the share of the template's words that align.

    Of licenses that share words the one that aligns most is told. The text is read in blocks of twice the template, a template apart, so any copy lies in one block and repeated copies don't hide
    each other's unique words. A text or block that holds too few of the template's words to reach the share is skipped.
    """
    have, found = set(words), []
    for name, template in templates.items():
        n, need = len(template), Counter(template)
        if sum(c for w, c in need.items() if w in have) < least * n:
            continue
        best: list[tuple[str, int, int, int]] = []
        for at in range(0, max(1, len(words) - n), n):
            block = words[at : at + 2 * n]
            got = Counter(block)
            if sum(min(c, got[w]) for w, c in need.items()) < least * n:
                continue
            aligned = patience(block, template)
            if len(aligned) < least * n:
                continue
            span = (name, at + aligned[0][0], at + aligned[-1][0], len(aligned))
            if best and span[1] <= best[-1][2]:  # the same copy, seen from the next block
                best[-1] = max(best[-1], span, key=lambda s: s[3])
            else:
                best.append(span)
        found += best
    return [(name, a, b, k / len(templates[name])) for name, a, b, k in apart(found)]


def read_templates(spark: SparkSession, path: str, most: int = 200, most_chars: int = 400_000) -> dict[str, str]:
    """Templates from a folder of license texts, a file each, named as the files are without `.txt`. At most `most` files of at most most_chars characters each come to the driver: more are an error."""
    texts = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("name"), "value")
    found = texts.where(F.length("value") <= most_chars).limit(most + 1).collect()
    if len(found) > most or len(found) < texts.count():
        raise ValueError(f"more than {most} license texts, or one of over {most_chars} characters, below {path}")
    return {unquote(r.name): r.value for r in sorted(found, key=lambda r: r.name)}


@keeps_names
def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, text_col: str = "text") -> DataFrame:
    """Finds copies of license texts in whole documents, one pass over the rows.

    templates: text by name, by default TEMPLATES; read_templates reads whole texts from files. Adds licenses (license, first_word, last_word, coverage, in order of place) over an input column of that name. Words are runs of
    a-z and 0-9 after lower-casing; coverage is the share of the template's words that patience alignment pairs with
    the text, and spans need at least `least`, so a whole license that lacks its disclaimer is told as its permission or conditions only. All rows stay. Null and empty texts have none. Repeated rows and ties
    are scanned one by one; an empty table gives an empty table.
    """
    known = {k: license_words(v) for k, v in (templates or TEMPLATES).items()}

    @F.pandas_udf(FOUND)
    def licenses(texts):
        import pandas as pd

        keys = ("license", "first_word", "last_word", "coverage")
        return pd.Series([[dict(zip(keys, s, strict=True)) for s in find_licenses(license_words(t), known, least)] for t in texts])

    return with_columns(docs, [], licenses=licenses(F.col(text_col)))
