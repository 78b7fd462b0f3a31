r"""License scans by conditional compression.

A candidate block is a run of lines with a cue word, gaps of ``GAP`` lines included, at most ``BLOCK_LINES`` lines. Cues are
``CUES`` and, for each template of which a text could keep ``100 - ALLOWED`` percent of the words and still have none of them, as
many of the template's own rarest words as that takes: so no text that can be confirmed goes without a cue, whatever the templates. Each block is compressed by zstandard
alone and with each template as a raw dictionary; the templates are ranked by how much smaller the block becomes. In this
order all are then confirmed by the exact differences in wording, in the block and the lines around it, since lines of a
license need not have a cue; only those with too few of their words anywhere in that text are passed over, as they can't be
confirmed. A template is found where its words, case and punctuation put aside, stand in order with
at most ``ALLOWED`` percent of them missing, its version number never. Confirmed words are taken out of the block and what
is left is ranked again, until nothing more is confirmed, so that a block may hold any number of licenses. Of licenses
confirmed at places that overlap, the one with the most words in common is reported, ties to fewer differences.

Edge cases (tested): null and empty texts have no block; a block without a confirmed template gives no row, unless
``unconfirmed`` asks for it (license null); rows that repeat are each scanned; ties in rank go to the template's name; very
long lines are compared whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common

GAP = 1
#: Longer runs of lines are parted; the lines around a block cover what lies across the cut.
BLOCK_LINES = 64
ALLOWED = 10
CUES = r"(?i)licen[sc]|copyright|copyleft|all rights reserved|permission|redistribut|warrant|public domain|creative commons|\bcc[ -](?:by|0)|spdx|\bgpl\b|\bmit\b|\bbsd\b"

#: Notices and texts of public licenses, by name.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All rights reserved": "All rights reserved.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

def cues(templates: dict[str, str]) -> str:
    """A pattern for the words that candidate blocks have: ``CUES``, and what the templates need beyond them."""
    known = re.compile(CUES)
    words = {name: wording(text) for name, text in templates.items()}
    used = Counter(w for own in words.values() for w in set(own))
    added: list[str] = []
    for name in sorted(words):
        own, have = Counter(words[name]), 0
        for w, n in own.items():
            have += n if known.search(w) or w in added else 0
        # more cues than words that may be missing
        for w in sorted(own, key=lambda w: (len(w) < 3, used[w], -len(w), w)):
            if 100 * have > ALLOWED * len(words[name]):
                break
            if not known.search(w) and w not in added:
                added.append(w)
                have += own[w]
    # by first letter, so that a place in a text is tried once and not once a word
    letters = [f"{re.escape(c)}(?:{'|'.join(re.escape(w[1:]) for w in sorted(added) if w[0] == c)})" for c in sorted({w[0] for w in added})]
    return rf"{CUES}|\b(?:{'|'.join(letters)})\b" if letters else CUES


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("license", pa.string()), ("rank", pa.int32()), ("saved", pa.float64()),
    ("n_missing", pa.int32()), ("n_other", pa.int32()), ("missing", pa.list_(pa.string())), ("other", pa.list_(pa.string())),
])
_OUT = "doc_id long, first_line int, last_line int, license string, rank int, saved double, n_missing int, n_other int, missing array<string>, other array<string>"


_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_NUMBER = re.compile(r"\d+(\.\d+)*")


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks(lines: list[str], cue: re.Pattern) -> list[tuple[int, int]]:
    """First and last line of each candidate block."""
    out: list[list[int]] = []
    for i, line in enumerate(lines):
        if cue.search(line):
            if out and i - out[-1][1] <= GAP + 1 and i - out[-1][0] < BLOCK_LINES:
                out[-1][1] = i
            else:
                out.append([i, i])
    return [(a, b) for a, b in out]


def difference(template: list[str], matcher: SequenceMatcher) -> tuple[list[int], list[int]]:
    """Places of the template's words that are missing, and those of the words (``matcher``'s second sequence) that agree.

    The longest run in common fixes the place; all else is compared in a window little longer than the template, so that
    a word far off never stands in for one that was changed.
    """
    matcher.set_seq1(template)
    run = matcher.find_longest_match()
    slack = 2 * ALLOWED * len(template) // 100
    begin = max(0, run.b - run.a - slack)
    near = matcher.b[begin : run.b - run.a + len(template) + slack]
    same = SequenceMatcher(None, template, near, autojunk=False).get_matching_blocks() if run.size else []
    held = {m.a + k for m in same for k in range(m.size)}
    return [i for i in range(len(template)) if i not in held], [begin + m.b + k for m in same for k in range(m.size)]


def _version(template: list[str], i: int) -> bool:
    """Whether a word of the template is the license's version."""
    return bool(_NUMBER.fullmatch(template[i])) and ("." in template[i] or (i > 0 and template[i - 1] == "version"))


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.cue = re.compile(cues(templates))
        self.names = sorted(templates)
        self.words = {n: wording(templates[n]) for n in self.names}
        self.counts = {n: Counter(w) for n, w in self.words.items()}
        self.around = 2 * max(map(len, templates.values()))
        plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.alone = plain.compress
        self.given = {n: zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(templates[n].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress for n in self.names}

    def ranked(self, block: str) -> list[tuple[float, str]]:
        """(share of the compressed size saved, name), best first."""
        data = block.encode(errors="replace")
        size = len(self.alone(data))
        return sorted(((1 - len(self.given[n](data)) / size, n) for n in self.names), key=lambda x: (-x[0], x[1]))

    def possible(self, words: Counter) -> set[str]:
        """Templates of whose words enough are there, in whatever order; no other can be confirmed."""
        there = words.get
        return {n for n in self.names if 100 * sum(max(0, k - there(w, 0)) for w, k in self.counts[n].items()) <= ALLOWED * len(self.words[n])}

    def confirmed(self, text: str, begin: int, end: int) -> list[dict]:
        """Licenses in the block ``text[begin:end]``, with the characters that each spans."""
        shift, out = max(0, begin - self.around), []
        found = [(m.start() + shift, m.end() + shift, m[0].lower()) for m in _WORD.finditer(text[shift : end + self.around])]
        pieces = [(begin, end)]
        while pieces and (possible := self.possible(Counter(w for _, _, w in found))):
            matcher = SequenceMatcher(None, [], [w for _, _, w in found], autojunk=False)
            news = []
            for rank, (saved, name) in enumerate(self.ranked("\n".join(text[a:b] for a, b in pieces)), 1):
                if name not in possible:
                    continue
                template = self.words[name]
                missing, held = difference(template, matcher)
                if 100 * len(missing) > ALLOWED * len(template) or any(_version(template, i) for i in missing):
                    continue
                first, last, places = held[0], held[-1], set(held)
                other = [found[i][2] for i in range(first, last + 1) if i not in places]
                if len(held) + len(other) <= len(template) * (100 + 2 * ALLOWED) / 100:
                    news.append({"license": name, "rank": rank, "saved": saved, "span": (found[first][0], found[last][1]), "held": len(held), "missing": [template[i] for i in missing], "other": other})
            if not news:
                return out
            news = best(news)
            out += news
            for start, stop in (n["span"] for n in news):
                found = [(a, b, w) if b <= start or a >= stop else (a, b, "") for a, b, w in found]  # a place without a word parts its neighbours
                pieces = [p for a, b in pieces for p in ((a, min(b, start)), (max(a, stop), b)) if p[0] < p[1]]
        return out

    def scan(self, text: str) -> list[dict]:
        lines, out = text.split("\n"), []
        starts = [0]
        for line in lines:
            starts.append(starts[-1] + len(line) + 1)
        found, empty = [], []
        for a, b in blocks(lines, self.cue):
            here = self.confirmed(text, starts[a], starts[b + 1] - 1)
            found += here
            if not here:
                empty.append((a, b))
        for f in best(found):
            a, b = (bisect(starts, x) - 1 for x in (f["span"][0], f["span"][1] - 1))
            out.append({k: f[k] for k in ("license", "rank", "saved", "missing", "other")} | {"first_line": a, "last_line": b, "n_missing": len(f["missing"]), "n_other": len(f["other"])})
        for a, b in empty:
            words = wording("\n".join(lines[a : b + 1]))
            out.append({"first_line": a, "last_line": b, "license": None, "rank": None, "saved": None, "n_missing": None, "n_other": len(words), "missing": None, "other": words})
        return out


def best(found: list[dict]) -> list[dict]:
    """Of licenses at places that overlap the one with the most words in common, in order of place."""
    spans: list[tuple[int, int]] = []
    out = []
    for f in sorted(found, key=lambda f: (-f["held"], len(f["missing"]) + len(f["other"]), f["rank"], f["license"], f["span"])):
        at = bisect(spans, f["span"])
        if (at == 0 or spans[at - 1][1] <= f["span"][0]) and (at == len(spans) or spans[at][0] >= f["span"][1]):
            spans.insert(at, f["span"])
            out.append(f)
    return sorted(out, key=lambda f: f["span"])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, unconfirmed: bool = False) -> DataFrame:
    """One row for each license confirmed in a block: lines, license, rank, share saved, and the words that differ."""
    templates = templates or TEMPLATES

    def run(it):
        scanner = Scanner(templates)
        for ids, texts in common.column_batches(it, "doc_id", "text"):
            rows = [r | {"doc_id": i} for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True) if t for r in scanner.scan(t) if r["license"] or unconfirmed]
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    rows = common.plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    # most texts have no cue: they end here, before Python
    return rows.filter(F.col("text").rlike(cues(templates))).mapInArrow(run, _OUT)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licenses: doc_id and what scan_licenses finds, word lists as text."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "first_line", "last_line", "license", "rank", "saved", "n_missing", "n_other", F.array_join("missing", " ").alias("missing"))
