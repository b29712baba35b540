"""License scans by conditional compression.

Blocks of text around words that a notice can't do without are compressed twice with zstandard:
alone, and with each notice as a raw dictionary, and the notices are ranked by the bytes that they save. Only those that save
at least GATE of what they save on their own wording are candidates. They are held against the block word by word in the order of their
rank, those of about the same savings (within NEAR) together: of these the one with the fewest differences wins if at
most TOLERANCE of its words differ. The winner's words are cut out, and so on with the next
candidates and with what is left of the block until no notice is confirmed.
What differs - words of the notice that are missing, words put in between - is reported.

Some differences refuse a match, however few they are: a missing word that tells a license from
others (its version, or a name: a word with a capital within a sentence that fewer than half of
the licenses have), such a word of another license put in, and a negation put in or just before.

Where to look follows from the notices themselves: of each notice one such telling word has to
be there, or else one of any words that are one more than may be missing. So the blocks
around these words hold all matches, whatever templates a caller gives. Notices may be wrapped
over lines and spelled the British way. Those of LONG words or more are looked for first; what they hold is not looked at again.

{holder} in a notice stands for up to MOST_HELD words, such as years and names, that are no
differences; of more words than that some are reported as put in. Notices too short for a difference by TOLERANCE may have one, but of three
words none may be missing: two are no notice ("all rights") or another ("some rights reserved").

Notices are short, so every task holds them; documents that hold none of the words are dropped by
built-in string functions in the scan, and only the others reach Python.

Defined results: null and empty texts have no blocks; repeated rows are each reported; an
empty table gives no rows; other columns are ignored; of notices of about the same savings with equally few
differences the one that saves more bytes wins, then the first by name. Notices that don't
share words are all reported, repeated ones too; saved_bytes of one found in
what was left are of that part of the block. Very long texts are held one at a time by a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TOLERANCE = 0.2
LEVEL = 12
#: Share of the bytes that a notice saves on its own wording, and share of the best savings, or bytes, by which savings count as about the same.
GATE = 0.1
NEAR, NEAR_BYTES = 0.1, 8
LONG = 30
MOST_HELD = 30
#: Words before a match among which a negation refuses it.
BEFORE = 3
# Words that negate, as far as _WORD takes them, and the notices.
NEGATIONS = ("not", "no", "never", "nor", "neither", "cannot", "isn", "aren", "wasn", "weren", "don", "doesn", "didn", "won")
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "All rights reserved.",
}
_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Copyright (c) {holder} All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_GNU = (
    "This {program} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation; "
    "either version {version} of the License, or (at your option) any later version. This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
)
# Further notices of a license.
FORMS = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations '
        "under the License.",
    ),
    "BSD-2-Clause": (_BSD + _WARRANTY,),
    "BSD-3-Clause": (
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. " + _WARRANTY,
    ),
    "GPL-2.0": (_GNU.format(program="program", kind="General Public License", version=2),),
    "GPL-3.0": (_GNU.format(program="program", kind="General Public License", version=3),),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-3.0": (_GNU.format(program="library", kind="Lesser General Public License", version=3),),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    "Proprietary": ("Copyright {holder}. All rights reserved.",),
}
for _name, _form in {
    "Apache-2.0": "Licensed under the terms of the Apache License 2.0.",
    "BSD-2-Clause": "Licensed under the terms of the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the terms of the BSD 3-Clause License.",
    "ISC": "Licensed under the terms of the ISC License.",
    "MIT": "Licensed under the terms of the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
}.items():
    FORMS[_name] = (*FORMS.get(_name, ()), _form)
OUT = "doc_id long, license string, block_start long, saved_bytes long, differences long, missing array<string>, added array<string>"

_ALONE = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_HOLDER = "{holder}"
#: A word put in, above the bits that tell where a match starts.
_PUT_IN = 1 << 32
_NEVER = 1 << 60


def folded(text: str) -> str:
    """In lower case and American spelling; as long as before but for one letter."""
    return text.lower().replace("licence", "license")


def _words(notice: str) -> list[str]:
    parts = [_WORD.findall(x) for x in folded(notice).split(_HOLDER)]
    return parts[0] + [w for p in parts[1:] for w in (_HOLDER, *p)]


def _tables(notice: list[str], block: list[str], lacks: int) -> Iterator[np.ndarray]:
    """For each number of the notice's words, from 0: by words missing and by end in the block, the fewest words put in, then the latest start."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(block))}
    own = np.array([ids[w] for w in block], np.int64)
    n = len(block)
    ends = np.arange(n + 1, dtype=np.int64)
    now = np.full((lacks + 1, n + 1), _NEVER, np.int64)
    now[0] = n - ends
    yield now
    for w in notice:
        if w == _HOLDER:
            new = now.copy()
            for k in range(1, min(MOST_HELD, n) + 1):
                np.minimum(new[:, k:], now[:, :-k], out=new[:, k:])
        else:
            new = np.full_like(now, _NEVER)
            if w in ids:
                new[:, 1:] = np.where(own == ids[w], now[:, :-1], _NEVER)
            np.minimum(new[1:], now[:-1], out=new[1:])
            new = np.minimum.accumulate(new - ends * _PUT_IN, axis=1) + ends * _PUT_IN
        now = new
        yield now


def _names(text: str) -> set[str]:
    """Versions of a notice, and in one of fewer than LONG words its words with a digit or with a capital within a sentence."""
    found = [m for m in _WORD.finditer(text.replace(_HOLDER, " " * len(_HOLDER)))]
    out = {b.group().lower() for a, b in zip(found, found[1:]) if a.group().lower() in ("version", "v") and b.group()[0].isdigit()}
    if len(found) < LONG:
        for k, m in enumerate(found):
            opens = not k or "." in text[found[k - 1].end() : m.start()]
            if any(c.isdigit() for c in m.group()) or (not opens and m.group()[0].isupper()):
                out.add(m.group().lower())
    return out


class Notice:
    """A notice, ready to compress and to compare."""

    def __init__(self, name: str, text: str):
        self.name, self.text, self.words = name, text, _words(text)
        raw = zstandard.ZstdCompressionDict(text.replace(_HOLDER, "").lower().encode("utf-8"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.given = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False)
        self.fixed = [w for w in self.words if w != _HOLDER]
        spare = int(TOLERANCE * len(self.fixed))
        self.lacks, self.adds = max(spare, int(len(self.fixed) > 3)), max(spare, 1)
        own = text.replace(_HOLDER, "").lower().encode("utf-8")
        self.least = GATE * (len(_ALONE.compress(own)) - len(self.given.compress(own)))
        self.telling: set[str] = set()
        self.others: set[str] = set()

    def possible(self, there: set[str]) -> bool:
        """Whether a block with these words has enough of the notice's."""
        return self.telling <= there and sum(w not in there for w in self.fixed) <= self.lacks

    def clues(self) -> list[str]:
        """Words of which every match holds one."""
        words = sorted(dict.fromkeys(self.fixed), key=lambda w: (-len(w), w))
        telling = [w for w in words if w in self.telling and len(w) > 2]  # shorter ones are everywhere
        return telling[:1] or words[: self.lacks + 1]


@lru_cache(4096)
def _pattern(words: tuple[str, ...], any_case: bool) -> re.Pattern:
    """One of the words, as a whole."""
    return re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, words)) + r")(?![^\W_])", re.IGNORECASE if any_case else 0)


class Scanner:
    """Notices, and where to look for them."""

    def __init__(self, templates: dict[str, str], forms: dict[str, tuple[str, ...]] | None = None):
        named = sorted([*templates.items(), *((name, text) for name, texts in (forms or {}).items() for text in texts)])
        notices = [Notice(*x) for x in named]
        names = {w for n in notices for w in _names(n.text)}
        licenses = {n.name for n in notices}
        common = {w for w in names if len({n.name for n in notices if w in n.fixed}) * 2 >= max(3, len(licenses))}
        for n in notices:
            n.telling = _names(n.text) - common
            n.others = names - common - set(n.fixed)
        self.kinds = []
        for long in (True, False):
            kind = [n for n in notices if (len(n.words) >= LONG) == long]
            if kind:
                clues = sorted({w for n in kind for w in n.clues()})
                self.kinds.append((clues, 2 * max(len(n.text) for n in kind), kind))

    def clues(self) -> list[str]:
        """Texts without any of these words, in any case, have no notice."""
        return sorted({w for _, _, kind in self.kinds for n in kind for w in n.clues()})

    @staticmethod
    def blocks(text: str, clues: list[str], reach: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Text within reach of a clue, outside of what is taken; parts that meet are one."""
        found: list[list[int]] = []
        low = folded(text)
        there = tuple(w for w in clues if w in low)
        if not there:
            return []
        aligned = len(low) == len(text)  # all but one letter keep their length
        for m in _pattern(there, not aligned).finditer(low if aligned else text):
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            lo = max([0, m.start() - reach, *(b for _, b in taken if b <= m.start())])
            hi = min([len(text), m.end() + reach, *(a for a, _ in taken if a >= m.end())])
            if found and lo <= found[-1][1]:
                found[-1][1] = max(hi, found[-1][1])
            else:
                found.append([lo, hi])
        return [(a, b) for a, b in found]

    @staticmethod
    def matches(notice: Notice, block: list[str]) -> list[tuple[int, int, int]]:
        """Differences, start and end of the best match that ends at a word, where there is one."""
        for last in _tables(notice.words, block, notice.lacks):  # noqa: B007
            pass
        added = last // _PUT_IN
        lacks = np.arange(notice.lacks + 1)[:, None]
        rank = np.where(added <= notice.adds, (np.maximum(added, lacks) * 4096 + added + lacks) * 4096 + lacks, _NEVER)
        best = rank.argmin(axis=0)
        out = []
        for end in np.flatnonzero(rank.min(axis=0) < _NEVER).tolist():
            m = int(best[end])
            start = len(block) - int(last[m, end] % _PUT_IN)
            if start < end:
                out.append((max(m, int(added[m, end])), start, end))
        return out

    @staticmethod
    def wording(template: list[str], block: list[str], at: tuple[int, int] | None = None, lacks: int | None = None) -> tuple[list[str], list[str]]:
        """Words of the notice that the block, or the part of it at some words, lacks, and words that stand between its others or in place of its first or last."""
        start, end = at or (0, len(block))
        part = block[start:end]
        steps = list(_tables(template, part, len(template) if lacks is None else lacks))
        added = steps[-1] // _PUT_IN
        _, _, m, j = min((max(k, a), k + a, k, j) for k, row in enumerate(added.tolist()) for j, a in enumerate(row) if at is None or j == len(row) - 1)
        missing, put_in, matched, i = [], [], [], len(template)
        after = end if at else j
        while i:
            here, before = steps[i][m, j], steps[i - 1]
            if template[i - 1] == _HOLDER:
                j -= next(k for k in range(j + 1) if before[m, j - k] == here)
                i -= 1
            elif j and part[j - 1] == template[i - 1] and before[m, j - 1] == here:
                i, j = i - 1, j - 1
                matched.append(i)
            elif m and before[m - 1, j] == here:
                i, m = i - 1, m - 1
                missing.append(template[i])
            else:
                j -= 1
                put_in.append(part[j])
        fixed = [k for k, w in enumerate(template) if w != _HOLDER]
        first, last = (fixed.index(matched[-1]), len(fixed) - 1 - fixed.index(matched[0])) if matched else (0, 0)
        before = start + j
        return missing[::-1], block[max(0, before - first) : before] + put_in[::-1] + block[after : after + last]

    def confirmed(self, text: str, lo: int, hi: int, notices: list[Notice]) -> tuple[list[tuple[int, tuple]], list[tuple[int, int]]]:
        """Where each notice in a block begins with its row, and the places of their words."""
        at = [(m.start(), m.end()) for m in _WORD.finditer(text, lo, hi)]
        words = [folded(text[a:b]) for a, b in at]
        there = set(words)
        able = [n for n in notices if n.possible(there)]
        if not able:
            return [], []
        raw = folded(text[lo:hi]).encode("utf-8")
        plain = len(_ALONE.compress(raw))
        ranked = sorted(((plain - len(n.given.compress(raw)), n) for n in able), key=lambda x: (-x[0], x[1].name))
        hits, tier, top = [], 0, None
        for less, n in ranked:
            if less < max(1, n.least):
                continue
            if top is not None and less < top - max(NEAR * top, NEAR_BYTES):
                tier, top = tier + 1, less
            top = less if top is None else top
            hits += [(tier, d, -less, n.name, start - end, start, end, n) for d, start, end in self.matches(n, words)]
        hits.sort(key=lambda h: h[:7])
        rows, places = [], []
        free = np.ones(len(words), bool)
        for _, differ, less, name, _, start, end, n in hits:
            if free[start:end].all():
                missing, added = self.wording(n.words, words, (start, end), n.lacks)
                ahead = [m.group().lower() for m in _WORD.finditer(text[max(0, at[start][0] - 100) : at[start][0]].rpartition(". ")[2])][-BEFORE:]
                if n.telling & set(missing) or n.others & set(added) or not set(NEGATIONS).isdisjoint((*added, *ahead)):
                    continue
                free[start:end] = False
                rows.append((at[start][0], (name, at[start][0], -less, differ, missing, added)))
                places.append((at[start][0], at[end - 1][1]))
        cuts = sorted(places)
        if cuts:
            for left, right in zip([lo, *(b for _, b in cuts)], [*(a for a, _ in cuts), hi], strict=True):
                more, further = self.confirmed(text, left, right, notices)
                rows += more
                places += further
        return rows, places

    def scan(self, text: str) -> list[tuple]:
        found, taken = [], []
        for clues, reach, notices in self.kinds:
            for lo, hi in self.blocks(text, clues, reach, taken):
                rows, places = self.confirmed(text, lo, hi, notices)
                found += rows
                if len(notices[0].words) >= LONG:
                    taken = sorted(taken + places)
        return [row for _, row in sorted(found, key=lambda x: x[0])]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each confirmed notice: doc_id, license, where it starts in the text, bytes saved, and the differences."""
    known, further = (templates, None) if templates else (TEMPLATES, FORMS)
    clues = Scanner(known, further).clues()
    # of an array of one, so that the text is lowered once and not for each word
    lowered = F.array(F.replace(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit("licence"), F.lit("license")))
    clue = F.exists(lowered, lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(c)) for c in clues)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, further)
        for batch in batches:
            rows = [(i, *hit) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in scanner.scan(text)]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

    return docs.where(clue).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)
