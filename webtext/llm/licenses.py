"""License scans by conditional compression (operator 8).

Words that point to a license (``ANCHOR``) mark candidate blocks: the words
around them, as far as the longest template of a class reaches (notices of one
sentence; whole license texts).  A block is compressed alone and with each
template of its class as a raw zstandard dictionary.  Templates that save at
least ``SHARE`` of what they save on themselves are tried in order of their
savings, and confirmed by an exact word alignment: at most ``TOLERANCE`` of the
template's words, and one in a short notice, may be missing, changed or inserted,
and none of them may be a number or a word that tells licenses apart.  The numbers
of a wording's list may be missing or be other signs.

A document with more anchors has more blocks; none is capped.  The words of an
overlong block are cut into windows that overlap by the longest template.

Defined results: one row per license found, in code points of the whole text;
null and empty texts and texts without an anchor give no row; repeated rows
give theirs each; of overlapping findings the one with the most words confirmed,
less its differences, stays, on ties the one that saves most, then the first, then
the longer; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, plain

SHARE, TOLERANCE = 0.2, 0.1
#: One setting for all sizes of block and dictionary, so that sizes compare.  Matches
#: from three bytes and an optimal parse keep the saving of a five-word notice above
#: the noise of its surroundings (at least 0.38 of its own, in trials).
_SETTING = zstandard.ZstdCompressionParameters(
    window_log=17, hash_log=12, chain_log=12, search_log=8, min_match=3, target_length=64,
    strategy=zstandard.STRATEGY_BTOPT, write_content_size=False)
#: Templates of at most so many words are notices.
NOTICE_WORDS = 16
#: The number before an entry of a wording's list.
_LIST_NUMBER = re.compile(r"[.:]\s+(\d)\.\s")
_WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")
#: Looked for in a text's words, joined by spaces.
ANCHOR = re.compile(r"licen[sc]|permission|redistribution|public domain|creative commons|cc (?:by|0)")
#: The same in whole texts, for the JVM; it may match more, never less.
NATIVE_ANCHOR = (r"(?iu)licen[sc]|permission|redistribution|public[\W_]+domain|creative[\W_]+commons"
                 r"|cc[\W_]+by|cc[\W_]*0")
#: A difference in one of these words, or in a number, makes another license.
TELLING = frozenset("""by sa nc nd attribution noncommercial sharealike noderivatives noderivs mit apache bsd isc
mozilla gpl lgpl agpl gnu lesser library affero boost zlib unlicense public domain not clause
style like modified variant""".split())

# License names, the sentences that carry them, and standard wordings.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0",
                        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0",
                        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
SENTENCES = ["licensed under {}", "licensed under the {}", "released under the {}", "under the terms of the {}",
             "distributed under the {}", "available under the {}", "subject to the terms of the {}",
             "governed by the {}", "covered by the {}"]
#: Identifiers that stand in SPDX lines beside the names of ``NAMES``.
SPDX = {
    "GPL-2.0": ["GPL-2.0-only"], "GPL-2.0-or-later": ["GPL-2.0-or-later"],
    "GPL-3.0": ["GPL-3.0-only"], "GPL-3.0-or-later": ["GPL-3.0-or-later"],
    "LGPL-2.1": ["LGPL-2.1-only"], "LGPL-2.1-or-later": ["LGPL-2.1-or-later"],
    "LGPL-3.0": ["LGPL-3.0-only"], "LGPL-3.0-or-later": ["LGPL-3.0-or-later"],
    "AGPL-3.0": ["AGPL-3.0-only"], "AGPL-3.0-or-later": ["AGPL-3.0-or-later"],
    "MIT-0": ["MIT-0"], "BSD-4-Clause": ["BSD-4-Clause"], "Zlib": ["Zlib"], "Unlicense": ["Unlicense"],
}
WORDINGS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation; either version 2 of the License,
        or (at your option) any later version.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright
        holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
    "BSD-4-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning
        features or use of this software must display the following acknowledgement: This product includes software
        developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors
        may be used to endorse or promote products derived from this software without specific prior written
        permission.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Zlib": """Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""",
}


def default_templates() -> list[tuple[str, str]]:
    """(license, wording) pairs: every name in every sentence, SPDX lines, and the wordings."""
    short = [(k, s.format(n)) for k, names in NAMES.items() for n in names for s in SENTENCES]
    lines = [(k, f"SPDX-License-Identifier: {n}") for k, names in [*((k, [k]) for k in NAMES), *SPDX.items()]
             for n in names]
    return short + lines + list(WORDINGS.items())


class Found(NamedTuple):
    license: str
    start: int
    end: int
    gain: int
    differences: int
    missing: list[str]
    added: list[str]


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lower-case words and their code-point spans in ``text``."""
    spans = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    return [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(compression_params=_SETTING)
    return zstandard.ZstdCompressor(compression_params=_SETTING, dict_data=raw)


#: "Alone" is with a dictionary that no UTF-8 text of words can match.
_ALONE = compressor(bytes(range(0xF8, 0x100)) * 4)


class Template:
    def __init__(self, name: str, wording: str) -> None:
        self.words, starts, _ = words_of(wording)
        self.name, self.tolerance = name, max(1, int(TOLERANCE * len(self.words)))
        marks = {m.start(1) for m in _LIST_NUMBER.finditer(wording)}
        self.telling_at = {i for i, (w, at) in enumerate(zip(self.words, starts)) if telling(w) and at not in marks}
        self.telling = {self.words[i] for i in self.telling_at}
        data = " ".join(self.words).encode()
        self.press = compressor(data)
        self.least = SHARE * (len(_ALONE.compress(data)) - len(self.press.compress(data)))


def align(template: list[str], words: list[str]) -> np.ndarray:
    """Edit distances of template prefixes to the block's words ending at each
    place, from any begin: row ``i`` for the first ``i`` words."""
    number: dict[str, int] = {}
    t = [number.setdefault(w, len(number)) for w in template]
    b = np.array([number.get(w, -1) for w in words], np.int64)
    place = np.arange(len(b) + 1)
    d = np.zeros((len(t) + 1, len(b) + 1), np.int64)
    for i, w in enumerate(t, 1):
        row = d[i - 1] + 1
        np.minimum(row[1:], d[i - 1, :-1] + (b != w), out=row[1:])
        d[i] = np.minimum.accumulate(row - place) + place
    return d


def _trace(d: np.ndarray, template: list[str], words: list[str], end: int) -> tuple[int, list[int], list[str]]:
    """Begin, places of template words missing and block words added on the way to ``end``."""
    i, j, missing, added = len(template), end, [], []
    while i:
        same = j > 0 and template[i - 1] == words[j - 1]
        if j and d[i, j] == d[i - 1, j - 1] + (not same):
            i, j = i - 1, j - 1
            if not same:
                missing.append(i)
                added.append(words[j])
        elif d[i, j] == d[i - 1, j] + 1:
            i -= 1
            missing.append(i)
        else:
            j -= 1
            added.append(words[j])
    return j, missing[::-1], added[::-1]


def telling(word: str) -> bool:
    return word in TELLING or word[0].isdigit()


def occurrences(t: Template, words: list[str], present: set[str]) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """Confirmed places of a template, apart from one another: begin, end and
    the words missing and added."""
    if not t.telling <= present:
        return
    d = align(t.words, words)
    last, taken = d[-1], []
    for end in sorted(np.flatnonzero(last <= t.tolerance).tolist(), key=lambda e: (last[e], e)):
        begin, missing, added = _trace(d, t.words, words, end)
        if begin < end and t.telling_at.isdisjoint(missing) and not any(map(telling, added)) \
                and all(e <= begin or b >= end for b, e in taken):
            taken.append((begin, end))
            yield begin, end, [t.words[i] for i in missing], added


def disjoint(found: list[tuple[int, Found]]) -> list[Found]:
    """The findings with the most words confirmed, given before each, without overlap, by place."""
    kept: list[Found] = []
    starts: list[int] = []
    for _, f in sorted(found, key=lambda x: (-x[0], -x[1].gain, x[1].start, -x[1].end, x[1].differences, x[1].license)):
        at = bisect_left(starts, f.end)      # kept findings before this place begin before ``f`` ends
        if not at or kept[at - 1].end <= f.start:
            starts.insert(at, f.start)
            kept.insert(at, f)
    return kept


class Scanner:
    """Templates in two classes, each with the reach of its longest."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        made = [Template(*t) for t in templates]
        for t in made:
            if not ANCHOR.search(" ".join(t.words)):
                raise ValueError(f"a template of {t.name} has no word that marks a block")
        split = ([t for t in made if len(t.words) <= NOTICE_WORDS], [t for t in made if len(t.words) > NOTICE_WORDS])
        self.classes = [(group, max(len(t.words) + t.tolerance for t in group)) for group in split if group]

    def scan(self, text: str) -> list[Found]:
        words, starts, ends = words_of(text)
        joined = " ".join(words)
        at, begins = 0, []
        for w in words:
            begins.append(at)
            at += len(w) + 1
        marks = [bisect_left(begins, m.start() + 1) - 1 for m in ANCHOR.finditer(joined)]
        found = []
        for group, reach in self.classes:
            for low, high, first, stop in blocks(marks, reach, len(words)):
                for f in self._block(group, words[low:high]):
                    if first <= low + f.start < stop:
                        confirmed = f.end - f.start - len(f.added) - f.differences
                        found.append((confirmed, f._replace(start=starts[low + f.start], end=ends[low + f.end - 1])))
        return disjoint(found)

    @staticmethod
    def _block(group: list[Template], words: list[str]) -> list[Found]:
        data, present = " ".join(words).encode(), set(words)
        alone = len(_ALONE.compress(data))
        ranked = sorted(((alone - len(t.press.compress(data)), k) for k, t in enumerate(group)),
                        key=lambda r: (-r[0], r[1]))
        return [Found(group[k].name, begin, end, gain, max(len(missing), len(added)), missing, added)
                for gain, k in ranked if gain >= group[k].least
                for begin, end, missing, added in occurrences(group[k], words, present)]


def blocks(marks: list[int], reach: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Word ranges around the marks, merged where they meet.  Long ones are cut
    into windows of four reaches, two apart.  The last two numbers are the range
    of begins that a window answers for: they tile the block, and whatever
    begins there lies whole in the window, with a reach of words before it."""
    merged: list[list[int]] = []
    for m in marks:
        low, high = max(0, m - reach), min(n, m + reach + 1)
        if merged and low <= merged[-1][1]:
            merged[-1][1] = high
        else:
            merged.append([low, high])
    for low, high in merged:
        first = low
        while high - low > 4 * reach:
            yield low, low + 4 * reach, first, low + 3 * reach
            first = low + 3 * reach
            low += 2 * reach
        yield low, high, first, high


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    """One per worker process and template list."""
    return Scanner(list(templates))


SCHEMA = ("doc_id long, license string, start long, end long, gain long, differences long, "
          "missing array<string>, added array<string>")
_ARROW = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                    ("gain", pa.int64()), ("differences", pa.int64()), ("missing", pa.list_(pa.string())),
                    ("added", pa.list_(pa.string()))])


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per license found: ``start`` and ``end`` in the text, ``gain`` in
    compressed bytes, the words that differ.  Texts without an anchor stay in the
    JVM; nothing is shuffled."""
    on_workers(docs.sparkSession)
    given = tuple(default_templates() if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(given).scan
        for b in batches:
            rows = [(doc_id.as_py(), *f) for doc_id, text in zip(b.column(0), b.column(1)) for f in scan(text.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)],
                                                 schema=_ARROW)

    return plain(docs).where(F.col("text").rlike(NATIVE_ANCHOR)).mapInArrow(run, SCHEMA)
