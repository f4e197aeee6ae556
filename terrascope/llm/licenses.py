"""License scans by conditional compression.

A block is the sentence, over its lines, around a word that license notices use. Each block is compressed alone and with
each template as a raw zstandard dictionary; the templates are ranked by how much smaller the block gets. In that order they
are compared word by word: a template is confirmed when the words that differ are few and none of them tells licenses
apart (a name, a number, a clause; not the number of a list item). The first confirmed one is a license of the
block; its stretch is cut out and what is left on either side is compared again, until nothing is confirmed. Notices in
one sentence share the words before the name ("Licensed under the MIT License and ..."). A
notice may be laid out in paragraphs: what stays unexplained of neighbouring blocks is compared together, blank lines and
short gaps between them included, with the templates of several sentences. Texts are read in windows of WINDOW words, of
which neighbours share half, so that a notice of up to half a window is seen whole.

Short sentences, SPDX lines and headings are made by rule from what licenses are called (`TITLES`, `GNU`,
`CREATIVE_COMMONS`, `HEADINGS`). A heading counts only when its block says nothing else, but for a copyright line.

Defined results: a null or empty text has no blocks; ties of rank go to the earlier template; equal texts get equal
results; a block that no template explains is reported without a license; a column named like the result is replaced.
"""

from __future__ import annotations

import difflib
import functools
import re
from collections import Counter
from collections.abc import Container, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Public license notices, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        'limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the '
        'Software, and to permit persons to whom the Software is furnished to do so, subject to the following '
        'conditions: The above copyright notice and this permission notice shall be included in all copies or '
        'substantial portions of the Software.',
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        'with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless '
        'required by applicable law or agreed to in writing, software distributed under the License is distributed on '
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License version 2 as published by the Free Software Foundation.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version.",
    ),
    "LGPL-2.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. This software is provided by the copyright holders and contributors "
        '"as is" and any express or implied warranties, including, but not limited to, the implied warranties of '
        "merchantability and fitness for a particular purpose are disclaimed.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.",),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.",),
}
# What licenses are called, by SPDX identifier; numbers as far as they tell licenses apart.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "Expat License"),
    "Apache-2.0": ("Apache 2.0", "Apache 2 License"),
    "MPL-2.0": ("Mozilla Public License 2.0", "MPL 2.0"),
    "BSD-3-Clause": ("BSD 3-Clause", "3-Clause BSD", "Three-Clause BSD", "Revised BSD License", "Modified BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause", "2-Clause BSD", "Two-Clause BSD", "Simplified BSD License"),
    "ISC": ("ISC License",),
    "BSL-1.0": ("Boost Software License 1.0",),
    "EPL-2.0": ("Eclipse Public License 2.0", "EPL 2.0"),
    "Zlib": ("zlib License",),
    "Unlicense": ("The Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 License", "Creative Commons Zero"),
}
GNU = {
    "GPL-2.0": ("General Public License", "GPL", "2"), "GPL-3.0": ("General Public License", "GPL", "3"),
    "LGPL-2.1": ("Lesser General Public License", "LGPL", "2.1"), "LGPL-3.0": ("Lesser General Public License", "LGPL", "3"),
    "LGPL-2.0": ("Library General Public License", "LGPL", "2"), "AGPL-3.0": ("Affero General Public License", "AGPL", "3"),
}
CREATIVE_COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
VERBS = ("Licensed", "Released", "Distributed", "Available")
# Headings of license files, which count when a block says nothing else.
HEADINGS: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT", "The MIT License (MIT)"),
    "Apache-2.0": ("Apache License Version 2.0, January 2004", "Apache License, Version 2.0"),
    "GPL-3.0": ("GNU General Public License Version 3, 29 June 2007",),
    "GPL-2.0": ("GNU General Public License Version 2, June 1991",),
    "LGPL-3.0": ("GNU Lesser General Public License Version 3, 29 June 2007",),
    "LGPL-2.1": ("GNU Lesser General Public License Version 2.1, February 1999",),
    "AGPL-3.0": ("GNU Affero General Public License Version 3, 19 November 2007",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
    "BSD-3-Clause": ("New BSD License",),
    "EPL-2.0": ("Eclipse Public License v 2.0",),
    "BSL-1.0": ("Boost Software License Version 1.0, 17 August 2003",),
    "ISC": ("ISC",),
    "Unlicense": ("Unlicense",),
}


def titles() -> dict[str, tuple[str, ...]]:
    """What the licenses are called, with the short and long names of the families that are named by a rule."""
    named = dict(TITLES)
    for name, (long, short, version) in GNU.items():
        named[name] = tuple(
            f"{t}{sign}{version}" for t in (long, f"GNU {long}", short, f"GNU {short}") for sign in (" version ", " v", " ")) + (f"{short}v{version}",)
    for short, long in CREATIVE_COMMONS.items():
        named[f"CC-{short}-4.0"] = (f"CC {short} 4.0", f"Creative Commons {long} 4.0", f"Creative Commons {short} 4.0")
    return named


def all_templates() -> dict[str, tuple[str, ...]]:
    """The notices, with an SPDX line and short sentences for every license."""
    named = titles()
    return {
        name: tuple(dict.fromkeys((
            *TEMPLATES.get(name, ()), f"SPDX-License-Identifier: {name}",
            *(f"{verb} under {title}" for title in named.get(name, ()) for verb in VERBS))))
        for name in dict.fromkeys((*TEMPLATES, *named))}


def headings() -> dict[tuple[str, ...], tuple[str, str]]:
    """Words of a heading -> (license, heading)."""
    found = {}
    for named in (titles(), HEADINGS):
        for name, called in named.items():
            for title in called:
                for form in ("{}", "The {}", "{} License", "The {} License", "License {}", "Licensed under {}",
                             "Licensed under the {}", "{} licensed"):
                    found.setdefault(tuple(words(form.format(title))), (name, form.format(title)))
    return found


# Words of which a notice has at least one.
MARKS = re.compile(
    r"licen[sc]|copyright|copyleft|public domain|creative commons|spdx|redistribut|permission (?:is|to)|\bwarrant(?:y|ies)|"
    r"endorse\s+or\s+promote|\b(?:[al]?gpl(?:v?\d)?|cc0|cc[ -]by|mpl|epl|bsd|apache[ -]\d)\b|'as[ -]is'",
    re.IGNORECASE)
TELLING = re.compile(
    r"mit|apache|gnu|gpl|lgpl|agpl|lesser|affero|mozilla|mpl|bsd|clause|isc|unencumbered|cc0|cc|by|nc|sa|nd|"
    r"attribution|sharealike|noncommercial|noderivatives|endorse|fee|[al]?gplv\d+|v\d+|zero|expat|boost|eclipse|epl|zlib|"
    r"unlicense|revised|modified|simplified|two|three|four|\d+")
REACH = 2000
GAP_WORDS = 20  # words between blocks of one group
LONG_WORDS = 20  # templates of more words are looked for over several blocks
WINDOW = 800  # words compared with a template at once
JOINING = {"and", "or", "either", "also", "alternatively", "at", "your", "option", "of", "under", "terms", "the", "a", "an"}
STRAY_WORDS = 10  # a smaller match so far from the others is chance
LEAST_MATCH = 0.8  # share of a template's words that a block must have in order
RESULT = T.StructType([
    T.StructField("blocks", T.LongType()),
    T.StructField("found", T.ArrayType(T.StructType([
        T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("saved", T.DoubleType()), T.StructField("missing", T.ArrayType(T.StringType())),
        T.StructField("added", T.ArrayType(T.StringType()))]))),
])
_ARROW = pa.struct([
    ("blocks", pa.int64()),
    ("found", pa.list_(pa.struct([
        ("license", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("saved", pa.float64()),
        ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])))])
_WORD = re.compile(r"[a-z]+\d*|\d+")
_STOP = re.compile(r"[.!?](?:\s|$)|\n\s*\n")
_LISTED = re.compile(r"(?:^[^\w\n]*|[.:;]\s+)\(?(\d{1,2})[.)](?=\s)", re.MULTILINE)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Words:
    """The words of a text, where they begin and end, and which of them number the items of a list."""

    def __init__(self, text: str):
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower()[0] for c in text)
        found = list(_WORD.finditer(low))
        listed = {m.start(1) for m in _LISTED.finditer(text)}
        self.text, self.said = text, [m[0] for m in found]
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        self.listed = {i for i, at in enumerate(self.starts) if at in listed}

    def part(self, low: int, high: int) -> str:
        """The text of some words; the whole text, of all."""
        return self.text if (low, high) == (0, len(self.said)) else self.text[self.starts[low]:self.ends[high - 1]]


def _sentence(text: str, mark: re.Match) -> tuple[int, int]:
    """The lines around a mark, from the end of the sentence before to the end of its own. Of a line or sentence of
    more than REACH characters, the text within REACH of the mark."""
    low, high = max(0, mark.start() - REACH), min(len(text), mark.end() + REACH)
    start = text.rfind("\n", low, mark.start()) + 1 or low
    while start > low:
        before = text.rfind("\n", low, start - 1) + 1 or low
        line = text[before:start].rstrip()
        if not line or line[-1] in ".!?":
            break
        start = before
    end = mark.end()
    while end < high:
        cut = text.find("\n", end, high)
        end = high if cut < 0 else cut
        if not text[start:end].rstrip() or text[start:end].rstrip()[-1] in ".!?" or text[end:end + 2] == "\n\n":
            break
        end = min(end + 1, high)
    return start, end


def blocks(text: str | None) -> list[list[tuple[int, str]]]:
    """Groups of neighbouring (start, block) around the marks of a text."""
    text = text or ""
    spans: list[tuple[int, int]] = []
    for mark in MARKS.finditer(text):
        if spans and mark.end() <= spans[-1][1]:
            continue
        start, end = _sentence(text, mark)
        if spans and start < spans[-1][1]:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((start, end))
    groups: list[list[tuple[int, str]]] = []
    last = -2
    for start, end in spans:
        if last < 0 or start > last + REACH or len(words(text[last:start])) > GAP_WORDS:
            groups.append([])
        groups[-1].append((start, text[start:end]))
        last = end
    return groups


class Notice(NamedTuple):
    """A confirmed template in a text: from where to where its words stand there, and which differ."""

    license: str
    saved: float
    missing: tuple[str, ...]
    added: tuple[str, ...]
    start: int
    end: int
    heading: bool = False


class Scanner:
    """Compressors with the templates as dictionaries."""

    def __init__(self, templates: dict[str, tuple[str, ...]], titled: dict[tuple[str, ...], tuple[str, str]] | None = None):
        self.alone = zstandard.ZstdCompressor(level=3)
        self.titled = titled or {}
        self.longest = max(map(len, self.titled), default=0)
        self.entries = []
        for name, texts in templates.items():
            for text in texts:
                data = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.entries.append((
                    name, words(text), Counter(words(text)), Counter(w for w in words(text) if TELLING.fullmatch(w)),
                    zstandard.ZstdCompressor(level=3, dict_data=data)))

    def ranked(self, block: str, said: list[str], several: bool = False) -> list[tuple[float, str, list[str]]]:
        """(share of the compressed size saved, license, words of the template), the best first. Templates of whose words
        too few are said in any order are left out, also those of which a telling word is not said; `several` takes those
        that stand in several blocks."""
        counts = Counter(said)
        entries = [
            e for e in self.entries if (len(e[1]) > LONG_WORDS or not several)
            and all(counts[w] >= n for w, n in e[3].items())
            and sum(min(n, counts[w]) for w, n in e[2].items()) >= LEAST_MATCH * len(e[1])]
        if not entries:
            return []
        raw = block.encode("utf-8", "replace")
        size = len(self.alone.compress(raw))
        scores = [((size - len(c.compress(raw))) / size, name, template) for name, template, _, _, c in entries]
        return sorted(scores, key=lambda s: -s[0])

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def identify(self, block: str, several: bool = False) -> list[Notice]:
        """The notices of a text, in order."""
        text, found, low = Words(block), [], 0
        while low < len(text.said):
            high = min(low + WINDOW, len(text.said))
            found += self._between(text, low, high, several)
            if high == len(text.said):
                break
            low = max(high - WINDOW // 2, found[-1][1] if found else 0)
        if not found and not several:
            return self._heading(text)
        return [notice for _, _, notice in found]

    def _heading(self, text: Words) -> list[Notice]:
        """The license that a block names and says nothing else, but for the copyright line that may follow."""
        said = text.said[:self.longest + 1]
        size = said.index("copyright") if "copyright" in said else len(text.said)
        name, title = self.titled.get(tuple(text.said[:size]), (None, ""))
        if name is None:
            return []
        part = text.part(0, size).encode("utf-8", "replace")
        data = zstandard.ZstdCompressionDict(title.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        small, alone = len(zstandard.ZstdCompressor(level=3, dict_data=data).compress(part)), len(self.alone.compress(part))
        return [Notice(name, (alone - small) / alone, (), (), text.starts[0], text.ends[size - 1], True)]

    def _between(self, text: Words, low: int, high: int, several: bool) -> list[tuple[int, int, Notice]]:
        """(first word, word after the last, notice) of the notices in the words from `low` to `high`, in order."""
        found, waiting = [], [(low, high, range(0))]
        while waiting:
            low, high, lead = waiting.pop()
            hit = None
            if len(lead):
                at = _joined(text, low, high)
                hit = self._first(text, [*lead, *range(at, high)], several, at) if at else None
            if hit is None:
                lead, hit = range(0), self._first(text, range(low, high), several)
            if hit is None:
                continue
            found.append(hit)
            if not len(lead):
                lead = range(hit[0], hit[1])
                lead = lead[:next((i for i, w in enumerate(lead) if TELLING.fullmatch(text.said[w])), 0)]
                waiting.append((low, hit[0], range(0)))
            waiting.append((hit[1], high, lead))
        return sorted(found, key=lambda f: f[0])

    def _first(
        self, text: Words, places: Sequence[int], several: bool, joined: int | None = None,
    ) -> tuple[int, int, Notice] | None:
        """The first confirmed template, by rank, of the words at `places`. With `joined`, words before that place are
        the lead of another notice, and the stretch must use some of them and the word at `joined`."""
        if not len(places):
            return None
        said, listed = [text.said[i] for i in places], {j for j, i in enumerate(places) if i in text.listed}
        lead = 0 if joined is None else places.index(joined)
        part = text.part(places[lead], places[-1] + 1)
        if lead:
            part = f"{text.part(places[0], places[lead - 1] + 1)} {part}"
        for saved, name, template in self.ranked(part, said, several):
            match = differences(template, said, listed, lead)
            if match is not None:
                missing, added, first, end = match
                first, end = places[max(first, lead)], places[end - 1] + 1
                return first, end, Notice(name, saved, missing, added, text.starts[first], text.ends[end - 1])
        return None


def _joined(text: Words, low: int, high: int) -> int | None:
    """The place of the first word from `low` on that does not join, if the same sentence goes on until there."""
    at = next((i for i in range(low, high) if text.said[i] not in JOINING), None)
    if not at:
        return None
    between = text.text[text.ends[low - 1]:text.starts[at]]
    return at if between.strip() and not _STOP.search(between) else None


def differences(
    template: list[str], said: list[str], listed: Container[int] = (), lead: int = 0,
) -> tuple[tuple[str, ...], tuple[str, ...], int, int] | None:
    """The template's words that the block lacks, words inside the matched stretch that the template lacks, and where
    the stretch begins and ends; None when too many are missing or one of either tells licenses apart. Words at the
    places in `listed` number list items and are no additions. Of a sentence with the first `lead` words taken from the
    notice before, the stretch must have some of them and the next word."""
    pairs = [m for m in difflib.SequenceMatcher(None, template, said, autojunk=False).get_matching_blocks() if m.size]
    least = LEAST_MATCH * len(template)
    if sum(m.size for m in pairs) < least:
        return None
    before = [pairs[:i] for i in range(len(pairs) - 1, 0, -1) if said[pairs[i - 1].b + pairs[i - 1].size] in ("and", "or")]
    for chosen in (_together(pairs, least), pairs, *(b for b in before if sum(m.size for m in b) >= least)):
        kept = {i for m in chosen for i in range(m.a, m.a + m.size)}
        used = {i for m in chosen for i in range(m.b, m.b + m.size)}
        missing = tuple(w for i, w in enumerate(template) if i not in kept)
        low, high = min(used), max(used) + 1
        if lead and (low >= lead or lead not in used):
            continue
        added = tuple(said[i] for i in range(low, high) if i not in used and i not in listed)
        if not any(TELLING.fullmatch(w) for w in (*missing, *added)):
            return missing, added, low, high
    return None


def _together(pairs: list[difflib.Match], least: float) -> list[difflib.Match]:
    """The matches without chance ones far before or after the others."""
    pairs = list(pairs)
    for outer, inner in ((0, 1), (-1, -2)):
        while len(pairs) > 1 and sum(m.size for m in pairs) - pairs[outer].size >= least:
            one, two = sorted((pairs[outer], pairs[inner]))
            if two.b - one.b - one.size < max(STRAY_WORDS, pairs[outer].size):
                break
            del pairs[outer]
    return pairs


def group_notices(scanner: Scanner, text: str, group: list[tuple[int, str]]) -> list[tuple[int, int, Notice]]:
    """(start, length, notice) of every notice of neighbouring blocks. A block with several notices is divided among
    them; a notice over several blocks has all that lies from the first of them to the last. A heading counts where no
    notice of its license is among the others."""
    found, titles_only, left, begin = [], [], [], group[0][0]
    end = group[-1][0] + len(group[-1][1])
    for start, block in group:
        notices, low = scanner.identify(block), start
        if notices and notices[0].heading:
            titles_only.append((start, len(block), notices[0]))
            continue
        for i, notice in enumerate(notices):
            high = start + (len(block) if i == len(notices) - 1 else notice.end)
            found.append((low, high - low, notice))
            left.append((begin, start + notice.start))
            low, begin = high, start + notice.end
    if len(group) > 1:
        for low, high in [*left, (begin, end)]:
            for notice in scanner.identify(text[low:high], several=True):
                first = max([s for s, _ in group if low <= s <= low + notice.start], default=low)
                last = min([s + len(b) for s, b in group if low + notice.end <= s + len(b) <= high], default=high)
                found.append((first, last - first, notice))
    told = {notice.license for _, _, notice in found}
    return sorted([*found, *(t for t in titles_only if t[2].license not in told)], key=lambda f: f[0])


def scan_licenses(
    docs: DataFrame, text: str = "text", result: str = "licenses", templates: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """The documents with a struct `result`: the number of candidate blocks, and of every block that a template
    explains the license, its place in the text, the share saved and the words that differ. Nothing is shuffled."""
    chosen, titled = templates or all_templates(), None if templates else headings()
    docs = docs.drop(result)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, titled)
        for batch in batches:
            rows = []
            for doc in batch.column(batch.schema.names.index(text)):
                body = doc.as_py() or ""
                groups = blocks(body)
                found = [{
                    "license": k.license, "start": start, "length": length, "saved": k.saved, "missing": list(k.missing),
                    "added": list(k.added)} for group in groups for start, length, k in group_notices(scanner, body, group)]
                rows.append({"blocks": sum(map(len, groups)), "found": found})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], [*batch.schema.names, result])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(result, RESULT)]))


def license_names(result: str = "licenses"):
    """The distinct licenses of a scanned document, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.col(result)["found"], lambda x: x["license"])))
