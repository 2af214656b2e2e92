"""License scans by conditional compression (operator 4).

Candidate blocks are the neighbourhoods of words of licensing (``CUE``): ``REACH`` characters to both sides of each such word, on to the ends of their lines; neighbourhoods that meet are one
block. A block is compressed alone and with each template as a raw zstandard dictionary, and templates are ranked by the bytes that they save. In that order they are held against the exact wording:
a template's words in order, where ``*`` stands for any words of the user's own (names), however many. Case, signs, line breaks and comment marks don't count. A winner takes the words that confirm
it, so a template further down is confirmed by words of its own alone: where wordings overlap, the gain decides. A wording begins in its block; what follows a ``*`` may stand anywhere after it.
Headings (wordings of up to ``HEADING`` words) aren't confirmed where one of the ``DENIALS`` is among the four words before them.

With ``max_difference``, words that a block lacks or has too many are counted by an alignment of all its words, whatever its length.

Edge cases: null and empty texts have no blocks; texts without such words give no rows; blocks have no limit of length; a block without a confirmed license has one row with a null license. Rows are
one for each block and license, so repeated documents give repeated rows; an empty table gives none; extra columns stay out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_NOTICE = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY * \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."

#: Wordings by license: fixed values, from the licenses and their recommended notices.
TEMPLATES = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", _MIT + _NOTICE],
    "ISC": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-2-Clause": ["Released under the 2-Clause BSD License.", f"{_BSD} {_BSD_END}"],
    "BSD-3-Clause": ["Released under the 3-Clause BSD License.", f"{_BSD} 3. Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0."],
    "EPL-2.0": ["Eclipse Public License - v 2.0"],
    "GPL-2.0-only": ["you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation", "under the terms of the GNU General Public License version 2 only"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This work is licensed under the GNU General Public License, version 2.", _GNU.format("General Public License", 2)],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This work is licensed under the GNU General Public License, version 3.", _GNU.format("General Public License", 3)],
    "LGPL-2.1": [_GNU.format("Lesser General Public License", "2.1")],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This work is licensed under the GNU Lesser General Public License, version 3.", _GNU.format("Lesser General Public License", 3)],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This work is licensed under the GNU Affero General Public License, version 3.", _GNU.format("Affero General Public License", 3)],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0", "dedicated to the public domain under CC0 1.0"],
}
CUE = r"(?i)licen[cs]e|public\W{1,9}domain|redistribut|hereby\W{1,9}granted|free\W{1,9}software|\bCC0\b|\bCC BY\b"
#: Words that deny the heading after them: fixed values.
DENIALS = {"not", "never", "no", "nor", "neither", "without", "cannot", "isn", "aren", "wasn", "longer", "except", "unlike"}
REACH, HEADING = 2000, 12
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*|\*")
ROWS = "doc_id long, block int, start int, end int, license string, nearest string, saved double, n_different int, confirmed boolean"


def words_of(text: str) -> list[str]:
    """Words in lower case, without stars; a number at a line's or sentence's start ("1.") is a word."""
    return [w for w in WORD.findall(text.lower()) if w != "*"]


class Line:
    """A text's words, each after a blank, as one string; words that a license took are blotted out."""

    def __init__(self, text: str):
        found = [(m[0], m.start()) for m in WORD.finditer(text.lower() if len(text.lower()) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)) if m[0] != "*"]
        self.words, self.places = [w for w, _ in found], np.array([p for _, p in found], dtype=np.int64)
        self.text = f"{''.join(' ' + w for w in self.words)} "

    def word_at(self, place: int) -> int:
        """The first word at a place of the original or after it."""
        return int(np.searchsorted(self.places, place))

    def offset(self, word: int) -> int:
        """Where a word's blank stands in text."""
        return sum(len(w) + 1 for w in self.words[:word])

    def take(self, spans: list[tuple[int, int]]) -> None:
        for a, b in spans:
            self.text = self.text[:a] + re.sub("[^ ]", "\0", self.text[a:b]) + self.text[b:]


class Template:
    def __init__(self, license: str, text: str, level: int):
        self.license, self.words = license, WORD.findall(text.lower())
        self.plain = [w for w in self.words if w != "*"]
        self.needs = Counter(self.plain)
        self.parts = [f" {p.strip()} " for p in f" {' '.join(self.words)} ".split(" * ")]
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def found(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Where the parts stand in a line: the first begins in start..end, each next one anywhere after. As what lies between is free, the leftmost places will do. A heading after a denial isn't found."""
        at = start
        while 0 <= (at := text.find(self.parts[0], at)) < end:
            if len(self.plain) > HEADING or not DENIALS & {*text[max(0, at - 80) : at].split()[-4:]}:
                break
            at += 1
        if not 0 <= at < end:
            return []
        spans = [(at, at + len(self.parts[0]))]
        for part in self.parts[1:]:
            at = text.find(part, spans[-1][1] - 1)
            if at < 0:
                return []
            spans.append((at, at + len(part)))
        return spans

    def difference(self, words: list[str]) -> int:
        """The fewest words that the best stretch of a block lacks or has beside the template's, by a row of costs a word of the template."""
        block = np.array(words, dtype=object)
        cost, places = np.zeros(len(words) + 1, dtype=np.int64), np.arange(len(words) + 1)
        for w in self.words:
            if w == "*":
                cost = np.minimum.accumulate(cost)
                continue
            lacks = cost + 1
            lacks[1:] = np.where(block == w, np.minimum(lacks[1:], cost[:-1]), lacks[1:])
            cost = np.minimum.accumulate(lacks - places) + places
        return int(cost.min())


class Ranker:
    def __init__(self, templates: dict[str, list[str]], level: int = 3):
        self.templates = [Template(name, text, level) for name, texts in templates.items() for text in texts]
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)

    def rank(self, block: str) -> list[tuple[float, Template]]:
        """Share of bytes saved and template, the best first."""
        data = block.encode()
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(t.compressor.compress(data)) / alone, t) for t in self.templates), key=lambda x: -x[0])

    def licenses(self, block: str, max_difference: int = 0, line: Line | None = None, start: int = 0) -> list[tuple[str | None, str, float, int, bool]]:
        """license (null: none confirmed), nearest, saved, difference, confirmed: for each confirmed license, or once for the best-ranked template. line: the whole text's, in which the block begins at
        start; else the block is the whole text."""
        line, ranked, found = line or Line(block), self.rank(block), {}
        first, past = line.word_at(start), line.word_at(start + len(block))
        words, a = line.words[first:past], line.offset(first)
        b, has = a + sum(len(w) + 1 for w in words), Counter(words)
        for saved, t in ranked:
            if (len(t.parts) == 1 and (t.needs - has).total() > max_difference) or t.license in found:
                continue
            if spans := t.found(line.text, a, b):
                line.take(spans)
                found[t.license] = (t.license, t.license, saved, 0, True)
            elif max_difference and len(t.plain) > HEADING and (n := t.difference(words)) <= max_difference:
                found[t.license] = (t.license, t.license, saved, n, True)
        saved, best = ranked[0]
        return [*found.values()] or [(None, best.license, saved, max(1, best.difference(words)), False)]


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """The neighbourhoods of cues in whole lines: place (code points, end exclusive) and text."""
    run = None
    for m in re.finditer(CUE, text):
        if run and m.end() + REACH <= run[1]:
            continue
        a, b = text.rfind("\n", 0, max(0, m.start() - REACH)) + 1, text.find("\n", m.end() + REACH)
        b = len(text) if b < 0 else b
        if run and a <= run[1] + 1:
            run = (run[0], max(b, run[1]))
            continue
        if run:
            yield *run, text[run[0] : run[1]]
        run = (a, b)
    if run:
        yield *run, text[run[0] : run[1]]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, max_difference: int = 0) -> DataFrame:
    """A row for each candidate block of docs (doc_id, text) and confirmed license, or one with a null license; confirmed: at most max_difference words of the wording differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(templates or TEMPLATES)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                line = Line(text)
                for n, (start, end, block) in enumerate(blocks(text)):
                    rows += [(doc_id, n, start, end, name, nearest, round(saved, 6), different, sure) for name, nearest, saved, different, sure in ranker.licenses(block, max_difference, line, start)]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in ROWS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(CUE)).mapInArrow(run, ROWS)
