"""License scan by conditional compression.

Candidate blocks are the paragraphs (lines up to an empty one) with a license word in them. A block's words, in lower case and
without comment marks and punctuation, are compressed alone and with every wording as a raw dictionary; wordings are
ranked by the bytes they save. Each one that saves a fifth of its own size or more is aligned word by word with the block:
it is confirmed if at most one word in eight is changed, missing or added (``differences`` lists them), and no word that
makes the license's name or carries a digit is. ``licence`` is the same word as ``license``, ``v2``, ``v. 2.0``
and ``version 2`` are the same version. Of overlapping confirmed wordings the one with most equal words stays.

Defined results: a null text counts as empty; repeated rows are scanned separately; among wordings with as many equal
words the one that saves more stays, then the first in name order; an empty table gives an empty result; other columns are
not read. Texts are read whole: a block of more than ``PIECE`` words is weighed in pieces that overlap by more than the
longest wording, words longer than any in a wording count as one unknown word, and work is linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# What the licenses are called in notices.
CALLED: dict[str, list[str]] = {
    "AGPL-3.0": ["GNU Affero General Public License version 3"],
    "Apache-2.0": ["Apache License version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU GPL version 2"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU GPL version 3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License version 2.0"],
}
# How notices refer to a license by its name.
REFERENCES = ["licensed under the {}", "licensed under {}", "released under the {}", "distributed under the {}",
              "under the terms of the {}", "subject to the terms of the {}", "dedicated to the public domain under {}", "SPDX-License-Identifier: {}"]
# The wording of common license notices and of the leading paragraphs of short licenses.
NOTICES: dict[str, list[str]] = {
    "AGPL-3.0": [
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
        "you may not use this file except in compliance with the License"],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission"],
    "GPL-2.0": [
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version",
        "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "GPL-3.0": [
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies"],
    "LGPL-2.1": [
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
        "License, or (at your option) any later version"],
    "LGPL-3.0": [
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version"],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at"],
    "Proprietary": ["All rights reserved"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
# Words that tell the name of a license; they, and words with a digit, may not differ.
NAMING = frozenset("affero agpl apache bsd cc cc0 by nc sa attribution noncommercial sharealike general gnu gpl isc lesser lgpl mit mozilla mpl unencumbered".split())
_GAP = "[^A-Za-z0-9]+"
TRIGGER = ("(?i:licen[sc]e|permission" + _GAP + "(?:is" + _GAP + "hereby|to" + _GAP + "use)|redistribution" + _GAP + "and|neither" + _GAP + "the" + _GAP
           + "name|public" + _GAP + "domain|\\bgnu\\b|\\bcc0\\b|\\bcc" + _GAP + "by\\b|unencumbered|all" + _GAP + "rights" + _GAP + "reserved|copyright)")
_TRIGGER = re.compile(TRIGGER)
_WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")
_VERSION = re.compile(r"v([0-9]+(?:\.[0-9]+)*)")
_EMPTY_LINE = re.compile(r"\n[\x20\t\r*#/;-]*(?=\n)")
_PACKERS: list = []
#: A level that knows every position of a short dictionary (the fastest ones skip some).
LEVEL = 13
PIECE = 512
LONGEST_WORD = 40
NEVER = 1 << 20


class Word(NamedTuple):
    text: str
    start: int
    end: int


class Found(NamedTuple):
    start: int
    end: int
    name: str
    saved: float
    differences: tuple[tuple[str, str], ...]  # (wording's word, text's word); "" where one has none
    equal: int


def words(text: str, start: int = 0, end: int | None = None) -> list[Word]:
    """The words of a range of the text, each spelt one way; places are those in the text."""
    out: list[Word] = []
    for m in _WORD.finditer(text, start, len(text) if end is None else end):
        a, b = m.span()
        if b - a > LONGEST_WORD:
            out.append(Word("-", a, b))
            continue
        word = m.group().lower().replace("licence", "license")
        version = _VERSION.fullmatch(word)
        if version:
            out.append(Word("version", a, a + 1))
            a, word = a + 1, version.group(1)
        elif word == "v" and text[b : b + 1] in (".", " "):
            word = "version"
        out.append(Word(word[:-2] if word[0].isdigit() and word.endswith(".0") else word, a, b))
    return out


class Wording:
    """One wording of a license: its words, which of them may not differ, and a compressor primed with it."""

    def __init__(self, name: str, text: str, called: str = ""):
        import zstandard

        self.name = name
        self.words = [w.text for w in words(text)]
        naming = {w.text for w in words(called)}
        self.required = [w in NAMING or w in naming or any(c.isdigit() for c in w) for w in self.words]
        if len(self.words) < 8:
            self.required = [True] * len(self.words)
        self.must = {w for w, r in zip(self.words, self.required) if r}
        self.bound = len(self.words) // 8
        known = zstandard.ZstdCompressionDict((" " + " ".join(self.words) + " ").encode() * 2, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        self.packed = zstandard.ZstdCompressor(dict_data=known, write_content_size=False).compress

    def found(self, block: list[str]) -> list[tuple[int, int, tuple[tuple[str, str], ...]]]:
        """``first, last + 1, differences`` of the places where the wording stands, nearest first, none overlapping."""
        m, n = len(self.words), len(block)
        numbers: dict[str, int] = {}
        have = np.array([numbers.setdefault(w, len(numbers)) for w in block])
        at = np.arange(n + 1)
        rows = [np.zeros(n + 1, np.int64)]  # the wording may start anywhere
        for i, word in enumerate(self.words):
            cost = NEVER if self.required[i] else 1
            row = rows[-1] + cost  # the word is missing
            row[1:] = np.minimum(row[1:], rows[-1][:-1] + np.where(have == numbers.get(word, -1), 0, cost))
            if i + 1 < m and not (self.required[i] and self.required[i + 1]):
                row = np.minimum.accumulate(row - at) + at  # words are added after it
            rows.append(row)
        out: list[tuple[int, int, tuple[tuple[str, str], ...]]] = []
        ends = np.flatnonzero(rows[m] <= self.bound)
        used = np.zeros(n, bool)
        for end in ends[np.argsort(rows[m][ends], kind="stable")].tolist():
            if used[end - 1]:
                continue
            i, j, differences = m, end, []
            while i:
                here, cost = rows[i][j], NEVER if self.required[i - 1] else 1
                same = j > 0 and block[j - 1] == self.words[i - 1]
                if j and here == rows[i - 1][j - 1] + (0 if same else cost):
                    if not same:
                        differences.append((self.words[i - 1], block[j - 1]))
                    i, j = i - 1, j - 1
                elif here == rows[i - 1][j] + cost:
                    differences.append((self.words[i - 1], ""))
                    i -= 1
                else:
                    differences.append(("", block[j - 1]))
                    j -= 1
            if not used[j:end].any():
                used[j:end] = True
                out.append((j, end, tuple(reversed(differences))))
        return out


def packers() -> tuple[list[Wording], object]:
    """Every wording, and the plain compressor; built once per worker."""
    if not _PACKERS:
        import zstandard

        wordings = [Wording(name, text) for name, texts in NOTICES.items() for text in texts]
        wordings += [Wording(name, how.format(called), called) for name, all_called in CALLED.items() for called in all_called for how in REFERENCES[:-1]]
        wordings += [Wording(name, REFERENCES[-1].format(name), name) for name in sorted(CALLED.keys() | NOTICES.keys()) if name != "Proprietary"]
        wordings.sort(key=lambda w: (w.name, w.words))
        _PACKERS.extend([wordings, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress])
        for wording in wordings:  # what the wording itself takes
            own = " ".join(wording.words).encode()
            wording.size = len(_PACKERS[1](own)) - len(_PACKERS[1](b""))
    return _PACKERS[0], _PACKERS[1]


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of the paragraphs with a license word: lines up to empty ones, or ones with comment marks only."""
    start = 0
    for edge in [*(m.span() for m in _EMPTY_LINE.finditer(text)), (len(text), len(text))]:
        if _TRIGGER.search(text, start, edge[0]):
            yield start, edge[0]
        start = edge[1]


def ranked(block: list[str], least: float = 0.2) -> list[tuple[float, Wording]]:
    """Wordings that save ``least`` of their own size or more when known, by the bytes they save. Those with a word that may
    not differ and is not in the block cannot be confirmed and are not weighed."""
    wordings, plain = packers()
    inside = set(block)
    wordings = [w for w in wordings if w.must <= inside]
    if not wordings:
        return []
    data = (" " + " ".join(block) + " ").encode()
    alone = len(plain(data))
    saved = [(alone - len(w.packed(data)), w) for w in wordings]
    return sorted(((s, w) for s, w in saved if s >= least * w.size), key=lambda x: -x[0])


def licenses_in(text: str) -> list[Found]:
    """Every confirmed wording of the text, by place."""
    found: dict[tuple[int, int, str], Found] = {}
    for a, b in blocks(text):
        block = words(text, a, b)
        for k in range(0, max(1, len(block) - PIECE // 2), PIECE // 2):
            piece = block[k : k + PIECE]
            plain = [w.text for w in piece]
            for saved, wording in ranked(plain):
                for i, j, differences in wording.found(plain):
                    place = (piece[i].start, piece[j - 1].end, wording.name)
                    new = Found(*place, round(saved / wording.size, 3), differences, len(wording.words) - sum(bool(w) for w, _ in differences))
                    if place not in found or (found[place].equal, found[place].saved) < (new.equal, new.saved):
                        found[place] = new
    kept: list[Found] = []
    for one in sorted(found.values(), key=lambda x: (-x.equal, -x.saved, x.name, x.start)):
        k = bisect_left(kept, (one.start,))
        if (k == len(kept) or kept[k].start >= one.end) and (k == 0 or kept[k - 1].end <= one.start):
            kept.insert(k, one)
    # the clause about names makes three clauses of the two before it
    opening = None
    for k, one in enumerate(kept):
        if one.name == "BSD-2-Clause":
            opening = k
        elif one.name == "BSD-3-Clause" and opening is not None:
            kept[opening], opening = kept[opening]._replace(name="BSD-3-Clause"), None
    return kept


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_licenses, licenses, spans, n_differences, differences`` of every text: names in order of first place,
    ``name:start:end``, and what differs as ``wording's word>text's word``."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           *T.StructType.fromDDL("n_licenses long, licenses string, spans string, n_differences long, differences string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            n, names, spans = [0] * len(texts), [""] * len(texts), [""] * len(texts)
            differ, shown = [0] * len(texts), [""] * len(texts)
            for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, TRIGGER), False)).to_pylist():
                found = licenses_in(texts[i].as_py())
                n[i] = len(found)
                names[i] = ",".join(dict.fromkeys(x.name for x in found))
                spans[i] = ",".join(f"{x.name}:{x.start}:{x.end}" for x in found)
                differ[i] = sum(len(x.differences) for x in found)
                shown[i] = ",".join(f"{want}>{got}" for x in found for want, got in x.differences)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(names), pa.array(spans), pa.array(differ, pa.int64()), pa.array(shown)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
