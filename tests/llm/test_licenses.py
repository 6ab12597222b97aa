"""Licenses: planted notices with changes, brute-force alignment, long blocks."""

import random
import textwrap
import time

import pytest

from packetloom.llm import licenses as L

GPL3 = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by "
        "the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
MIT = L.NOTICES["MIT"][0]


def names(text):
    return [x.name for x in L.licenses_in(text)]


@pytest.mark.parametrize("text, want", [
    (GPL3.format("", 3), ["GPL-3.0"]), (GPL3.format("", 2), ["GPL-2.0"]), (GPL3.format("Lesser ", "2.1"), ["LGPL-2.1"]), (GPL3.format("Affero ", 3), ["AGPL-3.0"]),
    ("Licensed under the Apache Licence, Version 2.0", ["Apache-2.0"]), ("distributed under the terms of the GNU General Public License v2", ["GPL-2.0"]),
    ("// SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0"]), ("# SPDX-License-Identifier: MIT", ["MIT"]), ("SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
    ("// Copyright 2009 The Authors.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.", ["BSD-3-Clause"]),
    ("under the terms of the GNU Nonsense License version 2", []), ("the license was renewed and the copyright holder paid", [])])
def test_notices(text, want):
    assert names(text) == want


def test_bsd_with_two_and_three_clauses():
    opening, clause = L.NOTICES["BSD-2-Clause"][0] + ":", L.NOTICES["BSD-3-Clause"][1].replace("the copyright holder", "Widget Corp")
    assert names(opening + "\n\n1. Keep the notice.") == ["BSD-2-Clause"]
    assert names(opening + "\n\n3. " + clause) == ["BSD-3-Clause", "BSD-3-Clause"]


def test_every_wording_has_a_license_word_and_fits_a_piece():
    for w in L.packers()[0]:
        assert L._TRIGGER.search(" ".join(w.words)) and len(w.words) + w.bound < L.PIECE // 2 and max(map(len, w.words)) <= L.LONGEST_WORD


def alignments(wording, block):
    """Smallest number of differences over all stretches of the block, word by word."""
    best = L.NEVER
    for start in range(len(block) + 1):
        row = [0] + [L.NEVER] * (len(block) - start)
        for i, w in enumerate(wording.words):
            cost = L.NEVER if wording.required[i] else 1
            new = []
            for j in range(len(row)):
                c = row[j] + cost
                if j:
                    c = min(c, row[j - 1] + (0 if block[start + j - 1] == w else cost))
                    if i + 1 < len(wording.words) and not (wording.required[i] and wording.required[i + 1]):
                        c = min(c, new[j - 1] + 1)
                new.append(c)
            row = new
        best = min(best, min(row))
    return best


def test_alignment_against_brute_force():
    rng = random.Random(3)
    for wording in rng.sample([w for w in L.packers()[0] if 8 <= len(w.words) <= 40], 12):
        for changes in (0, 1, 2, 5):
            block = ["some", "words"] + list(wording.words) + ["after", "it"]
            for _ in range(changes):
                k = rng.randrange(len(block))
                block[k : k + 1] = rng.choice([[], ["other"], [block[k], "more"]])
            best, got = alignments(wording, block), wording.found(block)
            assert bool(got) == (best <= wording.bound)
            if got:
                assert len(got[0][2]) == best


def test_planted_notices_are_found_and_plain_texts_are_not():
    rng = random.Random(5)
    vocabulary = "the license of this software is free to use and copy under terms that a person may obtain notice version permission rights public code".split()
    notices = [(n, t) for n, texts in L.NOTICES.items() for t in texts if len(L.words(t)) >= 16]
    caught = 0
    for k in range(200):
        filler = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(2)]
        assert not L.licenses_in("\n\n".join(filler))
        name, notice = notices[k % len(notices)]
        parts = notice.split(" ")
        free = [i for i, p in enumerate(parts) if p.isalpha() and p.islower() and p not in L.NAMING]
        parts[rng.choice(free)] = "changed"
        wrapped = textwrap.indent(textwrap.fill(" ".join(parts), 50), " * ", lambda _: True)
        caught += name in names(filler[0] + "\n" + wrapped + "\n" + filler[1])
    assert caught == 200


def test_long_block_and_differences(spark, docs_of):
    rng = random.Random(7)
    filler = " ".join(rng.choice(["licensed", "under", "the", "word", "copyright"]) for _ in range(20_000))
    changed = MIT.replace("merge", "mingle").replace("sublicense, ", "")
    text = filler + " " + changed + " " + filler + " " + "license" * 40_000
    start = time.time()
    found = L.licenses_in(text)
    assert time.time() - start < 20
    assert [(x.name, x.start, x.end) for x in found] == [("MIT", len(filler) + 1, len(filler) + 1 + len(changed))]
    assert found[0].differences == (("merge", "mingle"), ("sublicense", ""))
    row = L.scan_licenses(docs_of([(1, changed)])).first()
    assert (row.n_licenses, row.licenses, row.n_differences, row.differences) == (1, "MIT", 2, "merge>mingle,sublicense>")
