"""Licence notices in texts: MinHash bands over overlapping windows, then exact containment.

A template of s shingles of five words is looked for in windows of 2 B shingles, B the next
power of two, that overlap by half, so one window holds any run of s shingles whole.
A window that holds at least SIMILAR of the template's shingles has a Jaccard similarity of at
least SIMILAR / 4 with it, and as many bands of one MinHash each are used as make it
collide with probability SURE.  A collision is verified on the words themselves.

The templates are a fixed short list, so they travel with the code; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gsx.llm.texts import word_lists
from gsx.session import ship

WORDS = 5
SIMILAR = 0.8
SURE = 0.999
#: Bands of one MinHash: 1 - (1 - SIMILAR / 4) ** BANDS >= SURE.
BANDS = math.ceil(math.log(1 - SURE) / math.log(1 - SIMILAR / 4))
#: Shingles that are windowed at once.
RUN = 40_000
_CACHE = 100_000

# fixed values: public licence notices
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0 International.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "all-rights-reserved": "All rights reserved. No part of this work may be reproduced without permission.",
}

_EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def normal(word: bytes) -> bytes:
    """Lower case (A-Z), without punctuation at the edges."""
    return word.strip(_EDGE).lower()


class _Hashes(dict):
    """Hash of a word as written, from its normal form; 0 for punctuation alone."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHE:
            self.clear()
        plain = normal(word)
        value = self[word] = (xxhash.xxh3_64_intdigest(plain) | 1) if plain else 0
        return value


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of every run of WORDS words."""
    n = max(len(words) - WORDS + 1, 0)
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + words[k : k + n]
    return _mixed(total, 0)


_SALTS = [int(x) for x in np.random.default_rng(11).integers(1, 2**63, BANDS)]


class Matcher:
    """Templates with their MinHashes by window size."""

    def __init__(self, templates: dict[str, str] = TEMPLATES) -> None:
        hashes = _Hashes()
        self.hashes = hashes
        self.names = sorted(templates)
        self.shingles, self.levels = {}, {}
        for name in self.names:
            words = [w for w in templates[name].encode().split() if hashes[w]]
            plain = [normal(w) for w in words]
            self.shingles[name] = {tuple(plain[k : k + WORDS]) for k in range(len(plain) - WORDS + 1)}
            found = shingle_hashes(np.array([hashes[w] for w in words], np.uint64))
            if not len(found):
                raise ValueError(f"template {name} has fewer than {WORDS} words")
            block = 1 << math.ceil(math.log2(len(found)))
            low = np.array([_mixed(found, salt).min() for salt in _SALTS])
            self.levels.setdefault(block, []).append((name, low))
        self.blocks = sorted(self.levels)

    def candidates(self, shingles: np.ndarray) -> Iterator[tuple[str, int, int]]:
        """(template, first shingle, end) of the windows that collide in a band."""
        if not len(shingles):
            return
        rows = np.stack([_mixed(shingles, salt) for salt in _SALTS])
        size = 1
        for block in self.blocks:
            while size < block:
                if rows.shape[1] % 2:
                    rows = np.concatenate([rows, rows[:, -1:]], axis=1)
                rows = np.minimum(rows[:, ::2], rows[:, 1::2])
                size *= 2
            windows = np.minimum(rows, np.concatenate([rows[:, 1:], rows[:, -1:]], axis=1))
            for name, low in self.levels[block]:
                for at in np.flatnonzero((windows == low[:, None]).any(0)):
                    yield name, int(at) * block, int(at + 2) * block

    def containment(self, name: str, words: list[bytes]) -> float:
        """Share of the template's shingles among those of ``words``."""
        own = self.shingles[name]
        there = {tuple(words[k : k + WORDS]) for k in range(len(words) - WORDS + 1)}
        return len(own & there) / len(own)

    def matches(self, data: bytes) -> dict[str, tuple[float, int]]:
        """Template -> (best containment, word at which its window begins), where at least SIMILAR."""
        best: dict[str, tuple[float, int]] = {}
        held: list[bytes] = []
        # windows near a cut are seen again with the next run
        overlap, base = 4 * self.blocks[-1] + WORDS, 0

        def look(words: list[bytes]) -> None:
            marks = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
            for name, low, high in self.candidates(shingle_hashes(marks)):
                # the words of a window and of the template's length to both sides
                wide = len(self.shingles[name])
                first = max(low - wide, 0)
                part = [normal(w) for w in words[first : high + wide + WORDS]]
                share = self.containment(name, part)
                if share >= SIMILAR and share > best.get(name, (0.0, 0))[0]:
                    best[name] = (share, base + low)

        for words in word_lists(data):
            held += [w for w in words if self.hashes[w]]
            while len(held) >= RUN:
                look(held[:RUN])
                held = held[RUN - overlap :]
                base += RUN - overlap
        look(held)
        return best


    def distinct(self, data: bytes) -> dict[str, tuple[float, int]]:
        """Matches without those that a near licence explains, and the short notices outside them.

        A template gives way to one of at least its containment whose window overlaps its own, if
        under half of the shingles that only it has are there.
        """
        from gsx.llm.notices import notices

        best, words = self.matches(data), None
        if len(best) > 1:
            words = [normal(w) for w in data.split() if self.hashes[w]]
        width = {n: 4 << math.ceil(math.log2(len(self.shingles[n]))) for n in best}
        kept = {}
        for name, (share, at) in best.items():
            own = self.shingles[name]
            for other, (more, place) in best.items():
                if other == name or at >= place + width[other] or place >= at + width[name]:
                    continue
                only = own - self.shingles[other]
                if more < share or (more == share and len(own) > len(self.shingles[other])):
                    continue
                first = max(at - len(own), 0)
                part = words[first : at + width[name] + len(own) + WORDS]
                there = {tuple(part[k : k + WORDS]) for k in range(len(part) - WORDS + 1)}
                if 2 * len(only & there) < len(only) or not only:
                    break
            else:
                kept[name] = (share, at)
        out = dict(kept)
        for name, byte in notices(data):
            if name not in out:
                at = sum(1 for w in data[:byte].split() if self.hashes[w])
                if not any(place <= at < place + width[n] for n, (_, place) in kept.items()):
                    out[name] = (1.0, at)
        return out


def _scan(templates: dict[str, str], distinct: bool = False):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates)
        find = matcher.distinct if distinct else matcher.matches
        for batch in batches:
            ids, names, shares, words = [], [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                for name, (share, at) in sorted(find(raw.as_py()).items()):
                    ids.append(doc_id)
                    names.append(name)
                    shares.append(share)
                    words.append(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batch.column(0).type),
                    pa.array(names, pa.string()),
                    pa.array(shares, pa.float64()),
                    pa.array(words, pa.int64()),
                ],
                names=["doc_id", "license", "containment", "word"],
            )

    return scanned


def license_matches(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] = TEMPLATES,
    distinct: bool = False,
) -> DataFrame:
    """(doc_id, license, containment, word): one row per document and template found in it.

    ``containment`` is the best share of the template's shingles in one window and its
    surroundings, at least SIMILAR; ``word`` numbers the word (punctuation alone does not count) at
    which that window begins.  NULL and empty texts, and those under five words, match
    nothing; repeated rows are scanned each; a NULL id is kept; other columns are ignored;
    an empty table gives no rows.  With ``distinct`` only the best of overlapping matches
    is reported, and short notices (containment 1) are found by their words.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _scan(templates, distinct), f"doc_id {kind}, license string, containment double, word bigint"
    )
