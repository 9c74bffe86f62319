"""License statements in documents, by MinHash bands over overlapping windows of words.

Words are compared in small letters without marks around them; a word of marks alone (a comment sign) doesn't count.
A template matches a window if at least 0.8 of its distinct shingles of five words are in it (fewer words: the template is
one shingle). Templates are put into classes by size. For a class of at most u shingles, documents are cut into
windows of 2u shingles, each u after the one before, so that any run of u shingles lies within one window. A window
that matches has a similarity of at least some J to the template, which the sizes give; with one hash a band, b bands miss
it with probability (1 - J)**b, and b is set so that this is below one in a thousand million. Windows that collide in a
band with a template are verified by exact containment. Windows that hold no shingle of any template can't match and
get no signature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.words import LARGE_MEMO, blobs, mixed, shingles, text_batches

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-9
_MARKS = b".,;:!?\"'()[]{}<>*#/|&%$=+-_~`"

# The texts by which well-known licenses are stated.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0-warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License."),
    ("mit-licensed", "This project is licensed under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
     "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


class Plain(dict):
    """A 64-bit number for a word without marks, 0 for marks alone."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= LARGE_MEMO:
            self.clear()
        clean = word.lower().strip(_MARKS)
        code = self[word] = (xxhash.xxh64_intdigest(clean, 3) | 1) if clean else 0
        return code


def codes_of(text: bytes, memo: Plain) -> np.ndarray:
    words = text.split()
    codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return codes[codes != 0]


def bands(largest: int, containment: float, miss: float = MISS) -> int:
    """Bands of one hash for a class of templates of more than ``largest`` / 2 and at most ``largest`` shingles."""
    least = largest // 2 + 1
    similar = containment * least / (2 * largest + (1 - containment) * least)
    return math.ceil(math.log(miss) / math.log(1 - min(similar, 0.999)))


class Templates:
    """Shingles, classes and bands of the templates."""

    def __init__(self, templates: Sequence[tuple[str, str]], containment: float, k: int):
        memo, self.k, self.containment = Plain(), k, containment
        self.names = [name for name, _ in templates]
        self.sets = [np.unique(shingles(codes_of(text.encode(), memo), k)) for _, text in templates]
        if any(len(s) == 0 for s in self.sets):
            raise ValueError("a template needs a word")
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, np.uint64)
        self.classes: dict[int, tuple[np.ndarray, dict]] = {}
        for t, own in enumerate(self.sets):
            largest = 1 << (len(own) - 1).bit_length()
            if largest not in self.classes:
                seeds = mixed(np.arange(1, bands(largest, containment) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                self.classes[largest] = seeds, {}
            seeds, tables = self.classes[largest]
            for band, low in enumerate(signature(own, seeds).tolist()):
                tables.setdefault((band, low), []).append(t)


def signature(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return mixed(hashes[None, :] ^ seeds[:, None]).min(axis=1)


def windows_with(hit: np.ndarray, n: int, largest: int) -> list[tuple[int, int]]:
    """Windows of 2 * ``largest`` shingles, ``largest`` apart, that hold one of the positions ``hit``."""
    at = np.unique(np.concatenate((hit // largest, np.maximum(hit // largest - 1, 0))))
    return [(a, min(a + 2 * largest, n)) for a in (at * largest).tolist() if a < n]


def scan(codes: np.ndarray, known: Templates) -> list[tuple[int, int, int, float]]:
    """(template, windows that match, first word of the best, its containment) of a document's words."""
    hashes = shingles(codes, known.k)
    hit = np.flatnonzero(np.isin(hashes, known.all)) if len(hashes) else np.empty(0, np.int64)
    best: dict[int, tuple[int, int, float]] = {}
    if not len(hit):
        return []
    for largest, (seeds, tables) in known.classes.items():
        for start, end in windows_with(hit, len(hashes), largest):
            part = np.unique(hashes[start:end])
            found = set()
            for band, low in enumerate(signature(part, seeds).tolist()):
                found.update(tables.get((band, low), ()))
            for t in found:
                share = np.isin(known.sets[t], part, assume_unique=True).sum() / len(known.sets[t])
                if share >= known.containment:
                    first = start + int(np.flatnonzero(np.isin(hashes[start:end], known.sets[t]))[0])
                    n, at, top = best.get(t, (0, first, 0.0))
                    best[t] = (n + 1, first if share > top else at, max(top, float(share)))
    return [(t, *x) for t, x in sorted(best.items())]


def licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, k: int = SHINGLE) -> DataFrame:
    """(doc_id, license, n_windows, first_word, containment): a row for each template that a document matches.

    ``first_word`` counts the words that aren't marks alone, from 0. Null and empty texts match nothing; each row of ``docs`` is
    scanned by itself, so repeated rows give equal matches, and an empty table none.
    """
    known = Templates(templates, containment, k)
    text_batches(docs.sparkSession)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Plain()
        for b in batches:
            rows = [(i, known.names[t], n, at, share) for i, text in zip(b.column("doc_id").to_pylist(), blobs(b), strict=True)
                    for t, n, at, share in scan(codes_of(text, memo), known)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             ["doc_id", "license", "n_windows", "first_word", "containment"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scanned, "doc_id long, license string, n_windows long, first_word long, containment double")
