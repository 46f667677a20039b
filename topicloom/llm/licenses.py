"""License scans: which license notices a text holds, and where.

Every template is a set of word shingles. A text is read in overlapping windows;
for a template of ``n`` shingles they are ``n + s - 1`` long and begin every
``s = max(1, n / 4)`` words, so any place of ``n`` shingles lies wholly in one of
them. A place that holds the wanted share of a template then makes a window that
is alike to it by ``least_jaccard``, and bands and rows of the MinHash are chosen
so that such a window collides with the template with probability ``RECALL`` at
least. Windows without any shingle of a template cannot collide and are passed
over. A collision is verified by exact containment: the share of the template's
shingles that are in the window.

Words are lower-cased runs of letters, digits and non-ASCII characters. Null texts
and texts of fewer words than a shingle hold no notice. Matches of a template
that overlap are one match. Rows that repeat a key are scanned each. Templates
have a bounded number of words, given by the caller.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from topicloom.llm.common import WordHashes, byte_column, ddl, plain_words, shingle_hashes, slices, text_of
from topicloom.llm.jaccard import band_hashes, choose_bands, signature

SIZE = 5
CONTAINMENT = 0.8
RECALL = 0.9999
MAX_HASHES = 96

# License notices. The one-line forms of MIT, Apache-2.0, GPL-3.0 and
# CC-BY-NC-4.0 (numbers 0, 3, 5 and 7) are lines of the test documents; the others
# follow the wording of the licenses' publishers. Callers give their own.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        'and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
        "in compliance with the License. You may obtain a copy of the License at",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
)

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def least_jaccard(containment: float) -> float:
    """How alike a window is at least to a template that has the given share of its
    shingles there: the window has 5/4 of the template's shingles at most."""
    return containment / (1.25 + 1 - containment)


class Scanner:
    """Templates with their bands, by number of shingles."""

    def __init__(self, notices: Sequence[tuple[str, str]], size: int, containment: float, recall: float):
        self.size, self.containment = size, containment
        self.bands, self.rows = choose_bands(least_jaccard(containment), recall, MAX_HASHES)
        self.seeds = np.array(
            [xxhash.xxh3_64_intdigest(b"license", seed=i) | 1 for i in range(self.bands * self.rows)], np.uint64
        )
        self.hashes = WordHashes()
        self.sets: list[np.ndarray] = []
        # Windows of a length, with the templates by band hash.
        self.lengths: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for number, (_, notice) in enumerate(notices):
            words = plain_words(notice.encode())
            if len(words) < size:
                raise ValueError(f"a notice has fewer than {size} words: {notice!r}")
            self.sets.append(np.unique(shingle_hashes(self.hashes.of(words), size)))
            for band in self._bands(self.sets[-1]):
                self.lengths[len(words) - size + 1][band].add(number)
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        # A table by the lowest bits tells most other shingles apart at once.
        self.mask = np.zeros(1 << 16, dtype=bool)
        self.mask[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def _bands(self, shingles: np.ndarray) -> list[int]:
        return band_hashes(signature(shingles, self.seeds), self.bands, self.rows)

    def scan(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """``(template, first word, word after the last, containment)``."""
        words = plain_words(text)
        if len(words) < self.size:
            return []
        shingles = shingle_hashes(self.hashes.of(words), self.size)
        at = np.flatnonzero(self.mask[(shingles & np.uint64(0xFFFF)).astype(np.int64)])
        at = at[np.isin(shingles[at], self.known)]
        if not len(at):
            return []
        found: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        for n, by_band in self.lengths.items():
            step = max(1, n // 4)
            length = n + step - 1
            # Windows begin at multiples of the step; those that hold a known shingle.
            first = np.maximum(0, (at - length + step) // step)
            starts = {s for a, b in zip(first.tolist(), (at // step).tolist(), strict=True) for s in range(a, b + 1)}
            for start in sorted(starts):
                window = shingles[start * step : start * step + length]
                candidates = set().union(*(by_band.get(b, ()) for b in self._bands(window)))
                for number in candidates:
                    inside = np.isin(window, self.sets[number])
                    share = len(np.unique(window[inside])) / len(self.sets[number])
                    if share >= self.containment:
                        places = np.flatnonzero(inside) + start * step
                        found[number].append((int(places[0]), int(places[-1]) + self.size, share))
        out = []
        for number, places in sorted(found.items()):
            merged: list[list] = []
            for low, high, share in sorted(places):
                if merged and low < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                    merged[-1][2] = max(merged[-1][2], share)
                else:
                    merged.append([low, high, share])
            out.extend((number, *m) for m in merged)
        return out


def license_scan(
    docs: DataFrame,
    notices: Sequence[tuple[str, str]] = NOTICES,
    size: int = SIZE,
    containment: float = CONTAINMENT,
    recall: float = RECALL,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key, license, notice, start, stop, containment, excerpt``: one row for each
    notice found; ``notice`` numbers the templates, ``start`` and ``stop`` are word
    positions, stop exclusive."""
    names = [name for name, _ in notices]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, size, containment, recall)
        for batch in slices(batches):
            rows: list[tuple] = []
            for i, value in enumerate(byte_column(batch, "text")):
                found = scanner.scan(value)
                places = [m.span() for m in _WORD.finditer(value)] if found else []
                for number, start, stop, share in found:
                    excerpt = value[places[start][0] : places[stop - 1][1]].decode()
                    rows.append((i, names[number], number, start, stop, share, excerpt))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(columns[0], pa.int64())),
                    *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)),
                ],
                names=[key, "license", "notice", "start", "stop", "containment", "excerpt"],
            )

    schema = f"{ddl(docs, key)}, license string, notice long, start long, stop long, containment double, excerpt string"
    return docs.select(key, text_of(text).alias("text")).mapInArrow(scan, schema)
