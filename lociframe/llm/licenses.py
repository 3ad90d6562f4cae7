"""License scans.

Shingles are five words. Each template is looked for in windows of a document's shingles that are at least as long as
two times the template and overlap by half, so that an occurrence always lies whole in some window. Windows are built
from blocks: the MinHash of a window is the least of its blocks' values, and blocks of one level are pairs of the level
below, so a shingle is hashed once per MinHash function at all levels together.

BANDS bands of one row retrieve templates: a template is a candidate of a window if they share a MinHash value. A window
that holds 0.8 of a template's shingles has a Jaccard similarity of at least LEAST_JACCARD with it, so the chance that
no band agrees is at most (1 - LEAST_JACCARD) ** BANDS. Candidates are verified exactly: the share of the template's
distinct shingles, compared word by word, that stand in the window must reach CONTAINMENT.

Defined results: null and empty texts, and texts of fewer than five words, match nothing; a template found in several
windows is listed once, at its best window and there at its first shingle (ties: the first window); templates of fewer
than five words are refused; rows are judged one by one, so repeated rows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.base import text_function
from lociframe.llm.bytewords import Words, mixed, normalise, shingle_hashes, words_at, words_of

SHINGLE, CONTAINMENT = 5, 0.8
BLOCK = 4  # shingles of a block at the lowest level; a window there is two blocks
BANDS = 64
#: 0.8 n of n shingles in a window of at most 4 n, n > 1; for a template of one shingle in a window of 8 it is 1 / 8.
LEAST_JACCARD = 0.125
MISS = (1 - LEAST_JACCARD) ** BANDS  # 0.0002
RESULT = "array<struct<license:string,containment:double,start:long>>"

#: Phrases by which licenses are stated, by identifier.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_RNG = np.random.default_rng(17)
_FACTORS = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Templates:
    """`shingles`: distinct shingles of each; `level` of each; `keys[level][band]`: sorted MinHash values and the template of each."""

    names: list[str]
    shingles: list[set[bytes]]
    level: list[int]
    keys: dict[int, list[tuple[np.ndarray, np.ndarray]]]


def shingle_set(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def compile_templates(templates: dict[str, str]) -> Templates:
    names = sorted(templates)
    sets, levels, values = [], [], []
    for name in names:
        words = normalise(templates[name]).split()
        if len(words) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        sets.append(shingle_set(words))
        n = len(words) - SHINGLE + 1
        levels.append(max(0, int(np.ceil(np.log2(n / BLOCK)))))
        hashes, _ = shingle_hashes(words_of(pa.array([templates[name]])), SHINGLE)
        values.append([band_values(hashes, b).min() for b in range(BANDS)])
    keys = {}
    for level in sorted(set(levels)):
        own = np.array([k for k, x in enumerate(levels) if x == level])
        keys[level] = []
        for b in range(BANDS):
            found = np.array([values[k][b] for k in own], np.uint64)
            order = np.argsort(found, kind="stable")
            keys[level].append((found[order], own[order]))
    return Templates(names, sets, levels, keys)


def band_values(hashes: np.ndarray, band: int) -> np.ndarray:
    return mixed(hashes * _FACTORS[band])


def _block_starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First entry of each run of `width` entries inside each text, and the number of runs of each text."""
    runs = -(-counts // width)
    before = np.cumsum(counts) - counts
    within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(before, runs) + width * within, runs


def candidates(w: Words, t: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Retrieved windows: first word, words, and template."""
    hashes, at = shingle_hashes(w, SHINGLE)
    if not len(hashes):
        return (np.zeros(0, np.int64),) * 3
    counts = np.bincount(w.text_of(at), minlength=len(w.first) - 1)
    counts = counts[counts > 0]
    plan = []  # per level: starts of its blocks among those below, whether the next block is of the same text
    n, below = counts, BLOCK
    firsts = np.arange(len(hashes))
    for level in range(max(t.keys) + 1):
        starts, n = _block_starts(n, below)
        firsts = firsts[starts]
        joins = np.ones(len(starts), bool)
        joins[np.cumsum(n) - 1] = False
        plan.append((starts, joins, firsts))
        below = 2
    found = {level: [] for level in t.keys}
    for band in range(BANDS):
        values = band_values(hashes, band)
        for level, (starts, joins, _) in enumerate(plan):
            values = np.minimum.reduceat(values, starts)
            if level in t.keys:
                window = values.copy()
                window[:-1] = np.where(joins[:-1], np.minimum(values[:-1], values[1:]), values[:-1])
                keys, own = t.keys[level][band]
                low, high = np.searchsorted(keys, window), np.searchsorted(keys, window, side="right")
                hit = np.flatnonzero(high > low)
                for i in hit.tolist():
                    found[level] += [(i, k) for k in own[low[i] : high[i]].tolist()]
    rows = []
    ends = np.append(np.cumsum(counts), 0)
    text = np.repeat(np.arange(len(counts)), counts)
    for level, pairs in found.items():
        width = 2 * BLOCK << level
        for i, k in sorted(set(pairs)):
            first = plan[level][2][i]
            last = min(first + width, ends[text[first]]) - 1  # shingles first .. last
            rows.append((at[first], at[last] + SHINGLE - at[first], k))
    return tuple(np.array([r[j] for r in rows], np.int64) for j in range(3))


def scan(texts: pa.Array, t: Templates) -> list[list[tuple[str, float, int]]]:
    """Licenses of each text: name, containment, number of the first word that belongs to it."""
    w = words_of(texts)
    best: list[dict[int, tuple[float, int]]] = [{} for _ in range(len(texts))]
    starts, widths, kinds = candidates(w, t)
    order = np.lexsort((kinds, starts))
    docs = w.text_of(starts)
    for i in order.tolist():
        a, k, doc = int(starts[i]), int(kinds[i]), int(docs[i])
        words = words_at(w, a, a + int(widths[i]))
        own = [b" ".join(words[j : j + SHINGLE]) for j in range(len(words) - SHINGLE + 1)]
        share = len(t.shingles[k].intersection(own)) / len(t.shingles[k])
        if share >= CONTAINMENT and share > best[doc].get(k, (0.0, 0))[0]:
            first = next(j for j, s in enumerate(own) if s in t.shingles[k])
            best[doc][k] = (share, a + first - int(w.first[doc]))
    return [[(t.names[k], share, at) for k, (share, at) in sorted(b.items())] for b in best]


def license_column(text: Column, templates: dict[str, str] = TEMPLATES) -> Column:
    def make():
        compiled = compile_templates(templates)

        def run(texts: pa.Array) -> pa.Array:
            found = scan(texts, compiled)
            kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int64())]))
            return pa.array([[{"license": a, "containment": b, "start": c} for a, b, c in f] for f in found], kind)

        return run

    return text_function(make, RESULT)(text)


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, `n_licenses`, `licenses` (comma-joined, by name), `best` containment (null if none)."""
    found = docs.select(F.col(id_col).alias("id"), license_column(F.col(text_col), templates).alias("found"))
    return found.select(
        F.col("id").alias(id_col),
        F.size("found").cast("long").alias("n_licenses"),
        F.array_join(F.transform("found", lambda x: x["license"]), ",").alias("licenses"),
        F.array_max(F.transform("found", lambda x: x["containment"])).alias("best"),
    )
