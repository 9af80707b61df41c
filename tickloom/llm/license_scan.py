"""License scans by MinHash over overlapping windows of words.

Templates are split into words (A-Z lower-cased, ASCII punctuation parts words) and three-word shingles. For every template length
n, each text's windows of n words, one from every place, get a MinHash of BANDS x ROWS values by sliding minima; a window whose band equals a
template's band is a candidate. At Jaccard s a candidate is missed with probability (1 - s**ROWS)**BANDS: 0.0008 at 0.36, which is a window's
least where 0.8 of a template are spread evenly over 1.5 of its length; 2e-8 at 0.667 (0.8 in one window); none at 1.
Candidates are verified by exact containment in a span wider by half a template on both sides: of a template's distinct shingles, the share that the
span holds must be ``least`` or more, so that inserted words don't push out what is there. A match is a shortest part of the span that
holds so many. Of overlapping matches with the same template the best, then the shortest, then the leftmost is kept. Whole texts are read, all windows
counted, those too that a text is too short to fill.

Null or empty text: no match. Templates under three words can't be used. Repeated rows and null ids pass through, one result per row.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map
from .textkernel import _LANE, _LOWER, Block, blocks, mix, windows

SHINGLE, BANDS, ROWS = 3, 16, 1
LEAST = 0.8
#: Well-known notices, fixed values.
TEMPLATES: Mapping[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
}
_PLAIN = _LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum() and b != 10]] = 32


def _shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of three-word shingles from each word of a block, those that run out of a text too, and the first such word of each text."""
    h = block.hashes(lower=False)
    return windows(h, SHINGLE) if len(h) >= SHINGLE else np.zeros(0, np.uint64), block.bounds


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def _bands(shingles: np.ndarray, width: int):
    """For each band the keys of all runs of ``width`` shingles."""
    for b in range(BANDS):
        key = np.zeros(max(len(shingles) - width + 1, 0), np.uint64)
        for r in range(ROWS):
            i = b * ROWS + r
            key = key * np.uint64(0x9E3779B97F4A7C15) + _minima((shingles ^ _LANE[i]) * _LANE[32 + i], width)
        yield mix(key)


class Scanner:
    def __init__(self, templates: Mapping[str, str], least: float) -> None:
        self.least, self.by_width = least, {}
        for name in sorted(templates):
            buf = _PLAIN[np.frombuffer(templates[name].encode(), np.uint8)]
            s, _ = _shingles(Block(buf, np.array([0, len(buf)])))
            if not len(s):
                raise ValueError(f"template {name!r} has under {SHINGLE} words")
            self.by_width.setdefault(len(s), []).append((name, s, [k[0] for k in _bands(s, len(s))]))

    def __call__(self, column: pa.Array) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(column))]
        for first, buf, off in blocks(column):
            block = Block(_PLAIN[buf], off)
            s, bounds = _shingles(block)
            for width, templates in self.by_width.items():
                hits: dict[str, set[int]] = {}
                keys = np.array([t[2] for t in templates], np.uint64)
                # so that a last text of under ``width`` shingles has a window
                for b, k in enumerate(_bands(np.concatenate([s, np.zeros(width - 1, np.uint64)]), width)):
                    some = np.flatnonzero(np.isin(k, keys[:, b]))
                    for name, _, own in templates:
                        at = some[k[some] == own[b]]
                        if len(at):
                            hits.setdefault(name, set()).update(at.tolist())
                for name, own, _ in templates:
                    if name in hits:
                        self._verify(out, first, block, bounds, s, width, name, own, hits[name])
        for found in out:
            found.sort(key=lambda m: (m["start"], m["license"]))
        return out

    def _verify(self, out, first, block, bounds, s, width, name, own, hits) -> None:
        wanted, wide, at = np.unique(own), max(SHINGLE, (width + 1) // 2), np.array(sorted(hits))
        places = np.flatnonzero(np.isin(s, wanted))
        which = np.searchsorted(wanted, s[places])
        text = np.searchsorted(bounds, at, "right") - 1
        low, high = np.maximum(at - wide, bounds[text]), np.minimum(at + width + wide, bounds[text + 1] - SHINGLE + 1)  # inside one text
        parted = np.flatnonzero((text[1:] != text[:-1]) | (low[1:] > high[:-1])) + 1
        least = next((k for k in range(1, len(wanted) + 1) if k / len(wanted) >= self.least), len(wanted) + 1)
        good = set()
        for j, e in zip([0, *parted], [*parted, len(at)]):  # spans that meet are read once
            a, b = np.searchsorted(places, [low[j], high[e - 1]])
            own, kinds = places[a:b].tolist(), which[a:b].tolist()
            for k in range(least, len(set(kinds)) + 1):
                good |= {(int(text[j]), -k / len(wanted), end - start, start) for start, end in _shortest(own, kinds, k) if end - start < width + 2 * wide}
        taken: dict[int, list[tuple[int, int]]] = {}
        for i, share, size, start in sorted(good):
            end = start + size + SHINGLE
            if all(start >= e or end <= a for a, e in taken.setdefault(i, [])):
                taken[i].append((start, end))
                a, b = block.starts[start] - block.off[i], block.ends[end - 1] - block.off[i]
                out[first + i].append({"license": name, "start": int(a), "end": int(b), "containment": -share})


def _shortest(places: list[int], which: list[int], k: int):
    """First and last place of the shortest run with ``k`` distinct values of ``which`` to each end that has one."""
    seen: dict[int, int] = {}
    a = 0
    for b, w in enumerate(which):
        seen[w] = seen.get(w, 0) + 1
        start = None
        while len(seen) >= k:
            start, out = a, which[a]
            seen[out] -= 1
            if not seen[out]:
                del seen[out]
            a += 1
        if start is not None:
            yield places[start], places[b]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, n_matches, licenses, matches): distinct names in order, and each match's bytes [start, end) of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    templates = dict(templates)
    shape = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches):
        scanner = Scanner(templates, least)
        for b in batches:
            found = scanner(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(m) for m in found], pa.int64()), pa.array([sorted({x["license"] for x in m}) for m in found], pa.list_(pa.string())), pa.array(found, shape)], ["doc_id", "n_matches", "licenses", "matches"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_matches long, licenses array<string>, matches array<struct<license:string,start:bigint,end:bigint,containment:double>>")
