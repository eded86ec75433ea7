"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Templates and documents are word sequences (letters and digits, lower case). The hashes of all word triples of a template
are winnowed: of every `WINDOW` consecutive ones the least stays. The index maps a fingerprint to its places in the
templates. A document looks up all its triples; hits of one template near one diagonal form a candidate, and an alignment
in a band around that diagonal gives the matched words. A stretch of TRIPLE + WINDOW - 1 equal words is always a candidate.

Nulls and edge cases: null and empty texts have no matches; a template shorter than a triple is found by its whole
sequence; equal places of several templates are all reported; repeated rows are scanned alike.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import batch_of, text_batches, two_columns
from .substring import window_hashes

TRIPLE, WINDOW, BAND = 3, 3, 8
MAX_TEMPLATE_WORDS = 2_000_000
WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:\.[0-9]+)*")

# Short public licence notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _hashes(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return window_hashes(h, TRIPLE) if len(words) >= TRIPLE else np.zeros(0, np.int64)


class TemplateIndex:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [WORD.findall(t.encode().lower()) for t in templates.values()]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError("too many template words to send to every task; scan in several calls")
        places = defaultdict(list)
        self.short = [i for i, w in enumerate(self.words) if 0 < len(w) < TRIPLE]
        for i, words in enumerate(self.words):
            h = _hashes(words)
            span = min(WINDOW, len(h))
            for start in range(len(h) - span + 1) if span else ():
                part = h[start:start + span]
                at = start + int(part.argmin())
                if (i, at) not in places[int(part.min())]:
                    places[int(part.min())].append((i, at))
        self.places = dict(places)
        self.fingerprints = np.array(sorted(self.places), np.int64)

    def candidates(self, words: list[bytes]) -> dict[tuple[int, int], set[int]]:
        """(template, rough diagonal) -> diagonals of the hits."""
        out = defaultdict(set)
        h = _hashes(words)
        if len(self.fingerprints):
            at = np.searchsorted(self.fingerprints, h)
            for j in np.nonzero(self.fingerprints[np.minimum(at, len(self.fingerprints) - 1)] == h)[0].tolist():
                for template, place in self.places[int(h[j])]:
                    out[template, (j - place) // BAND].add(j - place)
        for template in self.short:
            t = self.words[template]
            for j in range(len(words) - len(t) + 1):
                if words[j:j + len(t)] == t:
                    out[template, j // BAND].add(j)
        return out

    def scan(self, text: str, least: float):
        """(template, start word, end word, matched words) of all matches that cover at least ``least`` of a template."""
        words = WORD.findall(text.encode().lower())
        found = {}
        for (template, _), diagonals in self.candidates(words).items():
            t = self.words[template]
            hit = banded_alignment(t, words, min(diagonals), max(diagonals))
            if hit and hit[2] >= least * len(t):
                key = (template, hit[0], hit[1])
                found[key] = max(found.get(key, 0), hit[2])
        # of overlapping matches of one template the fullest stays
        out, last = [], {}
        for (template, a, b), n in sorted(found.items(), key=lambda x: (-x[1], x[0])):
            if all(b <= x or a >= y for x, y in last.get(template, ())):
                last.setdefault(template, []).append((a, b))
                out.append((self.names[template], a, b, n, n / len(self.words[template])))
        return sorted(out, key=lambda x: (x[1], x[0]))


def banded_alignment(template: list[bytes], words: list[bytes], low: int, high: int):
    """Most equal words in order, with document place minus template place within BAND of [low, high]:
    (first matched word, end, matches), or None."""
    first, width, middle = low - BAND, high - low + 2 * BAND + 1, (low + high) // 2
    # (matches, -span, -distance of the first match from the middle diagonal, begin, end) per diagonal of the band
    none = (0, 0, 0, -1, -1)
    row = [none] * width
    for i, t in enumerate(template):
        new, left = [], none
        for d in range(width):
            j = i + first + d
            best = max(left, row[d + 1]) if d + 1 < width else left
            if 0 <= j < len(words) and words[j] == t:
                n, _, drift, begin, _ = row[d]
                if n == 0:
                    drift, begin = -abs(first + d - middle), j
                best = max(best, (n + 1, begin - j - 1, drift, begin, j + 1))
            new.append(best)
            left = best
        row = new
    n, _, _, begin, end = max(row)
    return (begin, end, n) if n else None


def scan_licenses(docs: DataFrame, templates: dict[str, str] = NOTICES, key: str = "doc_id", text: str = "text", least: float = 0.7) -> DataFrame:
    """doc_id, license, start_word, end_word (exclusive), matched_words, coverage of every match in every whole text."""
    index = TemplateIndex(templates)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("matched_words", pa.int64()), ("coverage", pa.float64())])

    def run(batches):
        for keys, texts in text_batches(batches, "text"):
            out = [(k, *hit) for k, t in zip(keys, texts) for hit in index.scan(t, least)]
            if out:
                yield batch_of(schema, *zip(*out))

    return two_columns(docs, key, text, "string").mapInArrow(run, "doc_id bigint, license string, start_word bigint, end_word bigint, matched_words bigint, coverage double")
