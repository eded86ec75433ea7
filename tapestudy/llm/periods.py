"""Periodic run detection by internal pattern matching.

A run is a maximal stretch of consecutive words with smallest period q, at least `least` words and two periods long. All runs of
many documents are found together:

1. A run's words all lie in windows of `GRAM` words that occur twice in their document. Stretches covered by such windows are
   kept, everything else is cut away; most documents end here.
2. The stretches, set apart by separators, get a suffix array by prefix doubling. Its rounds name every factor of a
   dyadic length: equal names, equal words. Names also answer how far two places agree, to the right and to the left.
3. A run of period q >= 2 * b - 1 holds a dyadic block of b words together with its copy q words later. The block's occurrences
   are an interval of the suffix array, and a wavelet matrix over the array gives the next occurrence behind any place (range
   successor). For each block its neighbouring window of distances is walked that way. Occurrences that overlap by half
   a block form an arithmetic progression: its difference is the block's own period, its end follows from one comparison of
   names, and its members are candidate periods without being visited one by one.
4. A candidate (place, period) is extended to both sides as far as words one period apart agree; of equal stretches the
   least period stays.

Blocks of 4 words stand at every second place, so that they catch all periods up to 14; longer ones stand side by side.

Nulls and edge cases: null and empty texts have no words and no runs; rows without doc_id are kept; repeated rows are separate
documents; a very long text is a group of its own, of which only covered stretches are indexed (some 150 bytes a word of
them); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, text_batches, two_columns, words_of

#: Words that are examined together.
TOGETHER = 200_000
GRAM = 6


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def covered_words(ids: np.ndarray, doc: np.ndarray, gram: int) -> np.ndarray:
    """Which words lie in a window of ``gram`` words that occurs twice in its document. Windows compare by 64-bit hashes: a
    collision keeps words that could go, never the other way."""
    n = len(ids) - gram + 1
    edges = np.zeros(len(ids) + 1, np.int32)
    if n > 0:
        names, h = _mixed(ids.astype(np.uint64) + np.uint64(1)), np.zeros(n, np.uint64)
        for i in range(gram):
            h = h * np.uint64(0xD6E8FEB86659FD93) + names[i:i + n]
        h = _mixed(h ^ _mixed(doc[:n].astype(np.uint64)))
        inside = np.flatnonzero(doc[:n] == doc[gram - 1:])
        h = h[inside]
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = inside[twice]
        edges[at] += 1
        edges[at + gram] -= 1
    return np.cumsum(edges)[:len(ids)] > 0


class Factors:
    """Suffix array of a sequence and the names of all factors of dyadic length, where a name is the place in the suffix array
    at which the suffixes with that beginning start."""

    def __init__(self, sequence: np.ndarray):
        n = len(sequence)
        self.names = []
        key = sequence.astype(np.int64)
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            name = np.empty(n, np.int32)
            name[order] = first
            self.names.append(name)
            if new.all():
                break
            width = 1 << len(self.names) - 1
            behind = np.zeros(n, np.int64)
            behind[:n - width] = name[width:].astype(np.int64) + 1
            key = name.astype(np.int64) * (n + 1) + behind
        self.order = order

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are equal (a and b differ; the sequence ends in a word of its own)."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        n = len(self.order)
        for k in range(len(self.names) - 1, -1, -1):
            name, width = self.names[k], 1 << k
            equal = name[np.minimum(a, n - 1)] == name[np.minimum(b, n - 1)]
            step = equal * width
            a += step
            b += step
            out += step
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to and including a and b are equal (a and b differ; the sequence begins with a word of its own)."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, width = self.names[k], 1 << k
            x, y = a - width + 1, b - width + 1
            step = ((x >= 0) & (y >= 0) & (name[np.maximum(x, 0)] == name[np.maximum(y, 0)])) * width
            a -= step
            b -= step
            out += step
        return out


class WaveletMatrix:
    """Range successor over an array of distinct numbers below its length."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.split, rest = [], [], values.astype(np.int32)
        for b in range(self.bits - 1, -1, -1):
            one = (rest >> b & 1).astype(bool)
            before = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            self.split.append(int(before[-1]))
            rest = np.concatenate((rest[~one], rest[one]))

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value of at least ``least`` among places low to high - 1; -1 where there is none."""
        l, r, smaller = low.astype(np.int64), high.astype(np.int64), np.zeros(len(low), np.int64)
        for level, (before, split) in enumerate(zip(self.zeros, self.split)):
            one = (least >> self.bits - 1 - level & 1).astype(bool)
            zl, zr = before[l], before[r]
            smaller += np.where(one, zr - zl, 0)
            l, r = np.where(one, split + l - zl, zl), np.where(one, split + r - zr, zr)
        none = (smaller >= high - low) | (least >> self.bits > 0)
        l, r, nth, value = low.astype(np.int64), high.astype(np.int64), np.where(none, 0, smaller), np.zeros(len(low), np.int64)
        for level, (before, split) in enumerate(zip(self.zeros, self.split)):
            zl, zr = before[l], before[r]
            one = nth >= zr - zl
            value = value * 2 + one
            nth = np.where(one, nth - (zr - zl), nth)
            l, r = np.where(one, split + l - zl, zl), np.where(one, split + r - zr, zr)
        return np.where(none, -1, value)


def _members(start, step, count):
    """All members of progressions, and of which progression each is."""
    of = np.repeat(np.arange(len(start)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return of, start[of] + nth * step[of]


def candidates(factors: Factors, longest: int):
    """(places, periods) among which every run with a period up to ``longest // 2`` has at least one."""
    matrix, places, periods = WaveletMatrix(factors.order), [], []
    n, k = len(factors.order), 2
    while k < len(factors.names):
        block, stride = 1 << k, 2 if k == 2 else 1 << k
        near, far = (1, 3 * block + 2) if k == 2 else (2 * block - 1, 4 * block - 2)
        if near > longest // 2:
            break
        name = factors.names[k]
        at = np.arange(0, n, stride)
        low = name[at].astype(np.int64)
        high = low + np.bincount(name, minlength=n)[low]
        often = high - low > 1
        at, low, high = at[often], low[often], high[often]
        if len(at):
            first = matrix.successor(low, high, at + 1)
            gap = first - at
            own = (first >= 0) & (gap <= block // 2)  # the block goes on periodically: all of that stretch is one run
            if k == 2:
                places.append(at[own])
                periods.append(gap[own])
            x = at + near
            a, g = at[own], gap[own]
            end = a + g + factors.right(a, a + g)
            x[own] = np.maximum(x[own], a + (end - block - a) // g * g + 1)
            while len(at):
                o = matrix.successor(low, high, x)
                inside = (o >= 0) & (o - at <= far)
                at, low, high, o = at[inside], low[inside], high[inside], o[inside]
                if not len(at):
                    break
                gap = matrix.successor(low, high, o + 1) - o
                row = (gap > 0) & (gap <= block // 2)
                x = o + 1
                places.append(at[~row])
                periods.append((o - at)[~row])
                if row.any():
                    a, g, s = at[row], gap[row], o[row]
                    last = (s + g + factors.right(s, s + g) - block - s) // g
                    of, member = _members(s, g, np.minimum(last, (a + far - s) // g) + 1)
                    places.append(a[of])
                    periods.append(member - a[of])
                    x[row] = s + last * g + 1
        k += 1
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def runs_of_sequence(sequence: np.ndarray, longest: int, least: int) -> np.ndarray:
    """(start, length, period) of the runs of a sequence that begins and ends with words of their own."""
    factors = Factors(sequence)
    place, period = candidates(factors, longest)
    if not len(place):
        return np.zeros((0, 3), np.int64)
    both = np.unique(place * len(sequence) + period)
    place, period = both // len(sequence), both % len(sequence)
    start = place - factors.left(place - 1, place + period - 1)
    length = place + period + factors.right(place, place + period) - start
    good = length >= np.maximum(least, 2 * period)
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return np.stack((start, length, period), axis=1)[new]


def runs_of(documents: list[list[bytes]], least: int = 12) -> list[np.ndarray]:
    """Per document its runs (start, length, period), by start, then period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    base, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(documents)), sizes)
    number = {w: i for i, w in enumerate(set().union(*documents))}
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(documents)), np.int64, int(sizes.sum()))
    empty = np.zeros((0, 3), np.int64)
    out = [empty] * len(documents)
    # a run of `least` words has windows of that half its length which occur twice in it
    kept = np.flatnonzero(covered_words(ids, doc, min(GRAM, least // 2)))
    if not len(kept):
        return out
    cut = np.concatenate(([True], (kept[1:] != kept[:-1] + 1) | (doc[kept[1:]] != doc[kept[:-1]])))
    part = np.cumsum(cut) - 1
    lengths = np.bincount(part)
    long = lengths[part] >= least
    kept, cut = kept[long], cut[long]
    if not len(kept):
        return out
    part = np.cumsum(cut)  # stretches from 1 on: each has a separator before it
    place = np.arange(len(kept)) + part
    sequence = len(number) + np.cumsum(np.ones(len(kept) + part[-1] + 1, np.int64))
    sequence[place] = ids[kept]
    word = np.zeros(len(sequence), np.int64)
    word[place] = kept
    found = runs_of_sequence(sequence, int(lengths.max()), least)
    found[:, 0] = word[found[:, 0]]
    owner = doc[found[:, 0]]
    found[:, 0] -= base[owner]
    order = np.lexsort((found[:, 2], found[:, 0], owner))
    found, owner = found[order], owner[order]
    for d, a, b in zip(*np.unique(owner, return_index=True), np.append(np.unique(owner, return_index=True)[1][1:], len(owner))):
        out[d] = found[a:b]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words outside of repeated periods: of each run the first period stays."""
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edges)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, chosen by the checksum of its id, goes on periodically from some word on; others stay as they are."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def _groups(keys, texts, change):
    """Documents as (keys, word lists), as many together as have about TOGETHER words."""
    held, docs, size = [], [], 0
    for k, t in zip(keys, texts):
        words = words_of(t)
        if change is not None:
            words = change(k, words)
        if docs and size + len(words) > TOGETHER:
            yield held, docs
            held, docs, size = [], [], 0
        held.append(k)
        docs.append(words)
        size += len(words)
    if docs:
        yield held, docs


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12, change=None) -> DataFrame:
    """doc_id, start, length, period of every run of every text; ``change(doc_id, words)`` may alter the words first."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for keys, texts in text_batches(batches, "text"):
            for ids, words in _groups(keys, texts, change):
                for k, runs in zip(ids, runs_of(words, least)):
                    if len(runs):
                        yield batch_of(schema, [k] * len(runs), *runs.T)

    return two_columns(docs, key, text, "string").mapInArrow(run, "doc_id bigint, start bigint, length bigint, period bigint")


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """doc_id, text with the repeated periods of all runs left out, words joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for keys, texts in text_batches(batches, "text"):
            for ids, words in _groups(keys, texts, None):
                yield batch_of(schema, ids, [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs_of(words, least))])

    return two_columns(docs, key, text, "string").mapInArrow(run, "doc_id bigint, text string")


def run_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12, change=None) -> DataFrame:
    """Per document: n_runs, its longest run (ties: smallest start, then period), SHA-256 of all runs and of the collapsed text."""
    number, name = pa.int64(), pa.string()
    schema = pa.schema([("doc_id", number), ("n_runs", number), ("start", number), ("length", number), ("period", number), ("exponent_milli", number), ("runs_sha256", name), ("collapsed_sha256", name)])

    def run(batches):
        for keys, texts in text_batches(batches, "text"):
            for ids, words in _groups(keys, texts, change):
                rows = []
                for k, w, runs in zip(ids, words, runs_of(words, least)):
                    best = (None,) * 4
                    if len(runs):
                        # runs come by start and period: the first of the longest is the one
                        start, length, period = runs[np.argmax(runs[:, 1])].tolist()
                        best = (start, length, period, 1000 * length // period)
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
                    rows.append((k, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(w, runs))).hexdigest()))
                yield batch_of(schema, *zip(*rows))

    kinds = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return two_columns(docs, key, text, "string").mapInArrow(run, kinds)
