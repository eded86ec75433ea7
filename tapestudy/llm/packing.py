"""Best-fit packing by minimum bin slack.

Tokenized documents become pieces of at most `capacity` tokens. How they can be packed depends only on how many pieces there
are of each length: a table of at most `capacity` counts. From it the driver builds the bins one kind at a time: the longest
length left is placed, and a subset-sum dynamic program over bitsets finds, from the lengths available, the combination that
fills the rest of the bin as far as possible. That combination is removed as often as the counts allow. The work depends on
the number of lengths, not on the number of documents.

Pieces are then ranked within their length (by hash parts, so that a common length is many groups) and take the places that
the bins have for that length.

Nulls and edge cases: a null or empty text is one piece with the end token alone; a text longer than the capacity is cut;
repeated rows are packed separately; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .bpe import WHITE
from .common import batch_of, hold_tables, keep_first, text_batches, two_columns, words_of

CAPACITY = 2048
END = 0
KEPT_WORDS = 600_000
# Fixed value: how the vocabulary cuts a word into parts before the merges.
PARTS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")


class WordTokens:
    """Ids of a text from a vocabulary that drops white space: the concatenated ids of its words, and those of a word the
    ids of its parts (runs of letters, digits, runs of other signs). Ids of words and parts are kept in bounded tables; new
    parts are encoded many at a time and told apart by the tokens that end a part."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.special)
        self.known, self.parts = {}, {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 4096):
            some = parts[i:i + 4096]
            (ids,) = self._encode([" ".join(some)])
            cuts = np.nonzero(self.ends[ids])[0] + 1
            each = np.split(ids, cuts)[:-1] if len(cuts) == len(some) and (not len(ids) or cuts[-1] == len(ids)) else self._encode(some)
            self.parts.update(zip(some, (x.tobytes() for x in each)))

    def _learn(self, words) -> None:
        keep_first(self.parts, self.kept)
        cut, alone, new, known = [], [], {}, self.parts
        for w in words:
            s = w.decode()
            if s.isascii():
                low = s.lower()
            else:
                s = unicodedata.normalize("NFC", s)
                low = "".join(map(str.lower, s))
            if len(low) != len(s) or self.mark in s and any(t in s for t in self.special):
                alone.append(w)
                continue
            if low.isalpha():
                parts = (low,)
            elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                parts = (low[:-1], low[-1])
            else:
                parts = PARTS.findall(low)
            cut.append((w, parts))
            for p in parts:
                if p not in known:
                    new[p] = None
        self._learn_parts(list(new))
        for w, parts in cut:
            self.known[w] = b"".join([self.parts[p] for p in parts])
        for w, ids in zip(alone, self._encode([w.decode() for w in alone])):
            self.known[w] = ids.tobytes()

    def ids(self, text: str) -> np.ndarray:
        words, out = words_of(text), []
        for i in range(0, len(words), 50_000):
            part = words[i:i + 50_000]
            keep_first(self.known, self.kept)
            known = self.known
            if new := set(part).difference(known):
                self._learn(new)
            out += map(known.__getitem__, part)
        return np.frombuffer(b"".join(out), "<u4")


_loaded: dict[tuple, WordTokens] = {}


def load(vocabulary: str, kept: int = KEPT_WORDS) -> WordTokens:
    """One encoder per vocabulary and worker process, with the words that earlier tasks have met."""
    hold_tables("packing", _loaded.clear)
    if (vocabulary, kept) not in _loaded:
        _loaded[vocabulary, kept] = WordTokens(vocabulary, kept)
    return _loaded[vocabulary, kept]


def pieces_of(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, kept: int = KEPT_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. Each document's ids end with END. A worker keeps the ids of about ``kept``
    words and as many parts of words: some 400 bytes each together."""
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(kinds)

    def run(batches):
        tokens = load(vocabulary, kept)
        for keys, texts in text_batches((b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)), "text"):
            out = []
            for k, t in zip(keys, texts):
                ids = np.append(tokens.ids(t), np.uint32(END)).astype("<u4")
                for i, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    out.append((k, i, start, len(part), zlib.crc32(part.tobytes())))
            if out:
                yield batch_of(schema, *zip(*out))

    return two_columns(docs, key, text, "string").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination with the largest sum of at most ``room``; ``lengths`` descend.

    The bits of an integer are the sums that can be reached; a length that is there several times enters as 1, 2, 4, ...
    copies at once, so that any number of copies can be taken."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in lengths:
        if length > room:
            continue
        left, at_once = min(counts[length], room // length), 1
        while left > 0:
            n = min(at_once, left)
            steps.append((length, n, reach))
            reach |= reach << length * n & mask
            left -= n
            at_once *= 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, Counter()
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            total -= length * n
            taken[length] += n
    return list(taken.items())


def bin_kinds(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, pieces per bin)]) of all bins for the given number of pieces per length."""
    counts = {k: n for k, n in counts.items() if n}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        kind = Counter(dict(fullest(counts, [x for x in lengths if counts[x]], capacity - first)))
        counts[first] += 1
        kind[first] += 1
        times = min(counts[k] // n for k, n in kind.items())
        for k, n in kind.items():
            counts[k] -= n * times
        out.append((times, sorted(kind.items(), reverse=True)))
        lengths = [x for x in lengths if counts[x]]
    return out


def places(kinds):
    """Sorted per length: first rank, first bin, pieces per bin, offset. One row per kind of bin and length in it."""
    used, rows, base = Counter(), [], 0
    for times, kind in kinds:
        offset = 0
        for length, n in kind:
            rows.append((length, used[length], base, n, offset))
            used[length] += n * times
            offset += length * n
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = 50_000) -> DataFrame:
    """``pieces`` (doc_id, piece, ..., length) with sequence_id and offset. Reads ``pieces`` several times: give a stored table."""
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per length
    table = places(bin_kinds(counts, capacity))
    # parts of a length: enough that one group holds some thousands of rows, whatever the share of one length
    parts = int(min(1 << 16, max(64, sum(counts.values()) // part_rows)))
    cut = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "part-starts")
    inner = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("_rank", inner).join(starts, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*pieces.columns, "_rank")
    keys = table[:, 0] << 44 | table[:, 1]
    names = pieces.columns
    fields = [*names, "sequence_id", "offset"]

    def run(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            _, first, base, n, offset = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1].T
            nth = rank - first
            columns = [b.column(c) for c in names] + [pa.array(base + nth // n), pa.array(offset + nth % n * length)]
            yield pa.RecordBatch.from_arrays(columns, fields)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(run, kinds)


def pack_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, kept: int = KEPT_WORDS) -> DataFrame:
    return packed(materialize(pieces_of(docs, vocabulary, key, text, capacity, kept), "pieces"), capacity)
