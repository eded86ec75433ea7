"""Substring dedup by level-wise doubling.

A window is `min_words` consecutive words. A word is removed if a window that covers it also starts in a document with a
smaller doc_id. Windows of half the length come first: every window of full length has one half-length window of least
hash inside it, its anchor, and equal windows have equal anchors. Only anchors that occur in several documents are
extended to twice their length; what still repeats decides which words go.

- Documents with the same word sequence are settled first: all but the smallest doc_id lose every window. A large group of
  copies so costs one row per copy.
- Level one is a grouped aggregate over the anchors (about 2 in 27 words) and a join back.
- Level two sends, per repeated anchor, the hashes of the full windows that chose it. Anchors with up to `group` places are
  compared within a task, streaming in doc_id order; of the rest each task sends every different window once, and each place of
  such an anchor looks its windows up in what repeats there.

Windows compare by 128 bits (anchor and window hash). Texts cross a shuffle compressed.

Nulls and edge cases: a null text has no words; shorter texts than a window lose nothing; repeated rows with one doc_id do
not count as repeats of each other; rows without doc_id lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .common import batch_of, hold_nothing, slices, text_batches, two_columns, unused, words_of

#: Up to so many repeated full windows of one common anchor go to its places as one table; more are joined one by one.
TABLE = 256
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int):
    if len(_powers[0]) < n:
        for i, base in enumerate((STEP, BACK)):
            steps = np.full(max(n, 2 * len(_powers[i])), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all windows of ``size`` words: a rolling polynomial, mixed; signed for Spark."""
    up, down = _power_tables(len(hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)))
    h = (sums[size:] - sums[:-size]) * down[: len(hashes) - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h.view(np.int64)


def chosen_anchors(half: np.ndarray, span: int) -> np.ndarray:
    """For every full window the place of its half window of least hash (the first of equal ones); never decreases."""
    view = np.lib.stride_tricks.sliding_window_view(half, span)
    return np.concatenate([view[i:i + 8192].argmin(axis=1) + np.arange(i, min(i + 8192, len(view))) for i in range(0, len(view), 8192)])


class _Sizes:
    def __init__(self, words: int):
        self.full, self.half = words, max(1, words // 2)
        self.span = self.full - self.half + 1

    def levels(self, words):
        h = word_hashes(words)
        half = window_hashes(h, self.half)
        return h, half, chosen_anchors(half, self.span)


def _compact(docs: DataFrame) -> DataFrame:
    """doc_id and the words of its text, joined by one space and compressed."""
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.binary())])

    def run(batches):
        hold_nothing("substring dedup")
        squeeze = zstandard.ZstdCompressor(level=1)
        for keys, texts in text_batches(slices(batches), "text"):
            yield batch_of(schema, keys, [squeeze.compress(b" ".join(words_of(t))) for t in texts])

    return docs.mapInArrow(run, "doc_id bigint, words binary")


def _unpacked(batch):
    expand = zstandard.ZstdDecompressor()
    for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column("words")):
        yield doc, expand.decompress(blob.as_py()).split()


def _level_one(docs: DataFrame, sizes: _Sizes) -> DataFrame:
    """doc_id, mark of the word sequence, hashes of its anchors in order; texts of a window or more."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("anchors", pa.list_(pa.int64()))])

    def run(batches):
        hold_nothing("substring dedup")
        for keys, texts in text_batches(slices(batches), "text"):
            out = []
            for key, text in zip(keys, texts):
                words = words_of(text)
                if len(words) >= sizes.full:
                    _, half, chosen = sizes.levels(words)
                    out.append((key, hashlib.blake2b(b" ".join(words), digest_size=16).digest(), half[np.unique(chosen)]))
            if out:
                yield batch_of(schema, *zip(*out))

    return docs.mapInArrow(run, "doc_id bigint, mark binary, anchors array<bigint>")


def _level_two(joined: DataFrame, sizes: _Sizes) -> DataFrame:
    """Per repeated anchor: the first of its full windows and the hashes of all of them."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("windows", pa.list_(pa.int64()))])

    def run(batches):
        hold_nothing("substring dedup")
        for batch in slices(batches):
            out = []
            for (doc, words), hits in zip(_unpacked(batch), batch.column("hits").to_pylist()):
                if len(words) < sizes.full:
                    continue
                hashes, half, chosen = sizes.levels(words)
                full = window_hashes(hashes, sizes.full)
                places = np.unique(chosen)
                for hit in hits:
                    if hit["k"] < len(places) and half[places[hit["k"]]] == hit["h"]:
                        place = places[hit["k"]]
                        a, b = np.searchsorted(chosen, place, "left"), np.searchsorted(chosen, place, "right")
                        out.append((hit["h"], hit["n"], doc, a, full[a:b]))
            if out:
                yield batch_of(schema, *zip(*out))

    return joined.mapInArrow(run, "h bigint, n bigint, doc_id bigint, first int, windows array<bigint>")


def _compare_groups(batches):
    """Rows sorted by anchor and doc_id: starts of the windows that an earlier document of the group has too."""
    schema = pa.schema([("doc_id", pa.int64()), ("starts", pa.list_(pa.int32()))])
    hold_nothing("substring dedup")
    anchor, seen = None, {}
    for b in slices(batches):
        out = []
        for h, doc, first, windows in zip(*(b.column(c).to_pylist() for c in ("h", "doc_id", "first", "windows"))):
            if h != anchor:
                anchor, seen = h, {}
            starts = [first + i for i, w in enumerate(windows) if seen.setdefault(w, doc) < doc]
            if starts:
                out.append((doc, starts))
        if out:
            yield batch_of(schema, *zip(*out))


def _window_minima(batches):
    """Least and greatest document of each full window of an anchor, once per task however often its anchor occurs there."""
    schema = pa.schema([("h", pa.int64()), ("w", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    kind, held, size = [("h", "<i8"), ("w", "<i8"), ("a", "<i8"), ("b", "<i8")], [], 0

    def merged(parts):
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["w"], rows["h"]))]
        first = np.flatnonzero(np.concatenate(([True], (rows["h"][1:] != rows["h"][:-1]) | (rows["w"][1:] != rows["w"][:-1]))))
        out = rows[first]
        out["a"], out["b"] = np.minimum.reduceat(rows["a"], first), np.maximum.reduceat(rows["b"], first)
        return out

    def sent(rows):
        for i in range(0, len(rows), 50_000):
            yield batch_of(schema, *(rows[c][i:i + 50_000] for c in "hwab"))

    for b in batches:
        if not b.num_rows:
            continue
        at, windows = _lists(b.column("windows"))
        owner = np.repeat(np.arange(b.num_rows), np.diff(at))
        rows = np.empty(len(owner), kind)
        rows["h"], rows["w"] = b.column("h").to_numpy()[owner], windows.to_numpy()
        rows["a"] = rows["b"] = b.column("doc_id").to_numpy()[owner]
        if len(rows):
            held.append(rows)
            size += len(rows)
        if size > 300_000:
            held = [merged(held)]
            size = len(held[0])
            if size > 150_000:
                yield from sent(held[0])
                held, size = [], 0
    if held:
        yield from sent(merged(held))


def _lists(column):
    """Bounds and flat values of an Arrow list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes))), column.flatten()


def _look_up(batches):
    """Rows of anchors with the table (w ascending, a) of their repeated windows: starts of those that a smaller document has."""
    schema = pa.schema([("doc_id", pa.int64()), ("starts", pa.list_(pa.int32()))])
    for b in batches:
        at, windows = _lists(b.column("windows"))
        windows = windows.to_numpy()
        bound, table = _lists(b.column("table"))
        known, earliest = (table.field(c).to_numpy(zero_copy_only=False) for c in ("w", "a"))
        out = []
        for i, (doc, first) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("first").to_pylist())):
            x, k, e = windows[at[i]:at[i + 1]], known[bound[i]:bound[i + 1]], earliest[bound[i]:bound[i + 1]]
            place = np.minimum(np.searchsorted(k, x), len(k) - 1)
            hit = np.flatnonzero((k[place] == x) & (e[place] < doc))
            if len(hit):
                out.append((doc, first + hit))
        if out:
            yield batch_of(schema, *zip(*out))


def repeated_windows(docs: DataFrame, compact: DataFrame, min_words: int = 50, group: int = 10_000) -> DataFrame:
    """doc_id, copy (its whole word sequence belongs to a smaller doc_id), starts of its repeated windows.

    ``docs`` has doc_id and text, ``compact`` the same rows from _compact. Only documents that lose words are listed."""
    sizes = _Sizes(min_words)
    one = materialize(_level_one(docs.where("doc_id IS NOT NULL"), sizes), "half-windows")
    firsts = materialize(one.groupBy("mark").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc"), "copies")
    marked = materialize(one.join(firsts, "mark", "left").select("doc_id", "anchors", F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(False)).alias("copy")), "half-windows")
    places = marked.where("NOT copy").select("doc_id", F.posexplode("anchors").alias("k", "h"))
    found = materialize(places.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("h", "n"), "repeated-halves")
    hits = places.join(found, "h").groupBy("doc_id").agg(F.collect_list(F.struct("k", "h", "n")).alias("hits"))
    two = materialize(_level_two(compact.join(hits, "doc_id"), sizes), "full-windows")
    near = (two.where(F.col("n") <= group).select("h", "doc_id", "first", "windows").repartition("h").sortWithinPartitions("h", "doc_id")
            .mapInArrow(_compare_groups, "doc_id bigint, starts array<int>"))
    spread = two.where(F.col("n") > group)
    minima = spread.select("h", "doc_id", "windows").mapInArrow(_window_minima, "h bigint, w bigint, a bigint, b bigint")
    common = materialize(minima.groupBy("h", "w").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a < b").select("h", "w", "a"), "repeated-windows")
    sizes = materialize(common.groupBy("h").agg(F.count(F.lit(1)).alias("m")), "repeated-windows")
    tables = materialize(common.join(sizes.where(F.col("m") <= TABLE), "h").groupBy("h").agg(F.array_sort(F.collect_list(F.struct("w", "a"))).alias("table")), "window-tables")
    looked = two.select("h", "doc_id", "first", "windows").join(tables, "h").mapInArrow(_look_up, "doc_id bigint, starts array<int>")
    large = sizes.where(F.col("m") > TABLE)
    wide = materialize(common.join(large, "h").select("h", "w", "a"), "repeated-windows")
    single = spread.join(large, "h", "left_semi").select("h", "doc_id", "first", F.posexplode("windows").alias("i", "w"))
    joined = (single.join(wide, ["h", "w"]).where("doc_id > a").groupBy("doc_id", "h", "first")
              .agg(F.collect_list((F.col("first") + F.col("i")).cast("int")).alias("starts")).select("doc_id", "starts"))
    far = looked.unionByName(joined)
    starts = near.unionByName(far).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    copies = marked.where("copy").select("doc_id", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("starts"))
    return starts.select("doc_id", F.lit(False).alias("copy"), "starts").unionByName(copies.distinct())


def covered(n: int, copy: bool, starts, size: int) -> np.ndarray:
    """Which of n words the windows cover."""
    if copy:
        return np.ones(n, bool)
    edges = np.zeros(n + 1, np.int64)
    if starts is not None and len(starts):
        at = np.asarray(starts)
        at = at[at + size <= n]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + size, -1)
    return np.cumsum(edges)[:n] > 0


def kept_words(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    docs = two_columns(docs, key, text, "string")
    compact = _compact(docs)
    found = materialize(repeated_windows(docs, compact, min_words), "removed-windows")
    text_type = pa.string()
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", text_type)])

    def run(batches):
        hold_nothing("substring dedup")
        for b in slices(batches):
            out = []
            for (doc, words), copy, starts in zip(_unpacked(b), b.column("copy").to_pylist(), b.column("starts").to_pylist()):
                gone = covered(len(words), bool(copy), starts, min_words)
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                yield batch_of(schema, *zip(*out))

    return compact.join(found, "doc_id", "left").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def _cut(text: str, copy: bool, starts, size: int) -> str:
    """The text without its covered words; what stood between kept words stays."""
    raw = text.encode()
    letters = ~np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    step = np.diff(np.concatenate(([False], letters, [False])).astype(np.int8))
    begin, end = np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]
    gone = covered(len(begin), copy, starts, size)
    parts, at = [], 0
    edges = np.nonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))[0]
    for a, b in zip(edges[::2], edges[1::2]):
        parts.append(raw[at:begin[a]])
        at = begin[b] if b < len(begin) else len(raw)
    return b"".join([*parts, raw[at:]]).decode().strip(" \t\n\x0b\x0c\r")


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with the repeated passages cut out of the text; documents of which nothing is left go. Needs rows with a key."""
    columns = docs.columns
    plain = two_columns(docs, key, text, "string")
    doc, copy, first = unused(docs, "_doc", "_copy", "_starts")
    found = materialize(repeated_windows(plain, _compact(plain), min_words), "removed-windows").toDF(doc, copy, first)
    joined = docs.join(found, F.col(f"`{key}`").cast("bigint") == F.col(doc), "left")

    def run(batches):
        hold_nothing("substring dedup")
        for b in slices(batches):
            listed = b.column(doc).is_valid()
            old, copies, starts = (b.column(x).to_pylist() for x in (text, copy, first))
            texts = [_cut(t or "", bool(c), s, min_words) if cut else t for t, cut, c, s in zip(old, listed.to_pylist(), copies, starts)]
            i = b.schema.get_field_index(text)
            out = b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type)).select(columns)
            # only what was cut can leave nothing; a text that came empty stays
            yield out.filter(pa.array([not cut or t != "" for t, cut in zip(texts, listed.to_pylist())]))

    return joined.mapInArrow(run, docs.schema)
