"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) P(word | class). The class of a frequent word is its own, other words share classes by
their ending. The class factor is a softmax over hashed n-gram and skip features of the history; it is trained by
distributed gradient updates: in each round every task follows the gradient over its documents and sends what it changed,
weighted by how often each row of weights was seen, and the weights move to the average. The word factor is the softmax of
one bias per word, log(count + 1), with one place per class for words never seen. The hashed rows of weights grow with the
counted vocabulary (at most `max_rows`). They are a table below `spark.checkpoint.dir` that tasks read, not a broadcast, of which
each executor would keep a copy on its disk; a task of a round learns from some TASK_TOKENS tokens or more and sends only the
rows it saw, so that what is sent stays in proportion to the corpus.

Counts cover every training document. The vocabulary is a table that grows with the input and is never collected: words above
a count cutoff (at most `frequent` of them) go to the tasks, all others meet their counts by a join on the word. Histories
and texts never cross a shuffle.

Nulls and edge cases: a null or empty text is the end token alone; repeated rows (equal id and text) get equal scores; words
without training count use the reserved place; without training documents all counts are zero; an empty table gives an
empty result; rows without doc_id are left out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import compress, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, shared_dir
from .common import batch_of, hold_nothing, slices, text_batches, two_columns

END = b""  # no word is empty
LAST_TWO = itemgetter(slice(-2, None))
OWN_CLASSES, ENDINGS = 24, 40
CLASSES = 1 + OWN_CLASSES + ENDINGS  # class 0: the end token
START = CLASSES  # stands before the first word
ROWS, MAX_ROWS, FEATURES = 8192, 1 << 18, 4  # rows of weights: the least, and what a task has room for
BLOCKS = 32
CHUNK = 8192
LIMIT = 15.0
STEP, RATE = 1024, 0.6
TASK_TOKENS = 1 << 22
FEW = 6
KEPT_WORDS = 600_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def tokens_of(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


class Classes:
    """word -> class; and, packed in one number, word hash and class for the features."""

    def __init__(self, own: list[bytes]):
        self.own = {w: i + 1 for i, w in enumerate(own)} | {END: 0}

    def of(self, word: bytes) -> int:
        found = self.own.get(word)
        return 1 + OWN_CLASSES + zlib.crc32(word[-2:]) % ENDINGS if found is None else found

    def codes(self, tokens: list[bytes]) -> np.ndarray:
        n = len(tokens)
        kind = np.fromiter(map(self.own.get, tokens, repeat(-1)), np.int64, n)
        other = np.flatnonzero(kind < 0)
        ends = np.fromiter(map(zlib.crc32, map(LAST_TWO, compress(tokens, kind < 0))), np.int64, len(other))
        kind[other] = 1 + OWN_CLASSES + ends % ENDINGS
        return np.fromiter(map(zlib.crc32, tokens), np.int64, n) << 8 | kind


def rows_for(distinct: int, most: int = MAX_ROWS) -> int:
    """The power of two that gives every counted word a row, within [ROWS, most]."""
    return max(ROWS, min(1 << max(distinct - 1, 0).bit_length(), 1 << most.bit_length() - 1))


def _histories(codes: np.ndarray, begins: np.ndarray, size: int = ROWS):
    """Feature rows (FEATURES, n) and classes of tokens whose texts begin at ``begins``."""
    n = len(codes)
    at = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    before = np.where(at >= 1, np.concatenate(([0], codes[:-1])), START)
    second = np.where(at >= 2, np.concatenate(([0, 0], codes[:-2]))[:n], START)
    # the class and the word before, the classes of the two before, and, skipping one, the word before that
    parts = (before & 255, before >> 8 << 8 | 255, (second & 255) << 8 | before & 255, second)
    shift, kind = np.uint64(65 - size.bit_length()), np.uint16 if size <= 1 << 16 else np.uint32
    rows = []
    for i, x in enumerate(parts):
        m = (x.astype(np.uint64) + np.uint64(i + 1)) * MIX[i]
        m ^= m >> np.uint64(32)
        m *= MIX[(i + 1) % 4]
        rows.append((m >> shift).astype(kind))
    return np.stack(rows), codes & 255


def _chunks(batches, classes: Classes):
    """(keys, tokens, codes, begins) of whole documents, CHUNK tokens or one long document at a time."""
    keys, tokens, begins = [], [], []
    for ids, texts in text_batches(slices(batches), "text"):
        for key, text in zip(ids, texts):
            keys.append(key)
            begins.append(len(tokens))
            tokens += tokens_of(text)
            if len(tokens) >= CHUNK:
                yield keys, tokens, classes.codes(tokens), np.array(begins)
                keys, tokens, begins = [], [], []
    if keys:
        yield keys, tokens, classes.codes(tokens), np.array(begins)


def _logits(weights, bias, rows):
    """Weights stay within LIMIT, so that the exponentials of their sums fit 32-bit floats."""
    logits = weights[rows[0]]
    more = np.empty_like(logits)
    for r in rows[1:]:
        logits += np.take(weights, r, axis=0, out=more, mode="clip")
    logits += bias
    return logits


def _log_chosen(weights, bias, rows, target):
    """log P(class | history) of the classes that occur."""
    logits = _logits(weights, bias, rows)
    chosen = logits[np.arange(len(target)), target].astype(np.float64)
    return chosen - np.log(np.exp(logits, out=logits).sum(axis=1, dtype=np.float64))


def _blocks(folder: str | None):
    """(block, its weights) of the blocks that are stored in a folder, one at a time; none without a folder."""
    if folder is None:
        return
    files, top = fs.FileSystem.from_uri(folder) if re.match(r"[a-z0-9]+:/", folder) else (fs.LocalFileSystem(), folder)
    for f in sorted(x.path for x in files.get_file_info(fs.FileSelector(top)) if x.path.endswith(".parquet")):
        with files.open_input_file(f) as opened:
            for b in pq.ParquetFile(opened).iter_batches(batch_size=1, columns=["block", "weights"]):
                for block, weights in zip(b.column("block").to_pylist(), b.column("weights").to_pylist()):
                    yield block, np.frombuffer(weights, np.float32).reshape(-1, CLASSES)


def _stored(folder: str | None, size: int) -> np.ndarray:
    """All weights (size, CLASSES); zero where no task has seen a row of the block."""
    weights = np.zeros((BLOCKS, size // BLOCKS, CLASSES), np.float32)
    for block, part in _blocks(folder):
        weights[block] = part
    return weights.reshape(size, CLASSES)


def _row_sums(g: np.ndarray, rows: np.ndarray):
    """Per feature: distinct rows of weights in ``rows`` (FEATURES, n), ascending, and for each the sum of the gradients (n, CLASSES) at its places."""
    n = rows.shape[1]
    keys = np.sort(rows.astype(np.uint64) << np.uint64(16) | np.arange(n, dtype=np.uint64), axis=1).ravel()
    ranked, at = (keys >> np.uint64(16)).view(np.int64), (keys & np.uint64(0xFFFF)).view(np.int64)
    new = np.ones(len(keys), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    new[::n] = True
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(keys)))
    unique, total = ranked[first], g.take(at[first], axis=0)
    # most rows occur once, and of the others most a few times: those are summed place by place, in the order of reduceat
    few = np.flatnonzero((times > 1) & (times <= FEW))
    rest = g.take(at[first[few] + 1], axis=0)
    for k in range(2, FEW):
        more = np.flatnonzero(times[few] > k)
        rest[more] += g.take(at[first[few[more]] + k], axis=0)
    total[few] += rest
    many = times > FEW
    if many.any():
        begins = np.concatenate(([0], np.cumsum(times[many])[:-1]))
        total[many] = np.add.reduceat(g.take(at[np.repeat(many, times)], axis=0), begins, axis=0)
    bounds = np.searchsorted(first, np.arange(len(rows) + 1) * n)
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield unique[a:b], total[a:b]


def _follow_gradient(folder: str | None, size: int, bias, classes: Classes, rate: float):
    """One pass over a task's documents; sends per block of rows the change times how often the row was seen."""
    schema = pa.schema([("block", pa.int32()), ("rows", pa.binary()), ("change", pa.binary()), ("seen", pa.binary())])
    per = size // BLOCKS

    def run(batches):
        hold_nothing("language model")
        w, seen, norm = _stored(folder, size), np.zeros(size, np.int64), np.full(size, 1e-3, np.float32)
        for _, _, codes, begins in _chunks(batches, classes):
            rows, target = _histories(codes, begins, size)
            seen += np.bincount(rows.ravel(), minlength=size)
            for i in range(0, len(target), STEP):
                part, wanted = rows[:, i:i + STEP], target[i:i + STEP]
                g = _logits(w, bias, part)
                np.exp(g, out=g)
                g /= g.sum(axis=1, keepdims=True)
                g[np.arange(len(wanted)), wanted] -= 1
                for unique, total in _row_sums(g, part):
                    length = norm[unique] + np.einsum("ij,ij->i", total, total)
                    norm[unique] = length
                    total *= (rate / np.sqrt(length))[:, None]
                    moved = w.take(unique, axis=0)
                    moved -= total
                    w[unique] = np.clip(moved, -LIMIT, LIMIT, out=moved)
        for block, before in _blocks(folder):
            w[block * per:(block + 1) * per] -= before
        for i in range(BLOCKS):
            at = np.flatnonzero(seen[i * per:(i + 1) * per]) + i * per
            if len(at):
                yield batch_of(schema, [i], [(at - i * per).astype(np.int32).tobytes()], [w[at].astype(np.float16).tobytes()], [seen[at].astype(np.float32).tobytes()])

    return run


def _average(size: int):
    """Per block of ``size`` rows, the weights before (the row without ``rows``, if there is one) plus the mean change of each row, weighted
    by how often tasks saw it. Rows come sorted by block."""
    schema = pa.schema([("block", pa.int32()), ("weights", pa.binary())])

    def moved(block, before, total, weight):
        now = (total / np.maximum(weight, 1)[:, None]).astype(np.float32) + before
        return batch_of(schema, [block], [np.clip(now, -LIMIT, LIMIT).astype(np.float32).tobytes()])

    def run(batches):
        block, before, total, weight = None, 0, None, None
        for b in slices(batches, 8):
            for key, rows, change, seen in zip(*(b.column(c).to_pylist() for c in ("block", "rows", "change", "seen"))):
                if key != block:
                    if block is not None:
                        yield moved(block, before, total, weight)
                    block, before, total, weight = key, np.float32(0), np.zeros((size, CLASSES)), np.zeros(size)
                if rows is None:
                    before = np.frombuffer(change, np.float32).reshape(-1, CLASSES)
                    continue
                at, s = np.frombuffer(rows, np.int32), np.frombuffer(seen, np.float32)
                total[at] += np.frombuffer(change, np.float16).reshape(-1, CLASSES).astype(np.float64) * s[:, None]
                weight[at] += s
        if block is not None:
            yield moved(block, before, total, weight)

    return run


def train_classes(docs: DataFrame, classes: Classes, class_counts: np.ndarray, rounds: int = 2, rate: float = RATE, size: int = ROWS):
    """Folder with the weights (size, CLASSES) in BLOCKS rows, and bias of the class factor. Every document is in one of the rounds."""
    spark = docs.sparkSession
    bias = np.log((class_counts + 1) / (class_counts.sum() + CLASSES)).astype(np.float32)
    tasks = max(1, math.ceil(int(class_counts.sum()) / rounds / TASK_TOKENS))
    folder = None
    for i in range(rounds):
        part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == i).coalesce(tasks)
        sent = part.mapInArrow(_follow_gradient(folder, size, bias, classes, rate), "block int, rows binary, change binary, seen binary")
        if folder is not None:
            sent = sent.unionByName(spark.read.schema("block int, weights binary").parquet(folder).select(
                "block", F.lit(None).cast("binary").alias("rows"), F.col("weights").alias("change"), F.lit(None).cast("binary").alias("seen")))
        folder = shared_dir(spark, "weights")
        sent.repartition("block").sortWithinPartitions("block").mapInArrow(_average(size // BLOCKS), "block int, weights binary").write.parquet(folder)
    return folder, bias


def vocabulary(docs: DataFrame) -> DataFrame:
    """token (binary), n over all tokens of ``docs``, the end token included."""
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def run(batches):
        hold_nothing("language model")
        counts = Counter()

        def flush():
            tokens, ns = list(counts), list(counts.values())
            counts.clear()
            for i in range(0, len(tokens), 50_000):
                yield batch_of(schema, tokens[i:i + 50_000], ns[i:i + 50_000])

        for _, texts in text_batches(slices(batches), "text"):
            for t in texts:
                counts.update(tokens_of(t))
                if len(counts) > KEPT_WORDS:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def frequent_words(vocab: DataFrame, most: int) -> dict[bytes, int]:
    """All tokens above the least count that leaves at most ``most`` of them; tokens of up to 64 bytes, and the end token."""
    step = F.floor(F.log2("n") * 8).cast("int")
    histogram = sorted(((r.step, r.n) for r in vocab.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, cut = 0, None
    for s, n in histogram:
        total += n
        if total > most:
            break
        cut = s
    chosen = vocab.where((F.length("token") <= 64) & (step >= cut)).collect() if cut is not None else []
    end = vocab.where(F.length("token") == 0).collect()
    return {bytes(r.token): r.n for r in [*chosen, *end]}


def _class_totals(vocab: DataFrame, classes: Classes):
    """Tokens and distinct words per class."""
    schema = pa.schema([("c", pa.int32()), ("n", pa.int64()), ("v", pa.int64())])

    def run(batches):
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in batches:
            c = classes.codes(b.column("token").to_pylist()) & 255
            np.add.at(n, c, b.column("n").to_numpy())
            v += np.bincount(c, minlength=CLASSES)
        yield batch_of(schema, range(CLASSES), n, v)

    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in vocab.mapInArrow(run, "c int, n bigint, v bigint").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r.c], v[r.c] = r.n, r.v
    return n, v


def _document_rows(docs: DataFrame, frequent, classes, folder, size, bias, class_cost) -> DataFrame:
    """One row without token per document: n tokens, class factor and class size (log10), log10(count + 1) and number of its
    frequent tokens. And one row per document and word outside ``frequent``, with its number."""
    schema = pa.schema([("token", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("model", pa.float64()), ("logs", pa.float64()), ("known", pa.int64())])
    logs = {w: float(np.log10(n + 1)) for w, n in frequent.items()}

    def run(batches):
        hold_nothing("language model")
        weights = _stored(folder, size)
        for keys, tokens, codes, begins in _chunks(batches, classes):
            rows, target = _histories(codes, begins, size)
            chosen = np.concatenate([_log_chosen(weights, bias, rows[:, i:i + STEP], target[i:i + STEP]) for i in range(0, len(target), STEP)])
            found = np.fromiter(map(logs.get, tokens, repeat(-1.0)), np.float64, len(tokens))
            known, sizes = found >= 0, np.diff(np.append(begins, len(tokens)))
            yield batch_of(schema, [None] * len(keys), keys, sizes, np.add.reduceat(chosen / np.log(10) - class_cost[target], begins),
                           np.add.reduceat(np.where(known, found, 0.0), begins), np.add.reduceat(known.astype(np.int64), begins))
            at = np.flatnonzero(~known)
            rare = Counter(zip(map(tokens.__getitem__, at.tolist()), np.repeat(np.arange(len(keys)), sizes)[at].tolist()))
            if rare:
                none = [None] * len(rare)
                yield batch_of(schema, [t for t, _ in rare], [keys[d] for _, d in rare], list(rare.values()), none, none, none)

    return docs.mapInArrow(run, "token binary, doc_id bigint, n bigint, model double, logs double, known bigint")


def score(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", frequent: int = 200_000, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``, learned from the rows of ``training``."""
    docs, training = (two_columns(x, key, text, "string").where("doc_id IS NOT NULL") for x in (docs, training))
    vocab = materialize(vocabulary(training), "vocabulary")
    total, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    common = frequent_words(vocab, frequent)
    own = sorted((w for w in common if w != END), key=lambda w: (-common[w], w))[:OWN_CLASSES]
    classes = Classes(own)
    n, v = _class_totals(vocab, classes)
    size = rows_for(distinct, max_rows)
    folder, bias = train_classes(training, classes, n, size=size)
    class_cost = np.log10(n + v + 1)
    rows = materialize(_document_rows(docs, common, classes, folder, size, bias, class_cost), "document-rows")
    sums = rows.where("token IS NULL").select("doc_id", F.col("n").alias("n_tokens"), "model", "logs", "known")
    # words never seen in training add log10(1) = 0
    rare = (rows.where("token IS NOT NULL").select("token", "doc_id", "n").join(vocab.select("token", F.col("n").alias("c")), "token").groupBy("doc_id")
            .agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_logs"), F.sum("n").alias("rare_known")))
    # repeated rows have added their words together
    times = sums.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    both = sums.join(times, "doc_id").join(rare, "doc_id", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce(F.col("rare_known") / F.col("times"), F.lit(0))).cast("bigint").alias("n_known"),
        (F.col("logs") + F.coalesce(F.col("rare_logs") / F.col("times"), F.lit(0.0))).alias("logs"), "model")
    return both.select("doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"),
                       (F.col("logs") - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), (F.col("logs") + F.col("model")).alias("score"))
