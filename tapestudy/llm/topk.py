"""Exact top-k search by inner product with a three-phase uniform threshold.

The dimensions are cut into a few blocks; for a query, each block ranks all vectors by its part of the inner product, and
the score is the sum over the blocks. Parts are shifted by their smallest value, so that they are not negative.

1. Every task sends its k largest parts per query and block. From the k best of each list, partial sums give a lower bound
   of the k-th score; that bound divided by the number of blocks is the cutoff, which goes to all tasks. A vector below the
   cutoff in every list cannot be among the k best.
2. Every task adds up the parts at or above the cutoff and sends its k largest sums: a sharper bound of the k-th score.
3. Only vectors whose upper bound (known parts, and the cutoff for unknown ones) reaches that bound are scored exactly.

Queries are handled in blocks of bounded size, which are sent to the tasks; vectors never cross a shuffle.

Nulls and edge cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
padded with zeros; equal scores go to the smaller id; repeated rows are separate candidates, but equal query rows count
once; a query without candidates has no rows. Components are scaled to integers; scores must fit 64 bits, else an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .common import batch_of

SCALE = 1024
ROWS = 2048


def _integers(column) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix of floor(SCALE * x)) of the usable vectors of an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    good, vectors = [], []
    for i, v in enumerate(column):
        if not v.is_valid:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if v.values.null_count == 0 and np.isfinite(x).all():
            good.append(i)
            vectors.append(x)
    width = max(map(len, vectors), default=0)
    if any(len(x) != width for x in vectors):
        vectors = [np.pad(x, (0, width - len(x))) for x in vectors]
    return np.array(good, np.int64), np.floor(SCALE * np.array(vectors).reshape(len(good), width))


class _Block:
    """Queries of one block and their partial products with a slice of the vectors."""

    def __init__(self, ids, matrix, lists):
        self.ids, self.matrix, self.lists = ids, matrix, lists

    def parts(self, ids, vectors):
        """(lists, queries, rows) partial products, and which pairs are a query with its own row."""
        width = max(self.matrix.shape[1], vectors.shape[1])
        q, v = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (self.matrix, vectors))
        most = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(v).max(initial=0)) * max(width, 1) * self.lists
        if most >= 2.0 ** 61:
            raise ValueError("components are too large for exact 64-bit scores")
        if most >= 2.0 ** 52:
            q, v = q.astype(np.int64), v.astype(np.int64)
        cuts = [width * i // self.lists for i in range(self.lists + 1)]
        out = np.stack([(q[:, a:b] @ v[:, a:b].T).astype(np.int64) for a, b in zip(cuts, cuts[1:])])
        return out, ids[None, :] == self.ids[:, None]


def _slices(batches):
    for b in batches:
        good, vectors = _integers(b.column("v"))
        ids = b.column("id").to_numpy(zero_copy_only=False)[good] if len(good) else np.zeros(0, np.int64)
        marks = b.column("h").to_numpy(zero_copy_only=False)[good] if len(good) else ids
        for i in range(0, len(good), ROWS):
            yield ids[i:i + ROWS], marks[i:i + ROWS], vectors[i:i + ROWS]


def _best(group, value, order, k, *more):
    """Rows of the k largest values (then smallest order) of each group."""
    at = np.lexsort((order, -value, group))
    g = group[at]
    first = np.searchsorted(g, g, side="left")
    at = at[np.arange(len(g)) - first < k]
    return [x[at] for x in (group, value, order, *more)]


def _first_phase(block, k):
    lows = np.iinfo(np.int64).max
    schema = pa.schema([("list", pa.int64()), ("part", pa.int64()), ("id", pa.int64()), ("h", pa.int64())])

    def run(batches):
        n = len(block.ids)
        low = np.full(block.lists * n, lows)
        kept = [np.zeros(0, np.int64)] * 4
        for ids, marks, vectors in _slices(batches):
            parts, own = block.parts(ids, vectors)
            flat = parts.reshape(block.lists * n, -1)
            own = np.tile(own, (block.lists, 1))
            low = np.minimum(low, np.where(own, lows, flat).min(axis=1, initial=lows))
            flat = np.where(own, -lows, flat)
            m = min(k, flat.shape[1])
            top = np.argpartition(-flat, m - 1, axis=1)[:, :m]
            lists = np.repeat(np.arange(len(flat)), m)
            top = top.ravel()
            values = flat[lists, top]
            real = values > -lows
            new = [lists[real], values[real], ids[top][real], marks[top][real]]
            kept = _best(*[np.concatenate(x) for x in zip(kept, new)][:3], k, np.concatenate((kept[3], new[3])))
        if len(kept[0]):
            yield batch_of(schema, *kept)
            seen = np.nonzero(low < lows)[0]
            # the smallest part of each list, as a row without an id
            yield batch_of(schema, seen, low[seen], [None] * len(seen), [None] * len(seen))

    return run


def _cutoffs(rows: DataFrame, n: int, lists: int, k: int):
    """Per query of the block: the smallest part of every list, and a lower bound of the k-th shifted score."""
    low = rows.where("id IS NULL").groupBy("list").agg(F.min("part").alias("low"))
    top = rows.where("id IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("part"), "id", "h"))).where(f"r <= {k}")
    sums = (top.join(low, "list").groupBy((F.col("list") % n).alias("q"), "id", "h", "list").agg(F.max(F.col("part") - F.col("low")).alias("part"))
            .groupBy("q", "id", "h").agg(F.sum("part").alias("s"))
            .withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(f"r = {k}"))
    lows, bound = np.zeros((lists, n), np.int64), np.zeros(n, np.int64)
    for r in low.collect():
        lows[r["list"] // n, r["list"] % n] = r.low
    for r in sums.collect():
        bound[r.q] = r.s
    return lows, bound


def _known(parts, lows, bound, lists):
    shifted = parts - lows[:, :, None]
    known = shifted * lists >= bound[None, :, None]
    return np.where(known, shifted, 0).sum(axis=0), known.sum(axis=0)


def _second_phase(block, lows, bound, k):
    schema = pa.schema([("q", pa.int64()), ("s", pa.int64())])

    def run(batches):
        kept = [np.zeros(0, np.int64)] * 3
        for ids, _, vectors in _slices(batches):
            parts, own = block.parts(ids, vectors)
            sums, _ = _known(parts, lows, bound, block.lists)
            sums[own] = -1
            m = min(k, sums.shape[1])
            values = -np.partition(-sums, m - 1, axis=1)[:, :m].ravel()
            q = np.repeat(np.arange(len(block.ids)), m)
            real = values >= 0
            kept = _best(*[np.concatenate(x) for x in zip(kept, (q[real], values[real], q[real]))], k)
        if len(kept[0]):
            yield batch_of(schema, kept[0], kept[1])

    return run


def _third_phase(block, lows, bound, sharper, k):
    schema = pa.schema([("q", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])

    def run(batches):
        kept = [np.zeros(0, np.int64)] * 3
        for ids, _, vectors in _slices(batches):
            parts, own = block.parts(ids, vectors)
            sums, known = _known(parts, lows, bound, block.lists)
            reach = sums * block.lists + (block.lists - known) * bound[:, None] >= sharper[:, None] * block.lists
            q, row = np.nonzero(reach & (known > 0) & ~own)
            new = (q, parts[:, q, row].sum(axis=0), ids[row])
            kept = _best(*[np.concatenate(x) for x in zip(kept, new)], k)
        if len(kept[0]):
            yield batch_of(schema, *kept)

    return run


def _search_block(rows: DataFrame, ids, matrix, k, lists) -> DataFrame:
    n = len(ids)
    block = _Block(ids, matrix, lists)
    lows, bound = _cutoffs(materialize(rows.mapInArrow(_first_phase(block, k), "list bigint, part bigint, id bigint, h bigint"), "score-lists"), n, lists, k)
    second = rows.mapInArrow(_second_phase(block, lows, bound, k), "q bigint, s bigint")
    sharper = bound.copy()
    for r in second.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(f"r = {k}").collect():
        sharper[r.q] = max(sharper[r.q], r.s)
    third = rows.mapInArrow(_third_phase(block, lows, bound, sharper, k), "q bigint, score bigint, id bigint")
    best = third.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(f"rank <= {k}")
    names = rows.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "q bigint, query_id bigint")
    return best.join(names, "q").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", value: str = "embedding", k: int = 10, lists: int = 4, block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for every row of ``queries``, its own id left out."""
    def plain(df):
        return df.select(F.col(key).cast("bigint").alias("id"), F.col(f"`{value}`").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = plain(vectors).withColumn("h", F.xxhash64("v"))
    results, ids, found = [], [], []

    def flush():
        width = max(map(len, found))
        matrix = np.array([np.pad(x, (0, width - len(x))) for x in found])
        results.append(materialize(_search_block(rows, np.array(ids, np.int64), matrix, k, lists), "top-k"))
        ids.clear()
        found.clear()

    for r in plain(queries).distinct().toLocalIterator():
        x = np.array([np.nan if c is None else c for c in r.v], np.float64)
        if np.isfinite(x).all():
            ids.append(r.id)
            found.append(np.floor(SCALE * x))
        if len(ids) == block:
            flush()
    if ids:
        flush()
    if not results:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = results[0]
    for df in results[1:]:
        out = out.unionByName(df)
    return out
