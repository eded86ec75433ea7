"""Near-duplicate stage: SimHash and BK-trees on five-word shingles, for a similarity of 0.8 or more.

At a Jaccard similarity of 0.8 two 64-bit fingerprints differ in about ten bits and up to some twenty, more than whole equal
blocks of bits can route. The shards here are therefore keyed by min-hash values of the shingles: BANDS keys of ROWS_PER_BAND
values each, which bring a pair of similarity 0.8 together with probability above 0.999. In a shard a BK-tree follows the
edges within RADIUS bits, and the shingle sets of what it finds are compared exactly. Pairs that are connected already are
not compared again, so a group of n near copies costs about n comparisons.

Similarity is that of sets, so a fingerprint counts each distinct shingle once, however often a run or line repeats.

Documents with equal shingle sets are one group from the start and take part once. A shard with more than `shard` documents
becomes several, and each pair of those meets in its own group, so memory stays bounded and no link is lost.

Nulls and edge cases: texts without words form one group; shorter texts than a shingle count as one shingle; rows with one
doc_id are one document and stay or go together, rows without doc_id stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .common import batch_of, hold_nothing, slices, text_batches, two_columns, unused
from .components import connected_components
from .simhash import BKTree, shingle_hashes, simhash

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 22
BANDS, ROWS_PER_BAND = 12, 3
_r = np.random.default_rng(11)
_MULTIPLIERS = _r.integers(1, 1 << 63, BANDS * ROWS_PER_BAND, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One signed key per band from the least values of ROWS_PER_BAND hash functions."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.array([_mixed(shingles * m).min() for m in _MULTIPLIERS], np.uint64).reshape(BANDS, ROWS_PER_BAND)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS_PER_BAND):
        key = _mixed((key ^ least[:, i]) * np.uint64(0x94D049BB133111EB))
    return key.view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        hold_nothing("near-dedup")
        for ids, texts in text_batches(slices(batches), "text"):
            sets = [np.unique(shingle_hashes(t, SHINGLE)) for t in texts]
            yield batch_of(schema, ids, [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [band_keys(s) for s in sets])

    return docs.mapInArrow(run, "doc_id bigint, mark binary, keys array<bigint>")


def _with_sets(rows: DataFrame) -> DataFrame:
    """One row per shard of a document: fingerprint and shingle set (32 bits a shingle, sorted)."""
    schema = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("own", pa.int32()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        hold_nothing("near-dedup")
        for b in slices(batches):
            for doc, text, shards in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("shards").to_pylist()):
                h = np.unique(shingle_hashes(text or "", SHINGLE))
                fp, small = simhash(h), np.unique(h.astype(np.uint32)).tobytes()
                yield batch_of(schema, *zip(*[(s["key"], s["part"], s["own"], doc, fp, small) for s in shards]))

    return rows.mapInArrow(run, "key bigint, part int, own int, doc_id bigint, fp bigint, shingles binary")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


class _Shard:
    """Finds links among the documents of one shard, one after the other."""

    def __init__(self):
        self.tree, self.at, self.sets, self.parent, self.own = BKTree(), {}, {}, {}, {}

    def _find(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, doc: int, own: int, fp: int, shingles: np.ndarray):
        """Links of ``doc`` to documents added before; of equal ``own`` >= 0 another group compares them."""
        if doc in self.parent:
            return []
        self.parent[doc], self.sets[doc], self.own[doc], out = doc, shingles, own, []
        near = sorted(self.tree.within(fp, RADIUS), key=lambda x: (x ^ fp).bit_count())
        for other in (o for x in near for o in self.at[x]):
            if own >= 0 and own == self.own[other]:
                continue
            a, b = self._find(doc), self._find(other)
            if a != b and _similar(shingles, self.sets[other]):
                self.parent[a] = b
                out.append((doc, other))
        if fp in self.at:
            self.at[fp].append(doc)
        else:
            self.at[fp] = [doc]
            self.tree.add(fp)
        return out


def _shard_links(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    hold_nothing("near-dedup")
    key, shard = None, None
    for b in slices(batches):
        out = []
        for k, part, own, doc, fp, shingles in zip(*(b.column(c).to_pylist() for c in ("key", "part", "own", "doc_id", "fp", "shingles"))):
            if (k, part) != key:
                key, shard = (k, part), _Shard()
            out += shard.add(doc, own, fp & (1 << 64) - 1, np.frombuffer(shingles, np.uint32))
        if out:
            yield batch_of(schema, *zip(*out))


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shard: int = 2000) -> DataFrame:
    """doc_id, component_id (smallest doc_id of its group) of every document that is not the smallest of its group."""
    docs = two_columns(docs, key, text, "string").where("doc_id IS NOT NULL")
    sketches = materialize(_sketches(docs), "sketches")
    first = materialize(sketches.groupBy("mark").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc"), "equal-sets")
    marked = materialize(sketches.join(first, "mark", "left").select("doc_id", "keys", F.coalesce("first_doc", "doc_id").alias("first_doc")), "sketches")
    keyed = marked.where("doc_id = first_doc").select("doc_id", F.explode("keys").alias("key")).distinct()
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard-sizes")
    parts = F.ceil(F.col("n") / shard).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    # with p parts, the pair (i, j) of parts is group i * p + j, i <= j; documents of one part meet in (i, i) only
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("part"), F.lit(-1).alias("own")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(
            (F.least("mine", j) * F.col("parts") + F.greatest("mine", j)).alias("part"), F.when(F.col("mine") == j, -1).otherwise(F.col("mine")).alias("own"))))
    placed = (keyed.join(sizes, "key").withColumn("parts", parts).withColumn("mine", own).select("doc_id", "key", F.explode(pairs).alias("g"))
              .groupBy("doc_id").agg(F.collect_list(F.struct("key", F.col("g.part").alias("part"), F.col("g.own").alias("own"))).alias("shards")))
    grouped = _with_sets(docs.join(placed, "doc_id")).repartition("key", "part").sortWithinPartitions("key", "part", "doc_id")
    links = grouped.mapInArrow(_shard_links, "a bigint, b bigint")
    roots = materialize(connected_components(links), "roots")
    named = marked.join(roots, marked.first_doc == roots.node, "left").select("doc_id", F.coalesce("root", "first_doc").alias("component_id"))
    return named.where("component_id <> doc_id").distinct()


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, all columns."""
    (gone,) = unused(docs, "_gone")
    copies = materialize(near_duplicate_groups(docs, key, text), "near-copies").select(F.col("doc_id").alias(gone))
    return docs.join(copies, F.col(f"`{key}`").cast("bigint") == F.col(gone), "left_anti")
