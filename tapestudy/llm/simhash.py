"""SimHash near-duplicates with BK-trees.

Fingerprints: one 64-bit SimHash per document over its word shingles. Links: fingerprints that differ in at most `radius`
bits. The 64 bits are cut into radius + 2 blocks; two linked fingerprints agree on at least two whole blocks, so every
pair of blocks is one routing key and linked fingerprints meet in at least one bucket. A bucket of up to `shard` distinct
fingerprints is one shard: its BK-tree (children keyed by integer Hamming distance to the parent) is built and searched
in one task, following only the edges within the radius. Larger buckets are linked through the values that lie between
two fingerprints, in groups of at most 65, so no group of near copies meets in one task. Both ways are exact.

Only distinct fingerprints take part; equal ones share the smallest doc_id from a grouped aggregate. Components are
found with distributed star contractions.

Nulls and edge cases: null and empty texts have fingerprint zero and are linked like any other; texts shorter than a
shingle count as one shingle; repeated rows get the same component; rows without doc_id link nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .common import batch_of, text_batches, two_columns
from .components import connected_components

SEED = 42
BITS = 64


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of every run of k words (A-Z lower-cased, repeats included); fewer words: the whole sequence."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
    stops = (ends[k - 1:] - 1).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[i:i + 65536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for keys, texts in text_batches(batches, "text"):
            yield batch_of(schema, keys, [simhash(shingle_hashes(t, k)) for t in texts])

    return two_columns(docs, key, text, "string").mapInArrow(run, "doc_id bigint, fp bigint")


class BKTree:
    """A burkhard-keller tree over 64-bit integers with the Hamming distance."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d not in node[1]:
                node[1][d] = (value, {})
                return
            node = node[1][d]

    def within(self, value: int, radius: int):
        stack = [self.root] if self.root is not None else []
        while stack:
            other, children = stack.pop()
            d = (other ^ value).bit_count()
            if d <= radius:
                yield other
            for edge in range(max(d - radius, 0), d + radius + 1):
                if edge in children:
                    stack.append(children[edge])


def _bucket_links(members: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among (fingerprint, document) of one bucket."""
    tree, doc, parent = BKTree(), {}, {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for fp, d in members:
        doc[fp], parent[fp] = d, fp
        for other in tree.within(fp, radius):
            a, b = find(fp), find(other)
            if a != b:
                parent[a] = b
                out.append((d, doc[other]))
        tree.add(fp)
    return out


def _block_masks(radius: int) -> list[int]:
    """Masks of every pair of blocks among radius + 2 blocks, as signed 64-bit values."""
    cuts = [BITS * i // (radius + 2) for i in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [(m if m < 1 << 63 else m - (1 << 64)) for m in (a | b for a, b in combinations(blocks, 2))]


def fingerprint_links(distinct: DataFrame, radius: int = 2, shard: int = 256) -> DataFrame:
    """Links (a, b) that connect the rows (fp, doc_id) of ``distinct`` as all pairs within the radius do. One row per fp."""
    if radius > 2:
        raise ValueError("the way for large buckets covers a radius of up to 2")
    masks = _block_masks(radius)
    keyed = distinct.select("fp", "doc_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])).alias("k")
    ).select("fp", "doc_id", "k.band", "k.value")
    sizes = materialize(keyed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    members = materialize(keyed.join(sizes, ["band", "value"]), "buckets")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def trees(batches):
        key, rows = None, []
        for b in batches:
            found = []
            for band, value, fp, doc in zip(*(b.column(c).to_pylist() for c in ("band", "value", "fp", "doc_id"))):
                if (band, value) != key:
                    found += _bucket_links(rows, radius)
                    key, rows = (band, value), []
                rows.append((fp & (1 << 64) - 1, doc))
            if found:
                yield batch_of(schema, *zip(*found))
        if found := _bucket_links(rows, radius):
            yield batch_of(schema, *zip(*found))

    small = (members.where(F.col("n") <= shard).select("band", "value", "fp", "doc_id").repartition("band", "value")
             .sortWithinPartitions("band", "value").mapInArrow(trees, "a bigint, b bigint"))
    # within radius 2 both fingerprints are at most one bit from a common value
    hot = members.where(F.col("n") > shard).select("fp", "doc_id").distinct()
    flips = [1 << i if i < 63 else -(1 << 63) for i in range(BITS)]
    near = hot.select("doc_id", F.explode(F.array("fp", *[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("between"))
    lowest = near.groupBy("between").agg(F.min("doc_id").alias("a"), F.collect_list("doc_id").alias("all")).where(F.size("all") > 1)
    large = lowest.select("a", F.explode("all").alias("b")).where("a < b").distinct()
    return small.unionByName(large)


def near_duplicate_components(prints: DataFrame, radius: int = 2, shard: int = 256) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) for rows (doc_id, fp). Reads ``prints`` twice."""
    first = materialize(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(first, radius, shard))
    named = first.join(roots, first.doc_id == roots.node, "left").select("fp", F.coalesce("root", "doc_id").alias("component_id"))
    return prints.join(materialize(named, "fingerprint-roots"), "fp", "left").select("doc_id", "fp", "component_id")
