"""Connected components of a link table by alternating star contractions (large-star, small-star)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .common import batch_of


def _contract(batches):
    """Union-find over the links that one task reads: as many links out as nodes in, at most."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    parent = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    out = [(x, find(x)) for x in parent if find(x) != x]
    for i in range(0, len(out), 50_000):
        yield batch_of(schema, *zip(*out[i:i + 50_000]))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-minima")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v."""
    low = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "star-minima")
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (two id columns) that is not itself the smallest of its component.

    Each round writes its links to the shared folder, so that lineage stays short and a lost executor costs one round.
    The number of rounds grows with the logarithm of the longest chain. Null links count for nothing."""
    a, b = (F.col(f"`{c}`") for c in links.columns[:2])
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    edges = materialize(edges.mapInArrow(_contract, "u bigint, v bigint"), "links")
    state = _state(edges)
    while state[0]:
        edges = materialize(_small_star(materialize(_large_star(edges), "links")), "links")
        after = _state(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
