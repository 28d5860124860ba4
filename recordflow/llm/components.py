"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a pre-aggregated minimum and a join; nothing is collected but two numbers a round. Each round's
edges are checkpointed in the folder all executors share. Up to SMALL edges, which a round may also come down to, are put
together by one task of an executor instead: that spares the shuffles and gives the same result.

Defined cases: edges with a null end or from a node to itself don't count, repeated ones count once, and an empty
table gives no rows. What isn't found after `rounds` rounds (they grow as the square of the logarithm of a
component's size) raises an error; an unfinished result is never given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, shared_dir

SMALL = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) from all edges (u, v)."""
    pairs = [(longs(b.column(0)), longs(b.column(1))) for b in batches if b.num_rows]
    if not pairs:
        return
    u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    over = list(range(len(nodes)))  # nodes are in order, so the smallest number is the smallest node

    def root(x: int) -> int:
        while over[x] != x:
            over[x] = over[over[x]]
            x = over[x]
        return x

    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        x, y = root(x), root(y)
        over[max(x, y)] = min(x, y)
    roots = np.fromiter((root(x) for x in range(len(nodes))), np.int64, len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots])], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has an edge to another; component: the smallest node that it reaches."""
    shared_dir(edges.sparkSession)  # sets the folder where none is set
    e = edges.where(f"{a} is not null and {b} is not null").select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    for _ in range(rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        if now[0] <= SMALL:
            return e.select("u", "v").repartition(1).mapInArrow(_joined, "node bigint, component bigint").checkpoint()
        before = now
        # large star: all larger neighbours of a node go to the smallest node near it
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = small.distinct().checkpoint()
    else:
        raise RuntimeError(f"components of {before[0]} edges are not found after {rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
