"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts are a group that isn't divided. Groups sorted by size, largest first, each enter the bin
with the tightest remaining capacity that they fit, found in a balanced tree. For a fixed number of shards the
capacity is an equal share of all bytes, so the sizes come out near equal.

The packing runs on the driver over a bounded list. Groups of at least a `grain`th of a share are items of their
own: there are at most shards * grain of them. All smaller groups are bundled by a hash of their text into as
many bundles as their bytes fill grains, at most shards * grain again. Only a group of more bytes than a whole
share, which fits no shard, is divided, by a hash of the identifier (at most `shards` groups can be so large).

Slots: each task counts its rows by shard, and the tasks' counts are summed into offsets.

Defined cases: a null text counts as empty: size 1 (the text's UTF-8 bytes plus 1), checksum 0. Rows without
identifier and rows that share one are rows like others; groups of equal size are placed in order of their texts' hashes. Texts of
any length count whole; only a group of more bytes than a shard is divided. Columns other than the two named may have any name and are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import longs, table


class Tree:
    """A balanced search tree (a treap) of keys that can be ordered."""

    def __init__(self, seed: int = 0):
        self.root, self.rng = None, random.Random(seed)

    def insert(self, key) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self.rng.random(), None, None]), high)

    def remove(self, key) -> None:
        low, rest = self._split(self.root, key)
        self.root = self._merge(low, self._without_first(rest))

    def at_least(self, key):
        """The smallest key not below this one, or None."""
        node, best = self.root, None
        while node:
            if node[0] >= key:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def largest(self):
        node = self.root
        while node and node[3]:
            node = node[3]
        return node and node[0]

    def _split(self, node, key):
        """Keys below this one, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]

    def _without_first(self, node):
        return node[3] if node[2] is None else [node[0], node[1], self._without_first(node[2]), node[3]]


def best_fit_decreasing(sizes: list[int], capacity: int, bins: int | None = None) -> list[int]:
    """The bin of each item. With a number of bins, an item that fits none enters the one with most room; without,
    it opens another, so there are few bins and none holds more than its capacity (but an item that is larger)."""
    tree, out, opened = Tree(), [0] * len(sizes), 0
    for i in range(bins or 0):
        tree.insert((capacity, i))
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = tree.at_least((sizes[i], -1))
        if got is None and bins:
            got = tree.largest()
        if got is None:
            got, opened = (capacity, opened), opened + 1
        else:
            tree.remove(got)
        out[i] = got[1]
        tree.insert((got[0] - sizes[i], got[1]))
    return out


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their task and their place among the task's rows of their shard."""
    pid, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        shard = longs(b.column(3))
        place = np.zeros(len(shard), np.int64)
        for s in np.unique(shard):
            here = np.flatnonzero(shard == s)
            place[here] = np.arange(len(here)) + seen.get(int(s), 0)
            seen[int(s)] = seen.get(int(s), 0) + len(here)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pid] * len(shard), pa.int32()), pa.array(place)], [*b.schema.names, "pid", "place"])


def shard(docs: DataFrame, shards: int = 16, grain: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "UTF-8")
    sized = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    sized = table(sized, "sized")
    groups = table(sized.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    share = max(1, -(-total // shards))
    least = max(1, share // grain)
    big = groups.where(F.col("bytes") >= least).collect()  # at most about shards * grain
    bundles = max(1, min(shards * grain, total // least))
    bundle = F.pmod(F.xxhash64("key"), F.lit(bundles))
    small = groups.where(F.col("bytes") < least).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect()
    over = [(bytes(r[0]), -(-r[1] // max(1, share // 8))) for r in big if r[1] > share]
    part = lambda n: F.pmod(F.xxhash64("doc_id", "text_crc32"), n).cast("int")
    items = [(r[1], "big", bytes(r[0]), 0) for r in big if r[1] <= share] + [(r[1], "small", r[0], 0) for r in small]
    if over:
        few = spark.createDataFrame(over, "key binary, pieces bigint")
        pieces = sized.join(F.broadcast(few), "key").groupBy("key", part(F.col("pieces")).alias("part")).agg(F.sum("size")).collect()  # at most 16 * shards
        items += [(r[2], "big", bytes(r[0]), r[1]) for r in pieces]
    items.sort(key=lambda x: (-x[0], x[1], str(x[2]), x[3]))
    bins = best_fit_decreasing([x[0] for x in items], share, shards)
    of: dict[bytes, list[int]] = {k: [0] * n for k, n in over}
    for x, s in zip(items, bins, strict=True):
        if x[1] == "big":
            of.setdefault(x[2], [0])[x[3]] = s
    bigs = spark.createDataFrame(list(of.items()), "key binary, shards array<int>")
    smalls = spark.createDataFrame([(x[2], s) for x, s in zip(items, bins, strict=True) if x[1] == "small"], "bundle bigint, small_shard int")
    placed = (
        sized.join(F.broadcast(bigs), "key", "left")
        .withColumn("bundle", bundle)
        .join(F.broadcast(smalls), "bundle", "left")  # both bounded by shards * grain
        .select("doc_id", "size", "text_crc32", F.coalesce(F.get("shards", part(F.size("shards"))), "small_shard").alias("shard"))
    )
    rows = table(placed.mapInArrow(_slots, "doc_id bigint, size bigint, text_crc32 bigint, shard int, pid int, place bigint"), "placed")
    counts = rows.groupBy("shard", "pid").agg(F.count(F.lit(1)).alias("n"))  # one row a task and shard
    before = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["shard", "pid"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).alias("slot"))
