"""N-gram Jaccard join over count vectors and R-trees.

A text's set of k-word shingles (numbered by 64-bit hashes) is hashed into groups, and the counts by group are
a point. Two sets share at most the sum of the smaller count of each coordinate, and the city-block distance
of their points is at most the size d of their symmetric difference, which the threshold bounds:
d <= (1 - t) / (1 + t) * (|A| + |B|).

One tree over all points can't be dealt out and would prune little (in many dimensions every point is near the
edge of many boxes), so the forest is dealt out by a rule that loses no pair: the fine coordinates (a count for
each shingle number) are cut into d + 2 s + 1 slices, d being the largest difference in a size class. Points that
are near enough agree in at least 2 s + 1 whole slices; each text leaves out its s emptiest slices, which say
little, so a slice is left that both give. Each is a bucket key. Texts give keys for their size class and for
each class in which a larger partner can be. Keys are shuffled and sorted; keys of one text only go at once.

Pairs are settled in two steps. First each bucket's hub, the member whose buckets hold most texts in all, is
compared with the other members: by the bound on their points, then on their sets. A group of near copies shares
most of its buckets and so most of its hubs, which makes its links grow with its size and not with its pairs.
What is left are buckets that hold members of two components besides the hub. Their points go into an R-tree, and
members of different components that the bound lets be linked become candidates; a bucket gives only as many of
these as hold its candidates together. Candidates that hang together are a family, and only families' sets are
shuffled. A family's task builds an R-tree over its points and goes through the pairs that the bound lets be
linked, the closest first: pairs that are in one component by then are skipped, the others verified on their sets.
It gives only the links that join components. Where links are to be counted, the first step is left out, all pairs
that the bound lets be linked are verified, and each text's links are added up in the task; pairs are not given
out. Buckets and families of more than BLOCK texts (or, for sets, SHINGLES shingles) are dealt out in blocks, each
pair of blocks to a task of its own; blocks of a family's largest component aren't paired with each other.

Texts with equal sets are collapsed to one representative before all that; within a task only the first of
them gives keys, so a set that a third of all rows share is no hot key.

Defined cases: null, empty or blank texts have no shingles, size 0, and are a component of their own. A text
of fewer than k words has its whole sequence as its only shingle. Rows without identifier get a null component
and are linked with nothing. Rows that share an identifier are each given back; a link of one is a link of all.
An empty table gives no rows. A text's links are the other rows, equal ones among them, whose sets link with its set;
their number presumes that rows which share an identifier share their text. Very long texts make one row of keys
each a slice and one set; texts are never cut. Columns of docs other than the two named are not read by classes() and
may have any name; dedup() gives them back as they are.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, fresh, grams, lean, longs, mix, numbers, octets, slices, table
from .components import components

GROUPS = 256  # coordinates of a point in the trees
BLOCK = 1000  # texts of a family, or hub's partners, in one task
SHINGLES = 4_000_000  # of a family's block, about
LEAF = 32


def shingles(text: bytes | None, k: int, memo: Memo) -> np.ndarray:
    """The distinct shingles' numbers in order."""
    w = numbers((text or b"").lower().split(), memo)  # split() is at \\x20 and \\x09-\\x0D, lower() is A-Z only
    if not len(w):
        return w
    return np.unique(grams(w, min(k, len(w))))


class Threshold:
    """Jaccard >= num / den in whole numbers, and the size classes that go with it."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        high = 20 * num >= 17 * den  # slices are long then, and few of them are empty
        ratio, self.spare = (1.4, 0.05) if high else (1.3, 0.15)
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * ratio)))

    def differ(self, total: int) -> int:
        """The largest symmetric difference of linked sets of `total` elements together."""
        return (self.den - self.num) * total // (self.den + self.num)

    def linked(self, inter, total):
        return self.den * inter >= self.num * (total - inter)

    def classes(self, n: int) -> list[int]:
        """The size classes a set of n elements gives keys for: its own, and each in which a larger partner can be."""
        own = bisect_right(self.bounds, n) - 1
        last = bisect_right(self.bounds, n * self.den // self.num) - 1
        return list(range(own, last + 1))

    def most(self, c: int) -> int:
        """The largest symmetric difference of a pair whose larger set is in size class c."""
        return self.differ(2 * (self.bounds[c + 1] - 1))


def keys(s: np.ndarray, t: Threshold) -> np.ndarray:
    """The bucket keys of a set."""
    out = []
    for c in t.classes(len(s)):
        if t.most(c) == 0:
            continue  # only equal sets can be linked, and these are one already
        drop = math.ceil(t.spare * t.most(c))
        b = t.most(c) + 2 * drop + 1
        of = ((s >> np.uint64(32)) * np.uint64(b)) >> np.uint64(32)  # slices are ranges of numbers, so s is in their order
        n = np.bincount(of.astype(np.int64), minlength=b)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(s))])  # wraps around, which is all right in a difference
        ends = np.cumsum(n)
        h = mix(sums[ends] - sums[ends - n] + np.arange(b, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c << 40))
        out.append(h[np.argsort(n, kind="stable")[drop:]])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


_ROWS = "sig bigint, kind byte, id bigint, ref bigint, n bigint, point binary"
_NAMES = ["sig", "kind", "id", "ref", "n", "point"]
_WHOLE, _KEY, _SAME = 0, 1, 2


def _emit(k: int, t: Threshold):
    """Rows of each text: its whole set (or the text of this task with the same set, if one came before) and its keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, first = Memo(), {}
        for b in batches:
            ids, texts = b.column(0).to_pylist(), octets(b.column(1))
            for i, j in slices(texts):
                sig, kind, own, ref, size, points = [], [], [], [], [], []
                for d, text in zip(ids[i:j], texts[i:j], strict=True):
                    s = shingles(text, k, memo)
                    n = len(s)
                    if not n or d is None:
                        sig.append(np.array([0 if d is None else d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], np.uint64))
                        row = [(_SAME, d, d)]
                    else:
                        m = mix(s)
                        a, c = int(m.sum()), int(mix(m + np.uint64(n)).sum())
                        one = first.get((a, c))
                        if one is None:
                            if len(first) > 50_000:
                                first.clear()
                            first[a, c] = d
                            own_keys = keys(s, t)
                            sig.append(np.concatenate([np.array([a], np.uint64), own_keys]))
                            row = [(_WHOLE, d, c - (1 << 64) if c >> 63 else c)]
                            kind += [_WHOLE] + [_KEY] * len(own_keys)
                            own += [d] * (1 + len(own_keys))
                            ref += [row[0][2]] + [0] * len(own_keys)
                            size += [n] * (1 + len(own_keys))
                            points += [packed(point(s))] + [None] * len(own_keys)
                            continue
                        sig.append(np.array([d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], np.uint64))
                        row = [(_SAME, d, one)]
                    kind.append(row[0][0])
                    own.append(d)
                    ref.append(row[0][2])
                    size.append(n)
                    points.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(kind, pa.int8()), pa.array(own, pa.int64()), pa.array(ref, pa.int64()), pa.array(size, pa.int64()), pa.array(points, pa.binary())], _NAMES)

    return lean(emit)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (kind, sig, ref, id): whole sets get their smallest id as ref; keys of one text go."""
    last = None  # (kind, sig, ref) of the row before, and the smallest id of its run
    low = 0
    held: list = []  # a key's first row, until the second comes

    def row(x) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0]], pa.int64()), pa.array([x[1]], pa.int8()), pa.array([x[2]], pa.int64()), pa.array([x[3]], pa.int64()), pa.array([x[4]], pa.int64()), pa.nulls(1, pa.binary())], _NAMES)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sig, kind, own, ref, size = longs(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), longs(b.column(2)), longs(b.column(3)), longs(b.column(4))
        new = np.ones(n, bool)
        new[1:] = (sig[1:] != sig[:-1]) | (kind[1:] != kind[:-1]) | (ref[1:] != ref[:-1])
        here = (int(kind[0]), int(sig[0]), int(ref[0]))
        new[0] = here != last
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1  # -1: goes on from the batch before
        lows = np.where(run >= 0, own[starts[run]] if len(starts) else 0, low)
        if held and not new[0]:
            yield row(held[0])
        held = []
        nxt = np.append(new[1:], True)
        alone = new & nxt
        keep = (kind != _KEY) | ~alone
        if kind[-1] == _KEY and alone[-1]:
            held = [(int(sig[-1]), _KEY, int(own[-1]), 0, int(size[-1]))]
        last, low = (int(kind[-1]), int(sig[-1]), int(ref[-1])), int(lows[-1])
        out_ref = np.where(kind == _WHOLE, lows, np.where(kind == _SAME, ref, 0))
        cols = [pa.array(sig), b.column(1), b.column(2), pa.array(out_ref), b.column(4), b.column(5).cast(pa.binary())]
        mask = pa.array(keep)
        null_ref = pa.array((kind == _SAME) & np.asarray(b.column(3).is_null()))
        cols[3] = pc.if_else(null_ref, pa.scalar(None, pa.int64()), cols[3])
        yield pa.RecordBatch.from_arrays([c.filter(mask) for c in cols], _NAMES)


def point(s: np.ndarray) -> np.ndarray:
    """Counts by group."""
    return np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype("<u4")


def packed(x: np.ndarray) -> bytes:
    """A point in as few bytes a count as hold it."""
    return x.astype("<u1" if x.max(initial=0) < 256 else "<u4").tobytes()


def unpacked(points: list[bytes]) -> np.ndarray:
    """Points, one a row."""
    out = np.empty((len(points), GROUPS), "<u4")
    for i, x in enumerate(points):
        out[i] = np.frombuffer(x, "<u1" if len(x) == GROUPS else "<u4")
    return out


def _sets(k: int, names: list[str]):
    """The second column's shingles in place of the text; what else is named goes through."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for b in batches:
            got = [shingles(t, k, memo).tobytes() for t in octets(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary()), *b.columns[2:]], names)

    return lean(sets)


class RTree:
    """Points in boxes, packed by sorting and tiling: by size first, then by the coordinate that spreads most.

    A box keeps the largest value of each coordinate and the smallest size of its points; what a point shares
    with any of them is at most the sum of the smaller values.
    """

    def __init__(self, points: np.ndarray):
        self.points, self.size = points, points.sum(1, dtype=np.int64)
        self.order = self._pack(np.arange(len(points)), 0)
        starts = np.arange(0, len(points), LEAF)
        self.levels = [(np.maximum.reduceat(points[self.order], starts), np.minimum.reduceat(self.size[self.order], starts))]
        while len(self.levels[-1][1]) > LEAF:
            high, low = self.levels[-1]
            starts = np.arange(0, len(low), LEAF)
            self.levels.append((np.maximum.reduceat(high, starts), np.minimum.reduceat(low, starts)))

    def _pack(self, rows: np.ndarray, depth: int) -> np.ndarray:
        if len(rows) <= LEAF:
            return rows
        by = self.size[rows] if depth == 0 else self.points[rows][:, int(self.points[rows].var(0).argmax())]
        rows = rows[np.argsort(by, kind="stable")]
        half = (len(rows) // 2 + LEAF - 1) // LEAF * LEAF  # leaves stay full
        return np.concatenate([self._pack(rows[:half], depth + 1), self._pack(rows[half:], depth + 1)])

    def near(self, q: np.ndarray, t: Threshold) -> np.ndarray:
        """Rows whose sets the bound lets be linked with q's."""
        size = int(q.sum())
        nodes = np.arange(len(self.levels[-1][1]))
        for level in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[level]
            nodes = nodes[t.linked(np.minimum(high[nodes], q).sum(1, dtype=np.int64), low[nodes] + size)]
            if not len(nodes):
                return nodes
            of = len(self.levels[level - 1][1]) if level else len(self.order)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < of]
        rows = self.order[nodes]
        return rows[t.linked(np.minimum(self.points[rows], q).sum(1, dtype=np.int64), self.size[rows] + size)]


class Union:
    """Disjoint sets of the numbers up to n; `of` names the set that each is in from the start."""

    def __init__(self, n: int, of: np.ndarray | None = None):
        self.over = list(range(n))
        if of is not None:
            _, first, inverse = np.unique(of, return_index=True, return_inverse=True)
            self.over = first[inverse].tolist()

    def root(self, x: int) -> int:
        over = self.over
        while over[x] != x:
            over[x] = over[over[x]]
            x = over[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        x, y = self.root(x), self.root(y)
        self.over[max(x, y)] = min(x, y)
        return x != y


def candidates(points: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, t: Threshold) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of one side, each with those of the other side in another component that the bound lets be linked; every pair once."""
    if len(left) > len(right):
        left, right = right, left
    same = len(left) == len(right) and bool((left == right).all())
    if same:  # each such pair has an end outside the largest component
        value, count = np.unique(comp[left], return_counts=True)
        asked = left[comp[left] != value[count.argmax()]]
    else:
        asked = left
    tree = RTree(points[right])
    took = np.zeros(len(points), bool)
    took[asked] = same
    for i in asked.tolist():
        j = right[tree.near(points[i], t)]
        j = j[(comp[j] != comp[i]) & ~(took[j] & (j <= i))]
        if len(j):
            yield i, j


def spanning_links(points: np.ndarray, sets: list[np.ndarray], comp: np.ndarray, left: np.ndarray, right: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """Links between rows of `left` and rows of `right` that join their components as all links would."""
    size = points.sum(1, dtype=np.int64)
    a, b, shared = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0, np.float32)]
    for i, j in candidates(points, comp, left, right, t):
        a.append(np.full(len(j), i, np.int32))
        b.append(j.astype(np.int32))
        shared.append((np.minimum(points[j], points[i]).sum(1, dtype=np.int64) / (size[j] + size[i])).astype(np.float32))
    order = np.argsort(-np.concatenate(shared), kind="stable")
    del shared
    a, b = np.concatenate(a)[order], np.concatenate(b)[order]
    over, out = Union(len(points), comp), []
    for at in range(0, len(a), 50_000):
        for x, y in zip(a[at : at + 50_000].tolist(), b[at : at + 50_000].tolist(), strict=True):
            if over.root(x) == over.root(y):
                continue
            both = np.concatenate([sets[x], sets[y]])
            both.sort()
            if t.linked(int((both[1:] == both[:-1]).sum()), len(both)):
                over.join(x, y)
                out.append((min(x, y), max(x, y)))
    return out


def all_links(points: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, right: np.ndarray, t: Threshold) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links as spanning_links gives them, and for each text how many rows of the other side it links with."""
    tree, sizes = RTree(points[right]), np.array([len(s) for s in sets])
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    held = np.zeros(int(sizes.sum()), bool)
    over, out, counts = Union(len(sets)), [], np.zeros(len(sets), np.int64)
    for i in left.tolist():
        j = right[tree.near(points[i], t)]
        j = j[j > i] if left is right else j[j != i]
        held[codes[i]] = True
        shared = np.fromiter((np.count_nonzero(held[codes[x]]) for x in j.tolist()), np.int64, len(j))
        held[codes[i]] = False
        j = j[t.linked(shared, sizes[j] + sizes[i])]
        counts[i] += copies[j].sum()
        counts[j] += copies[i]
        out += [(i, x) for x in j.tolist() if over.join(i, x)]
    return out, counts


def _groups(solve, width: int):
    """Runs solve(key, rows) for rows in order of their first `width` columns, a run of equal ones at a time."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([longs(batch.column(c)) for c in range(width)], 1)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            for s, e in zip(starts, np.append(starts[1:], len(keys)), strict=True):
                now = tuple(keys[s].tolist())
                if parts and now != key:
                    yield from solve(key, pa.Table.from_batches(parts))
                    parts = []
                key = now
                parts.append(batch.slice(s, e - s))
        if parts:
            yield from solve(key, pa.Table.from_batches(parts))

    return lean(groups)


def _sides(key: tuple, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left = np.flatnonzero(own == key[1])
    return left, left if key[1] == key[2] else np.flatnonzero(own == key[2])


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.int64())], ["a", "b", "n"])


_LINKS = "a bigint, b bigint, n bigint"


def _bounded(t: Threshold):
    """Of (hub, id, hub's point, point) the pairs that the bound lets be linked."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (unpacked(b.column(c).to_pylist()) for c in (2, 3))
            keep = t.linked(np.minimum(x, y).sum(1, dtype=np.int64), x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in (0, 1)], ["hub", "id"])

    return lean(bounded)


def _stars(t: Threshold):
    """From (hub, salt, role, id, shingles) in that order, the hub's own sets in role 0, to the links of the hub."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for b in batches:
            links = []
            for hub, salt, role, i, s in zip(*[b.column(c).to_pylist() for c in range(4)], octets(b.column(4)), strict=True):
                s = np.frombuffer(s, "<u8")
                if at != (hub, salt):
                    at, hubs = (hub, salt), []
                if not role:
                    hubs.append(s)
                elif any(t.linked(len(np.intersect1d(s, h, assume_unique=True)), len(s) + len(h)) for h in hubs):
                    links.append((hub, i))
            if links:
                yield _pairs(*np.array(links, np.int64).T)

    return lean(stars)


def _hints(t: Threshold):
    """From (sig, i, j, own, id, comp, point) in order of the first three to candidates that hold all candidates of a bucket together."""

    def solve(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        own, ids, comp = (longs(rows.column(c).combine_chunks()) for c in (3, 4, 5))
        left, right = _sides(key, own)
        if len(left) and len(right) and (comp != comp[0]).any():
            of, some = np.arange(len(ids)), []
            for x, near in candidates(unpacked(rows.column(6).to_pylist()), comp, left, right, t):
                apart, at = np.unique(of[near], return_index=True)
                for o, y in zip(apart.tolist(), near[at].tolist(), strict=True):
                    if o != of[x]:
                        some.append((x, y))
                        of[of == o] = of[x]
            if some:
                yield _pairs(*ids[np.array(some).T])

    return _groups(solve, 3)


def _families(t: Threshold, count: bool):
    """From (family, i, j, own, id, comp, copies, shingles) in order of the first three to links between blocks i and j of each family.

    With count, also a row (id, null, n) of each text that has links there, to n rows.
    """

    def solve(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if count:  # rows that share identifier and text are one, with all their copies
            seen = dict(zip(zip(rows.column(4).to_pylist(), rows.column(7).to_pylist(), strict=True), range(rows.num_rows), strict=True))
            if len(seen) < rows.num_rows:
                rows = rows.take(pa.array(sorted(seen.values()), pa.int64())).combine_chunks()
        own, ids, comp, copies = (longs(rows.column(c).combine_chunks()) for c in (3, 4, 5, 6))
        left, right = _sides(key, own)
        if not len(left) or not len(right):
            return
        sets = [np.frombuffer(x, "<u8") for x in rows.column(7).to_pylist()]
        points = np.stack([point(s) for s in sets])
        if count:
            links, counts = all_links(points, sets, copies, left, right, t)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(counts[some])], ["a", "b", "n"])
        else:
            links = spanning_links(points, sets, comp, left, right, t)
        if links:
            yield _pairs(*ids[np.array(links).T])

    return _groups(solve, 3)


def _dealt(rows: DataFrame, group: str, shape: DataFrame) -> DataFrame:
    """rows with i and j, the pair of blocks of their group that each goes to, and own, the one it belongs to.

    shape: (group, main, blocks_main, blocks_rest) of each group. Blocks of the component `main` come first and aren't
    paired with each other, if there are other blocks; what is not of it goes to the blocks after.
    """
    rows = rows.join(shape, group)
    hashed = F.xxhash64("id")
    inside = (F.col("comp") == F.col("main")) & (F.col("blocks_main") > 0)
    own = F.when(inside, F.pmod(hashed, F.greatest("blocks_main", F.lit(1)))).otherwise(F.col("blocks_main") + F.pmod(hashed, F.greatest("blocks_rest", F.lit(1)))).cast("int")
    others = F.sequence(F.when(inside, F.col("blocks_main")).otherwise(0), F.col("blocks_main") + F.col("blocks_rest") - 1)
    out = rows.withColumn("own", own).withColumn("other", F.explode(others))
    return out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "main", "blocks_main", "blocks_rest")


def _shape(rows: DataFrame, group: str, weight: str | None = None, every: bool = False) -> DataFrame:
    """For _dealt(): blocks by the number of texts in each group and what they weigh. every: all blocks are paired."""
    load = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(weight) / SHINGLES) if weight else F.count(F.lit(1)) / BLOCK
    by_comp = rows.groupBy(group, "comp").agg(load.alias("load"))
    of = by_comp.groupBy(group).agg(F.max_by("comp", F.struct("load", "comp")).alias("main"), F.max("load").alias("most"), F.sum("load").alias("load"))
    # a group that fits one block needs no blocks of its largest component
    main = F.when((F.col("load") > 1) & (F.col("most") >= 0.5) & F.lit(not every), F.ceil("most")).otherwise(0).cast("int")
    rest = F.when(main > 0, F.ceil(F.round(F.col("load") - F.col("most"), 6))).otherwise(F.ceil("load")).cast("int")
    return of.select(group, "main", main.alias("blocks_main"), rest.alias("blocks_rest")).where("blocks_rest > 0")


def _small(ids: DataFrame) -> DataFrame:
    """A table of a few numbers a row: up to a million rows are broadcast, more joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= 1_000_000 else ids


def _known(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of some ids."""
    return texts.join(_small(wanted), "id")


def _hub_links(buckets: DataFrame, points: DataFrame, texts: DataFrame, k: int, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """(sig, id, hub) of each bucket's members beside its hub, and the links (a, b) of hubs with members of their buckets."""
    weight = buckets.groupBy("id").agg(F.sum("members").alias("weight"))
    first = Window.partitionBy("sig").orderBy(F.desc("weight"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = buckets.join(weight, "id").select("sig", "id", F.first("id").over(first).alias("hub")).where("id <> hub")
    rest = table(rest, "hubs")
    pairs = rest.select("hub", "id").distinct()
    held = pairs.join(points, "id").select("hub", "id", "point").join(points.select(F.col("id").alias("hub"), F.col("point").alias("own")), "hub")
    near = held.select("hub", "id", "own", "point").mapInArrow(_bounded(t), "hub bigint, id bigint").distinct().checkpoint()
    salts = near.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    salted = near.join(salts, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "id")
    own = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("hub").alias("id"))
    wanted = near.select("id").union(near.select("hub")).distinct().checkpoint()
    sets = _known(texts, wanted).select("id", "text").mapInArrow(_sets(k, ["id", "shingles"]), "id bigint, shingles binary")
    dealt = salted.union(own).join(sets, "id").select("hub", "salt", "role", "id", "shingles")
    links = dealt.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "id").mapInArrow(_stars(t), _LINKS)
    return rest, links.select("a", "b").distinct().checkpoint()


def classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count: bool = False) -> DataFrame:
    """A row per row of docs: id, n_shingles, component_id and, with count, n_links. Sets link where Jaccard >= num / den."""
    t = Threshold(num, den)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = texts.mapInArrow(_emit(k, t), _ROWS).repartition("sig").sortWithinPartitions("kind", "sig", "ref", "id")
    rows = table(rows.mapInArrow(_match, _ROWS), "matches")
    whole = rows.where(f"kind = {_WHOLE}").select("id", F.col("ref").alias("rep"), "n")
    same = rows.where(f"kind = {_SAME}").select("id", "ref", "n")
    # keys of a text whose set another text stands for are that text's too
    others = whole.groupBy("id").agg(F.max(F.col("rep") == F.col("id")).alias("stands")).where("not stands").select("id").checkpoint()
    keyed = rows.where(f"kind = {_KEY}").select("sig", "id").join(_small(others), "id", "left_anti")
    crowd = F.count(F.lit(1)).over(Window.partitionBy("sig"))
    buckets = table(keyed.select("sig", "id", crowd.alias("members")).where("members > 1"), "buckets")
    points = rows.where(f"kind = {_WHOLE} and id = ref").select("id", "n", "point")
    if count:
        again = same.where("n > 0").groupBy(F.col("ref").alias("id")).agg(F.count(F.lit(1)).alias("more"))
        # of rows that share an identifier, one takes the copies that other rows name by it
        whole_ids = whole.groupBy("id", "rep").agg(F.count(F.lit(1)).alias("own"))
        copies = whole_ids.join(again, "id", "left").groupBy("rep").agg(F.sum(F.col("own") + F.coalesce("more", F.lit(0))).alias("copies")).checkpoint()
        left = buckets.select("sig", "id", F.col("id").alias("comp"))
    else:
        rest, links = _hub_links(buckets, points.select("id", "point"), texts, k, t)
        comp = components(links)
        left = rest.join(comp.withColumnRenamed("node", "id"), "id", "left").select("sig", "id", F.coalesce("component", "id").alias("comp"))
        of = Window.partitionBy("sig")
        left = left.select("*", F.min("comp").over(of).alias("low"), F.max("comp").over(of).alias("high")).where("low <> high").select("sig", "id", "comp").checkpoint()
    held = left.join(points.select("id", "point"), "id")
    dealt = _dealt(held, "sig", _shape(left, "sig", every=count)).select("sig", "i", "j", "own", "id", "comp", "point")
    hints = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(_hints(t), _LINKS)
    family = components(hints.select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("family"))
    if count:
        family = family.join(copies.withColumnRenamed("rep", "id"), "id").withColumn("comp", F.col("id"))
    else:
        family = family.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", "family", F.lit(1).cast("bigint").alias("copies"), F.coalesce("component", "id").alias("comp"))
    family = family.join(points.groupBy("id").agg(F.sum("n").alias("n")), "id").checkpoint()
    names = ["id", "shingles", "family", "comp", "copies"]
    sets = _known(texts, family.drop("n")).select("id", "text", "family", "comp", "copies").mapInArrow(_sets(k, names), "id bigint, shingles binary, family bigint, comp bigint, copies bigint")
    dealt = _dealt(sets, "family", _shape(family, "family", "n", every=count)).select("family", "i", "j", "own", "id", "comp", "copies", "shingles")
    more = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(_families(t, count), _LINKS).checkpoint()
    found = more.where("b is not null").select("a", "b").distinct()
    if count:
        comp = components(found)
    elif not found.isEmpty():
        comp = components(links.union(found))
    first = whole.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    extra = []
    if count:
        extra = ["n_links"]
        seen = more.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("found"))
        first = first.join(copies, "rep").join(seen, "rep", "left").withColumn("n_links", F.coalesce("found", F.lit(0)) + F.col("copies") - 1)
    first = first.select("id", "n", F.coalesce("component", "rep").alias("component_id"), *extra).checkpoint()
    again = same.join(first.select(F.col("id").alias("ref"), "component_id", *extra).distinct(), "ref", "left")
    links_again = [F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links")] if count else []
    again = again.select("id", "n", F.coalesce("component_id", "ref").alias("component_id"), *links_again)
    out = first.union(again)
    # a text that came after an equal one of its task may have the smaller identifier
    low = again.where("id < component_id").groupBy("component_id").agg(F.min("id").alias("low"))
    out = out.join(low, "component_id", "left").withColumn("component_id", F.coalesce("low", "component_id"))
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", *extra)


def dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the one with its smallest identifier, and rows without one."""
    (gone,) = fresh(docs, "gone")
    out = classes(docs, k, num, den, id_col, text_col).where("id <> component_id").select(F.col("id").alias(gone)).distinct()
    return docs.join(out, F.col(f"`{id_col}`") == F.col(gone), "left_anti")
