"""Suffix-array dedup by bucket-pointer refinement: bytes covered by a string of `length` bytes that occurs twice.

Sorting all suffixes of a corpus together can't be dealt out, and isn't needed to find repeats of a fixed
length. Each window of `length` bytes picks the q-gram with the smallest hash in it (leftmost of equals), so equal
windows pick equal q-grams at the same place: these q-grams are the initial buckets, and every window belongs to
exactly one pick. A pick's record is its bucket, the range of windows that chose it, and a hash of all bytes
of that range.

Records are shuffled and sorted by (bucket, hash), the hash being one of 128 bits. Records with equal hashes cover each
other's whole ranges; of them one goes on for the others. A bucket with different ranges is then refined in full: the
units of its ranges are fetched, positions get buckets by the q-gram that starts there, and each round sorts them by
(own bucket, bucket of the position that many units later), which doubles the length that a bucket stands
for; a round reuses the buckets that the one before updated, and positions alone in their bucket drop out.
Buckets for `length` units that hold two positions or more are repeats. Buckets with very many different ranges
are dealt out again by the hash of each window, so no task holds one whole.

At last the ranges of each document are joined to it and its bytes removed. Matches never cross documents. Only
documents with ranges are shuffled, as long as a million identifiers name them all; beyond that all are.

Units are bytes. Passages that repeat are also found in units of words (between white space, as they are written): a
passage of some fifty words may be shorter than `length` bytes. This is counted beside the removal, which it doesn't change.

Defined cases: a null text counts as empty. Texts shorter than `length` lose nothing. Rows are told apart by
identifier and text, so rows without identifier and rows that share one are each given back (equal rows lose
everything they share with each other). Texts of any length are read whole, in pieces that overlap by a window. Columns of
docs other than the two named may have any name and are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, lean, longs, mix, numbers, octets, slices, table

CHUNK = 1 << 20  # bytes hashed at a time
MANY = 4_000  # ranges of a bucket that one task refines
IDS = 1_000_000  # of documents that are broadcast, at most: two numbers each
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))


class Hashes:
    """64-bit hashes of any piece of a buffer of bytes or words' numbers, from prefix sums."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: np.ndarray, base: int = _BASES[0]):
        n = len(raw) + 1
        up, down = self.powers.get(base, (np.empty(0, np.uint64),) * 2)
        if len(up) < n:
            size = max(n, CHUNK + 1)
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            up, down = self.powers[base] = np.cumprod(up), np.cumprod(down)
        self.down = down
        self.sums = np.zeros(n, np.uint64)
        values = _TABLE[raw] if raw.dtype == np.uint8 else mix(raw)
        if base != _BASES[0]:
            values = mix(values + np.uint64(base))
        np.cumsum(values * up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        """The hashes of all pieces of this length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n] if n > 0 else np.empty(0, np.uint64)


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w successive entries."""
    n = len(x)
    if w > n:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def picks(raw: np.ndarray, ends: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """(place, first window, last window, bucket, both hashes of range) of each pick in a buffer of texts; ends: of each unit's text."""
    n = len(raw) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 3
    hashes = Hashes(raw)
    grams = hashes.all(q)
    bits = np.uint64(max(1, int(len(raw)).bit_length()))
    order = (mix(grams) >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    best = (window_minimum(order, length - q + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    p = np.flatnonzero(np.arange(n) + length <= ends[:n])
    at = best[p]
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
    starts = np.flatnonzero(new)
    first, last = p[starts], p[np.append(starts[1:], len(p)) - 1] if len(p) else p[:0]
    place = at[starts]
    shape = ((place - first) << 24 | (last - first)).astype(np.uint64)
    whole = [mix(h.of(first, last + length) ^ mix(shape)) for h in (hashes, Hashes(raw, _BASES[1]))]
    return place, first, last, mix(grams[place] + np.uint64(q)), *whole


_PICKS = "bucket bigint, range bigint, range2 bigint, id bigint, text_hash bigint, first bigint, last bigint"


def _units(words: bool):
    """What cuts a text into units: its bytes, or its words' numbers."""
    if not words:
        return lambda text: np.frombuffer(text, np.uint8)
    memo = Memo()
    return lambda text: numbers(text.split(), memo)


def _pick(length: int, q: int, words: bool):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(words)
        for b in batches:
            texts = [t or b"" for t in octets(b.column(2))]
            for i, j in slices(texts, CHUNK):
                some = [(r, 0, x) for r in range(i, j) if len(x := units(texts[r])) >= length]
                groups = [some]
                if len(some) == 1 and len(some[0][2]) > CHUNK:
                    x = some[0][2]
                    groups = [[(i, s, x[s : s + CHUNK - 1])] for s in range(0, len(x) - length + 1, CHUNK - length)]  # each window lies in exactly one
                for group in groups:
                    if not group:
                        continue
                    sizes = np.array([len(x[2]) for x in group], np.int64)
                    raw = np.concatenate([x[2] for x in group])
                    place, first, last, bucket, *whole = picks(raw, np.repeat(np.cumsum(sizes), sizes), length, q)
                    of = np.searchsorted(np.cumsum(sizes), first, "right")
                    shift = (np.array([x[1] for x in group]) - (np.cumsum(sizes) - sizes))[of]
                    rows = pa.array(np.array([x[0] for x in group])[of])
                    hashed = [pa.array(x.view(np.int64)) for x in (bucket, *whole)]
                    yield pa.RecordBatch.from_arrays([*hashed, b.column(0).take(rows), b.column(1).take(rows), pa.array(first + shift), pa.array(last + shift)], ["bucket", "range", "range2", "id", "text_hash", "first", "last"])

    return lean(pick)


_FULL, _OPEN, _STANDS = 0, 1, 2  # its whole range is repeated; to be refined; stands for repeated ranges in that


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From picks in order of (bucket, range, range2) to (kind, bucket, id, text_hash, first, last)."""
    held: pa.RecordBatch | None = None  # one row, whose successor decides
    before = (None, None, None)  # the row before it
    leads = True  # the held row's range is the first of its bucket

    def emit(b: pa.RecordBatch, ended: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, before, leads
        bucket, rng, rng2 = longs(b.column(0)), longs(b.column(1)), longs(b.column(2))
        n = len(bucket)
        new_b, new_r = np.ones(n, bool), np.ones(n, bool)
        new_b[1:] = bucket[1:] != bucket[:-1]
        new_r[1:] = new_b[1:] | (rng[1:] != rng[:-1]) | (rng2[1:] != rng2[:-1])
        new_b[0] = before[0] != int(bucket[0])
        new_r[0] = new_b[0] or before[1:] != (int(rng[0]), int(rng2[0]))
        first_range = np.zeros(n, bool)  # by row: its range is the first of its bucket
        starts = np.flatnonzero(new_r)
        run = np.cumsum(new_r) - 1
        head = new_b[starts]
        first_range = np.where(run >= 0, head[run] if len(head) else False, leads)
        end_r, end_b = np.append(new_r[1:], True), np.append(new_b[1:], True)
        alone = new_r & end_r
        multi = ~(first_range & end_b)  # right where the range ends
        done = n if ended else n - 1
        ok = np.arange(n) < done
        parts = [(_FULL, ok & ~alone), (_OPEN, ok & alone & multi), (_STANDS, ok & ~alone & end_r & multi)]
        for kind, mask in parts:
            if mask.any():
                some = b.filter(pa.array(mask))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * some.num_rows, pa.int32()), *[some.column(c) for c in (0, 3, 4, 5, 6)]], ["kind", "bucket", "id", "text_hash", "first", "last"])
        if not ended:
            held, leads = b.slice(n - 1, 1), bool(first_range[-1])
            if n > 1:
                before = (int(bucket[-2]), int(rng[-2]), int(rng2[-2]))

    for b in batches:
        if b.num_rows:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            yield from emit(b, False)
    if held is not None:
        yield from emit(held, True)


def refine(ranges: list[bytes], length: int, kind: str = "u1") -> list[np.ndarray]:
    """For each range of windows (len - length + 1 of them) which of its windows occur twice or more in all. kind: of the units."""
    raw = np.frombuffer(b"".join(ranges), kind)
    sizes = np.array([len(r) for r in ranges], np.int64) // raw.itemsize
    stops = np.repeat(np.cumsum(sizes), sizes)
    q = -(-length // 8)
    ids = np.full(len(raw), -1, np.int64)
    grams = Hashes(raw).all(q)

    def buckets(at: np.ndarray, keys: np.ndarray) -> None:
        """New buckets for the positions `at`; all others are alone and out."""
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        ids[:] = -1
        keep = count[inverse] > 1
        ids[at[keep]] = inverse[keep]

    at = np.flatnonzero(np.arange(len(raw)) + q <= stops)
    _, inverse = np.unique(grams[at], return_inverse=True)
    ids[at] = inverse
    known = q
    while known < length:
        later = min(known, length - known)  # the last round's second part overlaps the first
        at = np.flatnonzero(ids >= 0)
        at = at[at + later + known <= stops[at]]
        at = at[ids[at + later] >= 0]
        buckets(at, ids[at] << 32 | ids[at + later])
        known += later
    found = ids >= 0
    bounds = np.cumsum(sizes)
    return [found[e - n : e - length + 1] for e, n in zip(bounds.tolist(), sizes.tolist(), strict=True)]


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], found.view(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


_SPANS = "id bigint, text_hash bigint, first bigint, last bigint"


def _cut(length: int, words: bool):
    """From (id, text_hash, text, ranges) to each range with its units: (kind, bucket, id, text_hash, first, last, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(words)
        for b in batches:
            for i, h, t, ranges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), octets(b.column(2)), b.column(3).to_pylist(), strict=True):
                x = units(t or b"")
                rows = [(r["kind"], r["bucket"], i, h, r["first"], r["last"], x[r["first"] : r["last"] + length].tobytes()) for r in ranges]
                kinds = (pa.int32(), *[pa.int64()] * 5, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["kind", "bucket", "id", "text_hash", "first", "last", "bytes"])

    return lean(run)


def _refined(length: int, kind: str):
    """From (kind, bucket, id, text_hash, first, last, bytes) in order of bucket to repeated ranges of windows."""

    def solve(rows: list) -> Iterator[pa.RecordBatch]:
        out = []
        for (state, _, i, h, first, _, _), found in zip(rows, refine([r[6] for r in rows], length, kind), strict=True):
            if state == _OPEN:
                for s, e in zip(*_runs(found), strict=True):
                    out.append((i, h, first + int(s), first + int(e)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["id", "text_hash", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        size = 0
        for b in batches:
            cols = [b.column(c).to_pylist() for c in range(6)]
            for row in zip(*cols, octets(b.column(6)), strict=True):
                if rows and rows[-1][1] != row[1] and size > CHUNK // 2:  # several small buckets together: other buckets add no false repeats
                    yield from solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
        if rows:
            yield from solve(rows)

    return run


def _windows(length: int, unit: str):
    """A row per window, for buckets with very many ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in range(6)]
            for kind, _, i, h, first, _, raw in zip(*cols, octets(b.column(6)), strict=True):
                w, w2 = (mix(Hashes(np.frombuffer(raw, unit), base).all(length)) for base in _BASES)
                n = len(w)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(w2.view(np.int64)), pa.array([kind] * n, pa.int32()), pa.array([i] * n, pa.int64()), pa.array([h] * n, pa.int64()), pa.array(np.arange(first, first + n))], ["w", "w2", "kind", "id", "text_hash", "first"])

    return run


def _covered(ranges: list[dict] | None, length: int) -> list[list[int]]:
    """Start and end of the maximal runs that the windows of some ranges cover."""
    spans: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in ranges or ()):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    return spans


def _removed(length: int, words: int):
    """From (doc_id, text, ranges, ranges in words) to the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, ranges, passages in zip(octets(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                t, spans = t or b"", _covered(ranges, length)
                digest, at = hashlib.sha256(), 0
                for s, e in spans:
                    digest.update(t[at:s])
                    at = e
                digest.update(t[at:])
                out.append((len(t), sum(e - s for s, e in spans), len(spans), digest.hexdigest(), [x for s in spans for x in s], sum(e - s for s, e in _covered(passages, words))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passage_words"]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)]], names)

    return lean(run)


def _same(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["text_hash"] == b["text_hash"])


def _of(rows: DataFrame, ids: DataFrame, n: int, how: str = "left_semi") -> DataFrame:
    return rows.join(F.broadcast(ids) if n <= IDS else ids, _same(rows, ids), how)


def _repeated(rows: DataFrame, length: int, q: int, words: bool) -> DataFrame:
    """(id, text_hash, ranges) of the documents with repeated windows: first and last windows of ranges of them."""
    unit = "<u8" if words else "u1"
    picked = rows.mapInArrow(_pick(length, q, words), _PICKS).repartition("bucket").sortWithinPartitions("bucket", "range", "range2")
    kinds = table(picked.mapInArrow(_compare, "kind int, bucket bigint, id bigint, text_hash bigint, first bigint, last bigint"), "ranges")
    rest = kinds.where(f"kind <> {_FULL}")
    many = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select("bucket", F.lit(True).alias("many"))
    by_text = rest.groupBy("id", "text_hash").agg(F.collect_list(F.struct("kind", "bucket", "first", "last")).alias("ranges"))
    ids = rest.select("id", "text_hash").distinct().checkpoint()
    some = _of(rows, ids, ids.count())
    with_bytes = some.join(by_text, _same(some, by_text)).select(some["id"], some["text_hash"], "text", "ranges")
    with_bytes = with_bytes.mapInArrow(_cut(length, words), "kind int, bucket bigint, id bigint, text_hash bigint, first bigint, last bigint, bytes binary")
    crowded = not many.isEmpty()
    marked = with_bytes.join(many, "bucket", "left") if crowded else with_bytes.withColumn("many", F.lit(None).cast("boolean"))
    marked = marked.select("kind", "bucket", "id", "text_hash", "first", "last", "bytes", "many")
    if crowded:
        marked = table(marked, "cut")  # read twice, cut and dealt out once
    few = marked.where("many is null").drop("many").repartition("bucket").sortWithinPartitions("bucket")
    spans = few.mapInArrow(_refined(length, unit), _SPANS)
    if crowded:
        windows = marked.where("many").drop("many").mapInArrow(_windows(length, unit), "w bigint, w2 bigint, kind int, id bigint, text_hash bigint, first bigint")
        twice = windows.groupBy("w", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "w2")
        spans = spans.union(windows.join(twice, ["w", "w2"]).where(f"kind = {_OPEN}").select("id", "text_hash", "first", F.col("first").alias("last")))
    spans = kinds.where(f"kind = {_FULL}").select("id", "text_hash", "first", "last").union(spans)
    return table(spans.groupBy("id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "repeats")


def repeats(docs: DataFrame, length: int = 400, q: int | None = None, id_col: str = "doc_id", text_col: str = "text", words: int = 0) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of each, in bytes), n_passage_words.

    words: if not 0, the last column counts the words in passages of that many words or more that also start elsewhere.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    spans = _repeated(rows, length, q or max(1, length // 4), False)
    if words:
        passages = _repeated(rows, words, max(1, words // 4), True).withColumnRenamed("ranges", "passages")
        both = spans.join(passages, _same(spans, passages), "full")
        spans = both.select(F.coalesce(spans["id"], passages["id"]).alias("id"), F.coalesce(spans["text_hash"], passages["text_hash"]).alias("text_hash"), "ranges", "passages")
    else:
        spans = spans.withColumn("passages", F.lit(None).cast("array<struct<first:bigint,last:bigint>>"))
    ids = spans.select("id", "text_hash").checkpoint()
    n = ids.count()
    touched = _of(rows, ids, n)
    touched = touched.join(spans, _same(touched, spans)).select(touched["id"].alias("doc_id"), "text", "ranges", "passages")
    none = F.lit(None).cast(spans.schema["ranges"].dataType)
    others = _of(rows, ids, n, "left_anti").select(F.col("id").alias("doc_id"), "text", none.alias("ranges"), none.alias("passages"))
    return touched.union(others).mapInArrow(_removed(length, words), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>, n_passage_words bigint")
