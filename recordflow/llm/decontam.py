"""Benchmark decontamination by winnowing.

Words of documents and benchmark items are numbered by a 64-bit hash. Of the k-grams (k = 5) in each window of
w = n - k + 1 (n = 13) successive positions the smallest hash is kept as a fingerprint, so every span of n
words that two texts share gives both the same fingerprint at the same place of the span. Fingerprints of
documents and items are joined, and a hit is extended to the left and the right, word by word; where the
extension has n words or more, all its words are hit. An item of fewer than n words is one window as a whole:
its hash is looked up among the document's runs of that many words.

A benchmark whose text has at most `broadcast_bytes` bytes goes to every task as arrays. A larger one is
joined by a shuffle on fingerprints instead, and the texts of the pairs found are then compared.

Defined cases: null or empty texts have no words (no hits; as items they have no window). Items that share an
identifier count once; an item without identifier hits words but is not counted. Rows that share a doc_id stay
rows of their own, and so do rows without one. Texts of any length are read whole. Further columns, of any name, are carried along. An
empty benchmark hits nothing; an empty documents table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, fresh, grams, lean, mix, numbers, octets, slices, table, widened

#: Bytes that are no part of a word become blanks; A-Z become a-z.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def fingerprints(w: np.ndarray, ends: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the smallest k-gram of each window; ends[i] is where the text of word i ends.

    Of equal hashes the leftmost counts. Windows don't cross texts.
    """
    g = grams(w, k)
    n = len(g) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, window):
        less = g[j : j + n] < best
        best[less] = g[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    ok = np.arange(n) + window + k - 1 <= ends[:n]
    at = np.unique(at[ok])
    return at, g[at]


class Benchmark:
    """The items as arrays: words one after the other, fingerprints in order of hash, short items by length."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], n: int = 13, k: int = 5):
        self.n, self.k = n, k
        memo, parts, self.short = Memo(), [], {}
        ids = []
        for item, text in items:
            w = numbers(words(text), memo)
            if len(w) >= n:
                parts.append(w)
                ids.append(item)
            elif len(w):
                self.short.setdefault(len(w), {}).setdefault(int(grams(w, len(w))[0]), set()).add(item)
        self.w = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        lengths = np.array([len(p) for p in parts], np.int64)
        self.ends = np.repeat(np.cumsum(lengths), lengths)
        self.starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.of = np.repeat(np.arange(len(ids)), lengths)
        self.ids = ids
        at, h = fingerprints(self.w, self.ends, k, n - k + 1)
        order = np.argsort(h, kind="stable")
        self.at, self.h = at[order], h[order]
        self.unique = np.unique(self.h)
        self.short_keys = {m: np.array(sorted(d), np.uint64) for m, d in self.short.items()}

    def hits(self, w: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, set]]]:
        """(whether each word is hit, (position, items) of the hits) for the words of several texts."""
        hit = np.zeros(len(w) + 1, np.int64)
        found: list[tuple[int, set]] = []
        at, h = fingerprints(w, ends, self.k, self.n - self.k + 1)
        keep = np.isin(h, self.unique)
        done: dict[tuple[int, int], int] = {}  # (text's end, difference of places): how far an extension went
        for p, x in zip(at[keep].tolist(), h[keep], strict=True):
            for q in self.at[np.searchsorted(self.h, x) : np.searchsorted(self.h, x, "right")].tolist():
                end, start = int(ends[p]), 0
                if done.get((end, p - q), -1) >= p:
                    continue
                room = min(end - p, int(self.ends[q]) - q)
                differ = np.flatnonzero(w[p : p + room] != self.w[q : q + room])
                right = int(differ[0]) if len(differ) else room
                start = int(np.searchsorted(ends, end))  # of the document's text
                room = min(p - start, q - int(self.starts[q]))
                differ = np.flatnonzero(w[p - room : p][::-1] != self.w[q - room : q][::-1])
                left = int(differ[0]) if len(differ) else room
                done[end, p - q] = p + right - 1
                if left + right >= self.n:
                    hit[p - left] += 1
                    hit[p + right] -= 1
                    found.append((p, {self.ids[self.of[q]]}))
        for m, keys in self.short_keys.items():
            g = grams(w, m)
            ok = np.flatnonzero(np.isin(g, keys) & (np.arange(len(g)) + m <= ends[: len(g)]))
            np.add.at(hit, ok, 1)
            np.add.at(hit, ok + m, -1)
            found += [(int(p), self.short[m][int(g[p])]) for p in ok]
        return np.cumsum(hit[:-1]) > 0, found


_OUT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()


def _scan(bench: Benchmark, text_at: int, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for b in batches:
            texts = octets(b.column(text_at))
            n_words, n_hit, items = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [set() for _ in texts]
            for i, j in slices(texts):
                parts = [numbers(words(t), memo) for t in texts[i:j]]
                lengths = np.array([len(p) for p in parts], np.int64)
                w = np.concatenate(parts) if parts else np.empty(0, np.uint64)
                ends = np.repeat(np.cumsum(lengths), lengths)
                hit, found = bench.hits(w, ends)
                n_words[i:j] = lengths
                bounds = np.cumsum(lengths)
                n_hit[i:j] = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(hit)])[bounds]]))
                for p, some in found:
                    items[i + int(np.searchsorted(bounds, p, "right"))].update(x for x in some if x is not None)
            more = [pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items], pa.string()), pa.array((n_hit > 0) & (20 * n_hit >= n_words))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *names])

    return scan


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 13, broadcast_bytes: int = 32_000_000) -> tuple[DataFrame, list[str]]:
    """docs with further columns (their names are returned): n_words, n_hit, n_items, items_sha256, contaminated."""
    names = fresh(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    schema = widened(docs, names, ("long", "long", "long", "string", "boolean"))
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= broadcast_bytes:
        rows = [(r[0], r[1] and r[1].encode()) for r in items.collect()]
        return docs.mapInArrow(lean(_scan(Benchmark(rows, n), docs.columns.index(text_col), names)), schema), names
    return _by_shuffle(docs, items, text_col, names, n), names


_FP = "row bigint, key bigint"


def _keys(n: int, text_at: int, short: list[int], k: int = 5):
    """A row for each fingerprint of a text, and for each run of as many words as short items have."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for b in batches:
            for r, t in zip(b.column(0).to_pylist(), octets(b.column(text_at)), strict=True):
                w = numbers(words(t), memo)
                h = [fingerprints(w, np.full(len(w), len(w)), k, n - k + 1)[1]]
                h += [mix(grams(w, m) + np.uint64(m)) for m in short if m <= len(w)]
                h = np.unique(np.concatenate(h)).view(np.int64)
                yield pa.RecordBatch.from_pydict({"row": pa.array([r] * len(h), pa.int64()), "key": pa.array(h)})

    return keys


def _by_shuffle(docs: DataFrame, items: DataFrame, text_col: str, names: list[str], n: int) -> DataFrame:
    """For a benchmark that isn't broadcast: pairs of document and item that share a key, then their texts compared."""
    row, text2 = fresh(docs, "row", "item_text")
    numbered = table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    its = table(items.withColumn("irow", F.monotonically_increasing_id()), "items")
    short = list(range(1, n))
    d = texts.mapInArrow(_keys(n, 1, short), _FP)
    count = lambda w: F.size(F.array_remove(F.split(F.lower(w), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""))
    i = its.withColumn("m", count(F.col("text")))
    long_items = i.where(F.col("m") >= n).select("irow", "text").mapInArrow(_keys(n, 1, []), _FP)
    short_items = i.where((F.col("m") < n) & (F.col("m") > 0)).select("irow", "text").mapInArrow(_whole(), _FP)
    pairs = d.join(long_items.union(short_items).withColumnRenamed("row", "irow"), "key").select("row", "irow").distinct()
    full = pairs.join(texts, "row").join(its.select("irow", "item", F.col("text").alias(text2)), "irow")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for b in batches:
            out = []
            for r, item, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), octets(b.column(2)), octets(b.column(3)), strict=True):
                w = numbers(words(t), memo)
                hit, found = Benchmark([(item, x)], n).hits(w, np.full(len(w), len(w)))
                if found:
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    out.append((r, item, edges.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_pydict({"row": pa.array([x[0] for x in out], pa.int64()), "item": pa.array([None if x[1] is None else str(x[1]) for x in out], pa.string()), "spans": pa.array([x[2] for x in out], pa.binary())})

    found = full.select("row", "item", "text", text2).mapInArrow(compare, "row bigint, item string, spans binary")
    merged = found.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"), F.collect_list("spans").alias("spans"))

    @F.pandas_udf("bigint")
    def covered(spans):
        def one(parts) -> int:
            if parts is None:
                return 0
            edges = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in parts])
            edges = edges[np.argsort(edges[:, 0], kind="stable")]
            reach = np.maximum.accumulate(edges[:, 1])
            return int(np.maximum(0, edges[:, 1] - np.maximum(edges[:, 0], np.concatenate([[0], reach[:-1]]))).sum())

        return spans.map(one)

    got = numbered.join(merged.withColumnRenamed("row", row), row, "left")
    n_words = count(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    got = got.withColumn(names[0], n_words.cast("bigint")).withColumn(names[1], F.coalesce(covered("spans"), F.lit(0).cast("bigint")))
    got = got.withColumn(names[2], F.coalesce(F.size("items").cast("bigint"), F.lit(0).cast("bigint")))
    got = got.withColumn(names[2], F.greatest(F.col(names[2]), F.lit(0).cast("bigint")))
    got = got.withColumn(names[3], F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256))
    got = got.withColumn(names[4], (F.col(names[1]) > 0) & (20 * F.col(names[1]) >= F.col(names[0])))
    return got.select(*[F.col(f"`{c}`") for c in docs.columns], *names)


def _whole():
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for b in batches:
            out = [(r, w) for r, t in zip(b.column(0).to_pylist(), octets(b.column(1)), strict=True) if len(w := numbers(words(t), memo))]
            h = [mix(grams(w, len(w)) + np.uint64(len(w)))[0] for _, w in out]
            yield pa.RecordBatch.from_pydict({"row": pa.array([r for r, _ in out], pa.int64()), "key": pa.array(np.array(h, np.uint64).view(np.int64))})

    return whole
