"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words (letters, in lower case) and the five-letter runs of each word with
its beginning marked, hashed into 2^20 slots. The machine scores a text by a bias, a weight a slot and the
inner products of the slots' factors, so that two terms can count together (an insult and the mention of a
group) that count for little alone. Of the slots that LEAST or more sampled texts hold, the `slots` that tell the
labels apart best (by chi-square) get a weight, whatever the size of the sample. No chi-square is too low: it sets
how far a slot's weight and factors move in a round (in full from SURE, below that by the square of its share of
SURE), because with so many slots chance alone gives thousands that seem to tell a little.

Learning takes a bounded sample of the labelled rows: of each label the `most` rows first by hash of their
identifier. The sample's texts are reduced to slots on the executors, which also count them; the driver gets at most
2 * most arrays of at most 2 * slots numbers. Scoring is one pass over the documents.

Defined cases: null and empty texts have no terms and get the bias' score. Rows without label or identifier
teach nothing; a repeated identifier counts as several rows. If only one label (or none) is found, every score
is that label's share (0 without labels). Repeated rows get equal scores. Texts of any length are read whole. An empty table gives no
rows; further columns, of any name, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, octets, table, widened

SLOTS = 1 << 20
LEAST = 3
SURE = 50.0
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_slots(word: bytes) -> tuple[int, ...]:
    """The slots of a word and of its runs of five letters."""
    if word.isascii():  # a letter is a byte
        s = b"^" + word.lower()
        terms = {s + b"$", *(s[i : i + 5] for i in range(len(s) - 4))}
    else:
        t = f"^{word.decode(errors='replace').lower()}"
        terms = {x.encode() for x in (t + "$", *(t[i : i + 5] for i in range(len(t) - 4)))}
    return tuple(xxhash.xxh3_64_intdigest(t) & (SLOTS - 1) for t in terms)


def text_words(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(_SPLIT).split())


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t in octets(b.column(1)):
            slots = {s for w in text_words(t) for s in word_slots(w)}
            out.append(np.array(sorted(slots), "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["label", "slots"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, rows of label 1, rows of label 0) of the task's rows."""
    counts = np.zeros((2, SLOTS), np.int32)
    for b in batches:
        for label, slots in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts[label][np.frombuffer(slots, "<i4")] += 1  # a row's slots are distinct
    seen = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[1][seen]), pa.array(counts[0][seen])], ["slot", "p", "q"])


def _kept(slots: list[int]):
    """Each row with those of its slots that are in a sorted list."""
    best = np.array(slots, "<i4")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x, "<i4") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.intersect1d(x, best, assume_unique=True).tobytes() for x in own], pa.binary())], ["label", "slots"])

    return kept


class Machine:
    """bias, and for each slot of `slots` (sorted) a weight and a row of factors."""

    def __init__(self, bias: float, slots: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.slots, self.weights, self.factors = bias, slots, weights, factors

    def raw(self, at: np.ndarray) -> float:
        """at: places in slots."""
        v = self.factors[at]
        return self.bias + float(self.weights[at].sum()) + 0.5 * float((v.sum(0) ** 2).sum() - (v * v).sum())


def learn(rows: list[tuple[int, bytes]], share: float | None = None, slots: int = 20_000, k: int = 4, rounds: int = 40, seed: int = 1) -> Machine:
    """A machine from (label, slots) rows; share: that of label 1 among all rows, if the sample's differs."""
    y = np.array([r[0] for r in rows], float)
    none = Machine(0.0, np.empty(0, np.int64), np.empty(0), np.empty((0, k)))
    if not len(y) or y.min() == y.max():
        none.bias = 20.0 if len(y) and y[0] else -20.0
        return none
    pos, neg = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
    for label, slots_ in rows:  # a row's slots are distinct
        (pos if label else neg)[np.frombuffer(slots_, "<i4")] += 1
    n1, n0 = y.sum(), (1 - y).sum()
    seen = np.flatnonzero(pos + neg >= LEAST)
    p, q = pos[seen].astype(float), neg[seen].astype(float)
    chi = (p * (n0 - q) - q * (n1 - p)) ** 2 / ((p + q) * np.maximum(n0 + n1 - p - q, 1))
    chi *= (n1 + n0) / (n1 * n0)
    order = np.sort(np.argsort(-chi, kind="stable")[:slots])
    best, trust = seen[order], np.minimum(1, chi[order] / SURE) ** 2
    where = np.full(SLOTS, -1, np.int32)
    where[best] = np.arange(len(best))
    at, of = [], []
    for i, (_, slots_) in enumerate(rows):
        got = where[np.frombuffer(slots_, "<i4")]
        at.append(got[got >= 0])
        of.append(np.full(len(at[-1]), i, np.int32))
    at, of = np.concatenate(at), np.concatenate(of)
    w, v = np.zeros(len(best)), np.random.default_rng(seed).normal(0, 0.01, (k, len(best))) * trust
    bias = float(np.log(n1 / n0))
    gw, gv, gb = np.full(len(best), 1.0), np.full((k, len(best)), 1.0), 1.0
    n = len(y)
    weight = np.where(y == 1, n / (2 * n1), n / (2 * n0))  # both labels count alike
    for _ in range(rounds):  # full-batch AdaGrad with decay of weights; one factor at a time, so little is held at once
        sums = [np.bincount(of, x[at], n) for x in v]
        raw = bias + np.bincount(of, w[at], n)
        for s, x in zip(sums, v, strict=True):
            raw += 0.5 * (s * s - np.bincount(of, (x * x)[at], n))
        d = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) * weight
        by = d[of]
        total = np.bincount(at, by, len(w))
        dw = total + 0.5 * w
        for s, x, g in zip(sums, v, gv, strict=True):
            dx = np.bincount(at, by * s[of], len(w)) - total * x + 1.0 * x
            g += dx**2
            x -= 0.05 * trust * dx / np.sqrt(g)
        db = d.sum()
        gw, gb = gw + dw**2, gb + db**2
        w -= 0.3 * trust * dw / np.sqrt(gw)
        bias -= 0.3 * db / np.sqrt(gb)
    if share is not None and 0 < share < 1:
        bias += 0.5 * float(np.log(share / (1 - share)))  # half way from even odds to those of all labelled rows
    return Machine(bias, best, w, np.ascontiguousarray(v.T))


def _scored(machine: Machine, text_at: int, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(s): i for i, s in enumerate(machine.slots)}

        class Places(dict):
            def __missing__(self, word: bytes) -> tuple[int, ...]:
                if len(self) > 120_000:
                    self.clear()
                got = self[word] = tuple(place[s] for s in word_slots(word) if s in place)
                return got

        memo = Places()
        for b in batches:
            out = []
            for t in octets(b.column(text_at)):
                at = {p for got in map(memo.__getitem__, text_words(t)) if got for p in got}
                raw = machine.raw(np.fromiter(sorted(at), np.int64, len(at))) if at else machine.bias
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, raw)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, name])

    return lean(score)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", most: int = 4_000, slots: int = 20_000) -> Machine:
    """Learns from the rows of labels, of each label the `most` rows first by hash of their identifier.

    The sampled rows' slots are counted by the executors; of each row the driver gets at most 2 * slots numbers.
    """
    lab = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    counts = {r[0]: r[1] for r in lab.groupBy("label").count().collect()}
    order = [F.xxhash64("id"), "id"]
    some = lab.where("label = 1").orderBy(*order).limit(most).union(lab.where("label = 0").orderBy(*order).limit(most))
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    some = text.join(F.broadcast(some), "id").select("label", "text")  # at most 2 * most ids
    rows = table(some.mapInArrow(_sampled, "label int, slots binary"), "sampled")
    # twice as many slots as learn() takes, so that it has the choice; the driver then gets no more of a row than these
    size = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    seen = rows.mapInArrow(_counted, "slot int, p int, q int").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where(f"p + q >= {LEAST}")
    chi = F.expr(f"pow(p * {n0}D - q * {n1}D, 2) / ((p + q) * greatest({n1 + n0} - p - q, 1))")
    best = sorted(r[0] for r in seen.orderBy(chi.desc(), "slot").limit(2 * slots).select("slot").collect())
    rows = rows.mapInArrow(_kept(best), "label int, slots binary").collect()
    n = sum(counts.values())
    rows = sorted((label, bytes(held)) for label, held in rows)
    return learn(rows, counts.get(1, 0) / n if n else None, slots)


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a further column, whose name is returned: the score from 0 to 1."""
    (name,) = fresh(docs, "score")
    return docs.mapInArrow(_scored(machine, docs.columns.index(text_col), name), widened(docs, [name], ("double",))), name
