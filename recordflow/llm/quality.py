"""Quality classifier: a generalised additive model with pairwise interactions.

A text is reduced to statistics of its characters, words and lines. Each statistic has bins (at most 32, cut
where the sample's values are evenly spread). Cyclic boosting goes round the statistics again and again and
fits each a shallow tree (two cuts deep) over its bins to what the others leave unexplained; the trees of a
statistic add up to one lookup table. Then the pairs of statistics that explain most of the rest get tables in
the same way, with a cut along each of the two. A score is the sum of the tables' entries, so scoring a batch
is a few vectorised lookups and additions.

Learning takes a bounded sample: of each label the `most` rows first by hash of their identifier; the bias is
then set right for the labels' shares among all labelled rows.

Defined cases: null and empty texts have statistics of zero and get a score like others. Rows without label or
identifier teach nothing. If only one label (or none) is found, every score is that label's share (0.5 without
labels). Repeated rows get equal scores. Texts of any length are read whole. An empty table gives no rows; further columns, of any
name, are carried along.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, octets, widened

FEATURES = (
    "log_bytes log_words word_length upper digits marks symbols beyond_ascii blanks words_per_line distinct_words top_word repeated_words "
    "distinct_lines ends_sentence no_letters short_words capitalised distinct_pairs word_length_spread top_symbol"
).split()

_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL, _BEYOND, _BLANK, _LINE = range(8)
_CLASS = np.array([_UPPER if 65 <= c <= 90 else _LOWER if 97 <= c <= 122 else _DIGIT if 48 <= c <= 57 else _MARK if c in b".,;:!?'\"-" else _BEYOND if c >= 128 else _LINE if c == 10 else _BLANK if c <= 32 or c == 127 else _SYMBOL for c in range(256)], np.uint8)
_SENTENCE = (b".", b"!", b"?")


def features(text: bytes | None) -> np.ndarray:
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    each = np.bincount(raw, minlength=256)
    n = np.bincount(_CLASS, each, 8)
    letters = n[_UPPER] + n[_LOWER] + n[_BEYOND]
    out[0] = np.log1p(len(raw))
    out[3:9] = n[_UPPER] / max(1, letters), n[_DIGIT] / len(raw), n[_MARK] / len(raw), n[_SYMBOL] / len(raw), n[_BEYOND] / len(raw), (n[_BLANK] + n[_LINE]) / len(raw)
    out[20] = each[_CLASS == _SYMBOL].max() / len(raw)
    words = text.split()
    m = len(words)
    if not m:
        return out
    lengths = np.fromiter(map(len, words), np.int64, m)
    counts = Counter(words)
    lines = text.split(b"\n")
    out[1], out[2], out[9] = np.log1p(m), lengths.mean(), m / len(lines)
    out[10], out[11], out[12] = len(counts) / m, max(counts.values()) / m, sum(map(eq, words, words[1:])) / m
    out[13] = len(set(lines)) / len(lines)
    own = np.array([(w.endswith(_SENTENCE), not _has_letter(w), w[:1].isupper(), c) for w, c in counts.items()], float)
    out[14], out[15], out[17] = (own[:, :3] * own[:, 3:]).sum(0) / m
    out[16] = (lengths <= 2).mean()
    out[18] = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
    out[19] = lengths.std()
    return out


def _has_letter(word: bytes) -> bool:
    return word.lower() != word.upper() or any(c >= 128 for c in word)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t).tolist() for t in octets(b.column(1))], pa.list_(pa.float64()))], ["label", "x"])


class Model:
    """bias; for each statistic its cuts and table; (i, j, table) for pairs."""

    def __init__(self, bias: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]]):
        self.bias, self.cuts, self.tables, self.pairs = bias, cuts, tables, pairs

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], 1) if self.cuts else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, raw = self.bins(x), np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            raw += table[b[:, f]]
        for i, j, table in self.pairs:
            raw += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _gain(g, h, decay: float):
    return g * g / (h + decay)


def _cut(g: np.ndarray, h: np.ndarray, decay: float) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of bins with gradients g and weights h; 0: no cut."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(gl, hl, decay) + _gain(g.sum() - gl, h.sum() - hl, decay) - _gain(g.sum(), h.sum(), decay)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, decay: float) -> np.ndarray:
    """The step for each bin."""
    gain, at = _cut(g, h, decay) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + decay))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, decay), _tree(g[at:], h[at:], depth - 1, decay)])


def _quadrants(g: np.ndarray, h: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """(gain, steps) of the best tree with one cut along the rows and one along the columns."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gr, hr, gb, hb = gc[:-1, -1:], hc[:-1, -1:], gc[-1:, :-1], hc[-1:, :-1]
    a, ha = gc[:-1, :-1], hc[:-1, :-1]
    gain = _gain(a, ha, decay) + _gain(gr - a, hr - ha, decay) + _gain(gb - a, hb - ha, decay) + _gain(gc[-1, -1] - gr - gb + a, hc[-1, -1] - hr - hb + ha, decay) - _gain(gc[-1, -1], hc[-1, -1], decay)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + decay)
    return float(gain[i, j]), out


def learn(x: np.ndarray, y: np.ndarray, share: float | None = None, bins: int = 32, rounds: int = 60, pairs: int = 10, rate: float = 0.2, decay: float = 3.0) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(0.0 if not len(y) else 20.0 if y[0] else -20.0, [], [], [])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    model = Model(float(np.log(y.mean() / (1 - y.mean()))), cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    b, raw = model.bins(x), np.full(len(y), model.bias)

    def slope():
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slope()
            step = rate * _tree(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], h, len(table)), 2, decay)
            table += step
            raw += step[b[:, f]]

    def grid(i: int, j: int):
        shape = (len(cuts[i]) + 1, len(cuts[j]) + 1)
        at, (g, h) = b[:, i] * shape[1] + b[:, j], slope()
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_quadrants(*grid(i, j), decay)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(cuts[i]) + 1, len(cuts[j]) + 1))) for gain, i, j in gains[:pairs] if gain > 1]
    for _ in range(rounds // 3):
        for i, j, table in model.pairs:
            step = rate * _quadrants(*grid(i, j), decay)[1]
            table += step
            raw += step[b[:, i], b[:, j]]
    if share is not None and 0 < share < 1:
        model.bias += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", most: int = 5_000) -> Model:
    """Learns from the rows of labels, of each label the `most` rows first by hash of their identifier."""
    lab = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    counts = {r[0]: r[1] for r in lab.groupBy("label").count().collect()}
    order = [F.xxhash64("id"), "id"]
    some = lab.where("label = 1").orderBy(*order).limit(most).union(lab.where("label = 0").orderBy(*order).limit(most))
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = text.join(F.broadcast(some), "id").select("label", "text").mapInArrow(_featured, "label int, x array<double>").collect()  # at most 2 * most ids
    rows = sorted((r[0], tuple(r[1])) for r in rows)
    n = sum(counts.values())
    return learn(np.array([r[1] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[0] for r in rows], float), counts.get(1, 0) / n if n else None)


def _scored(model: Model, text_at: int, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in octets(b.column(text_at))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], [*b.schema.names, name])

    return score


def score(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a further column, whose name is returned: the score from 0 to 1."""
    (name,) = fresh(docs, "score")
    return docs.mapInArrow(_scored(model, docs.columns.index(text_col), name), widened(docs, [name], ("double",))), name
