"""Language ID by word-first backoff.

A known word counts with its log frequency in each language. An unseen word counts with the mean log frequency
of its longest character n-grams that are known (five letters, then four, down to one, word ends marked). The
language with the highest sum wins; its score is its share of the exponentials of the sums.

Learning reads a bounded sample: of each language about `most` documents, drawn by a hash of their identifier and text.
Terms are counted by Spark. The model keeps `words` words and, of each order, `ngrams` n-grams for each language that
there is, those with the highest share in the language that has most of them, so no language or order takes the places
of another. It travels with the tasks.

Defined cases: a null text, or one without a letter, is `und` with score 0. Rows without language teach
nothing; if no row has one, every text is `und`. Ties go to the language first in order of name. Repeated rows get equal
results. Texts of any length are read whole. An empty table gives no rows; further columns, of any name, are carried along.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, octets, slices, table, widened

#: ASCII bytes that are no letters become blanks, A-Z become a-z.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RUN = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def words_of(token: bytes) -> list[str]:
    """The runs of letters in a token (it may hold other characters beyond ASCII)."""
    if token.isascii():  # letters alone, in lower case
        return [token.decode()]
    return _RUN.findall(token.decode(errors="replace").lower())


def ngrams_of(word: str, n: int) -> list[str]:
    s = f"<{word}>"
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, Counter] = {}
        for lang, t in zip(b.column(0).to_pylist(), octets(b.column(1)), strict=True):
            counts.setdefault(lang, Counter()).update(tokens(t))
        out: Counter = Counter()
        for lang, c in counts.items():
            for token, n in c.items():
                for w in words_of(token):
                    out[lang, 0, w] += n
                    for k in ORDERS:
                        for g in ngrams_of(w, k):
                            out[lang, k, g] += n
        keys = list(out)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([out[k] for k in keys], pa.int64())], ["lang", "k", "term", "n"])


class Model:
    """langs, and by order (0: words) a vector of log frequencies for each known term."""

    def __init__(self, langs: list[str], tables: dict[int, dict[str, np.ndarray]]):
        self.langs, self.tables = langs, tables


class Places:
    """The model's vectors as rows of one matrix, so that many tokens are looked up at once."""

    def __init__(self, model: Model):
        self.at: dict[int, dict[str, int]] = {}
        rows = [np.zeros(len(model.langs))]  # for a word without anything known
        for k, table in model.tables.items():
            self.at[k] = dict(zip(table, range(len(rows), len(rows) + len(table)), strict=True))
            rows += table.values()
        self.m = np.array(rows)

    def rows(self, word: str) -> list[int]:
        """The rows whose mean is the word's vector."""
        got = self.at.get(0, {}).get(word)
        if got is not None:
            return [got]
        s = f"<{word}>"
        for k in ORDERS:
            at = self.at.get(k, {})
            known = [r for i in range(len(s) - k + 1) if (r := at.get(s[i : i + k])) is not None]
            if known:
                return known
        return [0]

    def vectors(self, tokens: list[bytes]) -> np.ndarray:
        """A row a token: the sum of its words' vectors, and at the end the number of words."""
        out = np.zeros((len(tokens), self.m.shape[1] + 1))
        rows: list[int] = []
        starts, first, some = [], [], []  # of the words in rows, of the tokens in words, tokens that have words
        for i, token in enumerate(tokens):
            words = words_of(token)
            if words:
                some.append(i)
                first.append(len(starts))
                for w in words:
                    starts.append(len(rows))
                    rows += self.rows(w)
        if some:
            means = np.add.reduceat(self.m[rows], starts, 0) / np.diff(starts, append=len(rows))[:, None]
            out[some, :-1] = np.add.reduceat(means, first, 0)
            out[some, -1] = np.diff(first, append=len(starts))
        return out


def fit(docs: DataFrame, most: int = 1500, words: int = 15_000, ngrams: int = 4_000, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one a language
    langs = sorted(sizes)
    if not langs:
        return Model([], {})
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(most / sizes[lang]))])
    some = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < F.lit(1 << 20) * F.element_at(share, F.col("lang"))).select("lang", "text")
    counts = some.mapInArrow(_counted, "lang string, k int, term string, n bigint").groupBy("k", "term", "lang").agg(F.sum("n").alias("n"))
    # each order has its own limit, which grows with the languages; a term counts by its share in the language that has most of it
    sums = counts.groupBy("k", "lang").agg(F.sum("n").alias("all"))  # one row an order and language
    shares = counts.join(F.broadcast(sums), ["k", "lang"]).withColumn("share", F.col("n") / F.col("all"))
    by_term = shares.groupBy("k", "term").agg(F.max("share").alias("share"), F.collect_list(F.struct("lang", "n")).alias("by"))  # one entry a language
    by_term = table(by_term, "terms")
    kept = []
    for k in (0, *ORDERS):
        limit = len(langs) * (ngrams if k else words)
        kept += by_term.where(F.col("k") == k).orderBy(F.desc("share"), "term").limit(limit).select("k", "term", "by").collect()
    at = {lang: i for i, lang in enumerate(langs)}
    total = np.zeros((max(ORDERS) + 1, len(langs)))
    raw: dict[int, dict[str, np.ndarray]] = {}
    for k, term, by in kept:
        v = np.zeros(len(langs))
        for lang, n in by:
            v[at[lang]] = n
        raw.setdefault(k, {})[term] = v
        total[k] += v
    return Model(langs, {k: {t: np.log((v + 0.5) / (total[k] + 0.5 * len(d))) for t, v in d.items()} for k, d in raw.items()})


def _predict(model: Model, text_at: int, names: list[str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, places = len(model.langs), Places(model)

        class Rows(dict):
            """Tokens to rows of a growing matrix; the last column counts words. New tokens get theirs by settle()."""

            def clear(self) -> None:
                super().clear()
                self.m, self.new = np.zeros((1 << 12, n + 1)), []

            def __missing__(self, token: bytes) -> int:
                self.new.append(token)
                i = self[token] = len(self)
                return i

            def settle(self) -> None:
                start = len(self) - len(self.new)
                while len(self) > len(self.m):
                    self.m = np.concatenate([self.m, np.zeros_like(self.m)])
                self.m[start : len(self)] = places.vectors(self.new)
                self.new = []

        memo = Rows()
        memo.clear()
        for b in batches:
            langs, scores = [], []
            texts = octets(b.column(text_at))
            for start, end in slices(texts):
                if len(memo) > 100_000:
                    memo.clear()
                at = [np.fromiter(map(memo.__getitem__, tokens(t)), np.int32) for t in texts[start:end]]
                memo.settle()
                for rows in at:
                    s = memo.m[rows].sum(0)
                    if not n or s[n] == 0:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    best = int(s[:n].argmax())
                    langs.append(model.langs[best])
                    scores.append(float(1 / np.exp(np.maximum(s[:n] - s[best], -50)).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, *names])

    return predict


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with further columns, whose names are returned: the language and its score."""
    names = fresh(docs, "lang_pred", "score")
    return docs.mapInArrow(_predict(model, docs.columns.index(text_col), names), widened(docs, names, ("string", "double"))), names
