"""Packing by concatenate and cut.

Every document is tokenised once, ended by a separator, and the ids are written (two bytes an id where the
vocabulary allows it) with the document's place in its task. The tasks' token totals are summed into global
offsets (first the totals of the tasks, then the places within each), so each task can cut its own documents
at the multiples of the sequence length without seeing any other's. Pieces that begin or end inside a document
are the boundary records: a sequence is read by putting its pieces in order of offset.

Tokens: a blank followed by no blank always begins a pre-token of a byte-level BPE of this kind, so a text is
cut there, and a line feed alone between others is a pre-token of its own, so a text is cut on both sides of it (unless
one of its line feeds has other white space beside it than a blank behind it). Each chunk's ids are looked up in a
bounded memo; chunks not seen before go to the tokenizer together. A text in which a blank is followed by white space
goes to the tokenizer as a whole.

Defined cases: a null or empty text is the separator alone. Rows that share a doc_id, or have
none, stay documents of their own. A text of any length is encoded whole and cut over as many sequences as it fills. Columns of
docs other than the two named may have any name and are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, longs, octets, table

_BLANKS = re.compile(r" (?!\S)")
_FEEDS = re.compile(r"\n(?:(?<=\s\n)|(?=[^\S ]))")  # a line feed that isn't alone


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the other bytes in order for the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Chunks of these characters alone are split alike by any version of the pattern.
_PLAIN = re.compile(r"[ -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*").fullmatch
_PLAIN_LINES = re.compile(r"[ -~\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*").fullmatch


class _Index(dict):
    """Chunks to places; new chunks get the next place and are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        got = self[chunk] = len(self)
        self.new.append(chunk)
        return got


class Encoder:
    """Texts to ids as a tokenizers file has them, without special tokens being added.

    A file of a byte-level BPE whose ranks are its ids (tested on the vocabulary itself) has its plain chunks
    encoded by the same ranks in tiktoken, which is several times as fast; all others go to tokenizers.
    """

    def __init__(self, path: str, most: int = 250_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.feed, self.feeds = -1, False  # a line feed's id, and whether texts are cut at it
        self.quick = self._by_ranks(json.loads(self.tok.to_str()))
        self._clear()

    def _by_ranks(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        byte_of = _byte_of()
        ends = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges") or []]
        vocab = {k: v for k, v in model["vocab"].items() if k not in {t["content"] for t in spec.get("added_tokens", [])}}
        ids = [vocab.get("".join(m), -1) for m in ends]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or ids != sorted(ids) or len(vocab) != len(ids) + 256 or min(ids, default=0) < 256:
            return None
        import tiktoken

        ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
        # where no white space follows white space, the file's \s+(?!\S)|\s+ is \s, which needs no looking ahead
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
        added = spec.get("added_tokens", [])
        self.feed, self.feeds = ranks[b"\n"], not any("\n" in t["content"] or t.get("lstrip") or t.get("rstrip") for t in added)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)").search
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _clear(self) -> None:
        self.index = _Index()
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def _plain(self, chunks: list[str]) -> np.ndarray:
        """Which chunks the ranks alone encode. White space in these is at most a blank in front."""
        if self.quick is None:
            return np.zeros(len(chunks), bool)
        text = "\n".join(chunks)
        if text.count("\n") == len(chunks) - 1 and _PLAIN_LINES(text) and not self.added(text):
            return np.ones(len(chunks), bool)
        return np.array([_PLAIN(c) is not None and not self.added(c) for c in chunks], bool)

    def _learn(self, chunks: list[str]) -> None:
        first = len(self.index) - len(chunks)
        while len(self.index) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        plain = self._plain(chunks)
        # all in one call, each with a line feed behind it, whose id no other token has
        ids = np.array(self.quick("\n".join([*compress(chunks, plain), ""])) if plain.any() else [], np.uint32)
        ends = ids == self.feed
        slow = [e.ids for e in self.tok.encode_batch_fast(list(compress(chunks, ~plain)), add_special_tokens=False)]
        n = np.empty(len(chunks), np.int64)
        n[plain] = np.diff(np.flatnonzero(ends), prepend=-1) - 1
        n[~plain] = [len(x) for x in slow]
        ids = np.concatenate([ids[~ends], np.fromiter(chain.from_iterable(slow), np.uint32)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        self.starts[first + order] = self.used + np.cumsum(n[order]) - n[order]
        self.lengths[first : len(self.index)] = n
        self.used += len(ids)

    def _chunks(self, text: str) -> list[str]:
        """A text without white space behind a blank, cut; some chunks may be empty."""
        if "\0" in text:
            return re.split("(?= )", text)[text[0] == " " :]
        cut = text.replace(" ", "\0 ")
        if self.feeds and not _FEEDS.search(text):
            cut = cut.replace("\n", "\0\n\0")
        return cut.split("\0")[text[0] == " " :]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. The texts should be a few MB together."""
        if len(self.index) > self.most:
            self._clear()
        whole = [i for i, t in enumerate(texts) if _BLANKS.search(t)]
        odd = set(whole)
        flat, lengths = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t and i not in odd:
                p = self._chunks(t)
                lengths[i] = len(p)
                flat += p
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        if self.index.new:
            self._learn(self.index.new)
            self.index.new = []
        n = self.lengths[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - n), n) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
        out = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        if whole:
            for i, e in zip(whole, self.tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One a worker, so that its memo serves all its tasks."""
    return Encoder(path)


_TOKENS = "doc_id bigint, pid int, before bigint, n bigint, ids binary"


def _slices(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)


def _tokens(path: str, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        kind = "<u2" if enc.tok.get_vocab_size() <= 1 << 16 else "<u4"
        end = np.array([separator], kind)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in _slices(texts):
                ids = [np.concatenate([x.astype(kind), end]) for x in enc.batch(texts[i:j])]
                n = np.array([len(x) for x in ids], np.int64)
                ahead = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([pid] * len(n), pa.int32()), pa.array(ahead), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "pid", "before", "n", "ids"])

    return lean(run)


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _cut(bases: dict[int, int], size: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc, n, ids = b.column(0), longs(b.column(3)), octets(b.column(4))
            first = longs(b.column(2)) + np.array([bases[p] for p in b.column(1).to_pylist()], np.int64)
            seq0 = first // size
            pieces = (first + n - 1) // size - seq0 + 1
            of = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = seq0[of] + k
            start = np.maximum(seq * size - first[of], 0)
            stop = np.minimum((seq + 1) * size - first[of], n[of])
            width = [len(x) // m for x, m in zip(ids, n.tolist(), strict=True)]
            raw = [np.frombuffer(ids[d], f"<u{width[d]}")[s:e].astype("<u4").tobytes() for d, s, e in zip(of.tolist(), start.tolist(), stop.tolist(), strict=True)]
            cols = [doc.take(pa.array(of)), pa.array(start), pa.array(stop - start), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(n[of]), pa.array(seq), pa.array(first[of] + start - seq * size)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols, names = [*cols, pa.array(raw, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return lean(cut)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, separator: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: also ids, four bytes each.

    tokenizer: a tokenizers file, found under this path by every executor.
    """
    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    tokens = table(narrow.mapInArrow(_tokens(tokenizer, separator), _TOKENS), "tokens")
    totals = tokens.groupBy("pid").agg(F.max(F.col("before") + F.col("n")).alias("n")).collect()  # one a task
    bases, total = {}, 0
    for pid, n in sorted(map(tuple, totals)):
        bases[pid], total = total, total + n
    return tokens.mapInArrow(_cut(bases, size, with_ids), _PIECES + ", ids binary" * with_ids)
