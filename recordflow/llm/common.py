"""What the operators of this package share: places for tables, Arrow helpers, words as numbers."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: The list that the tables written in an owned() block are added to.
_OWNER: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset (a local session, as in tests) a temporary folder is made and set.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="recordflow-"))
    return sc._jsc.sc().getCheckpointDir().get()


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts the lineage.

    It stays until whoever called inside an owned() block drops it; a frame that reads it may be used at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recordflow-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    owner = _OWNER.get()
    if owner is not None:
        owner.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def owned(paths: list[str]) -> Iterator[list[str]]:
    """The tables that are written inside are named in `paths`, and belong to the caller alone."""
    before = _OWNER.set(paths)
    try:
        yield paths
    finally:
        _OWNER.reset(before)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes an owner's tables. Only for when no result that reads them is still needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df (which ignores case) doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


def widened(df: DataFrame, names: list[str], kinds: tuple[str, ...]) -> StructType:
    """df's schema with further columns."""
    out = StructType(list(df.schema.fields))
    for n, kind in zip(names, kinds, strict=True):
        out.add(n, kind)
    return out


def octets(column: pa.Array) -> list[bytes | None]:
    """A text column's values as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def longs(column: pa.Array, null: int = 0) -> np.ndarray:
    """An integer column as int64, nulls as the given value."""
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def slices(texts: list[bytes | None], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes together; a longer text has a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def lean(run):
    """run, a function over batches, giving the worker's free memory back to the system at the end: workers live on beside other tasks."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return then


class Memo(dict):
    """Words to 64-bit numbers. It forgets all when it has grown large, so a worker's memory is bounded."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def numbers(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(w: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the runs of k words, from the words' numbers; len(w) - k + 1 of them."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15 + k, np.uint64)
    for i in range(k):
        out = mix(out ^ w[i : i + n]) + np.uint64(0x2545F4914F6CDD1D)
    return out


def held_out(ids, folds: int, fold: int):
    """crc32(doc_id as text) mod folds = fold, as a column."""
    from pyspark.sql import functions as F

    return F.crc32(ids.cast("string").cast("binary")) % folds == fold
