"""Exact dedup by content sort.

Each text is normalised (A-Z to a-z). Sampled splitters deal the rows out by the first bytes of the
normalised text, then its 128-bit hash, then the identifier; each task sorts its range externally, which puts
equal texts next to each other, and neighbours are compared in full. The identifier is part of the order, so
a text that a third of all rows share spreads over as many tasks as it needs; runs that cross from one range
into the next are joined afterwards from two boundary records a range.

Defined cases: a null text counts as empty, and all empty texts are equal. Rows that share text and
identifier count as rows of their own; exactly one row of each group stays. Rows without identifier sort after
all others, so they stay only in groups in which no row has one (then keep_id is null). An empty table gives
no rows. Texts of any length are compared whole. Further columns, of any name, are carried along by `dedup` and left out by `groups`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, octets, table, widened


def _sorted(df: DataFrame, keep: str, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """df's rows with equal texts next to each other, the one that stays being the last of its group."""
    names = fresh(df, "head", "h1", "h2")
    at = df.columns.index(text_col)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [(t or b"").lower() for t in octets(b.column(at))]
            h = np.array([divmod(xxhash.xxh3_128_intdigest(t), 1 << 64) for t in low], np.uint64).reshape(-1, 2).view(np.int64)
            more = [pa.array([t[:32] for t in low], pa.binary()), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *names])

    last = F.col(f"`{id_col}`").asc_nulls_first() if keep == "largest" else F.col(f"`{id_col}`").desc_nulls_first()
    order = [*names, last]
    return df.mapInArrow(lean(keys), widened(df, names, ("binary", "long", "long"))).repartitionByRange(*order).sortWithinPartitions(*order), names


_RUNS = "doc_id bigint, sha binary, pid int, run bigint, n bigint, keep_id bigint, last boolean, edge boolean"


def _runs(id_at: int, text_at: int, carry: bool, names: list[str]):
    """From sorted rows to rows with their run's size and last identifier; edge: the run may go on in another range.

    carry: only the last row of each run, with all its columns.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        run, before, ids, row = 0, None, [], None

        def flush(ending: bool) -> Iterator[pa.RecordBatch]:
            n, sha = len(ids), hashlib.sha256(before).digest()
            edge = run == 0 or ending
            if carry:
                more = [pa.array([sha], pa.binary()), pa.array([pid], pa.int32()), pa.array([run], pa.int64()), pa.array([n], pa.int64()), pa.array([edge])]
                yield pa.RecordBatch.from_arrays([*row.columns, *more], [*row.schema.names, *names])
                return
            for at in range(0, n, 10_000):
                some = ids[at : at + 10_000]
                k = len(some)
                last = [False] * k
                last[-1] = at + k == n
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(some, pa.int64()), "sha": pa.array([sha] * k, pa.binary()), "pid": pa.array([pid] * k, pa.int32()), "run": pa.array([run] * k, pa.int64()), "n": pa.array([n] * k, pa.int64()), "keep_id": pa.array([ids[-1]] * k, pa.int64()), "last": last, "edge": [edge] * k}
                )

        def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            for i, (d, t) in enumerate(zip(b.column(id_at).to_pylist(), octets(b.column(text_at)), strict=True)):
                t = (t or b"").lower()
                if before is not None and t != before:
                    for x in flush(False):
                        held.append(x)
                        rows += x.num_rows
                    run, ids = run + 1, []
                    if rows >= 2000:
                        yield from joined(held)
                        held, rows = [], 0
                before = t
                ids.append(d)
                if carry:
                    row = b.slice(i, 1)
        if before is not None:
            held += flush(True)
        if held:
            yield from joined(held)

    return lean(walk)


def _chains(edges: list) -> list[tuple]:
    """(pid, run, n of the whole group, its keep_id, whether the group's last row is here) for runs that cross ranges.

    edges: (pid, run, sha, n, keep_id) of each range's first and last run, so two a range at most.
    """
    out, chain = [], []

    def close():
        if len(chain) > 1:
            n = sum(x[3] for x in chain)
            out.extend((x[0], x[1], n, chain[-1][4], x is chain[-1]) for x in chain)

    for x in sorted(edges, key=lambda x: (x[0], x[1])):
        if chain and chain[-1][2] == x[2]:
            chain.append(x)
        else:
            close()
            chain = [x]
    close()
    return out


def groups(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows, _ = _sorted(narrow, keep, "doc_id", "text")
    runs = table(rows.mapInArrow(_runs(0, 1, False, []), _RUNS), "runs")
    edges = runs.where("edge and last").select("pid", "run", "sha", "n", "keep_id").collect()
    fixes = docs.sparkSession.createDataFrame(_chains([tuple(x) for x in edges]), "pid int, run bigint, all_n bigint, all_keep bigint, here boolean")
    return (
        runs.join(F.broadcast(fixes), ["pid", "run"], "left")  # two rows a range at most
        .select(
            "doc_id",
            F.when(F.col("here").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"),
            F.coalesce("all_n", "n").alias("group_size"),
            (F.col("last") & F.coalesce("here", F.lit(True))).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def dedup(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows, extra = _sorted(docs, keep, id_col, text_col)
    names = fresh(rows, "sha", "pid", "run", "n", "edge")
    schema = widened(rows, names, ("binary", "integer", "long", "long", "boolean"))
    at = docs.columns.index
    last = table(rows.mapInArrow(_runs(at(id_col), at(text_col), True, names), schema), "lasts")
    sha, pid, run, n, edge = names
    edges = last.where(F.col(edge)).select(pid, run, sha, n, F.lit(None).cast("bigint")).collect()
    gone = [(x[0], x[1]) for x in _chains([tuple(x) for x in edges]) if not x[4]]
    gone = docs.sparkSession.createDataFrame(gone, f"`{pid}` int, `{run}` bigint")
    return last.join(F.broadcast(gone), [pid, run], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
