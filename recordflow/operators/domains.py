"""Operators that keep state from row to row: each ordering domain is read as a stream by one task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

ROWS = 5_000  # rows of a batch that goes out


def in_order(df: DataFrame, by: list[str], order: list[str], run: Callable[[Iterator[tuple]], Iterable[tuple]], out: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """by and what run gives for the rows of each domain, which it gets in order, without the columns of `by`.

    out: name, Spark type and Arrow type of each column that run gives. Rows are dealt out by domain and sorted on disk if
    need be, so a task holds no more of a domain than run does. Without `by` all rows are one domain.
    """
    n = len(by)
    schema = StructType([df.schema[c] for c in by])
    for name, kind, _ in out:
        schema = schema.add(name, kind)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                kinds[:] = [f.type for f in list(b.schema)[:n]]
                yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

        def batch(held: list[tuple]) -> pa.RecordBatch:
            types = [*kinds, *[t for _, _, t in out]]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], schema.names)

        held: list[tuple] = []
        for key, some in groupby(rows(), key=lambda r: r[:n]):
            for row in run(r[n:] for r in some):
                held.append((*key, *row))
                if len(held) == ROWS:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    rest = [c for c in df.columns if c not in by]
    dealt = df.select(*[f"`{c}`" for c in [*by, *rest]])
    # a number that is given stays: by their bytes, small rows that take long to run would be put into a few tasks
    n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n_tasks, *[f"`{c}`" for c in by]) if by else dealt.repartition(1)
    return dealt.sortWithinPartitions(*[f"`{c}`" for c in [*by, *order]]).mapInArrow(task, schema)
