"""Binary packing and JSON."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Packing codes that differ from those of Python's struct (64-bit ones are Q and q, as there; N and n are the sizes).
ORDERS = "@=<>!"


def pack(fmt: str, *columns: Column) -> Column:
    """Binary by a struct format; p and s take text or bytes."""
    struct.calcsize(fmt)

    @F.pandas_udf("binary")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([pack_values(fmt, row) for row in zip(*series, strict=True)], dtype=object)

    return run(*columns)


def pack_values(fmt: str, values) -> bytes:
    return struct.pack(fmt, *[v.encode() if isinstance(v, str) else v.item() if hasattr(v, "item") else v for v in values])


def unpack(fmt: str, column: Column, schema: str) -> Column:
    """A struct of the given schema from binary; null for what is too short."""
    size = struct.calcsize(fmt)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    @F.pandas_udf(f"struct<{','.join(f.strip().replace(' ', ':', 1) for f in schema.split(','))}>")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = [struct.unpack(fmt, d[:size]) if d is not None and len(d) >= size else (None,) * len(names) for d in data]
        return pd.DataFrame(rows, columns=names)

    return run(column)


def parse_json(s: Column, schema: str | None = None) -> Column:
    """By a schema, or as a variant; null for what isn't JSON."""
    return F.from_json(s, schema) if schema else F.try_parse_json(s)


def to_json(x: Column) -> Column:
    return F.to_json(x)


def json_paths(s: Column) -> Column:
    """An array of (path, value) for the leaves of a JSON text; arrays count from 1."""

    def leaves(x, at: str):
        if isinstance(x, dict):
            for k, v in x.items():
                yield from leaves(v, f"{at}.{k}" if at else k)
        elif isinstance(x, list):
            for i, v in enumerate(x, 1):
                yield from leaves(v, f"{at}[{i}]")
        else:
            yield {"path": at, "value": None if x is None else json.dumps(x) if isinstance(x, (bool, int, float)) else x}

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return list(leaves(json.loads(t), ""))
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return run(s)
