"""Lookups: a table read into a map and probed by another.

Spark picks the join's strategy by the sides' sizes (with adaptive execution also at run time), so nothing is
broadcast here beyond what its size threshold allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import last
from .ordered import numbered


def lookup(probe: DataFrame, build: DataFrame, keys: list[str], order: list[str], values: list[str], how: str = "inner") -> DataFrame:
    """probe with build's values by key; of several rows of a key the last in order counts, as a later write would."""
    return probe.join(last(build, keys, order, **{v: v for v in values}), keys, how)


def semi(probe: DataFrame, build: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in build."""
    return probe.join(build, keys, "left_semi")


def anti(probe: DataFrame, build: DataFrame, keys: list[str]) -> DataFrame:
    return probe.join(build, keys, "left_anti")


def theta(a: DataFrame, b: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Pairs for which a condition holds."""
    return a.join(b, on, how)


def zip_rows(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], how: str = "full") -> DataFrame:
    """Rows side by side by their numbers in order."""
    return numbered(a, order_a, "nr").join(numbered(b, order_b, "nr"), "nr", how)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def intersect_keeping(a: DataFrame, b: DataFrame) -> DataFrame:
    """b's rows that are in a, repeated ones too."""
    return b.join(a, [b[c].eqNullSafe(a[c]) for c in b.columns], "left_semi")


def except_keeping(a: DataFrame, b: DataFrame) -> DataFrame:
    """b's rows that aren't in a, repeated ones too."""
    return b.join(a, [b[c].eqNullSafe(a[c]) for c in b.columns], "left_anti")


def keys_in_order(df: DataFrame, key: str) -> DataFrame:
    """A map's keys in the order in which they are gone through: as texts, by character code."""
    return df.select(F.col(key).cast("string").alias(key)).distinct().orderBy(key)
