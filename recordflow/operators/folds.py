"""Keyed folds: what a program keeps in maps while it reads, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import fresh, numbered


def count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def fold(df: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """One row a key; values: aggregates by name. No keys: one row in all."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in values.items()])


def first(df: DataFrame, keys: list[str], order: list[str], **values: str) -> DataFrame:
    """Of each key, columns of the first row in order."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(c, at).alias(n) for n, c in values.items()])


def last(df: DataFrame, keys: list[str], order: list[str], **values: str) -> DataFrame:
    """Of each key, columns of the last row in order: what a map slot holds at the end."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, at).alias(n) for n, c in values.items()])


def joined(df: DataFrame, keys: list[str], order: list[str], column: str, separator: str, name: str = "joined") -> DataFrame:
    """Of each key, the texts put together in order."""
    (v,) = fresh(df, "v")
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias(v))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x[v].cast("string")), separator).alias(name))


def distinct_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order. Pre-aggregated, so a key with very many rows isn't sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    (first_row,) = fresh(df, "row")
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias(first_row))
    return got.select(*[F.col(c) if c in keys else F.col(first_row)[c].alias(c) for c in df.columns])


def composite(*columns: str, separator: str = "\x1c") -> Column:
    """A key of several parts as one text."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def nested(df: DataFrame, outer: str, inner: str, value: Column, name: str = "m") -> DataFrame:
    """Of each outer key a map from inner keys to an aggregate."""
    (v,) = fresh(df, "v")
    flat = df.groupBy(outer, inner).agg(value.alias(v))
    return flat.groupBy(outer).agg(F.map_from_entries(F.collect_list(F.struct(F.col(inner).cast("string"), v))).alias(name))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def tail(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The last k rows in order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(k).orderBy(*order)


def rank_values(df: DataFrame, by: list[str], order: list[str], name: str = "at") -> DataFrame:
    """df with each row's place from 1 among its key's, as a sort into a container gives."""
    return numbered(df, order, name, by)
