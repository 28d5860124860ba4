"""Running values over a total order, without bringing all rows of a table or of a key into one task.

Rows are dealt into ranges of (key, order). A first pass over the order's columns alone finds where each range
begins and sums up the rows that its last key has in it; that is one row a range, which the driver folds into
what each range starts with. The second pass deals the rows themselves out by those beginnings, which are fixed by
then: nothing is sampled twice, and no plan relies on an exchange being used again. A key with most of the rows
fills several ranges. Rows that tie in the order are in one range.

Columns that these functions need for themselves get names that the table doesn't have.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df (which ignores case) doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"__{n}"
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _key(df: DataFrame, name: str) -> Column:
    """The column, or a number in the same order where the driver could not hold its values exactly."""
    kind, c = df.schema[name].dataType, _col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), c)
    return c


class Ranges:
    """df dealt into ranges of (by, order)."""

    def __init__(self, df: DataFrame, by: list[str], order: list[str], n: int | None = None):
        self.df, self.by, self.order = df, by, order
        self.n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.keys = [_key(df, c) for c in [*by, *order]]
        (self.at,) = fresh(df, "range")
        self.lows: list = []

    def first_pass(self, inputs: dict[str, Column], aggs: dict[str, Callable[[], Column]]) -> tuple[list[dict], T.StructType]:
        """A dict a range: the key of its first row, that of its last row, and aggregates of the last key's rows in it."""
        names = [f"k{i}" for i in range(len(self.keys))]
        by = names[: len(self.by)]
        slim = self.df.select(*[c.alias(n) for c, n in zip(self.keys, names, strict=True)], *[c.alias(n) for n, c in inputs.items()])
        dealt = slim.repartitionByRange(self.n, *names).withColumn("r", F.spark_partition_id())
        each = dealt.groupBy("r", *by).agg(F.min(F.struct(*names)).alias("low"), F.struct(*[f().alias(n) for n, f in aggs.items()], F.lit(1).alias("one")).alias("sums"))
        key = F.struct(*by, F.lit(1).alias("one"))
        got = each.groupBy("r").agg(F.min("low").alias("low"), F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("sums", key).alias("sums"))
        rows = sorted(got.collect(), key=lambda r: r.r)  # one row a range
        self.lows = [tuple(r.low) for r in rows]
        return [{"first": tuple(r["first"])[:-1], "last": tuple(r["last"])[:-1], **r.sums.asDict()} for r in rows], got.schema["sums"].dataType

    def number(self) -> Column:
        """The number of each row's range, found by halving."""
        kinds = self.df.select(*self.keys).schema
        names = [f"k{i}" for i in range(len(self.keys))]
        row = F.struct(*[c.alias(n) for c, n in zip(self.keys, names, strict=True)])

        def bound(i: int) -> Column:
            return F.struct(*[F.lit(v).cast(f.dataType).alias(n) for v, f, n in zip(self.lows[i], kinds, names, strict=True)])

        def search(a: int, b: int) -> Column:
            if b - a <= 1:
                return F.lit(a)
            m = (a + b) // 2
            return F.when(row < bound(m), search(a, m)).otherwise(search(m, b))

        return search(0, max(1, len(self.lows)))

    def dealt(self) -> DataFrame:
        return self.df.withColumn(self.at, self.number())

    def started(self, starts: list[dict[str, Any]], schema: T.StructType) -> tuple[DataFrame, list[str], Column]:
        """The dealt rows with what their range starts with; whether that is for the row's key."""
        names = fresh(self.df, *[f"start_{f.name}" for f in schema], *[f"first_{i}" for i in range(len(self.by))])
        of = names[len(schema) :]
        kinds = self.df.select(*[c.alias(n) for c, n in zip(self.keys, of, strict=False)]).schema if of else T.StructType()
        fields = T.StructType([T.StructField(self.at, T.IntegerType()), *[T.StructField(n, f.dataType) for n, f in zip(names, schema, strict=False)], *[T.StructField(n, f.dataType) for n, f in zip(of, kinds, strict=False)]])
        rows = [(i, *[s[f.name] for f in schema], *s["first"]) for i, s in enumerate(starts)]
        table = self.df.sparkSession.createDataFrame(rows, fields)
        mine = F.lit(True)
        for n, c in zip(of, self.keys, strict=False):
            mine = mine & c.eqNullSafe(F.col(n))
        return self.dealt().join(F.broadcast(table), self.at), names[: len(schema)], mine  # one row a range

    def window(self) -> Window:
        return Window.partitionBy(self.at, *[_col(c) for c in self.by]).orderBy(*[_col(c) for c in self.order])


def carried(rows: list[dict], zero: Any, step: Callable[[Any, dict], Any]) -> list[dict]:
    """What each range starts with: {"first": its first key, **state}, the state that the ranges before leave for that key."""
    out, key, state = [], None, zero
    for r in rows:
        out.append({"first": r["first"], **(state if key == r["first"] else zero)})
        state = step(state if key == r["last"] else zero, r)
        key = r["last"]
    return out


def _larger(a: Any, b: Any) -> Any:
    """The larger in Spark's order: nothing counts, and not-a-number is above all."""
    if a is None or b is None:
        return b if a is None else a
    if any(isinstance(x, float) and math.isnan(x) for x in (a, b)):
        return math.nan
    return max(a, b)


def _smaller(a: Any, b: Any) -> Any:
    if a is None or b is None:
        return b if a is None else a
    if isinstance(a, float) and math.isnan(a):
        return b
    return a if isinstance(b, float) and math.isnan(b) else min(a, b)


def _added(a: Any, b: Any) -> Any:
    return (b if a is None else a) if a is None or b is None else a + b


_FOLD = {"sum": _added, "count": _added, "max": _larger, "min": _smaller}


def running(df: DataFrame, order: list[str], values: dict[str, tuple[str, Column]], by: list[str] | None = None, inclusive: bool = True, ranges: int | None = None) -> DataFrame:
    """df with a column for each of `values`: (sum, count, max or min; of what) over the rows of its key up to each row.

    by: separate orders for each key; inclusive: the row itself counts. Sums and counts of nothing are 0.
    """
    dealt = Ranges(df, by or [], order, ranges)
    names = {f"v{i}": v for i, v in enumerate(values)}
    rows, schema = dealt.first_pass({n: values[v][1] for n, v in names.items()}, {n: (lambda n=n, v=v: _OWN[values[v][0]](n)) for n, v in names.items()})
    zero = dict.fromkeys(names)
    starts = carried(rows, zero, lambda s, r: {n: _FOLD[values[v][0]](s[n], r[n]) for n, v in names.items()})
    out, start, mine = dealt.started(starts, T.StructType([f for f in schema if f.name in names]))
    within = dealt.window().rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    combine = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
    combine["count"] = combine["sum"]
    return out.select(*[_col(c) for c in df.columns], *[combine[f](F.when(mine, F.col(s)), _OWN[f](c).over(within)).alias(v) for s, (v, (f, c)) in zip(start, values.items(), strict=True)])


def numbered(df: DataFrame, order: list[str], name: str = "nr", by: list[str] | None = None) -> DataFrame:
    """df with each row's number from 1."""
    return running(df, order, {name: ("count", F.lit(1))}, by)


def range_pattern(df: DataFrame, start: Column, stop: Column, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The rows of the ranges that begin where `start` holds and end where `stop` holds next, at the earliest on the same row.

    A row is in a range if the last start up to it comes after the last stop before it. Where a range of rows has neither so
    far, what the rows before left open decides.
    """
    dealt = Ranges(df, by or [], order)
    here = F.struct(*[F.col(f"k{i}") for i in range(len(by or []), len(dealt.keys))])
    on, off = F.coalesce(start, F.lit(False)), F.coalesce(stop, F.lit(False))
    last = {n: F.max(F.when(F.col(n), here)) for n in ("on", "off")}
    rows, _ = dealt.first_pass({"on": on, "off": off}, {"any": lambda: F.bool_or(F.col("on") | F.col("off")), "open": lambda: last["on"].isNotNull() & (last["off"].isNull() | (last["on"] > last["off"]))})
    starts = carried(rows, {"open": False}, lambda s, r: {"open": r["open"] if r["any"] else s["open"]})
    out, (opened,), mine = dealt.started(starts, T.StructType([T.StructField("open", T.BooleanType())]))
    at, lon, loff, keep = fresh(out, "at", "on", "off", "keep")
    out = out.withColumn(at, F.row_number().over(dealt.window())).withColumn(keep, mine & F.col(opened))
    within = dealt.window()
    out = out.withColumn(lon, F.max(F.when(on, F.col(at))).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn(loff, F.max(F.when(off, F.col(at))).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.when(F.col(lon).isNull() & F.col(loff).isNull(), F.col(keep)).otherwise(F.coalesce(F.col(lon) > F.coalesce(F.col(loff), F.lit(0)), F.lit(False)))
    return out.where(inside).select(*[_col(c) for c in df.columns])


def until(df: DataFrame, stop: Column, order: list[str], by: list[str] | None = None, keep_last: bool = True) -> DataFrame:
    """The rows up to the first where `stop` holds: `exit` for all rows, `nextfile` by file."""
    (end,) = fresh(df, "stop")
    key = F.struct(*[_col(c) for c in order])
    first = df.where(stop).groupBy(*[_col(c) for c in by or []]).agg(F.min(key).alias(end))
    ahead = key <= F.col(end) if keep_last else key < F.col(end)
    if by:
        joined = df.join(first, by, "left")
    else:
        joined = df.join(F.broadcast(first), F.lit(True))  # one row
    return joined.where(F.col(end).isNull() | ahead).select(*[_col(c) for c in df.columns])


def _after(df: DataFrame, by: list[str], order: list[str], size: int) -> tuple[DataFrame, Window, str]:
    """df dealt into ranges, each with the `size` rows before it, which a further column marks."""
    dealt = Ranges(df, by, order)
    dealt.first_pass({}, {})
    rows = dealt.dealt()
    (place,) = fresh(rows, "place")
    back = Window.partitionBy(dealt.at).orderBy(*[c.desc() for c in dealt.keys])
    tails = rows.withColumn(place, F.row_number().over(back)).where(F.col(place) <= size).drop(place).collect()  # `size` rows a range
    tails.sort(key=lambda r: r[dealt.at])
    by_range: dict[int, list] = {}
    for r in tails:
        by_range.setdefault(r[dealt.at], []).append(r)
    before: list = []
    ghosts = []
    for i in range(len(dealt.lows)):
        ghosts += [(*[r[c] for c in df.columns], i, True) for r in before]
        before = by_range.get(i, []) if len(by_range.get(i, [])) >= size else before + by_range.get(i, [])
    (ghost,) = fresh(rows, "before")
    schema = T.StructType([*rows.schema.fields, T.StructField(ghost, T.BooleanType())])
    both = rows.withColumn(ghost, F.lit(False)).union(df.sparkSession.createDataFrame(ghosts, schema))
    return both, dealt.window(), ghost


def lag(df: DataFrame, column: str, order: list[str], name: str, by: list[str]) -> DataFrame:
    """df with the column's value in the row before of the same key."""
    both, w, ghost = _after(df, by, order, 1)
    return both.withColumn(name, F.lag(_col(column)).over(w)).where(~F.col(ghost)).select(*[_col(c) for c in df.columns if c != name], _col(name))


def moving(df: DataFrame, column: str, order: list[str], size: int, name: str, by: list[str]) -> DataFrame:
    """The mean of the last `size` rows."""
    both, w, ghost = _after(df, by, order, size - 1)
    mean = F.avg(_col(column)).over(w.rowsBetween(1 - size, 0))
    return both.withColumn(name, mean).where(~F.col(ghost)).select(*[_col(c) for c in df.columns if c != name], _col(name))


def sessions(df: DataFrame, time: Column, gap: float, order: list[str], by: list[str], name: str = "session") -> DataFrame:
    """df with the number of each row's session from 1; a session ends where the next row comes more than `gap` later."""
    at, before = fresh(df, "at", "before_at")
    timed = lag(df.withColumn(at, time), at, order, before, by)
    opens = F.when(F.col(at) - F.col(before) <= gap, 0).otherwise(1)
    return running(timed, order, {name: ("sum", opens)}, by).drop(at, before)


def ranked(df: DataFrame, order: list[str], by: list[str], rank: str | None = None, dense: str | None = None, share: str | None = None, tiles: tuple[str, int] | None = None) -> DataFrame:
    """df with each row's places among its key's rows in ascending order: rank, dense rank, share (of the rows of
    other rank before it, as percent_rank) and tile (the rows that tie are put in any order).
    """
    dealt = Ranges(df, by, order)
    here = F.struct(*[F.col(f"k{i}") for i in range(len(by), len(dealt.keys))])
    rows, schema = dealt.first_pass({}, {"n": lambda: F.count(F.lit(1)), "steps": lambda: F.count_distinct(here)})
    starts = carried(rows, {"n": 0, "steps": 0}, lambda s, r: {"n": s["n"] + r["n"], "steps": s["steps"] + r["steps"]})
    out, (n, steps), mine = dealt.started(starts, T.StructType([f for f in schema if f.name in ("n", "steps")]))
    w, zero = dealt.window(), F.lit(0)
    own, total = fresh(out, "own", "total")
    out = out.withColumn(own, F.coalesce(F.when(mine, F.col(n)), zero) + F.rank().over(w))
    if dense:
        out = out.withColumn(dense, F.coalesce(F.when(mine, F.col(steps)), zero) + F.dense_rank().over(w))
    if tiles:
        out = out.withColumn(tiles[0], F.coalesce(F.when(mine, F.col(n)), zero) + F.row_number().over(w))
    if share or tiles:
        sizes = df.groupBy(*[_col(c) for c in by]).agg(F.count(F.lit(1)).alias(total))
        out = out.join(sizes, [out[c].eqNullSafe(sizes[c]) for c in by]).drop(*[sizes[c] for c in by]) if by else out.crossJoin(F.broadcast(sizes))  # one row
    if tiles:  # the first (total mod tiles) tiles hold a row more
        k, i = F.lit(tiles[1]), F.col(tiles[0]) - 1
        small, more = F.floor(F.col(total) / k), F.col(total) % k
        out = out.withColumn(tiles[0], F.when(i < more * (small + 1), F.floor(i / (small + 1))).otherwise(more + F.floor((i - more * (small + 1)) / F.greatest(small, F.lit(1)))) + 1)
    if share:
        out = out.withColumn(share, F.when(F.col(total) > 1, (F.col(own) - 1) / (F.col(total) - 1)).otherwise(0.0))
    if rank:
        out = out.withColumn(rank, F.col(own))
    return out.select(*[_col(c) for c in df.columns], *[x for x in (rank, dense, share, tiles and tiles[0]) if x])


def shard_filter(df: DataFrame, nr: str, limit: int, size: int, rank: int) -> DataFrame:
    """Of blocks of `limit` rows dealt round `size` readers, the rows of reader `rank`."""
    return df.where(F.floor(F.col(nr) / limit) % size == rank)
