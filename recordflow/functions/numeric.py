"""Mathematical functions with C's results at the edges (Spark gives null for the logarithm of 0)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edged(f, x: Column) -> Column:
    x = x.cast("double")
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(f(x))


def log(x: Column) -> Column:
    return _edged(F.ln, x)


def log10(x: Column) -> Column:
    return _edged(F.log10, x)


def log2(x: Column) -> Column:
    return _edged(F.log2, x)


def sqrt(x: Column) -> Column:
    return F.sqrt(x.cast("double"))


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def round_(x: Column) -> Column:
    """Half away from 0."""
    return F.round(x.cast("double"))


def rand(seed: int | None = None) -> Column:
    return F.rand(seed)


#: Functions that Spark has as they are wanted.
SAME = {name: getattr(F, name) for name in ("acos", "asin", "atan", "atan2", "cos", "cosh", "exp", "sin", "sinh", "tan", "tanh")}


def bit_and(a: Column, b: Column) -> Column:
    return a.cast("bigint").bitwiseAND(b.cast("bigint"))


def bit_or(a: Column, b: Column) -> Column:
    return a.cast("bigint").bitwiseOR(b.cast("bigint"))


def bit_xor(a: Column, b: Column) -> Column:
    return a.cast("bigint").bitwiseXOR(b.cast("bigint"))


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a.cast("bigint"))


def shift_left(a: Column, n: int) -> Column:
    return F.shiftleft(a.cast("bigint"), n)


def shift_right(a: Column, n: int) -> Column:
    return F.shiftright(a.cast("bigint"), n)
