"""How text counts as a number, and what counts as true.

A text's number is its longest numeric prefix after blanks, else 0. Signs may repeat. 0x, 0b and 0o begin hex,
binary and octal digits, and so does a leading 0 of an octal number, unless the digits go on to a point or an
exponent. A text is true if it isn't empty (so "0" is true), a number if it isn't 0, a container if it has
items; null is false, 0 and the empty text.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = r"^(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)"
_SIMPLE = r"^-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]{1,15})?\z"
_DECIMAL = r"^[0-9]*\.|^[0-9]+[eE][+-]?[0-9]"


def to_number(text: Column) -> Column:
    """The number as a double."""
    text = text.cast("string")
    # what is no more than a decimal without leading zeros needs none of the rule; the rule stands in a function over an array
    # of one item, so that it reads the text once and a plan's compiled code stays small enough to be fast
    rule = F.get(F.transform(F.array(text), _by_rule), F.lit(0))
    return F.when(text.rlike(_SIMPLE), text.try_cast("double")).otherwise(rule)


def _by_rule(text: Column) -> Column:
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", "")
    signs = F.regexp_extract(s, r"^[+-]*", 0)
    sign = F.when(F.length(F.regexp_replace(signs, r"\+", "")) % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    body = F.regexp_replace(s, r"^[+-]+", "")
    based = lambda pattern, base: F.conv(F.regexp_extract(body, pattern, 1), base, 10).cast("double")
    value = (
        F.when(body.rlike(r"^0[xX][0-9a-fA-F]"), based(r"^0[xX]([0-9a-fA-F]+)", 16))
        .when(body.rlike(r"^0[bB][01]"), based(r"^0[bB]([01]+)", 2))
        .when(body.rlike(r"^0[oO][0-7]"), based(r"^0[oO]([0-7]+)", 8))
        .when(body.rlike(_DECIMAL), F.expr("null"))
        .when(body.rlike(r"^0[0-7]"), based(r"^0([0-7]+)", 8))
    )
    plain = F.regexp_extract(body, _FLOAT, 0)
    plain = F.when(plain == "", F.lit(0.0)).otherwise(plain.cast("double"))
    return sign * F.coalesce(value, plain)


def to_int(text: Column) -> Column:
    """The number cut to a whole one."""
    return to_number(text).cast("bigint")


_NUMBER = re.compile(r"\s*([+-]*)(0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


def number(value) -> int | float:
    """The same of a Python value, for the sequential operators: an int where the text is one."""
    if value is None:
        return 0
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)):
        return value
    if not isinstance(value, str):
        return len(value)
    m = _NUMBER.match(value)
    if not m:
        return 0
    sign, body = -1 if m[1].count("-") % 2 else 1, m[2]
    if body[:2].lower() in ("0x", "0b", "0o"):
        return sign * int(body, 0)
    if body.isdigit():
        if len(body) > 1 and body[0] == "0" and body[1] in "01234567":
            return sign * int(re.match("[0-7]+", body)[0], 8)
        return sign * int(body)
    return sign * float(body)


def truth(column: Column, kind: str) -> Column:
    """Whether a value of the Spark type `kind` is true."""
    if kind == "string":
        out = F.length(column) > 0
    elif kind == "binary":
        out = F.octet_length(column) > 0
    elif kind == "boolean":
        out = column
    elif kind.startswith(("array", "map")):
        out = F.size(column) > 0
    else:
        out = column != 0
    return F.coalesce(out, F.lit(False))


def compare(a: Column, b: Column, numeric: bool) -> Column:
    """-1, 0 or 1: as numbers if both count as such, else as texts."""
    x, y = (to_number(a), to_number(b)) if numeric else (F.coalesce(a.cast("string"), F.lit("")), F.coalesce(b.cast("string"), F.lit("")))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def identical(a: Column, b: Column) -> Column:
    """Same type and same value."""
    return (F.typeof(a) == F.typeof(b)) & a.eqNullSafe(b)


def wrap(value: int) -> int:
    """A whole number in 64 bits."""
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


def divide(a: Column, b: Column) -> Column:
    """A double; by 0: infinite or not a number, as in C."""
    x, y = a.cast("double"), b.cast("double")
    zero = F.when(x > 0, F.lit(math.inf)).when(x < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    return F.when(y == 0, zero).otherwise(F.try_divide(x, y))


def int_divide(a: Column, b: Column) -> Column:
    """Cut toward 0; null for a divisor of 0."""
    q = F.try_divide(a.cast("bigint"), b.cast("bigint"))
    exact = F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint"))) if hasattr(F, "nullif") else q.cast("bigint")
    return exact


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))
