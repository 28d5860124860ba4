"""Text functions. Positions count from 1; 0 or null tell that nothing was found."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns

#: The classes that a whole text can be tested for, by function name.
CLASS_TESTS = {f"is{name}": patterns.CLASSES[name] for name in ("alnum", "alpha", "blank", "cntrl", "digit", "graph", "lower", "print", "punct", "space", "upper", "xdigit")}


def is_class(s: Column, name: str) -> Column:
    """1 if s isn't empty and all its characters are of the class (name as in CLASS_TESTS), else 0."""
    return F.coalesce(s.rlike(rf"(?U)\A{CLASS_TESTS[name]}+\z"), F.lit(False)).cast("int")


def substr(s: Column, start, count=None) -> Column:
    """A start below 1 counts as 1 without shortening the count; a negative count is 0."""
    start = start if isinstance(start, Column) else F.lit(start)
    count = F.length(s) if count is None else count if isinstance(count, Column) else F.lit(count)
    return F.substring(s, F.greatest(start.cast("int"), F.lit(1)), F.greatest(count.cast("int"), F.lit(0)))


def subchar(s: Column, at: int) -> Column:
    return F.when((F.lit(at) >= 1) & (F.lit(at) <= F.length(s)), F.substring(s, at, 1))


def index(s: Column, find: str, start: int = 1) -> Column:
    """Where `find` begins; a start of 0 counts as 1, a negative one from the end."""
    at = F.lit(max(1, start)) if start >= 0 else F.length(s) + 1 + start
    found = F.locate(find, s, start) if start >= 1 else F.position(F.lit(find), s, at.cast("int"))
    ok = (at >= 1) & (at <= F.length(s))
    return F.when(ok, found).otherwise(F.lit(0))


def rindex(s: Column, find: str, end: int | None = None) -> Column:
    """Where the last `find` begins that ends at or before `end`."""
    head = s if end is None else F.substring(s, F.lit(1), F.lit(end) if end > 0 else F.greatest(F.length(s) + 1 + end, F.lit(0)))
    back = F.locate(find[::-1], F.reverse(head))
    return F.when(back > 0, F.length(head) - back - len(find) + 2).otherwise(F.lit(0))


def match(s: Column, pattern: str, groups: int = 0, ignore_case: bool = False) -> Column:
    """A struct: start and length (0 and -1 if there is no match), and the groups' texts."""
    p = patterns.java(pattern, ignore_case)
    hit = s.rlike(p)
    # the text before the match and the match itself, by one expression
    whole = F.regexp_extract(s, f"{p[: p.index(')') + 1]}\\A(.*?)({p[p.index(')') + 1 :]})", 1)
    text = F.regexp_substr(s, F.lit(p))
    return F.struct(
        F.when(hit, F.length(whole) + 1).otherwise(F.lit(0)).alias("start"),
        F.when(hit, F.length(text)).otherwise(F.lit(-1)).alias("length"),
        F.array(*[F.regexp_extract(s, p, g) for g in range(groups + 1)]).alias("groups"),
    )


def gsub(s: Column, pattern: str, rep: str, ignore_case: bool = False) -> tuple[Column, Column]:
    """(the text with all matches replaced, how many)"""
    p = patterns.java(pattern, ignore_case)
    return F.regexp_replace(s, p, patterns.replacement(rep)), F.regexp_count(s, F.lit(p))


def sub(s: Column, pattern: str, rep: str, ignore_case: bool = False) -> tuple[Column, Column]:
    """(the text with the first match replaced, 0 or 1)"""
    return gensub(s, pattern, rep, 1, ignore_case), s.rlike(patterns.java(pattern, ignore_case)).cast("int")


def gensub(s: Column, pattern: str, rep: str, how: str | int = "g", ignore_case: bool = False) -> Column:
    """how: g for all matches, n > 0 for the n-th alone, anything else for the first."""
    p = patterns.java(pattern, ignore_case)
    if str(how) in ("g", "G"):
        return F.regexp_replace(s, p, patterns.replacement(rep))
    n = int(how) if str(how).isdigit() and int(how) > 0 else 1
    flags, body = p[: p.index(")") + 1], p[p.index(")") + 1 :]
    if re.search(r"(?<!\\)\((?!\?)|\\[1-9]", body):
        return _nth(s, pattern, rep, n, ignore_case)
    # what comes before is group 1, the match group 2
    before = "".join((f"(?:.*?(?:{body})){{{n - 1}}}" if n > 1 else "", ".*?"))
    to = re.sub(r"(?<!\\)\$(\d)", lambda m: "$2" if m[1] == "0" else "", patterns.replacement(rep))
    return F.regexp_replace(s, f"{flags}\\A({before})({body})", "$1" + to)


def _nth(s: Column, pattern: str, rep: str, n: int, ignore_case: bool) -> Column:
    """For patterns with groups of their own: in Python, by batches."""
    found = patterns.python(pattern, ignore_case)

    @F.pandas_udf("string")
    def nth(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else replace_nth(found, t, rep, n))

    return nth(s)


def expand(rep: str, m) -> str:
    """A replacement with & and \\0 to \\9 filled in from a match."""
    out, i = "", 0
    while i < len(rep):
        if rep[i] == "\\" and i + 1 < len(rep):
            d = rep[i + 1]
            out += (m[int(d)] or "" if int(d) <= m.re.groups else "") if d.isdigit() else d
            i += 2
        else:
            out += m[0] if rep[i] == "&" else rep[i]
            i += 1
    return out


def replace_nth(found, t: str, rep: str, n: int) -> str:
    for k, m in enumerate(found.finditer(t), 1):
        if k == n:
            return t[: m.start()] + expand(rep, m) + t[m.end() :]
    return t


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+\z", "")


def normspace(s: Column) -> Column:
    """Without blanks at the ends and with one for each run within."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def trim(s: Column, inner: bool = False) -> Column:
    return normspace(s) if inner else ltrim(rtrim(s))


def to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def from_hex(s: Column) -> Column:
    return F.unhex(s)


def to_base64(b: Column) -> Column:
    return F.base64(b)


def from_base64(s: Column) -> Column:
    return F.unbase64(s)


def to_bytes(s: Column, charset: str = "UTF-8") -> Column:
    return F.encode(s, charset)


def from_bytes(b: Column, charset: str = "UTF-8") -> Column:
    return F.decode(b, charset)


def from_byte_codes(*codes: Column) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.pmod(c, F.lit(256))), 2, "0") for c in codes]))


def from_char_codes(*codes: Column) -> Column:
    """Characters of any plane: each code as four bytes of UTF-32."""
    return F.decode(F.unhex(F.concat(*[F.lpad(F.hex(c), 8, "0") for c in codes])), "UTF-32")


def char_code(s: Column, at: int = 1) -> Column:
    """The code of the character there; null beyond the text."""
    code = F.conv(F.hex(F.encode(F.substring(s, at, 1), "UTF-32")), 16, 10).cast("bigint")
    return F.when((F.lit(at) >= 1) & (F.lit(at) <= F.length(s)), code)


def to_num(s: Column, base: int | None = None) -> Column:
    """Text as a number (functions.coerce); with a base, its longest prefix of digits in that."""
    from .coerce import to_number

    if base is None:
        return to_number(s)
    digits = "".join("0123456789abcdefghijklmnopqrstuvwxyz"[:base])
    return F.coalesce(F.conv(F.nullif(F.regexp_extract(F.lower(s), rf"^\s*([{digits}]+)", 1), F.lit("")), base, 10).cast("double"), F.lit(0.0))


def length(x: Column, kind: str = "string") -> Column:
    """Characters of text, bytes of binary, items of a container."""
    if kind == "binary":
        return F.octet_length(x)
    return F.size(x) if kind.startswith(("array", "map")) else F.char_length(x)
