"""Records cut into fields, and records put together from them.

Fields are an array column. The separator decides how: a blank (the default) or none takes runs of white space
and drops those at the ends; the empty text takes every character; one character is taken as it is; `?` and
four characters (separator, escape, left and right quote) take quoted fields; anything longer is a regular
expression. An empty record has no fields.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns


def split(record: Column, fs: str | None = " ", ignore_case: bool = False, strip: bool = False) -> Column:
    """The record's fields; strip: blank fields at the ends of a regular expression's fields go."""
    if fs is None or fs == " ":
        # most records have blanks alone, which are split faster than a pattern
        other = reduce(lambda a, b: a | b, [F.contains(record, F.lit(c)) for c in "\t\n\r\x0b\x0c"])
        return F.array_remove(F.when(other, F.split(record, r"\s+")).otherwise(F.split(record, " ")), "")
    if fs == "":
        return F.array_remove(F.split(record, ""), "")
    if len(fs) == 5 and fs[0] == "?":
        return quoted(record, fs)
    if len(fs) == 1:
        pattern = ("(?i)" if ignore_case else "") + re.escape(fs)
        out = F.split(record, pattern, -1)
    else:
        out = F.split(record, patterns.java(fs, ignore_case), -1)
        if strip:
            out = F.filter(out, lambda x, i: (x != "") | ((i > 0) & (i < F.size(out) - 1)))
    return F.when(record == "", F.array().cast("array<string>")).otherwise(out)


def split_quoted(text: str, sep: str, esc: str, lq: str, rq: str) -> list[str]:
    """Quotes are taken off; fields without quotes lose the blanks at their ends. Where all three quoting characters are
    the same, a doubled one stands for itself, else the escape character takes the next one as it is."""
    if text == "":
        return []
    out, i, n = [], 0, len(text)
    doubled = esc == lq == rq
    while True:
        field, was_quoted, edge = "", False, 0
        while i < n and text[i].isspace() and text[i] != sep:
            i += 1
        while i < n and text[i] != sep:
            if text[i] == lq:
                was_quoted, i = True, i + 1
                while i < n:
                    if doubled and text[i : i + 2] == rq * 2:
                        field, i = field + rq, i + 2
                    elif not doubled and text[i] == esc and i + 1 < n:
                        field, i = field + text[i + 1], i + 2
                    elif text[i] == rq:
                        i += 1
                        break
                    else:
                        field, i = field + text[i], i + 1
                edge = len(field)
            elif not doubled and text[i] == esc and i + 1 < n:
                field, i = field + text[i + 1], i + 2
                edge = len(field)
            else:
                field, i = field + text[i], i + 1
        out.append(field[:edge] + field[edge:].rstrip())
        if i >= n:
            return out
        i += 1
        if i >= n:
            return [*out, ""]


def quoted(record: Column, fs: str) -> Column:
    _, sep, esc, lq, rq = fs

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_quoted(t, sep, esc, lq, rq))

    return run(record)


def count(fields: Column) -> Column:
    return F.size(fields)


def field(fields: Column, n: int) -> Column:
    """Field n from 1; empty beyond the last."""
    if n < 1:
        raise ValueError("fields count from 1")
    return F.coalesce(F.get(fields, F.lit(n - 1)), F.lit(""))


def assign(fields: Column, n: int, value: Column) -> Column:
    """The fields with field n set; empty fields fill a gap."""
    length = F.greatest(F.size(fields), F.lit(n))
    return F.transform(F.sequence(F.lit(1), length), lambda i: F.when(i == n, value.cast("string")).otherwise(F.coalesce(F.get(fields, i - 1), F.lit(""))))


def resize(fields: Column, n: int) -> Column:
    """The first n fields, or empty ones added."""
    if n < 0:
        raise ValueError("the number of fields can't be negative")
    if n == 0:
        return F.slice(fields, 1, 0)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.get(fields, i - 1), F.lit("")))


def join(fields: Column, ofs: str = " ") -> Column:
    """The record; nulls are empty."""
    return F.array_join(F.transform(fields, lambda x: F.coalesce(x, F.lit(""))), ofs)
