"""Parts of lines by position: selectors of fields and characters.

A script is a list of parts parted by commas or blanks: `f2`, `f3-5`, `f5-3` (reversed), `f2-` (to the end), `c1-4`, `dX` (fields
are parted by X) and `dXY` (and put together with Y). Parts are given in the order they are asked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Script:
    parts: list[tuple[str, int | None, int | None]]
    delimiter: str = " "
    out: str = " "


def parse(script: str) -> Script:
    got = Script([])
    i, n = 0, len(script)
    while i < n:
        c = script[i]
        if c in ", \t\n":
            i += 1
        elif c == "d":
            m = re.match(r"d(.)([^,\s])?", script[i:], re.S)
            if not m:
                raise ValueError("d needs a delimiter")
            got.delimiter, got.out = m[1], m[2] or m[1]
            i += m.end()
        elif c in "fc":
            m = re.match(r"(\d+)?(-)?(\d+)?", script[i + 1 :])
            if not (m[1] or m[3]):
                raise ValueError(f"{c} needs a position")
            low = int(m[1]) if m[1] else 1
            high = int(m[3]) if m[3] else None if m[2] else low
            if low < 1 or high == 0:
                raise ValueError("positions count from 1")
            got.parts.append((c, low, high))
            i += 1 + m.end()
        else:
            raise ValueError(f"{c!r} begins no selector")
    return got


def cut(line: Column, script: str | Script, fold: bool = False, white_space: bool = False, trim: bool = False, normalise: bool = False) -> Column:
    """The selected parts. fold: adjacent delimiters are one; white_space: any blank is one."""
    s = parse(script) if isinstance(script, str) else script
    text = F.coalesce(line, F.lit(""))
    if normalise:
        text = F.trim(F.regexp_replace(text, r"\s+", " "))
    elif trim:
        text = F.regexp_replace(text, r"^\s+|\s+\z", "")
    one = r"\s" if white_space else re.escape(s.delimiter)
    fields = F.split(text, f"(?:{one})+" if fold else one, -1)
    pieces: list[Column] = []
    for kind, low, high in s.parts:
        back = high is not None and high < low
        first, last = (high, low) if back else (low, high)
        if kind == "c":
            piece = F.substring(text, F.lit(first), F.length(text) if last is None else F.lit(last - first + 1))
            pieces.append(F.when(F.length(piece) > 0, F.array(F.reverse(piece) if back else piece)).otherwise(F.array().cast("array<string>")))
        else:
            piece = F.slice(fields, F.lit(first), F.size(fields) if last is None else F.lit(last - first + 1))
            pieces.append(F.reverse(piece) if back else piece)
    kinds = [k for k, _, _ in s.parts]
    # fields that follow each other are put together with the delimiter, characters with nothing
    out: Column = F.lit("")
    seen_field = F.lit(False)
    for kind, piece in zip(kinds, pieces, strict=True):
        joined = F.array_join(piece, s.out if kind == "f" else "")
        some = F.size(piece) > 0
        lead = F.when(seen_field & some, F.lit(s.out)).otherwise(F.lit("")) if kind == "f" else F.lit("")
        out = F.concat(out, lead, joined)
        seen_field = (seen_field | some) if kind == "f" else F.lit(False)
    return out


def has_delimiter(line: Column, script: str | Script, white_space: bool = False) -> Column:
    s = parse(script) if isinstance(script, str) else script
    return F.coalesce(line.rlike(r"\s") if white_space else F.instr(line, s.delimiter) > 0, F.lit(False))


def cut_lines(df, column: str, script: str, delimited_only: bool = False, **options):
    """df with the column's lines cut; lines without the delimiter stay whole, or go if delimited_only."""
    line = F.col(column)
    by_field = any(k == "f" for k, _, _ in parse(script).parts)
    if delimited_only:
        df = df.where(has_delimiter(line, script, options.get("white_space", False)))
    got = cut(line, script, **options)
    if by_field and not delimited_only:
        got = F.when(has_delimiter(line, script, options.get("white_space", False)), got).otherwise(line)
    return df.withColumn(column, got)
