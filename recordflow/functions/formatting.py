"""printf's formats.

Formats of %s, %d, %x and %.Nf alone, with widths, zeros and left sides, on columns of fitting types become one built-in
expression. All others run in Python by batches of rows, with the same results as the sequential operators have. Beyond 9e18 the
built-in %f has zeros after the digits that tell a number from its neighbours.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import number

_SPEC = re.compile(r"%([ #0+\-]*)(\*|\d+)?(?:\.(\*|\d+)?)?([a-zA-Z%])")


def number_text(value, fmt: str = "%.6g") -> str:
    """A value as text: whole numbers in full, others by the format."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return str(int(value)) if value == value and abs(value) < 1e16 and value == int(value) else sprintf_text(fmt, [value])
    return value if isinstance(value, str) else value.decode("latin-1") if isinstance(value, bytes) else str(value)


def sprintf_text(fmt: str, args: list) -> str:
    """A format filled in; too few arguments are an error."""
    left, out, at = list(args), [], 0

    def take():
        if not left:
            raise ValueError("too few arguments for the format")
        return left.pop(0)

    for m in _SPEC.finditer(fmt):
        out.append(fmt[at : m.start()])
        at = m.end()
        flags, width, precision, kind = m[1], m[2], m[3], m[4]
        if kind == "%":
            out.append("%")
            continue
        dotted = "." in m[0]
        if width == "*":
            width = int(number(take()))
            if width < 0:
                flags, width = flags + "-", -width
        if precision == "*":
            precision = int(number(take()))
            dotted = precision >= 0
        width, precision = int(width or 0), int(precision or 0) if dotted else None
        out.append(_one(flags, width, precision, kind, take()))
    return "".join(out) + fmt[at:]


def _pad(text: str, flags: str, width: int, zero: bool = False) -> str:
    if "-" in flags:
        return text.ljust(width)
    if zero and "0" in flags:
        sign = len(text) - len(text.lstrip("+- "))
        head = sign + (2 if text[sign : sign + 2].lower() in ("0x", "0b") else 0)
        return text[:head] + text[head:].rjust(width - head, "0")
    return text.rjust(width)


def _one(flags: str, width: int, precision: int | None, kind: str, value) -> str:
    if kind == "v":
        if value is None:
            return _pad("<@nil>", flags, width)
        kind = "d" if isinstance(value, int) else "f" if isinstance(value, float) else "s"
    if kind in "diuxXobB":
        n = int(number(value))
        if kind not in "di" and n < 0:
            n += 1 << 64
        digits = format(abs(n), {"x": "x", "X": "X", "o": "o", "b": "b", "B": "b"}.get(kind, "d"))
        if precision is not None:
            digits = "" if precision == 0 and n == 0 else digits.rjust(precision, "0")
        prefix = {"x": "0x", "X": "0X", "b": "0b", "B": "0B"}.get(kind, "") if "#" in flags and n else ""
        if kind == "o" and "#" in flags and not digits.startswith("0"):
            prefix = "0"
        sign = "-" if n < 0 else "+" if "+" in flags and kind in "di" else " " if " " in flags and kind in "di" else ""
        return _pad(sign + prefix + digits, flags, width, precision is None)
    if kind in "eEgGfF":
        spec = "%" + "".join(f for f in "#+ " if f in flags) + (f".{precision}" if precision is not None else "") + kind
        return _pad(spec % float(number(value)), flags, width, True)
    if kind == "c":
        text = chr(int(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else (value or "\0")[:1]
        return _pad(text, flags, width)
    text = number_text(value)
    if kind in "wW":  # with what can't be printed escaped
        text = "".join(c if c.isprintable() else f"\\x{ord(c):02x}" if ord(c) < 256 else f"\\u{ord(c):04x}" for c in text)
    if kind in "kK":
        text = text.encode().decode("latin-1")
        if kind == "K":
            text = "".join(c if 32 <= ord(c) < 127 else f"\\x{ord(c):02x}" for c in text)
    elif kind not in "swW":
        raise ValueError(f"no format is named %{kind}")
    return _pad(text if precision is None else text[:precision], flags, width)


_WHOLE = ("bigint", "int", "smallint", "tinyint")


def _padded(text: Column, flags: str, width: int) -> Column:
    if not width:
        return text
    pad = F.rpad if "-" in flags else F.lpad
    return F.when(F.length(text) < width, pad(text, width, " ")).otherwise(text)


def _piece(flags: str, width: int, precision: int | None, kind: str, c: Column, of: str) -> Column | None:
    """One conversion as a built-in expression; None where there is none. of: the column's Spark type."""
    if kind == "s" and of == "string" and not set(flags) - {"-"}:
        text = F.coalesce(c, F.lit(""))
        return _padded(text if precision is None else F.substring(text, 1, precision), flags, width)
    if kind in "dix" and of in _WHOLE and precision is None and not set(flags) - set("-+0") and not (kind == "x" and "+" in flags):
        n = F.coalesce(c, F.lit(0)).cast("bigint")
        digits = F.lower(F.hex(n)) if kind == "x" else F.regexp_replace(n.cast("string"), "^-", "")
        sign = F.lit("") if kind == "x" else F.when(n < 0, F.lit("-")).otherwise(F.lit("+" if "+" in flags else ""))
        if "0" in flags and "-" not in flags and width:
            room = F.lit(width) - F.length(sign)
            digits = F.when(F.length(digits) < room, F.lpad(digits, room, F.lit("0"))).otherwise(digits)
        return _padded(F.concat(sign, digits), flags, width)
    if kind == "f" and of == "double" and not set(flags) - {"-"} and (precision or 0) <= 15:
        x = F.coalesce(c, F.lit(0.0))
        digits, whole = 6 if precision is None else precision, F.floor(F.abs(x)).cast("bigint")
        if digits:
            # the part after the point is exact as a double, and is rounded as the binary value that it is; it may round up to 1
            part = F.call_function("format_number", F.abs(x) - whole.cast("double"), F.lit("0." + "0" * digits))
            plain = F.concat((whole + F.substring(part, 1, 1).cast("bigint")).cast("string"), F.substring(part, 2, digits + 1))
        else:
            plain = F.rint(F.abs(x)).cast("bigint").cast("string")
        plain = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), plain)
        large = F.when(F.abs(x) >= 9e18, F.call_function("format_number", x, F.lit("0" + ("." + "0" * digits if digits else ""))))
        odd = F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf"))
        odd = F.coalesce(odd, large)
        plain = F.when(F.abs(x) < 9e18, plain)
        return _padded(F.coalesce(odd, plain), flags, width)
    return None


def _built_in(fmt: str, columns: tuple[Column, ...], kinds: list[str]) -> Column | None:
    """The whole text as a built-in expression, if each of its conversions is one."""
    parts, at, left = [], 0, list(zip(columns, kinds, strict=False))
    for m in _SPEC.finditer(fmt):
        if m.start() > at:
            parts.append(F.lit(fmt[at : m.start()]))
        at = m.end()
        if m[4] == "%":
            parts.append(F.lit("%"))
            continue
        if m[2] == "*" or m[3] == "*" or not left:
            return None
        precision = None if m[3] is None else int(m[3] or 0)
        part = _piece(m[1] or "", int(m[2] or 0), precision, m[4], *left.pop(0))
        if part is None:
            return None
        parts.append(part)
    if at < len(fmt):
        parts.append(F.lit(fmt[at:]))
    return F.concat(*parts) if parts else None


def sprintf(fmt: str, *columns: Column, kinds: list[str] | None = None) -> Column:
    """A text column; kinds: the columns' Spark types, with which common conversions become built-in expressions."""
    need = sum(1 + (m[2] == "*") + (m[3] == "*") for m in _SPEC.finditer(fmt) if m[4] != "%")
    if need > len(columns):
        raise ValueError("too few arguments for the format")
    if kinds and (built := _built_in(fmt, columns, kinds)) is not None:
        return built

    @F.pandas_udf("string")
    def run(*series: pd.Series) -> pd.Series:
        clean = [[None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v for v in s] for s in series]
        return pd.Series([sprintf_text(fmt, list(row)) for row in zip(*clean, strict=True)], dtype=object)

    return run(*columns) if columns else F.lit(sprintf_text(fmt, []))
