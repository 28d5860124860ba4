"""Times as epoch seconds: formatting and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: C's codes and the patterns of date_format that print the same.
CODES = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
    "j": "DDD", "p": "a", "I": "hh", "Z": "z", "z": "Z",
}
#: Codes that stand for others.
COMPOUND = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "R": "%H:%M", "D": "%m/%d/%y", "r": "%I:%M:%S %p", "c": "%a %b %e %H:%M:%S %Y", "x": "%m/%d/%y", "X": "%H:%M:%S"}


def strftime(fmt: str, seconds: Column) -> Column:
    """In the session's time zone."""
    for k, v in COMPOUND.items():
        fmt = fmt.replace(f"%{k}", v)
    ts, parts, text, i = F.timestamp_seconds(seconds), [], "", 0
    weekday = F.dayofweek(ts)  # Sunday is 1
    yday = F.dayofyear(ts)
    special = {
        "s": lambda: seconds.cast("bigint").cast("string"), "e": lambda: F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), "u": lambda: F.when(weekday == 1, 7).otherwise(weekday - 1).cast("string"), "w": lambda: (weekday - 1).cast("string"),
        "U": lambda: F.lpad(F.floor((yday + 7 - weekday) / 7).cast("string"), 2, "0"), "W": lambda: F.lpad(F.floor((yday + 6 - F.pmod(weekday - 2, F.lit(7))) / 7).cast("string"), 2, "0"),
        "V": lambda: F.lpad(F.weekofyear(ts).cast("string"), 2, "0"), "G": lambda: F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), "C": lambda: F.lpad(F.floor(F.year(ts) / 100).cast("string"), 2, "0"),
        "k": lambda: F.lpad(F.hour(ts).cast("string"), 2, " "), "l": lambda: F.lpad((F.pmod(F.hour(ts) + 11, F.lit(12)) + 1).cast("string"), 2, " "),
    }

    def flush():
        nonlocal text
        if text:
            parts.append(F.lit(text))
            text = ""

    while i < len(fmt):
        if fmt[i] != "%" or i + 1 == len(fmt):
            text, i = text + fmt[i], i + 1
            continue
        c = fmt[i + 1]
        i += 2
        if c in "%nt":
            text += {"%": "%", "n": "\n", "t": "\t"}[c]
        elif c in CODES:
            flush()
            parts.append(F.date_format(ts, CODES[c]))
        elif c in special:
            flush()
            parts.append(special[c]())
        else:
            text += f"%{c}"
    flush()
    return F.concat(*parts) if parts else F.lit("")


def mktime(text: Column) -> Column:
    """Epoch seconds of 'YYYY MM DD HH MM SS' in UTC; fields beyond their range carry over.

    -1 for a text of fewer fields.
    """
    part = F.split(F.trim(text), r"\s+")
    n = [F.get(part, k).try_cast("bigint") for k in range(6)]
    month = n[1] - 1
    day1 = F.make_date((n[0] + F.floor(month / 12)).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))
    days = F.unix_date(day1).cast("bigint") + n[2] - 1
    local = days * 86400 + n[3] * 3600 + n[4] * 60 + n[5]
    return F.coalesce(local, F.lit(-1).cast("bigint"))


def systime() -> Column:
    return F.unix_timestamp()


def gettime() -> Column:
    """A struct: seconds and nanoseconds."""
    us = F.unix_micros(F.current_timestamp())
    return F.struct(F.floor(us / 1_000_000).cast("bigint").alias("seconds"), ((us % 1_000_000) * 1000).alias("nanoseconds"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(path, r"/[^/]*\z", ""))
