"""POSIX extended regular expressions as Java's.

Differences that are translated: bracket classes, a bracket's special characters, `.` matching a newline,
braces that are literal unless bounds are switched on, and alternatives of plain text, of which POSIX takes the
longest and Java the first. Other alternatives keep Java's order.
"""

from __future__ import annotations

import re

#: The bracket classes' names and Java's names for them.
CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}", "xdigit": r"\p{XDigit}",
}


def _bracket(p: str, i: int) -> tuple[str, int]:
    """The bracket expression that begins at p[i], and where it ends."""
    out, j = "[", i + 1
    if p[j : j + 1] == "^":
        out, j = out + "^", j + 1
    first = True
    while j < len(p) and (p[j] != "]" or first):
        first = False
        if p[j : j + 2] == "[:" and (e := p.find(":]", j)) > 0:
            name = p[j + 2 : e]
            if name not in CLASSES:
                raise ValueError(f"no class of characters is named {name!r}")
            out, j = out + CLASSES[name], e + 2
        elif p[j] == "\\" and j + 1 < len(p):
            out, j = out + p[j : j + 2], j + 2
        else:
            out, j = out + ("\\" if p[j] in "[]&^~" else "") + p[j], j + 1
    if j >= len(p):
        raise ValueError("a bracket isn't closed")
    return out + "]", j + 1


def _longest_first(p: str) -> str:
    """Plain alternatives by falling length, at the top and in groups of plain text."""
    plain = r"[\w \-]+(?:\|[\w \-]+)+"
    order = lambda m: "|".join(sorted(m[0].split("|"), key=lambda x: -len(x)))
    if re.fullmatch(plain, p):
        return re.sub(plain, order, p)
    return re.sub(rf"(?<=\(){plain}(?=\))", order, p)


def java(pattern: str, ignore_case: bool = False, bounds: bool = True) -> str:
    """The Java pattern for a POSIX extended one."""
    out, i, p = "", 0, _longest_first(pattern)
    while i < len(p):
        c = p[i]
        if c == "[":
            part, i = _bracket(p, i)
            out += part
            continue
        if c == "\\" and i + 1 < len(p):
            out += p[i : i + 2] if p[i + 1] not in "/\"'" else re.escape(p[i + 1])
            i += 2
            continue
        if c in "{}" and not (bounds and re.match(r"\{\d*,?\d*\}|\}", p[i:])):
            out += "\\" + c
        else:
            out += c
        i += 1
    return ("(?si)" if ignore_case else "(?s)") + out


def python(pattern: str, ignore_case: bool = False, bounds: bool = True) -> re.Pattern:
    """The same for Python's engine, for the sequential operators."""
    classes = {r"\p{Alnum}": "a-zA-Z0-9", r"\p{Alpha}": "a-zA-Z", r"\p{Blank}": r" \t", r"\p{Cntrl}": r"\x00-\x1f\x7f", r"\p{Digit}": "0-9", r"\p{Graph}": "!-~", r"\p{Lower}": "a-z", r"\p{Print}": " -~", r"\p{Punct}": r"!-/:-@\[-`{-~", r"\p{Space}": r"\s", r"\p{Upper}": "A-Z", r"\p{XDigit}": "0-9A-Fa-f"}
    out = java(pattern, ignore_case, bounds)
    for k, v in classes.items():
        out = out.replace(k, v)
    return re.compile(out)


def replacement(text: str) -> str:
    """A replacement in which & or \\0 stand for the match and \\1 to \\9 for groups, as Java's."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            d = text[i + 1]
            out += f"${d}" if d.isdigit() else "&" if d == "&" else "\\\\" + ("\\$" if d == "$" else d) if d != "\\" else "\\\\"
            i += 2
            continue
        out += "$0" if c == "&" else "\\$" if c == "$" else c
        i += 1
    return out
