"""A program's tree as normalised text, which parses to the same tree."""

from __future__ import annotations

from .grammar import Program


def _quoted(s: str) -> str:
    names = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}
    return '"' + "".join(names.get(c, c if c.isprintable() else f"\\u{ord(c):04x}") for c in s) + '"'


def expression(e) -> str:
    k, many = e[0], lambda xs: ", ".join(map(expression, xs))
    if k == "num":
        return repr(e[1])
    if k == "str":
        return _quoted(e[1])
    if k == "bytes":
        return '@b"' + "".join(f"\\x{x:02x}" for x in e[1]) + '"'
    if k == "re":
        return "/" + e[1].replace("/", "\\/") + "/"
    if k == "name":
        return e[1]
    if k == "field":
        return f"${expression(e[1])}" if e[1][0] in ("num", "name") else f"$({expression(e[1])})"
    if k == "index":
        return f"{expression(e[1])}[{many(e[2])}]"
    if k == "dot":
        return f"{expression(e[1])}.{e[2]}"
    if k == "call":
        return f"{e[1]}({many(e[2])})"
    if k == "un":
        return f"({e[1]} {expression(e[2])})"
    if k == "bin":
        return f"({expression(e[2])} {e[1]} {expression(e[3])})"
    if k in ("and", "or"):
        return f"({expression(e[1])} {'&&' if k == 'and' else '||'} {expression(e[2])})"
    if k == "match":
        return f"({expression(e[2])} {'!~' if e[1] else '~'} {expression(e[3])})"
    if k == "cond":
        return f"({expression(e[1])} ? {expression(e[2])} : {expression(e[3])})"
    if k == "assign":
        return f"({expression(e[2])} {e[1]} {expression(e[3])})"
    if k == "incr":
        return f"({e[1]}{expression(e[3])})" if e[2] else f"({expression(e[3])}{e[1]})"
    if k == "in":
        keys = expression(e[1][0]) if len(e[1]) == 1 else f"({many(e[1])})"
        return f"({keys} in {expression(e[2])})"
    if k == "group":
        return f"({many(e[1])})"
    if k == "getline":
        target = ("getbline" if len(e) > 4 and e[4] else "getline") + (f" {expression(e[2])}" if e[2] else "")
        return f"({target}" + (f" < {expression(e[3])})" if e[1] == "<" else ")") if e[1] in ("", "<") else f"({expression(e[3])} {e[1]} {target})"
    if k == "map":
        return "@{" + ", ".join(f"{expression(a)}: {expression(b)}" for a, b in e[1]) + "}"
    if k == "array":
        return f"@[{many(e[1])}]"
    if k == "func":
        return f"function({_params(e[1])}) {statement(e[2], 0)}"
    raise ValueError(k)


def _params(params) -> str:
    return ", ".join(("&" if ref else "") + n for n, ref in params)


def statement(s, depth: int) -> str:
    pad, k = "\t" * (depth + 1), s[0]
    if k == "block":
        inner = [f"{pad}@local {', '.join(s[1])}\n"] if s[1] else []
        return "{\n" + "".join([*inner, *(f"{pad}{statement(x, depth + 1)}\n" for x in s[2])]) + "\t" * depth + "}"
    if k == "expr":
        return expression(s[1])
    if k in ("print", "printf"):
        dest = f" {s[2]} {expression(s[3])}" if s[2] else ""
        return f"{k}({', '.join(map(expression, s[1]))}){dest}" if s[1] else k + dest
    if k == "if":
        return f"if ({expression(s[1])}) {statement(s[2], depth)}" + (f"\n{pad[1:]}else {statement(s[3], depth)}" if s[3] else "")
    if k == "while":
        return f"while ({expression(s[1])}) {statement(s[2], depth)}"
    if k == "do":
        return f"do {statement(s[1], depth)} while ({expression(s[2])})"
    if k == "for":
        parts = [statement(s[1], depth) if s[1] else "", expression(s[2]) if s[2] else "", statement(s[3], depth) if s[3] else ""]
        return f"for ({'; '.join(parts)}) {statement(s[4], depth)}"
    if k == "forin":
        return f"for ({s[1]} in {expression(s[2])}) {statement(s[3], depth)}"
    if k == "switch":
        cases = "".join(f"{pad}{'default' if t is None else f'case {expression(t)}'}:\n" + "".join(f"{pad}\t{statement(x, depth + 1)}\n" for x in xs) for t, xs in s[2])
        return f"switch ({expression(s[1])}) {{\n{cases}{pad[1:]}}}"
    if k == "delete":
        return f"delete {expression(s[1])}" + (f"[{', '.join(map(expression, s[2]))}]" if s[2] else "")
    if k == "reset":
        return f"@reset {expression(s[1])}"
    return k + (f" {expression(s[1])}" if len(s) > 1 and s[1] is not None else "")


def program(p: Program) -> str:
    out = [f"@pragma {k} {v}" for k, v in p.pragmas.items()]
    out += [f"@global {n}{'' if v is None else f' = {expression(v)}'}" for n, v in p.globals.items()]
    out += [f"function {n}({_params(params)}) {statement(body, 0)}" for n, (params, body) in p.functions.items()]
    out += [f"BEGIN {statement(b, 0)}" for b in p.begin]
    for first, second, action in p.rules:
        head = "" if first is None else expression(first) + (f", {expression(second)}" if second is not None else "")
        out.append(" ".join(x for x in (head, statement(action, 0) if action else "") if x))
    out += [f"END {statement(b, 0)}" for b in p.end]
    return "\n".join(out) + "\n"
