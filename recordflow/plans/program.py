"""Programs of the record language as DataFrame plans.

A program is read for what it depends on. Rules that only read the record, its fields and its number become
column expressions (`rules`). Rules that only update map slots (m[k]++, m[k] += e) by one key, with an END that goes
through the map, become an aggregation with partial sums (`fold`); scalars updated likewise and printed at the
end become a global one. Every other program is run record by record (`sequential`), one task for each ordering
domain. `Plan.kind` says which it is.

Records are a table with `nr` (and `fnr`, `file` if there are several files) and `record`. Output is (nr, at, dest, line): at is the
place among the record's lines; END's lines have nr null in the plans and the last number when run in order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, formatting, patterns
from ..functions import text as T
from ..operators import fields
from ..operators.domains import in_order
from ..operators.ordered import fresh
from .compiled import Code
from .grammar import Program, parse
from .sequential import Interpreter


class NotPure(Exception):
    """An expression that needs more than its record."""


def number_column(c: Column, kind: str) -> Column:
    """A value as text: whole numbers in full, others in six digits."""
    if kind in ("str", "int"):
        return c.cast("string")
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(formatting.sprintf("%.6g", c))


class Columns:
    """Expressions as (column, kind); kinds: str, int, num (a double), bool."""

    def __init__(self, variables: dict | None = None, fs: str = " ", held: str | None = None):
        """held: a column that has the record's fields."""
        self.record, self.nr = F.col("record"), F.col("nr")
        self.variables, self.fs = variables or {}, fs
        self.fields = F.col(held) if held else fields.split(self.record, fs)

    def text(self, e) -> Column:
        c, kind = self.ev(e)
        return c.cast("int").cast("string") if kind == "bool" else number_column(c, kind)

    def number(self, e) -> Column:
        c, kind = self.ev(e)
        return coerce.to_number(c) if kind == "str" else c.cast("int").cast("double") if kind == "bool" else c

    def truth(self, e) -> Column:
        if e[0] == "re":
            return self.record.rlike(patterns.java(e[1]))
        c, kind = self.ev(e)
        return c if kind == "bool" else F.length(c) > 0 if kind == "str" else c != 0

    def ev(self, e) -> tuple[Column, str]:
        k = e[0]
        if k == "num":
            return F.lit(e[1]), "int" if isinstance(e[1], int) else "num"
        if k == "str":
            return F.lit(e[1]), "str"
        if k == "re":
            return self.truth(e), "bool"
        if k == "name":
            if e[1] == "NR":
                return self.nr, "int"
            if e[1] == "NF":
                return F.size(self.fields).cast("bigint"), "int"
            if e[1] in self.variables:
                v = self.variables[e[1]]
                return F.lit(v), "str" if isinstance(v, str) else "int" if isinstance(v, int) else "num"
            raise NotPure(e[1])
        if k == "field":
            if e[1] == ("name", "NF"):
                return F.coalesce(F.element_at(self.fields, F.when(F.size(self.fields) > 0, -1)), F.lit("")), "str"
            if e[1][0] != "num":
                raise NotPure("a computed field")
            return (self.record, "str") if e[1][1] == 0 else (fields.field(self.fields, e[1][1]), "str")
        if k in ("and", "or"):
            a, b = self.truth(e[1]), self.truth(e[2])
            return (a & b if k == "and" else a | b), "bool"
        if k == "un":
            if e[1] == "!":
                return ~self.truth(e[2]), "bool"
            if e[1] in "+-":
                c, kind = self.ev(e[2])
                c = c if kind in ("int", "num") else self.number(e[2])
                return (-c if e[1] == "-" else c), kind if kind == "int" else "num"
        if k == "match" and e[3][0] in ("re", "str"):
            hit = self.text(e[2]).rlike(patterns.java(e[3][1]))
            return (~hit if e[1] else hit), "bool"
        if k == "cond":
            (a, ka), (b, kb) = self.ev(e[2]), self.ev(e[3])
            if ka != kb:
                raise NotPure("kinds differ")
            return F.when(self.truth(e[1]), a).otherwise(b), ka
        if k == "bin":
            return self.binary(e[1], e[2], e[3])
        if k == "call":
            return self.call(e[1].split("::")[-1], e[2])
        raise NotPure(k)

    def binary(self, op: str, a, b) -> tuple[Column, str]:
        if op == "%%":
            return F.concat(self.text(a), self.text(b)), "str"
        (x, kx), (y, ky) = self.ev(a), self.ev(b)
        if op in ("==", "!=", "<", "<=", ">", ">="):
            if "str" in (kx, ky):
                x, y = self.text(a), self.text(b)
            return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool"
        whole = kx == ky == "int"
        if op in ("+", "-", "*", "%") and whole and not (op == "%" and b[0] != "num"):
            return {"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op], "int"
        p, q = self.number(a).cast("double"), self.number(b).cast("double")
        if op in ("+", "-", "*"):
            return {"+": p + q, "-": p - q, "*": p * q}[op], "num"
        if op == "/" and b[0] == "num" and b[1] != 0:
            return p / q, "num"
        raise NotPure(op)

    def call(self, name: str, args) -> tuple[Column, str]:
        if name == "length" and len(args) <= 1:
            return F.length(self.text(args[0]) if args else self.record).cast("bigint"), "int"
        if name in ("tolower", "toupper"):
            return (F.lower if name == "tolower" else F.upper)(self.text(args[0])), "str"
        if name == "substr":
            at = [F.floor(self.number(x)).cast("int") for x in args[1:]]
            return T.substr(self.text(args[0]), *at), "str"
        if name == "index" and len(args) == 2 and args[1][0] == "str":
            return T.index(self.text(args[0]), args[1][1]).cast("bigint"), "int"
        if name == "int":
            return self.number(args[0]).cast("bigint"), "int"
        if name in ("trim", "ltrim", "rtrim") and len(args) == 1:
            return getattr(T, name)(self.text(args[0])), "str"
        if name == "gensub" and len(args) == 4 and args[0][0] == "re" and args[1][0] == "str" and args[2][0] in ("num", "str"):
            return T.gensub(self.text(args[3]), args[0][1], args[1][1], args[2][1]), "str"
        if name in ("sin", "cos", "exp", "atan"):
            return getattr(F, name)(self.number(args[0])), "num"
        raise NotPure(name)


def _settings(p: Program, variables: dict, fs: str) -> tuple[dict, str] | None:
    """Variables after a BEGIN of plain assignments; None where it does more."""
    out = dict(variables)
    for block in p.begin:
        for s in block[2]:
            if s[0] != "expr" or s[1][0] != "assign" or s[1][1] != "=" or s[1][2][0] != "name" or s[1][3][0] not in ("num", "str"):
                return None
            out[s[1][2][1]] = s[1][3][1]
    known = {"FS", "OFS", "ORS"}
    if any(n in out for n in ("RS", "NF", "NR", "CONVFMT", "OFMT", "IGNORECASE", "SUBSEP", "NUMSTRDETECT")):
        return None
    fs = out.get("FS", fs)
    return {k: v for k, v in out.items() if k not in known} | {"OFS": out.get("OFS", " "), "ORS": out.get("ORS", "\n")}, fs


@dataclass
class Plan:
    kind: str
    program: Program
    variables: dict
    fs: str
    outputs: tuple[str, ...] = ()
    host: dict | None = None

    def run(self, records: DataFrame, by: list[str] | None = None, files: dict[str, str] | None = None) -> DataFrame:
        if self.kind == "rules":
            return _rules(self, records)
        if self.kind == "fold":
            return _fold(self, records)
        return _sequential(self, records, by or [], files or {})


def compile_program(text: str, variables: dict | None = None, fs: str = " ", includes: dict[str, str] | None = None, outputs: tuple[str, ...] = (), host: dict | None = None) -> Plan:
    p = parse(text, includes)
    variables = variables or {}
    plain = not (p.functions or p.globals or outputs or host) and set(p.pragmas) <= {"implicit"}
    settings = _settings(p, variables, fs) if plain else None
    for kind, fits in (("rules", _is_rules), ("fold", _is_fold)):
        if settings is not None:
            try:
                if fits(p, *settings):
                    return Plan(kind, p, *settings)
            except NotPure:
                pass
    return Plan("sequential", p, variables, fs, outputs, host)




_PURE = {"length", "tolower", "toupper", "substr", "index", "int", "trim", "ltrim", "rtrim", "gensub", "sin", "cos", "exp", "atan"}


def _assigned(x) -> bool:
    """Whether a tree holds an assignment, a getline or a call that may change something."""
    if isinstance(x, tuple):
        if x and x[0] in ("assign", "incr", "getline", "func") or x and x[0] == "call" and x[1].split("::")[-1] not in _PURE:
            return True
        return any(_assigned(y) for y in x)
    return isinstance(x, list) and any(_assigned(y) for y in x)


def _is_rules(p: Program, variables: dict, fs: str) -> bool:
    if p.end or not p.rules:
        return False
    for first, second, action in p.rules:
        if second is not None or _assigned(first):
            return False
        for s in action[2] if action else []:
            if s[0] == "next":
                continue
            if s[0] != "print" or s[2] not in (None, ">", ">>") or _assigned(s[1]) or _assigned(s[3]):
                return False
    return _compiles(p, variables, fs)


def _compiles(p: Program, variables: dict, fs: str) -> bool:
    e = Columns(variables, fs)
    for first, _, action in p.rules:
        if first is not None:
            e.truth(first)
        for s in action[2] if action else []:
            if s[0] == "print":
                for a in s[1]:
                    e.text(a)
                if s[3] is not None:
                    e.text(s[3])
    return True


def _split(plan: Plan, records: DataFrame) -> tuple[DataFrame, Columns]:
    """The records cut into fields once."""
    (held,) = fresh(records, "fields")
    return records.withColumn(held, fields.split(F.col("record"), plan.fs)), Columns(plan.variables, plan.fs, held)


def _rules(plan: Plan, records: DataFrame) -> DataFrame:
    records, e = _split(plan, records)
    ofs, alive, out = plan.variables["OFS"], F.lit(True), []
    empty = F.lit(None).cast("string")
    for first, _, action in plan.program.rules:
        on = alive if first is None else alive & F.coalesce(e.truth(first), F.lit(False))
        for s in action[2] if action else [("print", [], None, None)]:
            if s[0] == "next":
                alive = alive & ~on
                break
            line = F.concat_ws(ofs, *[e.text(a) for a in s[1]]) if s[1] else e.record
            out.append(F.when(on, F.struct((empty if s[3] is None else e.text(s[3])).alias("dest"), line.alias("line"))))
    some = F.filter(F.array(*out), lambda x: x.isNotNull())
    return records.select("nr", F.posexplode(some).alias("at", "o")).select("nr", "at", "o.dest", "o.line")


def _updates(action, maps: bool):
    """(target's name, key or None, what is added) of each statement."""
    for s in action[2]:
        x = s[1] if s[0] == "expr" else (None,)
        if x[0] == "incr" and x[1] == "++":
            target, added = x[3], ("num", 1)
        elif x[0] == "assign" and x[1] == "+=":
            target, added = x[2], x[3]
        else:
            raise NotPure("no sum")
        if _assigned(added):
            raise NotPure("an assignment")
        if maps and target[0] == "index" and target[1][0] == "name" and not _assigned(target[2]):
            yield target[1][1], tuple(target[2]), added
        elif not maps and target[0] == "name":
            yield target[1], None, added
        else:
            raise NotPure("another target")


def _shape(p: Program) -> tuple:
    """(updates by rule, the loop's variable and map or None, END's prints)"""
    if len(p.end) != 1 or not p.rules or any(r[1] is not None or r[2] is None or _assigned(r[0]) for r in p.rules):
        raise NotPure("no fold")
    end = p.end[0][2]
    if len(end) == 1 and end[0][0] == "forin" and end[0][2][0] == "name":
        _, var, base, body = end[0]
        prints = body[2] if body[0] == "block" else [body]
        updates = [(r[0], list(_updates(r[2], True))) for r in p.rules]
        if len({k for _, us in updates for _, k, _ in us}) != 1 or base[1] not in {n for _, us in updates for n, _, _ in us}:
            raise NotPure("several keys")
        loop = (var, base[1])
    else:
        prints, loop = end, None
        updates = [(r[0], list(_updates(r[2], False))) for r in p.rules]
    if not all(s[0] == "print" and s[1] and s[2] is None for s in prints):
        raise NotPure("more than prints")
    return updates, loop, prints


class _Totals(Columns):
    """END's expressions over the sums."""

    def __init__(self, plan_variables: dict, loop, names: set[str]):
        self.variables, self.loop, self.names = plan_variables, loop, names
        self.record = F.lit("")

    def ev(self, e):
        if self.loop and e == ("name", self.loop[0]):
            return F.col("__key"), "str"
        if self.loop and e[0] == "index" and e[1][0] == "name" and e[1][1] in self.names and e[2] == [("name", self.loop[0])]:
            return F.col(f"sum_{e[1][1]}"), "num"
        if not self.loop and e[0] == "name" and e[1] in self.names:
            return F.col(f"sum_{e[1]}"), "num"
        if e[0] in ("field", "re") or e == ("name", "NF"):
            raise NotPure("no record at the end")
        if e == ("name", "NR"):
            raise NotPure("the last number")
        return super().ev(e)


def _is_fold(p: Program, variables: dict, fs: str) -> bool:
    updates, loop, prints = _shape(p)
    e = Columns(variables, fs)
    names = set()
    for first, us in updates:
        if first is not None:
            e.truth(first)
        for name, key, added in us:
            names.add(name)
            e.number(added)
            for k in key or ():
                e.text(k)
    totals = _Totals(variables, loop, names)
    for s in prints:
        for a in s[1]:
            totals.text(a)
    return True


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with further columns that are computed once a row: filters and sums over them don't repeat their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _fold(plan: Plan, records: DataFrame) -> DataFrame:
    updates, loop, prints = _shape(plan.program)
    held, *flags = fresh(records, "fields", *[f"on{i}" for i in range(len(updates))])
    records = _once(records, {held: fields.split(F.col("record"), plan.fs)})
    e = Columns(plan.variables, plan.fs, held)
    records = _once(records, {n: F.lit(True) if first is None else F.coalesce(e.truth(first), F.lit(False)) for n, (first, _) in zip(flags, updates, strict=True)})
    sums: dict[str, Column] = {}
    in_map = F.lit(False)
    key = None
    for flag, (_, us) in zip(flags, updates, strict=True):
        on = F.col(flag)
        for name, k, added in us:
            key = k if key is None else key
            in_map = in_map | on if loop and name == loop[1] else in_map
            part = F.when(on, e.number(added)).otherwise(F.lit(0.0))
            sums[name] = sums[name] + part if name in sums else part
    aggregates = [F.sum(c).cast("double").alias(f"sum_{n}") for n, c in sums.items()]
    if loop:
        text = F.concat_ws("\x1c", *[e.text(k) for k in key])
        got = records.where(in_map).groupBy(text.alias("__key")).agg(*aggregates)
    else:
        got = records.agg(*aggregates)
        got = got.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in got.columns])
    totals = _Totals(plan.variables, loop, set(sums))
    lines = F.array(*[F.concat_ws(plan.variables["OFS"], *[totals.text(a) for a in s[1]]) for s in prints])
    none = F.lit(None)
    order = ["__key"] if loop else []
    out = got.select(*order, F.posexplode(lines).alias("at", "line"))
    out = out.orderBy(*order, "at") if loop else out
    return out.select(none.cast("bigint").alias("nr"), "at", none.cast("string").alias("dest"), "line")


def _sequential(plan: Plan, records: DataFrame, by: list[str], files: dict[str, str]) -> DataFrame:
    program, variables, fs, outputs, host = plan.program, plan.variables, plan.fs, plan.outputs, plan.host
    has = records.columns
    columns = ["nr", "record", *[c for c in ("file", "fnr") if c in has and c not in by]]
    file_at, fnr_at = (columns.index(c) if c in columns else None for c in ("file", "fnr"))
    by_file = by.index("file") if "file" in by else None
    held: list[Code] = []  # put together once a task, for all of its domains

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        given = ((r[file_at] if file_at is not None else "", r[fnr_at] if fnr_at is not None else r[0], r[1]) for r in rows)
        last = at = None
        if not held:
            held.append(Code(program))
        for nr, dest, text in Interpreter(program, variables, files, fs, outputs=outputs, host=host, code=held[0]).run(given):
            at, last = (at + 1 if nr == last else 0), nr
            yield nr, at, dest, text.removesuffix("\n")

    out = [("nr", "long", pa.int64()), ("at", "integer", pa.int32()), ("dest", "string", pa.string()), ("line", "string", pa.string())]
    if by_file is not None:  # the file is a column of the domain too: a copy tells its name
        (name,) = fresh(records, "file")
        records = records.withColumn(name, F.col("file"))
        columns, file_at = [*columns, name], len(columns)
    return in_order(records.select(*by, *columns), by, ["nr"], run, out)


def run_program(text: str, records: DataFrame, by: list[str] | None = None, variables: dict | None = None, fs: str = " ", files: dict[str, str] | None = None, includes: dict[str, str] | None = None, outputs: tuple[str, ...] = (), host: dict | None = None) -> DataFrame:
    """files: texts for getline; includes: texts for @include; outputs: names of the console outputs, which the destination column gets;
    host: Python functions that the program may call, which go to the executors with it.
    """
    return compile_program(text, variables, fs, includes, outputs, host).run(records, by, files)


def execute(text: str, records: Iterable[str] = (), variables: dict | None = None, fs: str = " ", files: dict[str, str] | None = None, includes: dict[str, str] | None = None, host: dict | None = None) -> str:
    """What a program prints to the console, run here and now over a few records or none: for programs that only compute."""
    rows = (("", i, r) for i, r in enumerate(records, 1))
    return "".join(x for _, dest, x in Interpreter(parse(text, includes), variables, files, fs, host=host).run(rows) if dest is None)
