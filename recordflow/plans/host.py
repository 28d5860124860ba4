"""Functions of the host that programs may call: plain Python functions by name, and modules of them.

A function gets its arguments' values. Those at the places named by `stores` come as a Slot instead, whose `set` stores into
the variable, field or element that the program named there. Host functions run where the program runs, so what they hold on
to (a connection, a file) must be there; the modules below are for programs that the driver runs (`program.execute`).
"""

from __future__ import annotations

import sqlite3
from collections.abc import Callable
from typing import Any


class Slot:
    """Where a program wants a value stored."""

    def __init__(self, value: Any, put: Callable[[Any], None]):
        self.value, self.set = value, put


def stores(*places: int):
    """Marks a host function that stores into its arguments at these places, from 0."""

    def mark(f):
        f.stores = set(places)
        return f

    return mark


class _Statement:
    def __init__(self, db: sqlite3.Connection, sql: str):
        self.db, self.sql, self.bound = db, sql, {}
        self.cursor: sqlite3.Cursor | None = None
        names = db.execute(f"select * from ({sql}) limit 0", [None] * sql.count("?")).description if sql.lstrip().lower().startswith("select") else ()
        self.names = [c[0] for c in names or ()]

    def run(self) -> sqlite3.Cursor:
        if self.cursor is None:
            n = max(self.bound, default=0)
            n = max(n, self.sql.count("?"))
            self.cursor = self.db.execute(self.sql, [self.bound.get(i) for i in range(1, n + 1)])
        return self.cursor


def sqlite_module() -> dict[str, Callable]:
    """The functions of `sqlite::`: handles are numbers, -1 is an error that errmsg() tells, rows come as maps from 1."""
    databases: dict[int, Any] = {}
    statements: dict[int, _Statement] = {}
    last = {"error": "", "handle": -1}

    def guarded(f):
        def run(*args):
            try:
                return f(*args)
            except (sqlite3.Error, KeyError, ValueError, IndexError) as e:
                last["error"] = f"no such handle: {e}" if isinstance(e, KeyError) else str(e)
                return -1

        run.stores = getattr(f, "stores", set())
        return run

    def database(sid) -> sqlite3.Connection:
        db = databases[int(sid)]
        if db is None:
            raise ValueError("not connected")
        return db

    def handle(held: dict, made) -> int:
        last["handle"] += 1
        held[last["handle"]] = made
        return last["handle"]

    def connect(sid, path, *flags) -> int:
        if int(sid) not in databases:
            raise KeyError(sid)
        databases[int(sid)] = sqlite3.connect(str(path), isolation_level=None)
        return 0

    def execute(sid, sql) -> int:
        database(sid).execute(str(sql))
        return 0

    def close(sid) -> int:
        db = databases.pop(int(sid))
        if db is not None:
            db.close()
        return 0

    def bind(convert):
        def run(stmt, place, *value) -> int:
            if int(place) < 1:
                raise ValueError("parameters count from 1")
            statements[int(stmt)].bound[int(place)] = convert(*value)
            return 0

        return run

    @stores(1)
    def fetch_row(stmt, row: Slot, *_) -> int:
        got = statements[int(stmt)].run().fetchone()
        if got is None:
            return 0
        row.set({str(i): v for i, v in enumerate(got, 1)})
        return 1

    def reset(stmt) -> int:
        statements[int(stmt)].cursor = None
        return 0

    def finalize(stmt) -> int:
        statements.pop(int(stmt))
        return 0

    @stores(2)
    def escape_string(sid, text, out: Slot) -> int:
        database(sid)
        out.set(str(text).replace("'", "''"))
        return 0

    def by_type(v):
        return v if v is None or isinstance(v, (int, float, bytes)) else str(v)

    functions = {
        "open": lambda: handle(databases, None), "connect": connect, "close": close, "exec": execute, "prepare": lambda sid, sql: handle(statements, _Statement(database(sid), str(sql))), "bind": bind(by_type), "bind_int": bind(int), "bind_flt": bind(float),
        "bind_str": bind(str), "bind_blob": bind(lambda v: v if isinstance(v, bytes) else str(v).encode()), "bind_null": bind(lambda: None), "fetch_row": fetch_row, "reset": reset, "finalize": finalize, "column_count": lambda stmt: len(statements[int(stmt)].names),
        "column_name": lambda stmt, i: statements[int(stmt)].names[int(i) - 1], "changes": lambda sid: database(sid).execute("select changes()").fetchone()[0], "last_insert_rowid": lambda sid: database(sid).execute("select last_insert_rowid()").fetchone()[0],
        "errmsg": lambda: last["error"], "escape_string": escape_string,
    }
    return {f"sqlite::{n}": guarded(f) for n, f in functions.items()}
