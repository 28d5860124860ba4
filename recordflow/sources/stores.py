"""Databases, configuration files, commands and text sinks."""

from __future__ import annotations

import re
import sqlite3
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Sqlite:
    """An SQLite file that the driver opens: statements run there, and a query's rows become a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.db = spark, sqlite3.connect(path)
        self.changes = self.last_insert_rowid = 0

    def exec(self, sql: str, args=()) -> int:
        cursor = self.db.execute(sql, args)
        self.db.commit()
        self.changes, self.last_insert_rowid = cursor.rowcount, cursor.lastrowid
        return self.changes

    def query(self, sql: str, args=(), schema: str | StructType | None = None) -> DataFrame:
        """Values keep their types; the schema is needed where rows don't tell it."""
        cursor = self.db.execute(sql, args)
        names = [c[0] for c in cursor.description]
        return self.spark.createDataFrame(cursor.fetchall(), schema or names)

    def close(self) -> None:
        self.db.close()


def jdbc(spark: SparkSession, url: str, query: str, all_text: bool = False, **options: str) -> DataFrame:
    """A query that the database runs; all_text: every column as text, as some clients give rows."""
    df = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]) if all_text else df


_CONFIG = re.compile(r"""(?:[^\s'"#]|'[^']*'|"(?:[^"\\]|\\.)*")+""")


def config_rows(text: str, package: str | None = None) -> list[tuple]:
    """(package, section, type, option, value, place) of a configuration file of packages, sections, options and lists.

    An unnamed section is called by type and number, like @type[0]; a section itself has a row without option.
    """
    out, section, kind, seen = [], None, None, {}
    for line in text.splitlines():
        words = [re.sub(r"""'([^']*)'|"((?:[^"\\]|\\.)*)\"""", lambda m: m[1] if m[1] is not None else re.sub(r"\\(.)", r"\1", m[2]), w) for w in _CONFIG.findall(re.sub(r"^\s*#.*", "", line))]
        if not words:
            continue
        if words[0] == "package":
            package = words[1]
        elif words[0] == "config":
            kind = words[1]
            n = seen[kind] = seen.get(kind, -1) + 1
            section = words[2] if len(words) > 2 else f"@{kind}[{n}]"
            out.append((package, section, kind, None, None, 0))
        elif words[0] in ("option", "list"):
            at = sum(r[1] == section and r[3] == words[1] for r in out) if words[0] == "list" else 0
            if words[0] == "option":
                out = [r for r in out if (r[1], r[3]) != (section, words[1])]
            out.append((package, section, kind, words[1], words[2] if len(words) > 2 else "", at))
        else:
            raise ValueError(f"a configuration line can't begin with {words[0]!r}")
    return out


def read_config(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """Configuration files as rows (package, section, type, option, value, place)."""
    schema = "package string, section string, type string, option string, value string, place int"

    def parse(frames):
        import pandas as pd

        for f in frames:
            rows = [r for path, text in zip(f["path"], f["text"], strict=True) for r in config_rows(text, path.rsplit("/", 1)[-1])]
            yield pd.DataFrame(rows, columns=["package", "section", "type", "option", "value", "place"])

    whole = spark.read.text(files, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).mapInPandas(parse, schema)


def write_config(df: DataFrame) -> str:
    """The rows of one package as a file's text (collected: a configuration is small)."""
    out, by = [], {}
    for r in df.collect():
        by.setdefault(r.section, []).append(r)
    for section, rows in by.items():
        head = next(r for r in rows if r.option is None)
        out.append(f"config {head.type}" + ("" if section.startswith("@") else f" '{section}'"))
        lists = {r.option for r in rows if r.place}
        out += [f"\t{'list' if r.option in lists else 'option'} {r.option} '{r.value}'" for r in rows if r.option is not None] + [""]
    return "\n".join(out)


def command(spark: SparkSession, line: str, allow: bool = False) -> DataFrame:
    """(nr, record) of a command's output. The driver runs it, and only if this is allowed."""
    if not allow:
        raise PermissionError("commands are run only with allow=True")
    text = subprocess.run(line, shell=True, capture_output=True, text=True, check=False).stdout
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.splitlines(), 1)], "nr bigint, record string")


def through(df: DataFrame, column: str, line: str, allow: bool = False) -> DataFrame:
    """Each partition's texts through a command on its executor."""
    if not allow:
        raise PermissionError("commands are run only with allow=True")

    def run(frames):
        import pandas as pd

        texts = [t or "" for f in frames for t in f[column]]
        got = subprocess.run(line, shell=True, input="".join(f"{t}\n" for t in texts), capture_output=True, text=True, check=True).stdout
        yield pd.DataFrame({column: got.splitlines()})

    return df.select(column).mapInPandas(run, f"`{column}` string")


def printed(df: DataFrame, *columns: str, ofs: str = " ") -> DataFrame:
    """(value): the columns of each row put together; null is empty."""
    return df.select(F.concat_ws(ofs, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns]).alias("value"))


def print_to(df: DataFrame, path: str, *columns: str, ofs: str = " ", ors: str = "\n", append: bool = False, destination: str | None = None) -> None:
    """Writes text. destination: a column that names each row's output; each becomes a folder of its own."""
    text = F.concat_ws(ofs, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    out = df.select(text.alias("value"), *([F.col(destination).alias("dest")] if destination else []))
    writer = out.write.mode("append" if append else "overwrite").option("lineSep", ors)
    (writer.partitionBy("dest") if destination else writer).text(path)
