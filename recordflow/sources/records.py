"""Text files as records in order.

A record has its file's number, its number in the file (fnr) and its number in all (nr). The separator decides
how files are cut: None at line ends (a carriage return before one goes), the empty text at blank lines, one
character as it is, anything longer by a regular expression. The end of a file always ends a record.

Line and one-character separators are read in splits of large files: the order is (file, start of the block,
place in the block). The others need a file's text as a whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns
from ..operators.ordered import fresh


@dataclass
class Operands:
    """What a list of operands says: files in order, and the variables set before each."""

    files: list[str] = field(default_factory=list)
    variables: list[dict[str, str]] = field(default_factory=list)


def operands(args: list[str]) -> Operands:
    """Operands of the shape name=value set a variable from there on; the others are files."""
    out, now = Operands(), {}
    for a in args:
        if m := re.fullmatch(r"([A-Za-z_]\w*)=(.*)", a, re.S):
            now = now | {m[1]: m[2]}
        else:
            out.files.append(a)
            out.variables.append(now)
    return out


def _numbered(df: DataFrame, block: str, at: str) -> DataFrame:
    """fnr and nr: blocks are counted, and each adds up the blocks before it (one row a block); rows are numbered in their block."""
    n, start, first = fresh(df, "n", "start", "first")
    counts = df.groupBy("file_idx", block).agg(F.count(F.lit(1)).alias(n))
    before = Window.orderBy("file_idx", block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file_idx", block, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    starts = starts.withColumn(first, F.min(start).over(Window.partitionBy("file_idx")))
    out = df.withColumn(n, F.row_number().over(Window.partitionBy("file_idx", block).orderBy(at))).join(starts, ["file_idx", block])
    return out.withColumn("nr", F.col(start) + F.col(n)).withColumn("fnr", F.col("nr") - F.col(first))


def _path(spark: SparkSession, file: str) -> str:
    """The file's name as Spark's readers give it, but for slashes after the scheme."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    return re.sub(r"^(\w+):/+", r"\1:/", path.getFileSystem(conf).makeQualified(path).toUri().toString())


def read(spark: SparkSession, args: list[str], rs: str | None = None, encoding: str = "UTF-8", ignore_case: bool = False) -> DataFrame:
    """(file_idx, file, fnr, nr, record) of the operands' files, with a column for each variable they set.

    All files are one read; a file that is named twice gives its records twice. A variable can't have the name of one of the
    five columns.
    """
    ops = operands(args)
    names = sorted({n for v in ops.variables for n in v})
    if clash := {n.lower() for n in names} & {"file_idx", "file", "fnr", "nr", "record"}:
        raise ValueError(f"a column has the name of the variable {sorted(clash)}")
    kinds = ", ".join(["__path string", "file_idx int", "file string", *[f"`{n}` string" for n in names]])
    paths = [_path(spark, f) for f in ops.files]
    table = spark.createDataFrame([(p, i, f, *[v.get(n) for n in names]) for i, (p, f, v) in enumerate(zip(paths, ops.files, ops.variables, strict=True))], kinds)
    raw = _records(spark, sorted(set(ops.files)), rs, encoding, ignore_case)
    df = raw.join(F.broadcast(table), raw["__path"] == table["__path"])  # one row an operand
    block, at = fresh(table, "block", "at")
    df = df.select("file_idx", "file", "record", *names, F.col("0block").alias(block), F.col("0at").alias(at))
    return _numbered(df, block, at).select("file_idx", "file", "fnr", "nr", "record", *names)


def _records(spark: SparkSession, files: list[str], rs: str | None, encoding: str, ignore_case: bool) -> DataFrame:
    """(__path, 0block, 0at, record): the file, where the split begins and the place in it."""
    plain = F.regexp_replace("p", r"^(\w+):/+", "$1:/").alias("__path")
    if rs is None or len(rs) == 1 and encoding == "UTF-8":
        raw = spark.read.option("lineSep", rs or "\n").text(files).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("0block"), F.monotonically_increasing_id().alias("0at"), "value")
        record = F.col("value") if rs else F.regexp_replace("value", r"\r\z", "")
        return raw.select(plain, "0block", "0at", record.alias("record"))
    whole = spark.read.format("binaryFile").load(files).select(F.col("path").alias("p"), F.decode("content", encoding).alias("text"))
    return whole.select(plain, F.lit(0).cast("bigint").alias("0block"), F.posexplode(split(F.col("text"), rs, ignore_case)).alias("0at", "record"))


def split(text: Column, rs: str | None, ignore_case: bool = False) -> Column:
    """A file's records."""
    if rs is None:
        parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    elif rs == "":
        clean = F.regexp_replace(F.regexp_replace(text, r"\A\n+", ""), r"\n+\z", "")
        return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"\n\n+", -1))
    elif len(rs) == 1:
        parts = F.split(text, re.escape(rs), -1)
    else:
        parts = F.split(text, patterns.java(rs, ignore_case), -1)
    # a separator at the end doesn't begin another record
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def read_quoted(spark: SparkSession, files: list[str], fs: str) -> DataFrame:
    """Records whose quoted fields may hold line ends: (file, fnr, record, fields)."""
    from ..operators.fields import split_quoted

    _, sep, esc, lq, rq = fs

    def cut(text: str) -> list[str]:
        out, start, inside, i = [], 0, False, 0
        while i < len(text):
            c = text[i]
            if inside and c == esc and esc != rq:
                i += 1
            elif inside and c == rq:
                inside = False
            elif not inside and c == lq:
                inside = True
            elif c == "\n" and not inside:
                out.append(text[start:i].removesuffix("\r"))
                start = i + 1
            i += 1
        return [*out, text[start:]] if start < len(text) else out

    @F.pandas_udf("array<struct<record:string,fields:array<string>>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"record": r, "fields": split_quoted(r, sep, esc, lq, rq)} for r in cut(t)])

    whole = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(run("value")).alias("__at", "r"))
    return whole.select("file", (F.col("__at") + 1).alias("fnr"), "r.record", "r.fields")


def from_table(df: DataFrame, order: list[str], ofs: str = " ") -> DataFrame:
    """A table's rows as records: (nr, record)."""
    from ..operators.ordered import numbered

    record = F.concat_ws(ofs, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    return numbered(df, order, "nr").select("nr", record.alias("record"))
