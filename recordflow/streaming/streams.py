"""The same programs over unbounded input.

Rules that are pure run on a stream as they are. Keyed sums run as an aggregation in update or complete mode. Windows by
event time, sessions and a bound on lateness have no counterpart in the record language; they are offered beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.program import Plan, compile_program
from ..session import shared_folder


def lines(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """New files' lines as records. A stream has no order over all its files, so every number is 0."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_at_once) if files_at_once else spark.readStream
    return reader.text(folder).select(F.lit(0).cast("bigint").alias("nr"), F.col("value").alias("record"))


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    raw = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return raw.select(F.lit(0).cast("bigint").alias("nr"), F.col("value").alias("record"))


def rules(records: DataFrame, text: str, **options) -> DataFrame:
    """A program of pure rules over a stream of records."""
    plan: Plan = compile_program(text, **options)
    if plan.kind != "rules":
        raise ValueError(f"a stream runs pure rules only; this program is {plan.kind}")
    return plan.run(records)


def keyed_count(records: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return records.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def windowed(df: DataFrame, time: str, size: str, keys: list[str], late: str, slide: str | None = None, **values: Column) -> DataFrame:
    """Aggregates by key and window of event time; rows later than `late` are dropped by the watermark."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(*[c.alias(n) for n, c in values.items()])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str, **values: Column) -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*[c.alias(n) for n, c in values.items()])


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs all the input that there is, and gives what came out. State is kept in the folder that all executors share."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
    q = writer.option("checkpointLocation", shared_folder(df.sparkSession)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
