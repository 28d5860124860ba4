"""A session with the settings that the library's results assume, and the library for its executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def session(app: str = "recordflow", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below the folder that the cluster names in spark.checkpoint.dir; only a local session without it gets one of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="recordflow-")
    return f"{top}/recordflow-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session's context, so that they can import it wherever they run.

    Where the session leaves the rows of an Arrow batch at Spark's 10,000, they become fewer: that many texts take tens of
    megabytes on either side of each worker, which the executors keep.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")
    if getattr(sc, "_recordflow_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="recordflow-"), "recordflow.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("recordflow", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._recordflow_shipped = True
