"""Session defaults and the shared folder that written intermediates live in."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(name: str = "riskloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC dates; `settings` override."""
    options = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **settings,
    }
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in options.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that functions in
    tasks find their modules wherever a worker starts."""
    name = f"riskloom-{spark.sparkContext.applicationId}.zip"
    if any(name in path for path in spark.sparkContext.listFiles):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="riskloom-ship-"), name)
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A folder of our own is made only in local mode with the setting unset (tests);
    on a cluster a missing setting is an error, as a local folder would be lost with
    its machine.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, grouped by application."""
    return f"{shared_dir(spark)}/riskloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


class _Written(threading.local):
    """Paths that this thread has written, in order, for `written_only`: what another one
    writes meanwhile is its own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_written = _Written()


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors, and gives Catalyst the
    real size, so that later joins broadcast it only if it is below the threshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    _written.paths.append(path)
    return table


def _delete(spark: SparkSession, path: str) -> None:
    """A folder that `materialize` has made, by the file system that it lies in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing will read any more. Tables of other origin, what
    was derived from a written one, and what another thread has written, are left alone."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path in _written.paths:
            _written.paths.remove(path)
            _delete(table.sparkSession, path)


def written_only(make: Callable[[], DataFrame], label: str = "table") -> DataFrame:
    """Write the table that `make` returns, and delete all that was written while it was
    made: steps that only the result has read."""
    before = len(_written.paths)
    table = materialize(make(), label)
    for path in _written.paths[before:-1]:
        _delete(table.sparkSession, path)
    del _written.paths[before:-1]
    return table
