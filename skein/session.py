"""Sessions for local use, and the package for executors that lack it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine: UTC, adaptive, Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's sources to the executors, once for a session's context."""
    context = spark.sparkContext
    if not getattr(context, "_skein_shipped", False):
        top = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="skein-"), "skein_sources.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(path)
        context._skein_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: that of ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="skein-"))
    return context.getCheckpointDir()


def cut_lineage(df):
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
