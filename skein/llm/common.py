"""Shared scratch tables and connected components for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folders of Scratch tables that this driver made and hasn't cleared.
_ROOTS: list[str] = []


class Scratch:
    """Written tables of one operator run, below the shared folder. They outlive lost executors and cut lineage.

    Results read from them, so they stay until ``clear_scratch`` or the end of a ``scratch_space``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def again(self, df: DataFrame, tag: str) -> DataFrame:
        """A second, independent reading of a kept table, for joins with itself."""
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{tag}")

    def drop(self, *tags: str) -> None:
        """Delete written tables that nothing reads any more."""
        for tag in tags:
            _delete(self.spark, f"{self.root}/{tag}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables of the runs so far (from the ``since``-th on), once their results have been written."""
    while len(_ROOTS) > since:
        _delete(spark, _ROOTS.pop())


@contextlib.contextmanager
def scratch_space(spark: SparkSession):
    """Scratch tables made within are deleted at its end; write the results before."""
    since = len(_ROOTS)
    try:
        yield
    finally:
        clear_scratch(spark, since)


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", tag: str = "cc") -> DataFrame:
    """Smallest reachable node of every node that has an edge: ``node long, component long``.

    Alternates large-star and small-star steps until the edge set is a set of stars. Each step writes its edges and its
    minima, so the joins read plain tables on both sides and AQE can split the key of a hot star.
    """
    start = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = scratch.keep(start.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), f"{tag}-0")
    step, last = 0, [f"{tag}-0"]
    while not _stars(now):
        step += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{tag}-{step}-m")
        large = both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, f"{tag}-{step}-l")
        low2 = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-{step}-n")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = scratch.keep(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), f"{tag}-{step}")
        scratch.drop(*last)
        last = [f"{tag}-{step}{x}" for x in ("", "-m", "-l", "-n")]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node, or none: then the smaller ends are the components' least nodes."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def with_texts(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the text as UTF-8 bytes ``_t``, whatever else the table holds."""
    return docs.select(*columns, F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("_t"))


def release() -> None:
    """Gives freed memory of a Python worker back to the machine: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """The same function over batches, which releases memory when a task ends."""

    @functools.wraps(run)
    def then_release(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return then_release


def rows_by_bytes(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, text: str = "_t") -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose text column holds about ``most`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
