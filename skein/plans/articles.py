"""The article and entity views that the threading plans read, and their settings."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from skein.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    td: bool = True
    alpha: float = 3.0
    ent: bool = False
    gamma: float = 0.1
    mce: int = 5
    meb: int = 5
    w: float = 0.8
    th: float | str = "auto"
    outdegree: int = 1
    auto_scope: str = "first"
    length: tuple[int, int] = (2, 100)
    similarity: tuple[float, float] = (-1.0, 1.0)
    days: tuple[float, float] = (0.0, 120.0)


#: The documented thresholds of selection for incremental runs.
SELECTION = {"length": (3, 100), "similarity": (0.2, 0.8), "days": (0.0, 120.0)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_positions(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``doc_pos``, the dense rank in the given total order from 0, without gathering the rows in one task.

    Rows are dealt by range and written once with their partition's number: dealt twice, other columns may give other
    partitions. A window numbers each partition and only the partitions' counts are summed up in one place.
    """
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(spread, *order).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_p"), (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    start = F.coalesce(F.col("_before"), F.raise_error(F.lit("a partition of the dealt rows has no count")).cast("long"))
    return dealt.withColumn("_own", own).join(before, "_p", "left").withColumn("doc_pos", (start + F.col("_own")).cast("long")).drop("_p", "_own", "_before")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, emb, story_id, ts, text_id, sec, part_id, doc_pos`` from embeddings and events."""
    vectors, events = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "events")
    stride = events.count() // max(1, vectors.count())
    n_docs = table(spark, sf_dir, "documents").count()
    when = events.where(F.col("event_id") % stride == 0).select((F.col("event_id") / stride).cast("long").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("emb"), F.col("label").alias("story_id")).join(when, "doc_id")
    rows = rows.withColumn("text_id", F.col("doc_id") % n_docs).withColumn("sec", F.unix_micros("ts") / F.lit(1e6)).withColumn("part_id", F.lit(0))
    return with_positions(rows, "ts", "doc_id")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, q, entity``: who and where of the two events from an article's first."""
    events = table(spark, sf_dir, "events")
    n = table(spark, sf_dir, "embeddings").count()
    stride = events.count() // max(1, n)
    own = events.withColumn("doc_id", F.floor(F.col("event_id") / stride)).where(F.expr(f"event_id % {stride} < 2 and doc_id < {n}"))
    who = own.select("doc_id", F.lit("who").alias("q"), F.concat(F.lit("u"), "user_id").alias("entity"))
    where = own.select("doc_id", F.lit("where").alias("q"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("entity"))
    return who.unionByName(where).distinct()


_LETTERS, _ASCII_LETTERS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-Za-z]+")


def letter_words(text: str) -> list[str]:
    """Maximal runs of letters, category L."""
    if text.isascii():
        return _ASCII_LETTERS.findall(text)
    out = []
    for w in _LETTERS.findall(text):
        # the class also takes numbers that are no decimal digits
        out += [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()
    return out


@F.arrow_udf(ArrayType(StringType()))
def _letter_words(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else letter_words(t) for t in text.to_pylist()], pa.list_(pa.string()))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_id, tokens``: lower-cased words of letters of each document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), _letter_words(F.lower("text")).alias("tokens"))
