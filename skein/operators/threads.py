"""Ordered threads and their selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.kernels import NAN, cosine, is_nan_safe_between
from skein.plans.articles import Settings


def ordered(members: DataFrame, articles: DataFrame) -> DataFrame:
    """``thread_id, doc_id, ts, seq, step``: documents by time then id, and each one's cosine with the one before."""
    rows = members.join(articles.select(F.col("doc_id").alias("node"), "ts", "emb", "story_id"), "node").withColumnRenamed("node", "doc_id")
    w = Window.partitionBy("thread_id").orderBy("ts", "doc_id")
    rows = rows.withColumn("seq", F.row_number().over(w)).withColumn("before", F.lag("emb").over(w))
    return rows.select("thread_id", "doc_id", "ts", "seq", "story_id", F.when(F.col("before").isNotNull(), cosine(F.col("emb"), F.col("before"))).alias("step"))


def summary(threads: DataFrame) -> DataFrame:
    """``thread_id, length, first_ts, last_ts, span_days, similarity``; the similarity of a single document is NaN."""
    span = (F.floor(F.unix_micros(F.max("ts")) / 1_000_000 - F.unix_micros(F.min("ts")) / 1_000_000) / F.lit(86400.0)).alias("span_days")
    return threads.groupBy("thread_id").agg(F.count("*").alias("length"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), span, F.coalesce(F.avg("step"), F.lit(NAN)).alias("similarity"))


def select(threads: DataFrame, p: Settings) -> DataFrame:
    """Threads of ``summary`` within all three ranges, ends included; NaN similarity fails."""
    return threads.where(F.col("length").between(*p.length) & F.col("span_days").between(*p.days) & is_nan_safe_between(F.col("similarity"), *p.similarity))
