"""The evaluation record of a set of threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import metrics, threads
from skein.plans.articles import Settings
from skein.session import cut_lineage


def evaluate(ordered: DataFrame, articles: DataFrame, p: Settings) -> DataFrame:
    """One row on the threads within the ranges of ``p``: agreement with the stories of the selected documents and of all
    (those without a thread are one cluster), numbers of documents, threads and stories, mean lengths, span and cosine."""
    ordered = cut_lineage(ordered)
    chosen = cut_lineage(threads.select(threads.summary(ordered), p))
    docs = cut_lineage(ordered.join(chosen.select("thread_id"), "thread_id", "left_semi").select("doc_id", "thread_id", "story_id"))
    pooled = articles.select("doc_id", "story_id").join(docs.select("doc_id", "thread_id"), "doc_id", "left").withColumn("thread_id", F.coalesce("thread_id", F.lit(-1)))
    sel = metrics.agreement(docs, "story_id", "thread_id").toDF("sel_h", "sel_nmi")
    every = metrics.agreement(pooled, "story_id", "thread_id").toDF("all_h", "all_nmi")
    counts = docs.agg(F.count("*").alias("sel_docs"), F.count_distinct("thread_id").alias("sel_pred"), F.count_distinct("story_id").alias("sel_true"))
    whole = articles.agg(F.count("*").alias("all_docs"), F.count_distinct("story_id").alias("all_true"))
    lengths = chosen.agg(F.avg("length").alias("mean_pred"), F.avg("span_days").alias("mean_span"), F.avg("similarity").alias("cos"))
    stories = docs.groupBy("story_id").count().agg(F.avg("count").alias("mean_true"))
    return sel.crossJoin(every).crossJoin(counts).crossJoin(whole).crossJoin(lengths).crossJoin(stories)  # one row each
