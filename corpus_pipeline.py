"""A training-data pipeline over ``documents``: STAGES, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch
from skein.llm.minhash import near_duplicates
from skein.llm.mixing import mix_sources
from skein.llm.packing import pack
from skein.llm.pii import redact_pii
from skein.llm.quality import fit_quality, keep_quality, learnable

#: Up to so many ids, some 20 MB, go to where the texts are; beyond it both sides are shuffled.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. The score reads the text alone, so equal texts share their fate; null
    and empty texts have the score of the bias. Without labels nothing is rejected but by the bias, which is none."""
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learnable()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles at similarity 0.8 link: that of the smallest doc_id.

    Of repeated rows of a doc_id the one with the least text stays, nulls first. Rows with a null doc_id, and documents
    without words, link with nothing and stay. An empty table stays empty.
    """
    scratch = Scratch(spark, "kept")
    found = scratch.keep(near_duplicates(docs), "found")
    gone = scratch.keep(found.where("not kept").select("doc_id").distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = scratch.keep(again, "again")
    stay = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    row = F.struct(*docs.columns)
    least = stay.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("r"))
    return stay.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(least.select("r.*"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in every text, ``n_chars`` counted anew. Rows, also repeated and null ones, stay as many."""
    return redact_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights by repeating or dropping documents, in random order. A null source is one,
    texts are not looked at, and of an empty table nothing comes."""
    return mix_sources(docs).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, a row for each piece of each row; a null or empty text is its end mark alone."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]
#: A classifier and MinHash have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES on ``documents``, each written and read again. The tables between stay until ``clear_scratch``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
