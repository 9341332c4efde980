"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Scratch, unused

SEED = 20_240_501
#: Means above this are drawn as sums of equal smaller ones, so that exp(-mean) stays far from zero.
LARGEST_MEAN = 16
#: Terms of a distribution function; beyond them a Poisson variable of LARGEST_MEAN has less than 2**-52.
TERMS = 80
#: So many rates, 70 MB, go to every executor; of more sources each rate is copied so often, and documents meet one of the copies.
BROADCAST_SOURCES, SALTS = 100_000, 64


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(2**52)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.7, total: float | None = None) -> DataFrame:
    """``source, n, rate``: rows of each source and the mean repetitions that bring it to its target weight.

    ``weights``: target shares by source, scaled to sum 1 over the sources there are; sources that it lacks get none. Without it the share of a source
    is in proportion to its count to ``power``. ``total``: expected rows of the result, by default as many as there are.
    """
    stats = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        stats = stats.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        stats = stats.join(given, stats["source"].eqNullSafe(given["source"]), "left").select(stats["source"], "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = stats.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))  # one row
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * (F.lit(total) if total is not None else F.col("all_n")) / F.col("n")).otherwise(F.lit(0.0))
    return stats.crossJoin(F.broadcast(sums)).select("source", "n", rate.alias("rate"))


def _distributions(rates: DataFrame) -> DataFrame:
    """The rates with ``draws``, the Poisson variables that are summed, and the distribution function ``cdf`` of each."""
    rates = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    # Distribution function: terms p(k) = p(k-1) * mean / k, summed.
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)), first,
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.array_append(s["cdf"], F.element_at(s["cdf"], -1) + s["p"] * mean / k).alias("cdf")),
        lambda s: s["cdf"],
    )
    return rates.select("source", "rate", "draws", grown.alias("cdf"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.7, total: float | None = None, seed: int = SEED) -> DataFrame:
    """Every document as often as a Poisson variable of its source's rate says, in a global random order.

    Returns the input's columns and ``copy_no int`` from 1, ``rate double``, ``mix_key string``: rows stand in the order of
    ``mix_key`` within their partition, and partitions are dealt by it and the row's number, so that rows of one doc_id
    spread too. The variable is the inverse of the distribution function at a hash of seed and doc_id, so reruns agree, and
    repeated rows of a doc_id repeat alike. A null source is a source, a null doc_id is hashed as the word null; texts are
    not looked at. Input columns of the three new names are replaced, others may have any name.

    Up to BROADCAST_SOURCES rates go to where the documents are, so these are shuffled once, when they are mixed. Of more
    sources, each rate is copied to SALTS keys and documents meet it at one of them.
    """
    docs = docs.drop("copy_no", "rate", "mix_key")
    names = {c: unused(docs, f"_{c}") for c in ("source", "rate", "draws", "cdf", "count", "salt", "row")}
    col = lambda c: F.col(names[c])
    rates = Scratch(docs.sparkSession, "mixing").keep(_distributions(source_rates(docs, weights, power, total)), "rates")
    few = rates.count() <= BROADCAST_SOURCES
    rates = rates.select(*[F.col(c).alias(names[c]) for c in ("source", "rate", "draws", "cdf")])
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    same = docs["source"].eqNullSafe(rates[names["source"]])
    if few:
        tagged = docs.join(F.broadcast(rates), same)
    else:
        salted = docs.withColumn(names["salt"], F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
        copied = rates.withColumn(names["salt"] + "_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        tagged = salted.join(copied, salted["source"].eqNullSafe(copied[names["source"]]) & (col("salt") == F.col(names["salt"] + "_"))).drop(names["salt"], names["salt"] + "_")
    drawn = F.transform(F.sequence(F.lit(1), col("draws")), lambda i: _uniform(F.lit(str(seed)), key, i.cast("string")))
    count = F.aggregate(drawn, F.lit(0), lambda s, u: s + F.size(F.filter(col("cdf"), lambda c: c <= u)))
    tagged = tagged.withColumn(names["count"], count).where(col("count") > 0).drop(names["cdf"], names["draws"], names["source"])
    copies = tagged.withColumn("copy_no", F.explode(F.sequence(F.lit(1), col("count")))).drop(names["count"]).withColumnRenamed(names["rate"], "rate")
    copies = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), key, F.col("copy_no").cast("string"))))
    mixed = copies.withColumn(names["row"], F.monotonically_increasing_id()).repartition("mix_key", names["row"]).sortWithinPartitions("mix_key")
    return mixed.select(*docs.columns, "copy_no", "rate", "mix_key")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, texts and all, with source shares flattened by a power of 0.7."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("rate", F.round("rate", 9))


ORACLE_SQL = f"""
WITH s AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.7) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM s) * (SELECT sum(n) FROM s) / n AS rate FROM s),
m AS (SELECT *, greatest(1, CAST(ceil(rate / {LARGEST_MEAN}) AS INTEGER)) AS draws FROM r),
p AS (SELECT m.*, list_transform(range(0, {TERMS + 1}), lambda k: exp(-rate / draws + CASE WHEN k > 0 THEN k * ln(rate / draws) ELSE 0 END - lgamma(CAST(k + 1 AS DOUBLE)))) AS pmf FROM m),
c AS (SELECT source, rate, draws, list_transform(range(1, {TERMS + 2}), lambda k: list_sum(pmf[1:k])) AS cdf FROM p),
u AS (SELECT d.doc_id, d.source, c.rate, c.cdf, CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|' || CAST(i.i AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM documents d JOIN c ON c.source IS NOT DISTINCT FROM d.source, unnest(range(1, c.draws + 1)) AS i(i)),
k AS (SELECT doc_id, source, any_value(rate) AS rate, sum(len(list_filter(cdf, lambda x: x <= u))) AS cnt FROM u GROUP BY doc_id, source)
SELECT doc_id, d.text, d.lang, source, d.n_chars, CAST(t.c AS INTEGER) AS copy_no, round(rate, 9) AS rate, md5('{SEED}-order|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(t.c AS VARCHAR)) AS mix_key
FROM k JOIN documents d USING (doc_id, source), unnest(range(1, CAST(cnt AS BIGINT) + 1)) AS t(c)
"""
