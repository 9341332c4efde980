"""Clustering and classification measures as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))


def agreement(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """One row: ``homogeneity, nmi`` (arithmetic mean)."""
    cells = contingency(rows, true, predicted)
    total = cells.agg(F.sum("n").cast("double").alias("all"))
    part = lambda by, name: cells.groupBy(by).agg(F.sum("n").cast("double").alias(name))
    entropy = lambda by, name: part(by, "m").crossJoin(F.broadcast(total)).agg((-F.sum(F.col("m") / F.col("all") * F.log(F.col("m") / F.col("all")))).alias(name))
    joint = cells.join(part("t", "nt"), "t").join(part("p", "np"), "p").crossJoin(F.broadcast(total))
    mi = joint.agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nt") * F.col("np")))).alias("mi"))
    one = mi.crossJoin(entropy("t", "ht")).crossJoin(entropy("p", "hp"))  # one row each
    tiny = 1e-12
    homogeneity = F.when(F.col("ht") < tiny, 1.0).otherwise(F.col("mi") / F.col("ht"))
    nmi = F.when((F.col("ht") < tiny) & (F.col("hp") < tiny), 1.0).when(F.col("mi") < tiny, 0.0).otherwise(2 * F.col("mi") / (F.col("ht") + F.col("hp")))
    return one.select(homogeneity.alias("homogeneity"), nmi.alias("nmi"))


def classifier_measures(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """One row: balanced accuracy, precision, recall and F1 of 0/1 labels."""
    n = lambda t, p: F.count_if((F.col(true) == t) & (F.col(predicted) == p)).cast("double")
    c = rows.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    return c.selectExpr("(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 as bac", "tp / nullif(tp + fp, 0) as precision", "tp / nullif(tp + fn, 0) as recall", "2 * tp / nullif(2 * tp + fp + fn, 0) as f1")


#: Fixed value: the 95 % quantile of chi-squared with one degree of freedom.
CHI2_95 = 3.841458820694124
#: Coefficients of a rational approximation of erfc (Abramowitz and Stegun 7.1.26), within 1.5e-7.
ERFC = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def label_transitions(rows: DataFrame, true: str, a: str, b: str) -> DataFrame:
    """``before, after, n``: how rows move among TP, TN, FP and FN from the labels ``a`` to the labels ``b``."""
    state = lambda c: F.when(F.col(true) == 1, F.when(F.col(c) == 1, "TP").otherwise("FN")).otherwise(F.when(F.col(c) == 1, "FP").otherwise("TN"))
    return rows.groupBy(state(a).alias("before"), state(b).alias("after")).agg(F.count("*").alias("n"))


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the discordant counts of two 0/1 columns, the continuity-corrected statistic, its p-value and whether that is
    at most .05."""
    c = rows.agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("only_a"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("only_b"))
    c = c.selectExpr("only_a", "only_b", "pow(greatest(abs(only_a - only_b) - 1, 0), 2) / nullif(cast(only_a + only_b as double), 0) as statistic")
    t = 1 / (1 + F.lit(ERFC[0]) * F.sqrt(F.col("statistic") / 2))
    series = F.lit(0.0)
    for k in reversed(ERFC[1:]):
        series = (series + F.lit(k)) * t
    c = c.withColumn("p_value", series * F.exp(-F.col("statistic") / 2))
    return c.withColumn("significant", F.col("statistic") >= CHI2_95)
