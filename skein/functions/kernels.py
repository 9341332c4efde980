"""Column expressions of edge weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """L2-normalised; a zero vector stays zero. The norm is bound once, not computed anew for each component."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(F.array(norm), lambda n: F.transform(a, lambda x: x / n))[0]).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def time_decay(a: Column, b: Column, span: Column, alpha: float) -> Column:
    """exp(-alpha |a - b| / span); NaN where the span is 0."""
    return F.when(span == 0, F.lit(NAN)).otherwise(F.exp(-F.lit(alpha) * F.abs(a - b) / span))


def shared_factor(shared: Column, gamma: float, most: int) -> Column:
    """Of documents with shared entities: in [0.5, 1)."""
    return F.lit(0.5) * (F.lit(1.0) + (F.lit(1.0) - F.exp(F.lit(-gamma) * shared / F.lit(float(most)))))


def path_factor(edges: Column, gamma: float, most: int) -> Column:
    """Of documents without: from the number of edges between them; none within reach counts as 2 * most."""
    return F.lit(0.5) * F.exp(F.lit(-gamma) * (F.coalesce(edges, F.lit(2 * most)) / F.lit(2.0)) / F.lit(float(most)))


def final_weight(distance: Column, factor: Column) -> Column:
    return F.lit(1.0) - (F.lit(1.0) - distance) * factor


def is_nan_safe_between(x: Column, low: float, high: float) -> Column:
    """Inclusive range; NaN and null are outside."""
    return F.coalesce(~F.isnan(x) & x.between(low, high), F.lit(False))
