"""Vector expressions on arrays of numbers, in double precision.

A null element or different lengths make a dot product null. Nothing divides by norms: similarity is the dot
product of vectors that l2_normalize has made unit length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors whose norm is at most this stay as they are.
TINY = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if the lengths differ."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """The norm is bound once, beside the vector, and not found again for each element."""
    bound = F.array(F.struct(doubles(v).alias("v"), norm(v).alias("n")))
    return F.transform(bound, lambda b: F.when(b["n"] > TINY, F.transform(b["v"], lambda x: x / b["n"])).otherwise(b["v"]))[0]


def max_abs_difference(a: Column, b: Column) -> Column:
    """Largest difference of two elements at the same place; null if the lengths differ."""
    pairs = F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))
    return F.when(F.size(a) == F.size(b), F.array_max(pairs))


def class_token(v: Column, hidden: int) -> Column:
    """The first hidden numbers of all tokens' output: the class token."""
    return F.slice(v, 1, hidden)


def at_least(similarity: Column, threshold: float) -> Column:
    """The inclusive threshold. NaN never passes, though Spark orders it above all numbers."""
    return ~F.isnan(similarity) & (similarity.cast("double") >= F.lit(float(threshold)))


def find_similar(query: Column, candidates: Column, threshold: float) -> Column:
    """Array of (index, similarity) of an array of vectors: from 0, inclusive threshold, best first."""
    scored = F.transform(candidates, lambda c, i: F.struct((-dot(query, c)).alias("order"), i.alias("index"), dot(query, c).alias("similarity")))
    kept = F.array_sort(F.filter(scored, lambda s: F.coalesce(at_least(s["similarity"], threshold), F.lit(False))))
    return F.transform(kept, lambda s: F.struct(s["index"].alias("index"), s["similarity"].alias("similarity")))


def percentage(similarity: Column) -> Column:
    """-1..1 as 0..100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (similarity + 1) / 2 * 100))


def display_percent(similarity: Column) -> Column:
    """Whole percent, halves upwards."""
    return F.concat(F.floor(similarity * 100 + 0.5).cast("string"), F.lit("%"))


def badge(similarity: Column) -> Column:
    return F.when(similarity * 100 >= 90, "high").when(similarity * 100 >= 80, "medium").otherwise("low")


def slider_threshold(percent: Column) -> Column:
    return percent / 100
