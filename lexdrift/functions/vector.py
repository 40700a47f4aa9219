"""Vector and distribution expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length 1; null for a zero vector."""
    # the length is bound as the one element of an array, else it is worked out again for every number
    return F.get(F.transform(F.array(F.nullif(norm(a), F.lit(0.0))), lambda n: F.when(n.isNotNull(), F.transform(a, lambda x: x.cast("double") / n))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Null if one of the vectors is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences."""
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def bhattacharyya(a: Column, b: Column) -> Column:
    """-log10 of the coefficient of two vectors, each normalised by its sum; null where a sum is 0."""
    c = total(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))))
    return -F.log10(F.try_divide(c, F.sqrt(total(a) * total(b))))


def bhattacharyya_observed(p: Column, o: Column) -> Column:
    """-ln of the coefficient of a distribution and counts; null where nothing was counted."""
    return -F.log(F.try_divide(total(F.zip_with(p, o, lambda x, y: F.sqrt(x.cast("double") * y.cast("double")))), F.sqrt(total(o))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two lists without repetitions; null if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.try_divide(common.cast("double"), (F.size(a) + F.size(b) - common).cast("double"))


def native_weight(x: Column, clamp: bool = True) -> Column:
    """exp(x); clamped: above 6 it is 1, below -6 it is 0."""
    return F.when(x > 6, 1.0).when(x < -6, 0.0).otherwise(F.exp(x)) if clamp else F.exp(x)
