"""Distances between arrays of numbers as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The distance of empty vectors or vectors of different lengths.
FAR = 3.4028234663852886e38


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    total = F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), total).otherwise(F.lit(FAR))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column, no_length: float = FAR) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), 1 - dot(a, b) / n).otherwise(F.lit(no_length))


def inner_product(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), -dot(a, b)).otherwise(F.lit(FAR))


METRICS = {"cosine": cosine_distance, "ip": inner_product, "inner_product": inner_product, "l2": squared_l2}


def metric(name: str):
    """The distance of that name; squared L2 for unknown ones."""
    return METRICS.get(name, squared_l2)
