"""Similarities and distances of vectors as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two dense arrays of one length, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Inner product over norms; null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def angular_distance(similarity: Column) -> Column:
    """acos of a similarity capped at 1; a missing neighbour counts as a right angle."""
    return F.acos(F.coalesce(F.least(F.greatest(similarity, F.lit(-1.0)), F.lit(1.0)), F.lit(0.0)))


def sparse_dot(indices_a: Column, values_a: Column, indices_b: Column, values_b: Column) -> Column:
    """Inner product over shared indices of two sparse vectors; the second becomes a map, read once for each entry of the first."""
    other = F.map_from_arrays(indices_b, values_b)
    products = F.zip_with(indices_a, values_a, lambda i, v: v * F.coalesce(F.try_element_at(other, i), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def at_least(similarity: Column, threshold: float) -> Column:
    return similarity >= F.lit(float(threshold))


RIGHT_ANGLE = math.acos(0.0)
