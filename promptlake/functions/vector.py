"""Cosine similarity as an expression. Bulk search is in operators/similarity.py."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from promptlake.functions.text import _col


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_sim(a, b) -> Column:
    """1 - cosine distance; NULL for a zero vector or vectors of unequal length."""
    a, b = _col(a), _col(b)
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.try_divide(_dot(a, b), norm))
