"""Ordered lists and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_ids(old: Column, new: Column) -> Column:
    """Ordered union without blanks."""
    return F.array_distinct(F.filter(F.concat(old, new), lambda x: x.isNotNull() & (x != "")))


def cap_ids(ids: Column, limit: int, method: str = "FIFO") -> Column:
    """FIFO keeps the last ``limit``, KEEP the first."""
    if limit <= 0:
        return F.slice(ids, 1, 0)
    if method == "FIFO":
        return F.slice(ids, F.greatest(F.size(ids) - F.lit(limit - 1), F.lit(1)), limit)
    return F.slice(ids, 1, limit)


def subtract_ids(ids: Column, gone: Column) -> Column:
    """Ordered difference; repeats stay."""
    return F.filter(ids, lambda x: ~F.array_contains(gone, x))


def incremental_ids(full: Column, old: Column, new: Column) -> Column:
    """``full`` without what left between ``old`` and ``new``, then what came."""
    kept = subtract_ids(full, subtract_ids(old, new))
    come = F.array_distinct(subtract_ids(new, old))
    return F.concat(kept, subtract_ids(come, kept))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column, floor: float = 1e-12) -> Column:
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(floor)))


def token_overlap_f1(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Bag-of-words F1 of two word arrays."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))
    p, r = shared / F.size(a), shared / F.size(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), both_empty).when(shared == 0, 0.0).otherwise(2 * p * r / (p + r))
