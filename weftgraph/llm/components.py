"""Connected components by alternating large-star and small-star steps over distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged

#: The number of steps grows with the logarithm of the edges; this is far beyond it.
MOST_STEPS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) but the roots; root is the least node of a component.

    A minimum is taken by key before it is joined back, so a node with very many neighbours is
    summed map-side and its join can be split.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, last = staged(stars, "stars"), None
    for _ in range(MOST_STEPS):
        both = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(stars.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy(F.col("x").alias("k")).agg(F.min("y").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.join(least, F.col("x") == F.col("k")).where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(lowest, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        previous, stars = stars, staged(small.unionByName(lowest.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "stars")
        drop_staged(previous)
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
    raise RuntimeError("components did not settle")
