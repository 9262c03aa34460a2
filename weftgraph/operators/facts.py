"""Triples of the star schema: the driver tables' stand-in for extracted facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

SQL = (
    "facts AS (SELECT l_orderkey AS chunk, 'supplier ' || l_suppkey AS s, 'supplies' AS p, 'part ' || l_partkey AS o FROM lineitem "
    "UNION ALL SELECT o_orderkey, 'customer ' || o_custkey, 'placed', 'order ' || o_orderkey FROM orders)"
)


def facts(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = read_table(spark, d, "lineitem"), read_table(spark, d, "orders")
    a = lines.select(F.col("l_orderkey").alias("chunk"), F.concat(F.lit("supplier "), "l_suppkey").alias("s"), F.lit("supplies").alias("p"), F.concat(F.lit("part "), "l_partkey").alias("o"))
    b = orders.select("o_orderkey", F.concat(F.lit("customer "), "o_custkey"), F.lit("placed"), F.concat(F.lit("order "), "o_orderkey"))
    return a.union(b)
