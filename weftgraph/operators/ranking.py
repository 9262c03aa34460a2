"""Rankings, budgets and interleavings over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def min_max(value: Column, over, constant: float = 1.0) -> Column:
    """(x - least) / range within a window; ``constant`` where all values are equal."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high == low, F.lit(constant)).otherwise((value - low) / (high - low))


def within_budget(rows: DataFrame, by: list[str], order: list, cost: str, budget: float) -> DataFrame:
    """The longest prefix of each group whose summed cost is within the budget."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(upto)).where((F.col("spent") <= budget) & F.lit(budget > 0))


def round_robin(rows: DataFrame, by: list[str], key: str, pos: str, source_rank: str) -> DataFrame:
    """Sources interleaved by position; the first row of a key stays."""
    first = Window.partitionBy(*by, key).orderBy(pos, source_rank)
    kept = rows.withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(pos, source_rank, key)))


def weighted_polling(rows: DataFrame, by: str, item: str, pos: str, most: int, least: int) -> DataFrame:
    """Linear quotas from ``most`` to ``least`` over the items of a group, then what is left to the earliest items.

    ``item`` counts from 0 within ``by`` and ``pos`` from 1 within an item.
    """
    items = rows.groupBy(by, item).agg(F.count(F.lit(1)).alias("have"))
    own = Window.partitionBy(by)
    items = items.withColumn("n", F.max(item).over(own) + 1)
    quota = F.when(F.col("n") == 1, most).otherwise(F.bround(most - F.col(item) / (F.col("n") - 1) * (most - least))).cast("int")
    items = items.withColumn("quota", quota).withColumn("left", F.sum(F.greatest(F.lit(0), F.col("quota") - F.col("have"))).over(own))
    both = rows.join(items.drop("n", "have"), [by, item])
    over = both.where(F.col(pos) > F.col("quota")).withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(item, pos))).where("n <= left").drop("n")
    return both.where(F.col(pos) <= F.col("quota")).withColumn("round", F.lit(1)).unionByName(over.withColumn("round", F.lit(2))).drop("left", "quota")


def covered(intervals: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Length covered by the union of [start, end), by +1 and -1 events and a running sum."""
    events = intervals.select(*by, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    events = events.groupBy(*by, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    line = Window.partitionBy(*by).orderBy("at")
    events = events.withColumn("open", F.sum("d").over(line)).withColumn("next", F.lead("at").over(line))
    return events.groupBy(*by).agg(F.sum(F.when(F.col("open") > 0, F.col("next") - F.col("at")).otherwise(0)).alias("covered"))


def mean_places(rows: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """(``by``, ``value``, ``out``): the mean place of a value's rows in the order of values within ``by``.

    Values are counted and dealt by ranges; places go on from the counts of the ranges before, so no group is sorted in one task.
    """
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n_")).repartitionByRange(by, value).withColumn("range_", F.spark_partition_id())
    counts = staged(counts, "places")
    # a row a range and group
    totals = counts.groupBy(F.col(by).alias("by_"), F.col("range_").alias("r_")).agg(F.sum("n_").alias("t_"))
    before = F.coalesce(F.sum("t_").over(Window.partitionBy("by_").orderBy("r_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = F.broadcast(totals.select("by_", "r_", before.alias("before_")))
    within = F.coalesce(F.sum("n_").over(Window.partitionBy(by, "range_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("within_", within).join(totals, F.col(by).eqNullSafe(F.col("by_")) & (F.col("range_") == F.col("r_")))
    return placed.select(by, value, (F.col("before_") + F.col("within_") + (F.col("n_") + 1) / 2).alias(out))
