"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash. Summing sizes by source and hash bucket shows in which bucket a
source's budget ends; only that bucket is summed again by finer bits, and only its last cell by
whole hashes. The thresholds so found nest: a document below the threshold of one more pass is
in every smaller mix of the same seed. Rows are then filtered by comparison with their source's
threshold; they are never sorted.

Defined cases: a null source is a source of its own and comes last; a null or empty text has
size 0 and is taken 0 words; rows with equal doc_id, source and text share a hash and are taken
together or not at all; an empty table gives an empty result; further columns, whatever their names,
do not matter to the result of :func:`mix_plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, small, staged, table, text_or_empty

#: Bits of the hash, and of it those of the first and of the second histogram.
HASH_BITS, FIRST_BITS, SECOND_BITS = 60, 12, 12
#: Weights dealt to the sources in code-point order, again and again.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document is repeated more often than this.
MOST_PASSES = 3
#: Sources up to which their thresholds (a few dozen bytes each) are broadcast.
BROADCAST_SOURCES = 100_000


def size_in_words(text: Column) -> Column:
    """Number of words; ``split`` gives one empty string at either end that has white space."""
    parts = F.split(text, BLANK)
    n = F.size(parts)
    blank_first = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    blank_last = F.when((n > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (n - blank_first - blank_last).cast("long")


def row_hash(seed: int = 0) -> Column:
    """60 bits of the md5 of seed, doc_id and text, evenly spread and the same in every run."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text_or_empty()))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST_PASSES) -> DataFrame:
    """Target words by source, from (source, source_size).

    The budget is ``share`` of all sizes, dealt by weight; a source's target stops at ``most``
    times its size and the excess goes to the others by weight. The sources that stop are those
    with the smallest size by weight, so one running sum over the sources finds them all.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    everything = Window.partitionBy()
    by_room = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    dealt = dealt.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(everything))
    dealt = dealt.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_room), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(by_room), F.lit(0.0)))
    # the level if all sources before this one stop at their caps and no later one does
    dealt = dealt.withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    dealt = dealt.withColumn("stops", F.col("ratio") <= F.col("level"))
    # levels rise while sources stop and fall after the first that does not: its level holds
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    target = F.when(F.col("stops") | level.isNull(), F.col("cap")).otherwise(level * F.col("weight"))
    return dealt.select("source", "source_size", target.alias("target"))


def _joined(rows: DataFrame, few: DataFrame, *extra: str) -> DataFrame:
    """``rows`` with what ``few`` has for their source (and ``extra`` columns); nulls are equal."""
    few = small(few.withColumnsRenamed({"source": "source_", **{c: f"{c}_" for c in extra}}), BROADCAST_SOURCES)
    on = F.col("source").eqNullSafe(F.col("source_"))
    for c in extra:
        on = on & (F.col(c) == F.col(f"{c}_"))
    return rows.join(few, on).drop("source_", *[f"{c}_" for c in extra])


def _boundary(cells: DataFrame) -> DataFrame:
    """The cell in which each source's budget ends, and what is left of it when the cell begins."""
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    # sums before the cell rise with it, so the last one within the budget is the boundary
    run = cells.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    hit = run.where(F.col("before") <= F.col("left")).groupBy("source").agg(F.max_by(F.struct("cell", (F.col("left") - F.col("before")).alias("left")), "cell").alias("x"))
    return hit.select("source", "x.cell", "x.left")


def thresholds(base: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST_PASSES) -> DataFrame:
    """By source: source_size, target, whole passes, and the hash up to which rows get one more.

    ``base`` has source, size and hash and should be staged, as it is read three times.
    """
    low = HASH_BITS - FIRST_BITS
    lower = low - SECOND_BITS
    first = staged(base.groupBy("source", F.shiftright("hash", low).alias("cell")).agg(F.sum("size").alias("words")), "mix-cells")
    aims = targets(first.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = staged(aims.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "mix-aims")
    at_first = staged(_boundary(_joined(first, aims.select("source", "left"))), "mix-first")
    inside = _joined(base.withColumn("cell", F.shiftright("hash", low)), at_first, "cell").drop("cell")
    second = inside.groupBy("source", "left", F.shiftright("hash", lower).alias("cell")).agg(F.sum("size").alias("words"))
    at_second = staged(_boundary(second), "mix-second")
    last = _joined(base.withColumn("cell", F.shiftright("hash", lower)), at_second, "cell").groupBy("source", "left", F.col("hash").alias("cell")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    # a hash is below the threshold if at least half of its words fit
    last = last.withColumn("fits", 2 * F.sum("words").over(upto) - F.col("words") <= 2 * F.col("left"))
    cut = last.groupBy("source").agg(F.max(F.when(F.col("fits"), F.col("cell"))).alias("fit"), F.min("cell").alias("least"))
    # a threshold of one less than the least keeps nothing of the last cell
    cut = cut.select(F.col("source").alias("s"), F.coalesce("fit", F.col("least") - 1).alias("threshold"))
    return staged(aims.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "left"), "mix-thresholds")


def _with_passes(rows: DataFrame, known: DataFrame, most: int) -> DataFrame:
    passes = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("hash") <= F.col("threshold"), 1).otherwise(0)).otherwise(F.lit(0))
    return _joined(rows, known).withColumn("passes", F.least(passes, F.lit(most)).cast("int"))


def _base(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", size_in_words(text_or_empty()).alias("size"), row_hash(seed).alias("hash"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST_PASSES, seed: int = 0) -> DataFrame:
    """For every row of ``docs``: doc_id, source, hash, size, source_size, target, passes, taken.

    A source of size S and target T is taken floor(T / S) whole times, and once more the rows up to
    the hash at which their sizes come nearest to what is left of T. So a source's taken words miss
    T by at most half of one document (half of one set of equal rows).
    """
    base = staged(_base(docs, seed), "mix")
    rows = _with_passes(base, thresholds(base, weights, share, most), most)
    return rows.select("doc_id", "source", "hash", "size", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST_PASSES, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the columns of ``docs``.

    Texts are read twice and never shuffled: only their sizes are summed.
    """
    known = thresholds(staged(_base(docs, seed), "mix"), weights, share, most)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    rows = docs.select("source", size_in_words(text_or_empty()).alias("size"), row_hash(seed).alias("hash"), whole)
    kept = _with_passes(rows, known, most).where("passes > 0")
    return kept.select(F.explode(F.array_repeat("row_", F.col("passes"))).alias("row_")).select("row_.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
dealt AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap FROM sized),
levels AS (
  SELECT 0 AS i, (SELECT sum(source_size)::DOUBLE FROM sized) / (SELECT sum(weight) FROM dealt) AS level
  UNION ALL
  SELECT i + 1, ((SELECT sum(source_size)::DOUBLE FROM sized) - (SELECT coalesce(sum(cap), 0) FROM dealt WHERE cap / weight <= level)) / (SELECT sum(weight) FROM dealt WHERE cap / weight > level)
  FROM levels WHERE i < 60),
aims AS (SELECT source, source_size, CASE WHEN cap / weight <= level THEN cap ELSE level * weight END AS target FROM dealt, (SELECT max(level) AS level FROM levels)),
split AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM aims),
summed AS (SELECT source, hash, sum(size) AS words FROM base GROUP BY source, hash),
runs AS (SELECT *, 2 * sum(words) OVER (PARTITION BY source ORDER BY hash) - words AS twice FROM summed)
SELECT b.doc_id, b.size, s.source_size, s.target,
       (b.size * (s.whole + CASE WHEN r.twice <= 2 * (s.target - s.whole * s.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM base b JOIN split s ON b.source IS NOT DISTINCT FROM s.source
JOIN runs r ON b.source IS NOT DISTINCT FROM r.source AND b.hash = r.hash
"""
