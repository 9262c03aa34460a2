"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so the sketch of two texts together
is the union of their sketches, and how much of one text lies in another can be estimated however
unequal they are. A text with very few hashes below the threshold, which would be judged by them at random, keeps its
``FLOOR`` smallest hashes instead, up to its own higher limit; two sketches are compared below the lower of their limits.
So texts of up to ``FLOOR`` shingles are compared exactly, and the threshold alone decides for those of ``SCALE * FLOOR`` or more on average.

Words are runs of characters that are not white space, A-Z lower-cased; a shingle is five words in a row (of a shorter
text, all its words). Hashes are taken as a set.

Defined cases: a null text is an empty one; a text without words has the empty sketch, is like
another such text (1) and unlike all others (0); equal rows are ordered by text and are rows of
their own; a null doc_id comes last; an empty table gives an empty result; very long texts are sketched whole; further
columns do not matter, whatever their names. Ids are integers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table, text_or_empty, words_of

WORDS = 5
#: One shingle hash in so many is kept.
SCALE = 4
#: Hashes that a sketch has at least, if its text has as many.
FLOOR = 32
#: Hashes are not negative and below this.
TOP = (1 << 63) - 1
#: Groups of neighbours in id order, for each shuffle partition.
GROUPS_A_PARTITION = 4


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The distinct shingle hashes, from 0 to ``TOP``; words are hashed once, shingles from their words' hashes."""
    hashed = F.transform(words_of(ascii_lower(text)), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        long = F.transform(F.sequence(F.lit(1), F.size(h) - (words - 1)), lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(words)]))
        short = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, w: F.xxhash64(a, w)))
        return F.when(F.size(h) >= words, long).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    # a one-element transform names the words' hashes, so that they are made once
    each = F.element_at(F.transform(F.array(hashed), shingles), 1)
    return F.array_distinct(F.transform(each, lambda x: F.shiftrightunsigned(x, 1)))


def sketch(text: Column, words: int = WORDS, scale: int = SCALE, floor: int = FLOOR) -> Column:
    """struct(limit, hashes): all the text's hashes up to the limit, in order; its form is mergeable.

    limit is TOP if all hashes are kept, the largest kept hash if only ``floor`` are, else the fixed threshold.
    """
    fixed = TOP // scale

    def cut(h: Column) -> Column:
        low = F.filter(h, lambda x: x <= fixed)
        few = F.slice(F.array_sort(h), 1, floor)
        return (
            F.when(F.size(h) <= floor, F.struct(F.lit(TOP).alias("limit"), F.array_sort(h).alias("hashes")))
            .when(F.size(low) >= floor, F.struct(F.lit(fixed).alias("limit"), F.array_sort(low).alias("hashes")))
            .otherwise(F.struct(F.element_at(few, -1).alias("limit"), few.alias("hashes")))
        )

    return F.element_at(F.transform(F.array(shingle_hashes(text, words)), cut), 1)


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts together, as far as both sketches are complete."""
    limit = F.least(a["limit"], b["limit"])
    return F.struct(limit.alias("limit"), F.filter(F.array_sort(F.array_union(a["hashes"], b["hashes"])), lambda x: x <= limit).alias("hashes"))


def _below(s: Column, limit: Column) -> Column:
    return F.filter(s["hashes"], lambda x: x <= limit)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the shingle sets, estimated below the common limit."""
    limit = F.least(a["limit"], b["limit"])
    left, right = _below(a, limit), _below(b, limit)
    shared = F.size(F.array_intersect(left, right))
    both = F.size(left) + F.size(right) - shared
    return F.when(both > 0, shared / both).otherwise(F.when((F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0), 1.0).otherwise(0.0))


def containment(a: Column, b: Column) -> Column:
    """The part of a's shingles that b has, estimated below the common limit."""
    limit = F.least(a["limit"], b["limit"])
    left = _below(a, limit)
    return F.when(F.size(left) > 0, F.size(F.array_intersect(left, _below(b, limit))) / F.size(left)).otherwise(F.when(F.size(a["hashes"]) == 0, 1.0).otherwise(0.0))


def as_string(s: Column) -> Column:
    """Hex of the limit, a colon, the hashes' hex in order."""
    return F.concat(F.hex(s["limit"]), F.lit(":"), F.array_join(F.transform(s["hashes"], lambda x: F.hex(x)), ","))


def with_next(docs: DataFrame, groups: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, sketch) with next_text and next_sketch: the next row's in descending doc_id, the first's after the last.

    Ids are cut into ranges by quantiles; a range is one window group. The rows at which a range
    begins are given to the range before it as guests, so that no row need be looked up by a join.
    Rows of equal doc_id are ordered by their text.
    """
    spark = docs.sparkSession
    groups = groups or max(1, GROUPS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / groups for i in range(1, groups)] or [0.5], 10 * groups)).first()[0] or []
    cuts = sorted(set(cuts))
    outer = cuts[:: max(1, math.isqrt(len(cuts)))] if cuts else []
    # two short searches find the range of an id: the block, then the cut in it
    blocks = [[c for c in cuts if c >= lo and (hi is None or c < hi)] for lo, hi in zip(outer, [*outer[1:], None])]
    i = F.size(F.filter(F.array(*[F.lit(c) for c in outer]).cast("array<bigint>"), lambda c: c <= F.col("doc_id")))
    before = F.element_at(F.array(F.lit(0), *[F.lit(sum(map(len, blocks[:k]))) for k in range(len(blocks))]), i + 1)
    inside = F.element_at(F.array(F.array().cast("array<bigint>"), *[F.array(*[F.lit(c) for c in b]).cast("array<bigint>") for b in blocks]), i + 1)
    at = before + F.size(F.filter(inside, lambda c: c <= F.col("doc_id")))
    rows = docs.withColumn("range_", F.when(F.col("doc_id").isNull(), -1).otherwise(at).cast("int"))
    heads = {r["range_"]: r["head"] for r in rows.groupBy("range_").agg(F.max("doc_id").alias("head")).collect()}  # one row for each range
    order = sorted(heads, reverse=True)
    host = {r: order[k - 1] for k, r in enumerate(order)}  # the range before, in descending order; the last for the first
    if not order:
        return docs.withColumn("next_text", F.lit(None).cast("string")).withColumn("next_sketch", F.col("sketch"))
    names = F.create_map(*[x for r, h in heads.items() if h is not None for x in (F.lit(r), F.lit(h))]) if any(h is not None for h in heads.values()) else F.lit(None).cast("map<int,bigint>")
    hosts = F.create_map(*[x for r, h in host.items() for x in (F.lit(r), F.lit(h))])
    is_head = F.col("doc_id").eqNullSafe(F.element_at(names, F.col("range_")))
    own = F.struct(F.col("range_").alias("r"), F.lit(False).alias("guest"))
    guest = F.struct(F.element_at(hosts, F.col("range_")).alias("r"), F.lit(True).alias("guest"))
    rows = rows.withColumn("to_", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))))
    rows = rows.select("*", F.col("to_.r").alias("line_"), F.col("to_.guest").alias("guest_")).drop("to_", "range_")
    # one window over plain columns: expressions here would make Spark deal the texts out once for each lead
    line = Window.partitionBy("line_").orderBy("guest_", F.desc_nulls_last("doc_id"), "text")
    rows = rows.select("*", F.lead(F.struct("text", "sketch")).over(line).alias("next_"))
    return rows.where(~F.col("guest_")).select(*docs.columns, F.col("next_.text").alias("next_text"), F.col("next_.sketch").alias("next_sketch"))


def edited_text() -> Column:
    """The text with its last third (floor of code points / 3) replaced by as many first code points of the next text."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each row's sketch, that of its edited text, and likenesses to that and to the next document."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = with_next(rows.withColumn("sketch", sketch(F.col("text"))))
    rows = rows.withColumn("edited", edited_text())
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("sketch")).alias("fingerprint"), as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_text"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
