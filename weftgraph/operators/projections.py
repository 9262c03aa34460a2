"""Projections of question samples, metrics and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Metric names that only count.
COUNT_KEYS = ("num_samples", "num_questions", "count")


def three_parts(triple: Column) -> Column:
    """The first three of three or more trimmed parts, null if one is empty (survey 2.3)."""
    first = F.transform(F.slice(triple, 1, 3), T.strip)
    return F.when((F.size(triple) >= 3) & ~F.exists(first, lambda x: x.isNull() | (x == "")), first)


def gold_documents(titles: Column, context: Column, joiner: str) -> Column:
    """``title\\ntext`` of the context (array of title, sentences) whose titles are supporting, each once (survey 2.16)."""
    return F.array_distinct(F.transform(F.filter(context, lambda c: F.array_contains(titles, c["title"])), lambda c: F.concat(c["title"], F.lit("\n"), F.array_join(c["sentences"], joiner))))


def support_titles(indexes: Column, paragraphs: Column) -> Column:
    """Trimmed titles of the paragraphs at the indexes that exist, in order, without blank ones (survey 2.17)."""
    inside = F.filter(indexes, lambda i: (i >= 0) & (i < F.size(paragraphs)))
    return F.filter(F.transform(inside, lambda i: T.strip(F.get(paragraphs, i.cast("int"))["title"])), lambda t: t != "")


def gold_titles(facts: Column, paragraphs: Column, contexts: Column) -> Column:
    """Sorted distinct titles of the first kind there is: facts, paragraphs not marked false, contexts marked true (survey 2.20)."""
    said = F.transform(F.filter(paragraphs, lambda p: F.coalesce(p["is_supporting"], F.lit(True))), lambda p: p["title"])
    marked = F.transform(F.filter(contexts, lambda c: F.coalesce(c["is_supporting"], F.lit(False))), lambda c: c["title"])
    some = F.when(F.size(facts) > 0, facts).when(F.size(paragraphs) > 0, said).otherwise(marked)
    return F.array_sort(F.array_distinct(F.filter(F.transform(some, T.strip), lambda t: t != "")))


def numeric_metrics(metrics: Column) -> Column:
    """A JSON object's numbers by name, without private names, counts and truth values (survey 2.18)."""
    raw = F.from_json(metrics, "map<string,string>")
    number = lambda v: v.rlike(r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?$")
    kept = F.map_filter(raw, lambda k, v: ~k.startswith("_") & ~k.isin(*COUNT_KEYS) & v.isNotNull() & number(v))
    return F.transform_values(kept, lambda k, v: v.cast("double"))


def named_entities(answer: Column) -> Column:
    """The list ``named_entities`` of the JSON object in a model's answer; empty without one (survey 8.14)."""
    found = F.regexp_extract(answer, r'(?s)\{[^{}]*"named_entities"\s*:\s*\[[^\]]*\][^{}]*\}', 0)
    return F.coalesce(F.from_json(found, "named_entities array<string>")["named_entities"], F.array().cast("array<string>"))


def openie_merge(known: DataFrame, chunks: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """``known`` (chunk_id, passage, entities, triples) and a row for each new chunk with what two extractions found in it (survey 1.8)."""
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    new = chunks.join(known.select("chunk_id"), "chunk_id", "left_anti").join(entities, "chunk_id", "left").join(triples, "chunk_id", "left")
    return known.unionByName(new.select("chunk_id", "passage", none("entities", "array<string>"), none("triples", "array<array<string>>")))


def by_track_id(status: DataFrame, track_id: str) -> DataFrame:
    """Status rows of one enqueue call (survey 13.5)."""
    return status.where(F.col("track_id") == track_id)


def list_loss(scores: DataFrame) -> DataFrame:
    """(q, loss): cross entropy of the scores (q, score, gold) against an even share on the gold ones (survey 8.34)."""
    top = scores.groupBy("q").agg(F.max("score").alias("top"))
    rows = scores.join(top, "q").withColumn("e", F.exp(F.col("score") - F.col("top")))
    sums = rows.groupBy("q").agg(F.log(F.sum("e")).alias("z"), F.sum(F.when(F.col("gold"), F.col("score") - F.col("top"))).alias("s"), F.count_if("gold").alias("n"))
    return sums.where("n > 0").select("q", (F.col("z") - F.col("s") / F.col("n")).alias("loss"))
