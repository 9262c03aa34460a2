"""Stored entities and relations: merges with what is stored, rebuilds after deletions, creation with checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import drop_staged, shared_dir, staged

#: Descriptions are joined below these, else summarised.
JOIN_ITEMS, JOIN_TOKENS = 8, 1200
MORE_PATHS = "...truncated"


def ordered_union(stored: DataFrame | None, new: DataFrame, keys: list[str], item: str, limit: int, method: str = "FIFO") -> DataFrame:
    """(keys, items, total): a key's stored items (at), then its new ones (seq), each once; FIFO keeps the last ``limit``, KEEP the first.

    Rows are ranked before they are collected, so a key with very many items never holds more than ``limit`` in one place.
    """
    rows = new.select(*keys, item, F.lit(1).alias("part"), F.col("seq").cast("long").alias("at"))
    rows = rows if stored is None else stored.select(*keys, item, F.lit(0).alias("part"), F.col("at").cast("long").alias("at")).unionByName(rows)
    once = rows.groupBy(*keys, item).agg(F.min(F.struct("part", "at")).alias("place"))
    order = [F.desc("place"), F.desc(item)] if method == "FIFO" else [F.asc("place"), F.asc(item)]
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = F.collect_list(F.when(F.col("n") <= limit, F.struct("place", F.col(item).alias("x"))))
    lists = ranked.groupBy(*keys).agg(F.array_sort(kept).alias("list"), F.max("n").cast("long").alias("total"))
    return lists.select(*keys, F.transform("list", lambda s: s["x"]).alias("items"), "total")


def _listed(stored: DataFrame | None, keys: list[str], column: str, item: str) -> DataFrame | None:
    return stored and stored.select(*keys, F.posexplode(T.split_list(F.col(column))).alias("at", item))


def described(stored: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, items): stored descriptions, then the distinct new ones by time, the longer first, and order."""
    first = new.where("description <> ''").groupBy(*keys, "description").agg(F.min(F.struct("ts", "seq")).alias("first"))
    fresh = first.select(*keys, F.struct(F.lit(1).alias("part"), F.col("first.ts").cast("long").alias("a"), (-F.length("description")).cast("long").alias("b"), F.col("first.seq").cast("long").alias("c"), "description").alias("x"))
    if stored is not None:
        old = _listed(stored, keys, "description", "description")
        fresh = old.select(*keys, F.struct(F.lit(0).alias("part"), F.col("at").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), "description").alias("x")).unionByName(fresh)
    lists = fresh.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lists.select(*keys, F.transform("x", lambda s: s["description"]).alias("items"))


def joined_or_summary(items: Column, summary: Callable[[Column], Column] = T.summary) -> Column:
    """The items joined if there is one, or few short ones; else what ``summary`` makes of them."""
    whole = T.join_list(items)
    few = (F.size(items) == 1) | (F.size(items) < JOIN_ITEMS) & (T.token_count(whole) < JOIN_TOKENS)
    return F.when(few, whole).otherwise(summary(whole))


def _paths(lists: DataFrame, keys: list[str], limit: int, method: str) -> DataFrame:
    more = F.when(F.col("total") > limit, F.array(F.lit(MORE_PATHS))).otherwise(F.array().cast("array<string>"))
    return lists.select(*keys, T.join_list(F.concat("items", more)).alias("file_path"))


def _sources(new: DataFrame, stored: DataFrame | None, keys: list[str], limit: int, method: str) -> tuple[DataFrame, DataFrame]:
    """(ordered capped source lists, the new rows that count): KEEP drops rows of chunks that are neither kept nor stored."""
    own = _listed(stored, keys, "source_id", "source")
    ids = ordered_union(own, new, keys, "source", limit, method)
    if method == "KEEP":
        held = ids.select(*keys, F.explode("items").alias("source"))
        held = held if own is None else held.unionByName(own.select(*keys, "source"))
        new = new.join(held, [*keys, "source"], "left_semi")
    return ids.select(*keys, T.join_list(F.col("items")).alias("source_id"), F.size("items").cast("long").alias("n_sources")), new


def _file_paths(new: DataFrame, stored: DataFrame | None, keys: list[str], limit: int, method: str) -> DataFrame:
    own = _listed(stored, keys, "file_path", "file_path")
    own = own and own.where(F.col("file_path") != MORE_PATHS)
    return _paths(ordered_union(own, new, keys, "file_path", limit, method), keys, limit, method)


def merge_into_entities(new: DataFrame, stored: DataFrame | None, sources: int = 300, paths: int = 100, method: str = "FIFO", summary: Callable[[Column], Column] = T.summary) -> DataFrame:
    """The rows of the names in ``new`` after merging it into ``stored`` (survey 4.6).

    new: name, type, description, source, file_path, ts, seq; stored: name, entity_type, description, source_id, file_path, the last three joined lists.
    The type that most rows have wins, of equals the first, the stored one last. Where nothing is ``stored`` and ``new`` lies in buckets by name, nothing is shuffled.
    """
    keys = ["name"]
    stored = stored and stored.join(new.select("name").distinct(), "name", "left_semi")
    ids, new = _sources(new, stored, keys, sources, method)
    kinds = new.select("name", "type", F.lit(0).alias("part"), F.col("seq").cast("long").alias("seq"))
    if stored is not None:
        kinds = kinds.unionByName(stored.select("name", F.col("entity_type").alias("type"), F.lit(1).alias("part"), F.lit(0).cast("long").alias("seq")))
    kinds = kinds.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("part", "seq")).alias("first"))
    kind = kinds.groupBy("name").agg(F.min_by("type", F.struct(-F.col("n"), "first")).alias("entity_type"))
    said = described(stored, new, keys).select("name", joined_or_summary(F.col("items"), summary).alias("description"))
    out = kind.join(said, "name", "left").join(ids, "name").join(_file_paths(new, stored, keys, paths, method), "name", "left")
    said = F.when(F.coalesce("description", F.lit("")) == "", F.concat(F.lit("Entity "), "name")).otherwise(F.col("description"))
    return out.select("name", "entity_type", said.alias("description"), "source_id", "n_sources", F.coalesce("file_path", F.lit("")).alias("file_path"))


def merge_into_relations(new: DataFrame, stored: DataFrame, sources: int = 300, paths: int = 100, method: str = "FIFO", summary: Callable[[Column], Column] = T.summary) -> DataFrame:
    """The rows of the pairs in ``new`` after merging it into ``stored`` (survey 4.7): weights add up, keywords are a sorted set.

    new: src, tgt, weight, keywords, description, source, file_path, ts, seq, in any direction; stored has sorted pairs and joined lists.
    """
    keys = ["src", "tgt"]
    new = new.where("src <> tgt").withColumns({"src": F.least("src", "tgt"), "tgt": F.greatest("src", "tgt")})
    stored = stored.join(new.select(*keys).distinct(), keys, "left_semi")
    ids, new = _sources(new, stored, keys, sources, method)
    both = new.select(*keys, "weight", "keywords").unionByName(stored.select(*keys, "weight", "keywords"))
    words = both.select(*keys, F.explode(F.split("keywords", ",")).alias("w")).select(*keys, T.strip(F.col("w")).alias("w")).where("w <> ''").distinct()
    words = words.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias("keywords"))
    said = described(stored, new, keys).select(*keys, joined_or_summary(F.col("items"), summary).alias("description"))
    out = both.groupBy(*keys).agg(F.sum("weight").alias("weight"))
    for part in (words, said, ids, _file_paths(new, stored, keys, paths, method)):
        out = out.join(part, keys, "left")
    return out.select(*keys, "weight", "keywords", "description", "source_id", "n_sources", "file_path")


def two_phase_merge(entities: DataFrame, relations: DataFrame, stored_entities: DataFrame, stored_relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) after a batch: entities first, then relations, whose unknown ends become entities (survey 4.8)."""
    links = merge_into_relations(relations, stored_relations)
    nodes = merge_into_entities(entities, stored_entities)
    known = nodes.select("name").unionByName(stored_entities.select("name")).distinct()
    ends = links.select(F.explode(F.array("src", "tgt")).alias("name"), "description", "source_id", "n_sources", "file_path")
    first = ends.join(known, "name", "left_anti").groupBy("name").agg(F.min_by(F.struct("description", "source_id", "n_sources", "file_path"), F.struct("source_id", "description")).alias("r"))
    return nodes.unionByName(first.select("name", F.lit("UNKNOWN").alias("entity_type"), "r.*").select(*nodes.columns)), links


def deletion(sources: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action) of ``sources`` (keys, source): delete without a source left, rebuild if some go, else untouched (survey A15)."""
    marked = sources.join(gone.select("source").distinct().withColumn("gone", F.lit(1)), "source", "left")
    counts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("gone").alias("g"))
    return counts.select(*keys, F.when(F.col("g") == F.col("n"), "delete").when(F.col("g") > 0, "rebuild").otherwise("untouched").alias("action"))


def delete_documents(stored: DataFrame, cached: DataFrame, gone: DataFrame, sources: int = 300, paths: int = 100) -> DataFrame:
    """``stored`` entities after the chunks ``gone`` (source) are deleted (survey 12.2, 4.11).

    Untouched rows stay as they are, rows without a chunk left go, the others are built anew from the ``cached`` extractions of
    the chunks that are left. These are shuffled once, into buckets by name, from which all lists are built; the buckets go when the result is written.
    """
    spark = stored.sparkSession
    listed = stored.select("name", F.explode(T.split_list(F.col("source_id"))).alias("source"))
    plan = deletion(listed, gone, ["name"])
    parts, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"left_{uuid.uuid4().hex}"
    left = cached.join(gone.select("source").distinct(), "source", "left_anti").repartition(parts, "name").join(plan.where("action = 'rebuild'").select("name"), "name", "left_semi")
    left = left.select("name", "type", "description", "source", "file_path", "ts", "seq")
    left.write.format("parquet").option("path", f"{shared_dir(spark)}/{table}").bucketBy(parts, "name").saveAsTable(table)
    left = spark.table(table)
    built = merge_into_entities(left, None, sources, paths)
    same = stored.join(plan.where("action = 'untouched'").select("name"), "name", "left_semi")
    out = staged(same.select(*built.columns).unionByName(built), "deletion-result")
    drop_staged(left)
    spark.sql(f"DROP TABLE {table}")
    return out


def create_entities(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (name, entity_type, description) with its outcome: created, exists or no description (survey 12.6)."""
    seen = stored.select("name").distinct().withColumn("has", F.lit(True))
    outcome = F.when(F.trim(F.coalesce("description", F.lit(""))) == "", "no description").when(F.col("has"), "exists").otherwise("created")
    rows = wanted.join(seen, "name", "left").select("name", F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), "description", F.lit("manual_creation").alias("source_id"), outcome.alias("outcome"))
    return rows


def create_relations(entities: DataFrame, relations: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (src, tgt, description) with its outcome: created, exists or no end (survey 12.6)."""
    pair = wanted.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "description")
    names = entities.select("name").distinct()
    ends = lambda c, flag: names.select(F.col("name").alias(c), F.lit(True).alias(flag))
    rows = pair.join(ends("src", "a"), "src", "left").join(ends("tgt", "b"), "tgt", "left").join(relations.select("src", "tgt").distinct().withColumn("has", F.lit(True)), ["src", "tgt"], "left")
    outcome = F.when(F.col("a").isNull() | F.col("b").isNull(), "no end").when(F.col("has"), "exists").otherwise("created")
    return rows.select("src", "tgt", "description", F.lit(1.0).alias("weight"), F.lit("manual_creation").alias("source_id"), outcome.alias("outcome"))


def tracking_seed(stored: DataFrame, tracked: DataFrame) -> DataFrame:
    """(name, chunk_ids, count): ``tracked`` if it has rows, else derived from the sources of ``stored`` (survey 4.33)."""
    if not tracked.isEmpty():
        return tracked
    ids = T.split_list(F.col("source_id"))
    return stored.select("name", T.join_list(ids).alias("chunk_ids"), F.size(ids).cast("long").alias("count"))
