"""Life cycle: inserts, deletes, renames and merges as whole-table rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def insert_if_absent(stored: DataFrame, new: DataFrame, prefix: str) -> DataFrame:
    """(hash_id, content) of the store with the new texts that it lacks; stored rows are never changed."""
    own = stored.select(T.md5_id(F.col("text"), prefix).alias("hash_id"), F.col("text").alias("content"))
    more = new.select(T.md5_id(F.col("text"), prefix).alias("hash_id"), F.col("text").alias("content")).groupBy("hash_id").agg(F.first("content").alias("content"))
    return own.unionByName(more.join(own.select("hash_id"), "hash_id", "left_anti"))


def enqueue(docs: DataFrame) -> DataFrame:
    """(doc_id, id, status): of equal contents the first is queued, the others become FAILED audit rows."""
    first = docs.groupBy(F.md5("text").alias("hash")).agg(F.min("doc_id").alias("first"))
    rows = docs.select("doc_id", F.md5("text").alias("hash"), F.md5(F.concat("text", "doc_id")).alias("audit")).join(first, "hash")
    is_first = F.col("doc_id") == F.col("first")
    return rows.select("doc_id", F.when(is_first, F.concat(F.lit("doc-"), "hash")).otherwise(F.concat(F.lit("dup-"), "audit")).alias("id"), F.when(is_first, "PENDING").otherwise("FAILED").alias("status"))


def deletion_plan(sources: DataFrame, gone: DataFrame) -> DataFrame:
    """(name, action): delete without remaining sources, rebuild if some go, else untouched."""
    marked = sources.join(gone.distinct().withColumn("gone", F.lit(1)), "source", "left")
    counts = marked.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count("gone").alias("g"))
    return counts.select("name", F.when(F.col("g") == F.col("n"), "delete").when(F.col("g") > 0, "rebuild").otherwise("untouched").alias("action"))


def unsupported(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """Distinct (s, p, o) all of whose chunks are in ``gone`` (chunk)."""
    marked = facts.join(gone.distinct().withColumn("gone", F.lit(1)), "chunk", "left")
    return marked.groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n"), F.count("gone").alias("g")).where("n = g").select("s", "p", "o")


def rename_node(edges: DataFrame, old, new) -> DataFrame:
    swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)).alias(c)
    return edges.select(*[swap(c) if c in ("src", "tgt") else F.col(c) for c in edges.columns])


def merge_nodes(edges: DataFrame, sources: list, target) -> DataFrame:
    """Edges with the source nodes turned into the target: self loops go, of equal pairs the greatest weight stays."""
    swap = lambda c: F.when(F.col(c).isin(sources), F.lit(target)).otherwise(F.col(c))
    rows = edges.select(swap("src").alias("a"), swap("tgt").alias("b"), "weight").where("a <> b")
    return rows.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt")).agg(F.max("weight").alias("weight"))


def overlay(rows: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Columns of an edit replace those of the row with its key; of several edits of a key the greatest counts, so rows stay as many as they were."""
    changed = [c for c in edits.columns if c != key]
    one = edits.groupBy(F.col(key).alias("key_")).agg(F.max(F.struct(*changed)).alias("e_"))
    e = one.select("key_", F.lit(True).alias("hit_"), *[F.col("e_")[c].alias(f"new_{c}") for c in changed])
    both = rows.join(e, F.col(key) == F.col("key_"), "left")
    return both.select(*[F.when(F.col("hit_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in rows.columns])


def latest(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("n_ = 1").drop("n_")


def advance_queue(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The queue (doc_id, status, attempts) after a round of work (survey 13.1, 13.4).

    Processed rows stay. All others are taken up: one with an outcome (doc_id, error) becomes PROCESSED or, with an error, FAILED, and has one
    attempt more; one without is PENDING again, also if an earlier round broke off in PROCESSING.
    """
    done = outcomes.groupBy("doc_id").agg(F.max("error").alias("error"), F.lit(True).alias("has"))
    rows = queue.join(done, "doc_id", "left")
    keep = F.col("status") == "PROCESSED"
    status = F.when(keep, F.col("status")).when(F.col("has") & F.col("error").isNotNull(), "FAILED").when(F.col("has"), "PROCESSED").otherwise("PENDING")
    tried = F.when(~keep & F.coalesce("has", F.lit(False)), 1).otherwise(0)
    return rows.select("doc_id", status.alias("status"), (F.col("attempts") + tried).alias("attempts"), F.when(~keep, F.col("error")).alias("error"))
