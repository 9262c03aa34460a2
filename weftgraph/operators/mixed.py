"""Mixed retrieval for a whole table of queries: from vectors to the context's rows, the mode being a column.

Local queries start from entities and take their relations, global ones start from relations and take their ends, hybrid ones do both, mixed ones also
search chunks, naive ones only do that, and a bypass has no context. Each step is one join or window over all queries at once. Entities and
relations are cut by their token budgets; chunks are chosen by how many of the kept items list them, under quotas that fall with an
item's place; what the budget leaves after entities, relations and the question goes to chunks, whose files are numbered per query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_staged, staged
from . import ranking, vector

LOCAL, GLOBAL, CHUNKS = ("local", "hybrid", "mix"), ("global", "hybrid", "mix"), ("naive", "mix")


@dataclass
class Limits:
    top_k: int = 40
    chunk_top_k: int = 20
    threshold: float = 0.2
    entity_tokens: int = 6000
    relation_tokens: int = 8000
    total_tokens: int = 30000
    prompt_tokens: int = 0
    related_chunks: int = 5


#: Tokens kept free besides what is counted.
MARGIN = 200


@dataclass
class Stores:
    """What is searched; ids are integers."""

    entities: DataFrame  # id, embedding, tokens
    relations: DataFrame  # id, src, dst, weight, embedding, tokens; once a pair
    entity_chunks: DataFrame  # id, at, chunk: the chunks that an item lists, in order
    relation_chunks: DataFrame
    chunks: DataFrame  # id, embedding, tokens, file_path


def _hits(queries: DataFrame, modes: tuple, column: str, keys: DataFrame, k: int, threshold: float) -> DataFrame:
    asked = queries.where(F.col("mode").isin(*modes) & F.col(column).isNotNull()).select(F.col("q").alias("vec_id"), F.col(column).alias("embedding"))
    found = vector.knn(asked, keys.where("embedding IS NOT NULL").select(F.col("id").alias("vec_id"), "embedding"), k, threshold)
    return found.select(F.col("query_id").alias("q"), F.col("key_id").alias("id"), F.col("rank").cast("long").alias("pos"))


def _numbered(rows: DataFrame, key: str, *order) -> DataFrame:
    """(q, key, pos): the first row of each key in the order, numbered from 1."""
    first = rows.withColumn("n_", F.row_number().over(Window.partitionBy("q", key).orderBy(*order))).where("n_ = 1")
    return first.select("q", key, F.row_number().over(Window.partitionBy("q").orderBy(*order)).cast("long").alias("pos"))


def _merged(*sources: DataFrame) -> DataFrame:
    """(q, id, place): sources (q, id, pos) interleaved, each id once."""
    rows = None
    for n, s in enumerate(sources):
        s = s.select("q", "id", "pos", F.lit(n).alias("source"))
        rows = s if rows is None else rows.unionByName(s)
    return ranking.round_robin(rows, ["q"], "id", "pos", "source").select("q", "id", "place")


def _budgeted(rows: DataFrame, store: DataFrame, budget: int) -> DataFrame:
    costs = store.select(F.col("id").alias("i"), F.greatest(F.col("tokens"), F.lit(1)).alias("tokens"))
    return ranking.within_budget(rows.join(costs, F.col("id") == F.col("i")), ["q"], ["place"], "tokens", budget).select("q", "id", "place", "tokens")


def chosen_chunks(items: DataFrame, lists: DataFrame, most: int, without: DataFrame | None = None) -> DataFrame:
    """(q, id, pos): chunks of the items (q, id, place) by quotas that fall linearly from ``most`` to 1.

    A chunk belongs to the first item that lists it; within an item, chunks that more items list come first, then in list order. What an
    item cannot use goes to the earliest items that have more. ``without`` (q, id) are chunks that are there already; items that have no
    others then have no quota.
    """
    listed = items.join(lists.select(F.col("id").alias("i"), "at", "chunk"), F.col("id") == F.col("i")).select("q", "place", "at", "chunk")
    if without is not None:
        listed = listed.join(without.select("q", F.col("id").alias("chunk")), ["q", "chunk"], "left_anti")
    votes = listed.groupBy("q", "chunk").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("place", "at")).alias("first"))
    own = votes.select("q", "chunk", "votes", "first.place", "first.at")
    having = (listed if without is None else own).select("q", "place").distinct()
    have = own.groupBy("q", F.col("place").alias("p")).agg(F.count(F.lit(1)).alias("have")).withColumnRenamed("q", "q_")
    every = having.join(have, (F.col("q") == F.col("q_")) & (F.col("place") == F.col("p")), "left").select("q", "place", F.coalesce("have", F.lit(0)).alias("have"))
    by_q = Window.partitionBy("q")
    every = every.withColumn("item", F.row_number().over(by_q.orderBy("place")) - 1).withColumn("n", F.count(F.lit(1)).over(by_q))
    quota = F.when(F.col("n") == 1, most).otherwise(F.bround(most - F.col("item") / (F.col("n") - 1) * (most - 1))).cast("int")
    spare = F.when(F.col("n") == 1, F.lit(0)).otherwise(F.sum(F.greatest(F.lit(0), F.col("quota") - F.col("have"))).over(by_q))
    quotas = every.withColumn("quota", quota).withColumn("spare", spare).select("q", "place", "quota", "spare")
    rows = own.join(quotas, ["q", "place"]).withColumn("k", F.row_number().over(Window.partitionBy("q", "place").orderBy(F.desc("votes"), "at", "chunk")))
    beyond = F.col("k") > F.col("quota")
    rows = rows.withColumn("extra", F.when(beyond, F.row_number().over(Window.partitionBy("q", beyond).orderBy("place", "k"))).otherwise(0)).where(F.col("extra") <= F.when(beyond, F.col("spare")).otherwise(0))
    return rows.select("q", F.col("chunk").alias("id"), F.row_number().over(by_q.orderBy("extra", "place", "k")).cast("long").alias("pos"))


def context(queries: DataFrame, stores: Stores, limits: Limits | None = None) -> DataFrame:
    """(q, kind, place, id, tokens, reference_id) of every query (q, mode, tokens, low, high, asked).

    The vectors are those of the low-level keywords (for entities), the high-level ones (for relations) and the question (for chunks);
    a null vector finds nothing. Unknown modes and bypass give no rows.
    """
    limits = limits or Limits()
    entity_hits = staged(_hits(queries, LOCAL, "low", stores.entities, limits.top_k, limits.threshold), "mixed-hits")
    relation_hits = staged(_hits(queries, GLOBAL, "high", stores.relations, limits.top_k, limits.threshold), "mixed-hits")
    chunk_hits = staged(_hits(queries, CHUNKS, "asked", stores.chunks, limits.chunk_top_k, limits.threshold), "mixed-hits")
    pairs = stores.relations.select(F.col("id").alias("r"), "src", "dst", "weight")
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    for end in ("src", "dst"):
        pairs = pairs.join(degree.select(F.col("node").alias(end), F.col("degree").alias(f"{end}_degree")), end, "left")
    ends = pairs.select("r", (F.col("src_degree") + F.col("dst_degree")).alias("rank"), "weight", F.explode(F.array("src", "dst")).alias("node"))
    near = entity_hits.select("q", F.col("id").alias("e")).join(ends, F.col("e") == F.col("node")).select("q", F.col("r").alias("id"), "rank", "weight")
    local_relations = _numbered(near, "id", F.desc("rank"), F.desc("weight"), "id").where(F.col("pos") <= limits.relation_tokens)  # each takes a token at least
    named = relation_hits.join(stores.relations.select(F.col("id").alias("r"), F.posexplode(F.array("src", "dst")).alias("end", "node")), F.col("id") == F.col("r"))
    global_entities = _numbered(named.select("q", F.col("node").alias("id"), "pos", "end"), "id", "pos", "end")
    entities = staged(_budgeted(_merged(entity_hits, global_entities), stores.entities, limits.entity_tokens), "mixed-entities")
    relations = staged(_budgeted(_merged(local_relations, relation_hits), stores.relations, limits.relation_tokens), "mixed-relations")
    of_entities = staged(chosen_chunks(entities, stores.entity_chunks, limits.related_chunks), "mixed-chunks")
    of_relations = chosen_chunks(relations, stores.relation_chunks, limits.related_chunks, of_entities)
    merged = _merged(chunk_hits, of_entities, of_relations).where(F.col("place") <= limits.chunk_top_k)
    spent = entities.select("q", "tokens").union(relations.select("q", "tokens")).groupBy(F.col("q").alias("s")).agg(F.sum("tokens").alias("spent"))
    left = queries.join(spent, F.col("q") == F.col("s"), "left").select(F.col("q").alias("o"), (F.lit(limits.total_tokens - limits.prompt_tokens - MARGIN) - F.col("tokens") - F.coalesce("spent", F.lit(0))).alias("left"))
    costs = stores.chunks.select(F.col("id").alias("i"), "tokens", "file_path")
    upto = Window.partitionBy("q").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    chunks = merged.join(costs, F.col("id") == F.col("i")).withColumn("sum", F.sum("tokens").over(upto)).join(left, F.col("q") == F.col("o")).where(F.col("sum") <= F.col("left"))
    chunks = staged(chunks.select("q", "id", "place", "tokens", "file_path"), "mixed-chunks")
    known = chunks.where("file_path IS NOT NULL AND file_path NOT IN ('', 'unknown_source')").groupBy(F.col("q").alias("r"), F.col("file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    numbers = known.select("r", "f", F.row_number().over(Window.partitionBy("r").orderBy(F.desc("n"), "first")).cast("string").alias("reference_id"))
    cited = chunks.join(numbers, (F.col("q") == F.col("r")) & (F.col("file_path") == F.col("f")), "left")
    row = lambda df, kind, ref: df.select("q", F.lit(kind).alias("kind"), F.col("place").cast("long").alias("place"), "id", F.col("tokens").cast("long").alias("tokens"), ref.alias("reference_id"))
    none = F.lit(None).cast("string")
    out = row(entities, "entity", none).unionByName(row(relations, "relation", none)).unionByName(row(cited, "chunk", F.coalesce("reference_id", F.lit(""))))
    out = staged(out, "mixed-context")
    for df in (entity_hits, relation_hits, chunk_hits, entities, relations, of_entities, chunks):
        drop_staged(df)
    return out
