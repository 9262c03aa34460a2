"""Mixed retrieval over orders as chunks, suppliers and parts as entities; every twentieth vector asks, in six modes by turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixed
from ..session import read_table
from .registry import query

LIMITS = mixed.Limits(top_k=10, chunk_top_k=20, threshold=0.1, entity_tokens=500, relation_tokens=700, total_tokens=4000, prompt_tokens=100, related_chunks=5)
MODES = ("local", "global", "hybrid", "mix", "naive", "bypass")


def tables(spark, d):
    """(queries, stores)."""
    vectors = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), ((F.col("id") / 20).cast("int") % 6 + 1).cast("int"))
    queries = vectors.where("id % 20 = 0").select(F.col("id").alias("q"), mode.alias("mode"), (F.col("id") % 50).cast("int").alias("tokens"), F.col("embedding").alias("low"), F.reverse("embedding").alias("high"), F.col("embedding").alias("asked"))
    rows = read_table(spark, d, "lineitem").where("l_suppkey <> l_partkey").select(F.least("l_suppkey", "l_partkey").alias("src"), F.greatest("l_suppkey", "l_partkey").alias("dst"), "l_orderkey", "l_quantity")
    pair = F.col("src") * 1_000_000 + F.col("dst")
    relations = rows.groupBy("src", "dst").agg(F.sum("l_quantity").alias("weight")).join(vectors.withColumnRenamed("id", "v"), F.col("dst") == F.col("v"), "left")
    relations = relations.select(pair.alias("id"), "src", "dst", "weight", "embedding", (30 + pair % 17).cast("int").alias("tokens"))
    nodes = rows.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
    entities = nodes.join(vectors, F.col("n") == F.col("id"), "left").select(F.col("n").alias("id"), "embedding", (20 + F.col("n") % 13).cast("int").alias("tokens"))
    of_entity = rows.select(F.explode(F.array("src", "dst")).alias("id"), F.col("l_orderkey").alias("at"), F.col("l_orderkey").alias("chunk")).distinct()
    of_relation = rows.select(pair.alias("id"), F.col("l_orderkey").alias("at"), F.col("l_orderkey").alias("chunk")).distinct()
    orders = read_table(spark, d, "orders").join(vectors, F.col("o_orderkey") == F.col("id"), "left")
    file = F.when(F.col("o_orderstatus") == "P", "unknown_source").otherwise(F.concat(F.lit("file-"), F.col("o_custkey") % 7))
    chunks = orders.select(F.col("o_orderkey").alias("id"), "embedding", (F.floor(F.col("o_totalprice") / 1000) + 1).cast("int").alias("tokens"), file.alias("file_path"))
    return queries, mixed.Stores(entities, relations, of_entity, of_relation, chunks)


def _hits(name: str, modes: tuple, column: str, keys: str, k: int) -> str:
    there = ", ".join(f"'{m}'" for m in modes)
    return f"{name} AS MATERIALIZED (SELECT q, id, pos FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS pos FROM (SELECT q, id, round(list_cosine_similarity({column}::DOUBLE[], embedding::DOUBLE[]), 9) AS s FROM asks, {keys} WHERE mode IN ({there}) AND embedding IS NOT NULL) WHERE s >= {LIMITS.threshold}) WHERE pos <= {k})"


def _merge(name: str, sources: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT q, id, pos, {n} AS src FROM {s}" for n, s in enumerate(sources))
    return f"{name} AS MATERIALIZED (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY pos, src) AS place FROM (SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY q, id ORDER BY pos, src) = 1))"


def _cut(name: str, rows: str, store: str, budget: int) -> str:
    return f"{name} AS MATERIALIZED (SELECT q, id, place, tokens FROM (SELECT q, r.id, place, tokens, sum(tokens) OVER (PARTITION BY q ORDER BY place ROWS UNBOUNDED PRECEDING) AS spent FROM {rows} r JOIN {store} s ON s.id = r.id) WHERE spent <= {budget})"


def _choose(name: str, items: str, lists: str, without: str | None) -> str:
    gone = f" WHERE (q, chunk) NOT IN (SELECT (q, id) FROM {without})" if without else ""
    m = LIMITS.related_chunks
    return f"""{name}_l AS MATERIALIZED (SELECT q, place, nth, chunk FROM {items} i JOIN {lists} l ON l.id = i.id{gone}),
    {name}_o AS MATERIALIZED (SELECT q, chunk, count(*) AS votes, min((place, nth)) AS f FROM {name}_l GROUP BY q, chunk),
    {name}_i AS (SELECT q, place, count(*) OVER (PARTITION BY q) AS n, row_number() OVER (PARTITION BY q ORDER BY place) - 1 AS item FROM (SELECT DISTINCT q, {'f[1] AS place FROM ' + name + '_o' if without else 'place FROM ' + name + '_l'})),
    {name}_q AS (SELECT i.q, i.place, n, CASE WHEN n = 1 THEN {m} ELSE round_even({m} - item::DOUBLE / (n - 1) * {m - 1}, 0)::INTEGER END AS quota, (SELECT count(*) FROM {name}_o o WHERE o.q = i.q AND o.f[1] = i.place) AS have FROM {name}_i i),
    {name}_r AS (SELECT o.q, chunk, place, quota, CASE WHEN n = 1 THEN 0 ELSE (SELECT sum(greatest(0, z.quota - z.have)) FROM {name}_q z WHERE z.q = o.q) END AS spare, row_number() OVER (PARTITION BY o.q, place ORDER BY votes DESC, f[2], chunk) AS k FROM {name}_o o JOIN {name}_q u ON u.q = o.q AND u.place = f[1]),
    {name}_t AS (SELECT q, chunk AS id, 0 AS extra, place, k FROM {name}_r WHERE k <= quota UNION ALL SELECT q, chunk, extra, place, k FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place, k) AS extra FROM {name}_r WHERE k > quota) WHERE extra <= spare),
    {name} AS MATERIALIZED (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY extra, place, k) AS pos FROM {name}_t)"""


_STEPS = [
    "asks AS (SELECT vec_id AS q, " + f"{list(MODES)}[(vec_id // 20) % 6 + 1] AS mode, vec_id % 50 AS tokens, embedding AS low, list_reverse(embedding) AS high FROM embeddings WHERE vec_id % 20 = 0)",
    "f AS MATERIALIZED (SELECT least(l_suppkey, l_partkey) AS src, greatest(l_suppkey, l_partkey) AS dst, l_orderkey AS chunk, l_quantity AS w FROM lineitem WHERE l_suppkey <> l_partkey)",
    "rels AS MATERIALIZED (SELECT src * 1000000 + dst AS id, src, dst, weight, embedding, 30 + (src * 1000000 + dst) % 17 AS tokens FROM (SELECT src, dst, sum(w) AS weight FROM f GROUP BY src, dst) LEFT JOIN embeddings ON vec_id = dst)",
    "ents AS MATERIALIZED (SELECT n AS id, embedding, 20 + n % 13 AS tokens FROM (SELECT src AS n FROM f UNION SELECT dst FROM f) LEFT JOIN embeddings ON vec_id = n)",
    "ent_chunks AS MATERIALIZED (SELECT src AS id, chunk AS nth, chunk FROM f UNION SELECT dst, chunk, chunk FROM f)",
    "rel_chunks AS MATERIALIZED (SELECT DISTINCT src * 1000000 + dst AS id, chunk AS nth, chunk FROM f)",
    "texts AS MATERIALIZED (SELECT o_orderkey AS id, embedding, (floor(o_totalprice / 1000) + 1)::INTEGER AS tokens, CASE WHEN o_orderstatus = 'P' THEN 'unknown_source' ELSE 'file-' || (o_custkey % 7) END AS file_path FROM orders LEFT JOIN embeddings ON vec_id = o_orderkey)",
    _hits("eh", mixed.LOCAL, "low", "ents", LIMITS.top_k),
    _hits("rh", mixed.GLOBAL, "high", "rels", LIMITS.top_k),
    _hits("ch", mixed.CHUNKS, "low", "texts", LIMITS.chunk_top_k),
    "deg AS (SELECT n, count(*) AS g FROM (SELECT src AS n FROM rels UNION ALL SELECT dst FROM rels) GROUP BY n)",
    f"lr AS (SELECT q, id, pos FROM (SELECT q, r.id, row_number() OVER (PARTITION BY q ORDER BY a.g + b.g DESC, weight DESC, r.id) AS pos FROM rels r JOIN deg a ON a.n = src JOIN deg b ON b.n = dst JOIN (SELECT DISTINCT q, r.id FROM eh e JOIN rels r ON r.src = e.id OR r.dst = e.id) h ON h.id = r.id) WHERE pos <= {LIMITS.relation_tokens})",
    "ge AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY pos, e) AS pos FROM (SELECT * FROM (SELECT q, src AS id, pos, 0 AS e FROM rh JOIN rels USING (id) UNION ALL SELECT q, dst, pos, 1 FROM rh JOIN rels USING (id)) QUALIFY row_number() OVER (PARTITION BY q, id ORDER BY pos, e) = 1))",
    _merge("em", ["eh", "ge"]),
    _merge("rm", ["lr", "rh"]),
    _cut("ek", "em", "ents", LIMITS.entity_tokens),
    _cut("rk", "rm", "rels", LIMITS.relation_tokens),
    _choose("ec", "ek", "ent_chunks", None),
    _choose("rc", "rk", "rel_chunks", "ec"),
    _merge("cm", ["ch", "ec", "rc"]),
    "spent AS (SELECT q, sum(tokens) AS s FROM (SELECT q, tokens FROM ek UNION ALL SELECT q, tokens FROM rk) GROUP BY q)",
    f"ck AS MATERIALIZED (SELECT q, id, place, c.tokens, file_path FROM (SELECT m.q, m.id, place, t.tokens, file_path, sum(t.tokens) OVER (PARTITION BY m.q ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM cm m JOIN texts t ON t.id = m.id WHERE place <= {LIMITS.chunk_top_k}) c JOIN (SELECT asks.q AS aq, {LIMITS.total_tokens - LIMITS.prompt_tokens - mixed.MARGIN} - tokens - coalesce(s, 0) AS room FROM asks LEFT JOIN spent ON spent.q = asks.q) ON aq = q WHERE upto <= room)",
    "refs AS (SELECT q, file_path, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, min(place)) AS n FROM ck WHERE file_path <> 'unknown_source' GROUP BY q, file_path)",
]
_ROWS = "SELECT q, 'entity' AS kind, place, id, tokens::BIGINT AS tokens, NULL::VARCHAR AS reference_id FROM ek UNION ALL SELECT q, 'relation', place, id, tokens, NULL FROM rk UNION ALL SELECT ck.q, 'chunk', place, id, tokens, coalesce(n::VARCHAR, '') FROM ck LEFT JOIN refs ON refs.q = ck.q AND refs.file_path = ck.file_path"


@query("mixed_context", f"WITH {', '.join(_STEPS)} {_ROWS}")
def mixed_context(spark, d):
    """Entities, relations and cited chunks of every query's context, in all modes at once (survey 10.5, 10.9)."""
    return mixed.context(*tables(spark, d), LIMITS)
