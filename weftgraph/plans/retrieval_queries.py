"""Retrieval pipelines and answer metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import chunking
from ..operators import retrieve as R
from ..session import read_table
from .registry import query

_PROBE = "p AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_HITS = f"{_PROBE}, h AS (SELECT vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS score FROM embeddings e, p), k AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS pos FROM h WHERE score >= 0.0 ORDER BY pos LIMIT 40)"


def _probe(spark, d):
    """The embedding of the first vector stands for the embedded question."""
    one = read_table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]
    return F.array(*[F.lit(float(x)) for x in one])


def _vectors(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _chunks(spark, d):
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("file_path"))


@query(
    "naive_search",
    rf"""WITH {_HITS}, c AS (SELECT id, score, pos, source AS file_path, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]')) AS tokens, text FROM k JOIN documents ON doc_id = id),
    b AS (SELECT *, sum(tokens) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS spent FROM c), w AS (SELECT * FROM b WHERE spent <= 30000),
    r AS (SELECT file_path, row_number() OVER (ORDER BY count(*) DESC, min(pos)) AS n FROM w GROUP BY file_path)
    SELECT 'chunk-' || md5(text) AS chunk_id, id, score, pos::BIGINT AS pos, tokens::BIGINT AS tokens, spent::BIGINT AS spent, file_path, n::VARCHAR AS reference_id FROM w JOIN r USING (file_path)""",
)
def naive_search(spark, d):
    out = R.naive(_chunks(spark, d), _vectors(spark, d), _probe(spark, d), 40, 0.0, 30000, F.size(chunking.tokens_of(F.col("text"))))
    return out.select(T.md5_id(F.col("text"), "chunk-").alias("chunk_id"), "id", "score", F.col("pos").cast("long").alias("pos"), F.col("tokens").cast("long").alias("tokens"), "spent", "file_path", "reference_id")


_LOCAL = "l AS (SELECT DISTINCT least('s' || l_suppkey, 'p' || l_partkey) AS a, greatest('s' || l_suppkey, 'p' || l_partkey) AS b, 's' || l_suppkey AS s, 'p' || l_partkey AS t FROM lineitem), g AS (SELECT n, count(*) AS d FROM (SELECT s AS n FROM l UNION ALL SELECT t FROM l) GROUP BY n)"


def _graph(spark, d):
    rows = read_table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    degrees = rows.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return rows, degrees


@query("local_search", f"WITH {_HITS}, {_LOCAL} SELECT l.a, l.b, 1.0::DOUBLE AS weight, x.d + y.d AS rank FROM l JOIN g x ON x.n = l.a JOIN g y ON y.n = l.b WHERE s IN (SELECT 's' || id FROM k)")
def local_search(spark, d):
    """Entity hits and the edges at them."""
    entities = R.hits(_vectors(spark, d), _probe(spark, d), 40, 0.0).select(F.concat(F.lit("s"), "id").alias("id"))
    return R.local_edges(entities, *_graph(spark, d))


@query("global_search", f"WITH {_HITS} SELECT l_suppkey AS node, min(pos)::BIGINT AS pos FROM k JOIN lineitem ON l_partkey = id GROUP BY 1")
def global_search(spark, d):
    """Relation hits and their ends, at the first relation that names them."""
    found = R.hits(_vectors(spark, d), _probe(spark, d), 40, 0.0)
    return found.join(read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("node")), "id").groupBy("node").agg(F.min("pos").cast("long").alias("pos"))


@query(
    "hybrid_search",
    f"WITH {_HITS}, a AS (SELECT id AS node, pos, 0 AS src FROM k UNION ALL SELECT l_suppkey, min(pos), 1 FROM k JOIN lineitem ON l_partkey = id GROUP BY 1), f AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pos, src) AS n FROM a) SELECT node, src, row_number() OVER (ORDER BY pos, src, node) AS place FROM f WHERE n = 1",
)
def hybrid_search(spark, d):
    from ..operators import ranking

    found = R.hits(_vectors(spark, d), _probe(spark, d), 40, 0.0)
    ends = global_search(spark, d).withColumn("src", F.lit(1))
    both = found.select(F.col("id").alias("node"), F.col("pos").cast("long").alias("pos"), F.lit(0).alias("src")).unionByName(ends).withColumn("q", F.lit(0))
    return ranking.round_robin(both, ["q"], "node", "pos", "src").select("node", "src", "place")


@query(
    "mix_search",
    f"WITH {_HITS}, a AS (SELECT l_orderkey AS chunk, min(pos) AS pos, 1 AS src FROM k JOIN lineitem ON l_suppkey = id GROUP BY 1 UNION ALL SELECT id, pos, 0 FROM k), f AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY pos, src) AS n FROM a), o AS (SELECT chunk, src, row_number() OVER (ORDER BY pos, src, chunk) AS place FROM f WHERE n = 1) SELECT * FROM o WHERE place <= 100",
)
def mix_search(spark, d):
    """Vector chunks interleaved with the chunks of hit entities."""
    from ..operators import ranking

    found = R.hits(_vectors(spark, d), _probe(spark, d), 40, 0.0)
    graph = found.join(read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("chunk")), "id").groupBy("chunk").agg(F.min("pos").alias("pos")).withColumn("src", F.lit(1))
    both = found.select(F.col("id").alias("chunk"), "pos", F.lit(0).alias("src")).unionByName(graph).withColumn("q", F.lit(0))
    return ranking.round_robin(both, ["q"], "chunk", "pos", "src").where("place <= 100").select("chunk", "src", "place")


@query("ppr_retrieve")
def ppr_retrieve(spark, d):
    """Facts seed phrases, phrases and passages seed PageRank, passages come back by rank."""
    from ..operators import graph

    rows = read_table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("o"), "l_orderkey").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    seeds = R.hits(_vectors(spark, d), _probe(spark, d), 5, 0.0).select(F.lit(0).alias("q"), F.concat(F.lit("s"), "id").alias("node"), F.col("score").alias("weight"))
    rank = graph.personalised_pagerank(rows, seeds, rounds=graph.SETTLED).where(F.col("node").startswith("o"))
    return rank.select("node", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "node").limit(200)


@query("fact_scores", f"WITH {_PROBE}, s AS (SELECT vec_id, list_sum(list_transform(list_zip(e.embedding, p.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS s FROM embeddings e, p) SELECT vec_id, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) AS score FROM s")
def fact_scores(spark, d):
    rows = read_table(spark, d, "embeddings").select("vec_id", A.dot(F.col("embedding"), _probe(spark, d)).alias("s"))
    ends = rows.agg(F.min("s").alias("l"), F.max("s").alias("h"))
    return rows.join(F.broadcast(ends), F.lit(True)).select("vec_id", F.round((F.col("s") - F.col("l")) / (F.col("h") - F.col("l")), 6).alias("score"))


@query("context_rows", "SELECT s_suppkey, json_object('id', s_suppkey, 'name', s_name)::VARCHAR AS context FROM supplier")
def context_rows(spark, d):
    return read_table(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("context"))


_WORDS = r"list_filter(string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"
_PAIRS = f"x AS (SELECT d.doc_id, {_WORDS.format('split_part(d.text, chr(10), 1)')} AS p, {_WORDS.format('split_part(b.text, chr(10), 1)')} AS g FROM documents d JOIN benchmark b ON b.item_id = d.doc_id)"


def _pairs(spark, d):
    """First lines as predicted and gold answers, as normalised words."""
    gold = read_table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), T.first_line(F.col("text")).alias("gold"))
    rows = read_table(spark, d, "documents").select("doc_id", T.first_line(F.col("text")).alias("said")).join(gold, "doc_id")
    words = lambda c: F.filter(F.split(T.answer(F.col(c)), " "), lambda w: w != "")
    return rows.select("doc_id", words("said").alias("p"), words("gold").alias("g"))


@query("em", f"WITH {_PAIRS} SELECT doc_id, (p = g)::INTEGER AS em FROM x")
def em(spark, d):
    return _pairs(spark, d).select("doc_id", (F.col("p") == F.col("g")).cast("int").alias("em"))


_F1 = "list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda y: y = w)), len(list_filter(g, lambda y: y = w)))))"


@query("f1_tokens", f"WITH {_PAIRS}, c AS (SELECT *, coalesce({_F1}, 0) AS s FROM x) SELECT doc_id, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN s = 0 THEN 0.0 ELSE 2.0::DOUBLE * s / (len(p) + len(g)) END, 6) AS f1 FROM c")
def f1_tokens(spark, d):
    return _pairs(spark, d).select("doc_id", F.round(A.token_overlap_f1(F.col("p"), F.col("g"), 1.0), 6).alias("f1"))


@query("f1_guarded", f"WITH {_PAIRS}, c AS (SELECT *, coalesce({_F1}, 0) AS s FROM x) SELECT doc_id, round(CASE WHEN p <> g AND (array_to_string(p, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(g, ' ') IN ('yes', 'no', 'noanswer')) THEN 0.0 WHEN s = 0 THEN 0.0 ELSE 2.0::DOUBLE * s / (len(p) + len(g)) END, 6) AS f1 FROM c")
def f1_guarded(spark, d):
    guard = (F.col("p") != F.col("g")) & (F.array_join("p", " ").isin("yes", "no", "noanswer") | F.array_join("g", " ").isin("yes", "no", "noanswer"))
    return _pairs(spark, d).select("doc_id", F.when(guard, 0.0).otherwise(F.round(A.token_overlap_f1(F.col("p"), F.col("g"), 0.0), 6)).alias("f1"))


_RANKED = "r AS (SELECT user_id, event_id, event_type = 'purchase' AS gold, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)"


def _ranked(spark, d):
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return read_table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("gold"), F.row_number().over(order).alias("rank"))


@query("recall_at_k", f"WITH {_RANKED} SELECT user_id, " + ", ".join(f"round(count(*) FILTER (WHERE gold AND rank <= {k}) / count(*) FILTER (WHERE gold), 6) AS r{k}" for k in (1, 2, 5, 10)) + " FROM r GROUP BY user_id HAVING count(*) FILTER (WHERE gold) > 0")
def recall_at_k(spark, d):
    rows = _ranked(spark, d).groupBy("user_id").agg(F.count_if("gold").alias("n"), *[F.count_if(F.col("gold") & (F.col("rank") <= k)).alias(f"h{k}") for k in (1, 2, 5, 10)])
    return rows.where("n > 0").select("user_id", *[F.round(F.col(f"h{k}") / F.col("n"), 6).alias(f"r{k}") for k in (1, 2, 5, 10)])


@query("mrr_hits", f"WITH {_RANKED}, b AS (SELECT user_id, min(rank) AS rank FROM r WHERE gold GROUP BY user_id) SELECT count(*) AS queries, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg((rank <= 1)::INTEGER), 6) AS hits1, round(avg((rank <= 3)::INTEGER), 6) AS hits3, round(avg((rank <= 10)::INTEGER), 6) AS hits10 FROM b")
def mrr_hits(spark, d):
    best = _ranked(spark, d).where("gold").groupBy("user_id").agg(F.min("rank").alias("rank"))
    hit = lambda k: F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"hits{k}")
    return best.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), hit(1), hit(3), hit(10))


@query("qa_rollup", f"WITH {_PAIRS} SELECT count(*) AS n, round(avg((p = g)::INTEGER), 4) AS exact_match FROM x")
def qa_rollup(spark, d):
    return _pairs(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("p") == F.col("g")).cast("int")), 4).alias("exact_match"))


@query("min_rerank_filter", "SELECT event_id, coalesce(value, 1.0) AS rerank_score FROM events WHERE coalesce(value, 1.0) >= 50 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY coalesce(value, 1.0) DESC, event_id) <= 20")
def min_rerank_filter(spark, d):
    rows = read_table(spark, d, "events").select("event_id", "event_type", F.coalesce("value", F.lit(1.0)).alias("rerank_score")).where("rerank_score >= 50")
    order = Window.partitionBy("event_type").orderBy(F.desc("rerank_score"), "event_id")
    return rows.withColumn("n", F.row_number().over(order)).where("n <= 20").select("event_id", "rerank_score")


@query("user_format", "SELECT s_suppkey AS id, s_name AS entity_name, 'UNKNOWN' AS entity_type, coalesce(n_name, '') AS description FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def user_format(spark, d):
    rows = read_table(spark, d, "supplier").join(read_table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("entity_name"), F.lit("UNKNOWN").alias("entity_type"), F.coalesce("n_name", F.lit("")).alias("description"))


@query("gold_answers", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS gold FROM orders GROUP BY o_custkey")
def gold_answers(spark, d):
    rows = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("answer"), F.collect_set("o_orderpriority").alias("aliases"))
    return rows.select("o_custkey", F.array_join(F.array_sort(F.array_distinct(F.array_union(F.array("answer"), "aliases"))), "|").alias("gold"))


@query("bce_loss", "SELECT round(avg(-(CASE WHEN event_type = 'purchase' THEN ln(1 / (1 + exp(-value / 100))) ELSE ln(1 - 1 / (1 + exp(-value / 100))) END)), 6) AS bce FROM events")
def bce_loss(spark, d):
    p = 1 / (1 + F.exp(-F.col("value") / 100))
    return read_table(spark, d, "events").agg(F.round(F.avg(-F.when(F.col("event_type") == "purchase", F.log(p)).otherwise(F.log(1 - p))), 6).alias("bce"))
