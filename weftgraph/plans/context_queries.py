"""Context assembly: packing, truncation, picks, corpus rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import ranking
from ..session import read_table
from .registry import query


@query("row_zip", "SELECT o_orderkey AS id, o_totalprice AS predicted, count(l_orderkey) AS retrieved FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def row_zip(spark, d):
    """Predictions and retrieved rows by sample id."""
    got = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = read_table(spark, d, "orders").join(got, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("predicted"), F.coalesce("n", F.lit(0)).alias("retrieved"))


@query("summary_branch", "SELECT conv_id, count(*) AS items, sum(length(text))::BIGINT AS tokens, CASE WHEN count(*) = 1 THEN 'single' WHEN count(*) < 8 AND sum(length(text)) < 1200 THEN 'join' ELSE 'summarise' END AS branch FROM conversations GROUP BY conv_id")
def summary_branch(spark, d):
    """Which way a list of descriptions goes: as it is, joined, or to the summary hook."""
    n, tokens = F.count(F.lit(1)), F.sum(F.length("text"))
    branch = F.when(n == 1, "single").when((n < 8) & (tokens < 1200), "join").otherwise("summarise")
    return read_table(spark, d, "conversations").groupBy("conv_id").agg(n.alias("items"), tokens.alias("tokens"), branch.alias("branch"))


@query(
    "summary_packing",
    "WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS i, length(text) AS n FROM conversations), "
    "s AS (SELECT conv_id, i, 1 AS g, n AS held FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.i, CASE WHEN held = 0 OR held + n <= 1200 THEN g ELSE g + 1 END, CASE WHEN held = 0 OR held + n <= 1200 THEN held + n ELSE n END FROM s JOIN o ON o.conv_id = s.conv_id AND o.i = s.i + 1), "
    "c AS (SELECT conv_id, g, count(*) AS c FROM s GROUP BY conv_id, g) SELECT conv_id, string_agg(c, ',' ORDER BY g) AS groups, sum(c)::INTEGER AS items FROM c GROUP BY conv_id",
)
def summary_packing(spark, d):
    """Greedy groups of descriptions in order, each within a budget, for map-reduce summaries."""
    items = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda s: s["n"]).alias("sizes"))
    start = F.struct(F.array(F.lit(0)).alias("groups"), F.lit(0).alias("held"))

    def put(state, n):
        fits = (state["held"] == 0) | (state["held"] + n <= 1200)
        head, last = F.slice(state["groups"], 1, F.size(state["groups"]) - 1), F.element_at(state["groups"], -1)
        return F.when(fits, F.struct(F.concat(head, F.array(last + 1)).alias("groups"), (state["held"] + n).alias("held"))).otherwise(F.struct(F.concat(state["groups"], F.array(F.lit(1))).alias("groups"), n.alias("held")))

    packed = F.aggregate("sizes", start, put)["groups"]
    return items.select("conv_id", F.array_join(packed, ",").alias("groups"), F.aggregate(packed, F.lit(0), lambda a, x: a + x).alias("items"))


@query(
    "chunk_pick_vector",
    "WITH p AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 9) AS score FROM embeddings, p) SELECT label, vec_id, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 5",
)
def chunk_pick_vector(spark, d):
    rows = read_table(spark, d, "embeddings")
    one = rows.orderBy("vec_id").select("embedding").first()[0]
    score = F.round(A.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in one])), 9)
    order = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    return rows.select("label", "vec_id", score.alias("score")).withColumn("n", F.row_number().over(order)).where("n <= 5").select("label", "vec_id", "n")


@query("context_truncation", "SELECT o_custkey, o_orderkey, spent FROM (SELECT *, sum(length(o_orderpriority) + length(o_orderstatus)) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM orders) WHERE spent <= 60")
def context_truncation(spark, d):
    rows = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.length("o_orderpriority") + F.length("o_orderstatus")).alias("cost"))
    return ranking.within_budget(rows, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], "cost", 60).select("o_custkey", "o_orderkey", "spent")


@query("dynamic_budget", "SELECT conv_id, greatest(0, 30000 - (sum(CASE WHEN role = 'system' THEN length(text) ELSE 0 END) + sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) + 200))::BIGINT AS available FROM conversations GROUP BY conv_id")
def dynamic_budget(spark, d):
    size = lambda role: F.sum(F.when(F.col("role") == role, F.length("text")).otherwise(0))
    return read_table(spark, d, "conversations").groupBy("conv_id").agg(F.greatest(F.lit(0), 30000 - (size("system") + size("user") + 200)).alias("available"))


@query("mask_views", "SELECT l_suppkey, l_partkey, substr(md5('mask-' || l_suppkey || '-' || l_partkey), 1, 2) < '33' AS masked FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def mask_views(spark, d):
    """A fifth of the fact edges is masked by hash, the same in every run (survey 11.11)."""
    rows = read_table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return rows.select("l_suppkey", "l_partkey", (F.substring(F.md5(F.concat(F.lit("mask-"), "l_suppkey", F.lit("-"), "l_partkey")), 1, 2) < "33").alias("masked"))


@query("corpus_build", r"SELECT doc_id, '[chunk ' || lpad((row_number() OVER (PARTITION BY source ORDER BY doc_id))::VARCHAR, 4, '0') || ']' AS title, count(*) OVER (PARTITION BY source) AS num_chunks FROM documents")
def corpus_build(spark, d):
    own = Window.partitionBy("source")
    number = F.lpad(F.row_number().over(own.orderBy("doc_id")).cast("string"), 4, "0")
    return read_table(spark, d, "documents").select("doc_id", F.concat(F.lit("[chunk "), number, F.lit("]")).alias("title"), F.count(F.lit(1)).over(own).alias("num_chunks"))


@query("keyword_fallback", "SELECT conv_id, turn, CASE WHEN length(text) < 50 THEN text ELSE '' END AS keywords FROM conversations")
def keyword_fallback(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.when(F.length("text") < 50, F.col("text")).otherwise("").alias("keywords"))


@query(
    "chunk_id_alias",
    "WITH i AS (SELECT item_id, 'chunk-' || md5(text) AS chunk_id FROM benchmark), s AS (SELECT item_id, unnest([0, 1, 2, 3]) AS form, chunk_id FROM i) SELECT item_id, form, CASE WHEN form < 3 THEN chunk_id END AS chunk_id FROM s",
)
def chunk_id_alias(spark, d):
    """Ids as a model cites them, quoted, spaced or in capitals, resolve to the stored id, others to none (survey 8.17)."""
    ids = read_table(spark, d, "benchmark").select("item_id", T.md5_id(F.col("text"), "chunk-").alias("chunk_id"))
    forms = F.array(F.concat(F.lit(' "'), "chunk_id", F.lit('" ')), F.upper("chunk_id"), F.concat(F.lit("see "), "chunk_id", F.lit(".")), F.concat(F.lit("chunk-"), F.md5("chunk_id")))
    cited = ids.select("item_id", F.posexplode(forms).alias("form", "said"))
    alias = F.regexp_extract(F.lower("said"), "chunk-[0-9a-f]{32}", 0)
    known = ids.select("chunk_id").distinct()
    return cited.join(known, alias == F.col("chunk_id"), "left").select("item_id", "form", "chunk_id")


@query("retry_rows", "SELECT event_type AS status, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def retry_rows(spark, d):
    """Rows of the given states, by state."""
    return read_table(spark, d, "events").where(F.col("event_type").isin("click", "view")).groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))
