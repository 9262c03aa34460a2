"""Hooks, path search, scored rankings and state machines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import facts as fx
from ..operators import hooks
from ..session import read_table
from .registry import query

FACTS = fx.SQL


@query("embedding_hook", "SELECT doc_id, 64::BIGINT AS dim FROM documents")
def embedding_hook(spark, d):
    rows = hooks.embed(read_table(spark, d, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.size("embedding").cast("long").alias("dim"))


@query("cached_llm_calls", "SELECT conv_id, turn, upper(role) AS answer FROM conversations")
def cached_llm_calls(spark, d):
    prompts = read_table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("prompt"))
    cache = prompts.where("prompt = 'user'").select(F.md5("prompt").alias("key"), F.upper("prompt").alias("answer")).distinct()
    answers, _ = hooks.cached_calls(prompts, cache, lambda xs: [x.upper() for x in xs])
    return answers.select("conv_id", "turn", "answer")


@query("json_repair", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_repair(spark, d):
    broken = F.concat(F.substring_index("props", "}", 1), F.lit(', "tail": [1, {"x'))
    rows = read_table(spark, d, "events").select("event_id", broken.alias("broken"))
    return rows.select("event_id", F.get_json_object(hooks.repaired_json(F.col("broken")), "$.k").cast("long").alias("k"))


#: Answers of a judge and what they say.
ANSWERS = (
    ("Correct.", True), ("INCORRECT", False), ('```json {"same": true} ```', True), ('{"same": false, "verdict": "correct"}', False), ('so {"verdict": "Correct"} then', True), ('{"label": "incorrect"}', False),
    ('{"equivalent": "yes"}', True), ('{"is_same": 0}', False), ('"correct"', True), ("yes", False), ("The answer is correct", True), ("It is not correct but incorrect", False), ("{broken", False), ('{"other": 1}', False),
)
_SAID = " ".join(f"WHEN {i} THEN {str(v).lower()}" for i, (_, v) in enumerate(ANSWERS))


@query("judge_parse", f"SELECT o_orderkey, CASE o_orderkey % {len(ANSWERS)} {_SAID} END AS correct FROM orders")
def judge_parse(spark, d):
    """Verdicts of a judge's answers, of every form that they come in (survey 8.15)."""
    said = F.element_at(F.array(*[F.lit(x) for x, _ in ANSWERS]), (F.col("o_orderkey") % len(ANSWERS) + 1).cast("int"))
    return read_table(spark, d, "orders").select("o_orderkey", hooks.judged(said).alias("correct"))


@query("closest_match")
def closest_match(spark, d):
    """The part type most alike to each name; types are a vocabulary, so all of them are sent, and each distinct name is compared once."""
    parts = read_table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    types = [r[0] for r in parts.select("p_type").distinct().orderBy("p_type").collect()]
    names = hooks.map_text(parts.select("p_name").distinct(), "p_name", lambda x: types[hooks.closest(x or "", types)], "type", "string")
    return parts.join(names, parts["p_name"].eqNullSafe(names["p_name"])).select("p_partkey", "type")


@query("first_line_merge", r"SELECT split_part(text, chr(10), 1) AS title, string_agg(substr(text, length(split_part(text, chr(10), 1)) + 2), chr(10) ORDER BY doc_id) AS body, count(*) AS n FROM documents GROUP BY 1")
def first_line_merge(spark, d):
    title = T.first_line(F.col("text"))
    body = F.col("text").substr(F.length(title) + F.lit(2), F.length("text"))
    rows = read_table(spark, d, "documents").select(title.alias("title"), "doc_id", body.alias("body"))
    merged = rows.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("doc_id", "body"))).alias("x"), F.count(F.lit(1)).alias("n"))
    return merged.select("title", F.array_join(F.transform("x", lambda s: s["body"]), "\n").alias("body"), "n")


@query("kg_completion_metrics", "WITH r AS (SELECT event_id, (SELECT count(*) FROM events n WHERE n.user_id = e.user_id AND n.event_type <> 'purchase' AND n.value > e.value) + 1 AS rank FROM events e WHERE event_type = 'purchase') SELECT count(*) AS n, round(avg(rank), 6) AS mr, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg((rank <= 1)::INTEGER), 6) AS hits1, round(avg((rank <= 10)::INTEGER), 6) AS hits10 FROM r")
def kg_completion_metrics(spark, d):
    rows = read_table(spark, d, "events").select("event_id", "user_id", "value", (F.col("event_type") == "purchase").alias("gold"))
    above = Window.partitionBy("user_id").orderBy(F.desc("value"))
    # equal values share a range, so the own value's negatives are taken off again
    same = Window.partitionBy("user_id", "value")
    negative = F.when(F.col("gold"), 0).otherwise(1)
    rank = 1 + F.sum(negative).over(above) - F.sum(negative).over(same)
    ranked = rows.withColumn("rank", rank).where("gold")
    hit = lambda k: F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"hits{k}")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rank"), 6).alias("mr"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), hit(1), hit(10))


@query("relation_spmm", "SELECT l_suppkey AS node, min(l_quantity * p_retailprice) AS low, max(l_quantity * p_retailprice) AS high FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def relation_spmm(spark, d):
    """Minimum and maximum over products along edges."""
    rows = read_table(spark, d, "lineitem").join(read_table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    value = F.col("l_quantity") * F.col("p_retailprice")
    return rows.groupBy(F.col("l_suppkey").alias("node")).agg(F.min(value).alias("low"), F.max(value).alias("high"))


@query("evidence_collection", f"WITH {FACTS}, r AS (SELECT s, p, o, chunk, row_number() OVER (PARTITION BY s ORDER BY chunk, o) AS n FROM facts) SELECT s, string_agg(o, '|' ORDER BY n) AS objects, count(*) AS n FROM r WHERE n <= 15 GROUP BY s")
def evidence_collection(spark, d):
    order = Window.partitionBy("s").orderBy("chunk", "o")
    rows = fx.facts(spark, d).withColumn("n", F.row_number().over(order)).where("n <= 15")
    out = rows.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("n", "o"))).alias("x"), F.count(F.lit(1)).alias("n"))
    return out.select("s", F.array_join(F.transform("x", lambda y: y["o"]), "|").alias("objects"), "n")


@query("completed_validation", f"WITH {FACTS}, c AS (SELECT 'customer ' || c_custkey AS s, 'near' AS p, 'customer ' || (c_custkey + c_nationkey) AS o FROM customer UNION ALL SELECT s, p, o FROM facts) SELECT DISTINCT s, p, o FROM c WHERE s <> o EXCEPT SELECT s, p, o FROM facts")
def completed_validation(spark, d):
    """Completed triples without known ones and self references."""
    near = read_table(spark, d, "customer").select(F.concat(F.lit("customer "), "c_custkey").alias("s"), F.lit("near").alias("p"), F.concat(F.lit("customer "), (F.col("c_custkey") + F.col("c_nationkey")).cast("string")).alias("o"))
    known = fx.facts(spark, d).select("s", "p", "o").distinct()
    return near.union(known).where("s <> o").distinct().join(known, ["s", "p", "o"], "left_anti")


@query("candidate_cap", "SELECT l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS n, count(*) OVER (PARTITION BY l_suppkey) AS c FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) WHERE n <= ceil(c * 0.1)")
def candidate_cap(spark, d):
    rows = read_table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    own = Window.partitionBy("l_suppkey")
    rows = rows.withColumn("n", F.row_number().over(own.orderBy("l_partkey"))).withColumn("c", F.count(F.lit(1)).over(own))
    return rows.where(F.col("n") <= F.ceil(F.col("c") * F.lit(0.1))).select("l_suppkey", "l_partkey")


@query("index_cache_state", "SELECT count(*) AS docs, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS cached, count(*) FILTER (WHERE l.doc_id IS NULL) AS fresh, bool_and(l.doc_id IS NOT NULL) AS complete FROM documents d LEFT JOIN labels l USING (doc_id)")
def index_cache_state(spark, d):
    labels = read_table(spark, d, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    rows = read_table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("hit").isNotNull()).alias("cached"), F.count_if(F.col("hit").isNull()).alias("fresh"), F.bool_and(F.col("hit").isNotNull()).alias("complete"))


@query("status_machine", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'FAILED' WHEN quality = 1 THEN 'PROCESSED' ELSE 'PENDING' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def status_machine(spark, d):
    """PENDING documents go to PROCESSED or FAILED by the outcome of their work."""
    rows = read_table(spark, d, "documents").select("doc_id").join(read_table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("toxic") == 1, "FAILED").when(F.col("quality") == 1, "PROCESSED").otherwise("PENDING").alias("status"))


@query("hidden_usage", "SELECT count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS hidden, round(count(*) FILTER (WHERE l_returnflag = 'R') / greatest(1, count(*)), 6) AS ratio FROM lineitem")
def hidden_usage(spark, d):
    hidden = F.count_if(F.col("l_returnflag") == "R")
    return read_table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("total"), hidden.alias("hidden"), F.round(hidden / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("ratio"))


@query("mape", "SELECT event_type, round(avg(abs(value - event_id % 100) / greatest(event_id % 100, 1)), 6) AS mape FROM events GROUP BY event_type")
def mape(spark, d):
    true = F.pmod("event_id", F.lit(100))
    return read_table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(F.abs(F.col("value") - true) / F.greatest(true, F.lit(1))), 6).alias("mape"))


@query("cosine_pairs", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    rows = read_table(spark, d, "embeddings")
    a, b = rows.select("vec_id", F.col("embedding").alias("x")), rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(A.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("induced_subgraph", f"WITH {FACTS}, e AS (SELECT DISTINCT s, o FROM facts), k AS (SELECT 'supplier ' || s_suppkey AS n FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'part ' || p_partkey FROM part WHERE p_size > 25) SELECT s AS src, o AS dst FROM e WHERE s IN (SELECT n FROM k) AND o IN (SELECT n FROM k)")
def induced_subgraph(spark, d):
    nodes = read_table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("supplier "), "s_suppkey").alias("n")).union(read_table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("part "), "p_partkey")))
    edges = fx.facts(spark, d).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()
    return edges.join(nodes.withColumnRenamed("n", "src"), "src", "left_semi").join(nodes.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst")


@query("walk_degree_bound", f"WITH {FACTS}, e AS (SELECT s, o, count(*) AS w FROM facts GROUP BY ALL) SELECT s AS node, sum(least(w, 5))::DOUBLE AS strength FROM e GROUP BY s")
def walk_degree_bound(spark, d):
    rows = fx.facts(spark, d).groupBy("s", "o").agg(F.count(F.lit(1)).alias("w"))
    return rows.groupBy(F.col("s").alias("node")).agg(F.sum(F.least("w", F.lit(5))).cast("double").alias("strength"))


@query("edge_view", f"WITH {FACTS} SELECT s AS source, o AS target, count(*) AS weight FROM facts WHERE s = 'supplier 1' GROUP BY s, o")
def edge_view(spark, d):
    """Batch read of a node's incident edges."""
    return fx.facts(spark, d).where("s = 'supplier 1' OR o = 'supplier 1'").groupBy(F.col("s").alias("source"), F.col("o").alias("target")).agg(F.count(F.lit(1)).alias("weight"))
