"""Set operations, deduplication and life-cycle operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts as fx
from ..operators import mutate as M
from ..session import read_table
from .registry import query

FACTS = fx.SQL


@query("missing_hash_ids", "SELECT DISTINCT 'chunk-' || md5(text) AS hash_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM benchmark)")
def missing_hash_ids(spark, d):
    ids = read_table(spark, d, "documents").select(T.md5_id(F.col("text"), "chunk-").alias("hash_id")).distinct()
    return ids.join(read_table(spark, d, "benchmark").select(T.md5_id(F.col("text"), "chunk-").alias("hash_id")), "hash_id", "left_anti")


@query("insert_if_absent", "SELECT hash_id, min(text) AS content FROM (SELECT 'chunk-' || md5(text) AS hash_id, text FROM documents UNION ALL SELECT 'chunk-' || md5(text), text FROM benchmark) GROUP BY hash_id")
def insert_if_absent(spark, d):
    stored = read_table(spark, d, "benchmark").select("text").distinct()
    return M.insert_if_absent(stored, read_table(spark, d, "documents").select("text"), "chunk-")


@query("embedding_delete", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)")
def embedding_delete(spark, d):
    gone = read_table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    return read_table(spark, d, "embeddings").select("vec_id", "label").join(gone, "vec_id", "left_anti")


@query("filter_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def filter_keys(spark, d):
    return read_table(spark, d, "customer").select("c_custkey").exceptAll(read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()).distinct()


@query("kv_upsert", "SELECT user_id, max_by(event_type, event_id) AS event_type, min(event_id) AS create_time, max(event_id) AS update_time FROM events GROUP BY user_id")
def kv_upsert(spark, d):
    from ..operators.merge import keyed_upsert

    rows = read_table(spark, d, "events").select("user_id", "event_type", "event_id")
    stored, new = rows.where("event_type = 'click'"), rows.where("event_type <> 'click'")
    return keyed_upsert(stored, new, "user_id", "event_id").select("user_id", "event_type", "create_time", "update_time")


@query("kv_get_by_ids", "SELECT conv_id, turn AS ord, doc_id, coalesce(n_chars, 0) AS n_chars FROM conversations LEFT JOIN documents ON doc_id = conv_id")
def kv_get_by_ids(spark, d):
    ids = read_table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"))
    docs = read_table(spark, d, "documents").select("doc_id", "n_chars")
    return ids.join(docs, F.col("doc_id") == F.col("conv_id"), "left").select("conv_id", "ord", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


@query("delete_entity_relation", "SELECT count(*) AS n FROM lineitem WHERE NOT (l_suppkey = 1 OR l_partkey = 1)")
def delete_entity_relation(spark, d):
    return read_table(spark, d, "lineitem").where(~((F.col("l_suppkey") == 1) | (F.col("l_partkey") == 1))).agg(F.count(F.lit(1)).alias("n"))


@query("new_nodes", f"WITH {FACTS} SELECT DISTINCT e FROM (SELECT s AS e FROM facts UNION ALL SELECT o FROM facts) WHERE e NOT IN (SELECT 'part ' || p_partkey FROM part)")
def new_nodes(spark, d):
    ends = fx.facts(spark, d).select(F.explode(F.array("s", "o")).alias("e")).distinct()
    return ends.join(read_table(spark, d, "part").select(F.concat(F.lit("part "), "p_partkey").alias("e")), "e", "left_anti")


@query("augmented_union", "SELECT hash, min(kind) AS kind FROM (SELECT md5(text) AS hash, 'hidden' AS kind FROM benchmark UNION ALL SELECT md5(text), 'zbase' FROM documents) GROUP BY hash")
def augmented_union(spark, d):
    """On an equal id the hidden row replaces the base row."""
    base = read_table(spark, d, "documents").select(F.md5("text").alias("hash"), F.lit("zbase").alias("kind"))
    hidden = read_table(spark, d, "benchmark").select(F.md5("text").alias("hash"), F.lit("hidden").alias("kind"))
    return base.distinct().join(hidden, "hash", "left_anti").unionByName(hidden.distinct())


@query("stage1_merge", f"WITH {FACTS} SELECT DISTINCT s AS source, p AS relation, o AS target FROM facts UNION SELECT 'part ' || p_partkey, 'of_brand', p_brand FROM part")
def stage1_merge(spark, d):
    brands = read_table(spark, d, "part").select(F.concat(F.lit("part "), "p_partkey").alias("source"), F.lit("of_brand").alias("relation"), F.col("p_brand").alias("target"))
    return fx.facts(spark, d).select(F.col("s").alias("source"), F.col("p").alias("relation"), F.col("o").alias("target")).union(brands).distinct()


@query("jaccard", "WITH s AS (SELECT l_suppkey AS k, list(DISTINCT l_partkey) AS m FROM lineitem GROUP BY 1) SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.m, b.m)) / len(list_distinct(a.m || b.m)), 6) AS jaccard FROM s a JOIN s b ON b.k = a.k + 1")
def jaccard(spark, d):
    from ..functions import arrays as A

    sets = read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("m"))
    a, b = sets.select(F.col("l_suppkey").alias("a"), F.col("m").alias("ma")), sets.select(F.col("l_suppkey").alias("b"), F.col("m").alias("mb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(A.jaccard(F.col("ma"), F.col("mb")), 6).alias("jaccard"))


@query("prediction_dedupe", "SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS first FROM orders GROUP BY o_custkey")
def prediction_dedupe(spark, d):
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = read_table(spark, d, "orders").withColumn("n", F.row_number().over(order)).where("n = 1")
    return rows.select("o_custkey", F.col("o_orderpriority").alias("first"))


@query(
    "enqueue_dedupe",
    "SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY md5(text)) THEN 'doc-' || md5(text) ELSE 'dup-' || md5(text || doc_id) END AS id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY md5(text)) THEN 'PENDING' ELSE 'FAILED' END AS status FROM documents",
)
def enqueue_dedupe(spark, d):
    return M.enqueue(read_table(spark, d, "documents").select("doc_id", "text"))


@query("set_recall", "WITH g AS (SELECT l_orderkey, list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R') AS gold, list(DISTINCT l_suppkey) FILTER (WHERE l_linenumber <= 2) AS got FROM lineitem GROUP BY 1) SELECT l_orderkey, round(len(list_intersect(gold, got)) / len(gold), 6) AS recall FROM g WHERE len(gold) > 0 AND got IS NOT NULL")
def set_recall(spark, d):
    rows = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("gold"), F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_suppkey"))).alias("got"))
    return rows.where((F.size("gold") > 0) & (F.size("got") > 0)).select("l_orderkey", F.round(F.size(F.array_intersect("gold", "got")) / F.size("gold"), 6).alias("recall"))


@query("custom_chunk_insert", "SELECT DISTINCT 'chunk-' || md5(text) AS chunk_id FROM conversations WHERE md5(text) NOT IN (SELECT md5(text) FROM documents)")
def custom_chunk_insert(spark, d):
    ids = lambda t: read_table(spark, d, t).select(T.md5_id(F.col("text"), "chunk-").alias("chunk_id"))
    return ids("conversations").distinct().join(ids("documents"), "chunk_id", "left_anti")


@query("documents_by_ids", "SELECT item_id, doc_id IS NOT NULL AS found FROM benchmark LEFT JOIN documents ON doc_id = item_id")
def documents_by_ids(spark, d):
    ids = read_table(spark, d, "benchmark").select("item_id")
    return ids.join(read_table(spark, d, "documents").select("doc_id"), F.col("doc_id") == F.col("item_id"), "left").select("item_id", F.col("doc_id").isNotNull().alias("found"))


_SRC = "SELECT l_partkey AS name, list(DISTINCT l_orderkey) AS src FROM lineitem GROUP BY 1"


@query("delete_document", f"WITH e AS ({_SRC}), g AS (SELECT list(o_orderkey) AS gone FROM orders WHERE o_orderstatus = 'P') SELECT name, CASE WHEN len(list_filter(src, lambda x: NOT list_contains(gone, x))) = 0 THEN 'delete' WHEN len(list_filter(src, lambda x: NOT list_contains(gone, x))) < len(src) THEN 'rebuild' ELSE 'untouched' END AS action FROM e, g")
def delete_document(spark, d):
    sources = read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("source")).distinct()
    gone = read_table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("source"))
    return M.deletion_plan(sources, gone)


@query("merge_entities", "WITH e AS (SELECT CASE WHEN l_suppkey IN (2, 3) THEN 1 ELSE l_suppkey END AS a, l_partkey + 1000000 AS b, l_quantity AS w FROM lineitem) SELECT least(a, b) AS src, greatest(a, b) AS tgt, max(w) AS weight FROM e WHERE a <> b GROUP BY 1, 2")
def merge_entities(spark, d):
    edges = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("tgt"), F.col("l_quantity").alias("weight"))
    return M.merge_nodes(edges, [2, 3], 1)


@query("rename_entity", "SELECT CASE WHEN l_suppkey = 1 THEN 999999 ELSE l_suppkey END AS src, l_partkey + 1000000 AS tgt, count(*) AS n FROM lineitem GROUP BY ALL")
def rename_entity(spark, d):
    edges = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("tgt"))
    return M.rename_node(edges, 1, 999999).groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("n"))


@query("delete_entity", f"WITH {FACTS} SELECT s, p, o FROM facts WHERE s <> 'supplier 1' AND o <> 'supplier 1'")
def delete_entity(spark, d):
    return fx.facts(spark, d).select("s", "p", "o").where((F.col("s") != "supplier 1") & (F.col("o") != "supplier 1"))


@query("edit_overlay", "SELECT p_partkey, p_name, coalesce(CASE WHEN p_size > 25 THEN 'big' END, p_type) AS p_type FROM part")
def edit_overlay(spark, d):
    rows = read_table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    edits = read_table(spark, d, "part").where("p_size > 25").select("p_partkey", F.lit("big").alias("p_type"))
    return M.overlay(rows, edits, "p_partkey")


@query("graph_delete_documents", f"WITH {FACTS}, k AS (SELECT * FROM facts WHERE chunk NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) SELECT DISTINCT s, p, o FROM facts EXCEPT SELECT DISTINCT s, p, o FROM k")
def graph_delete_documents(spark, d):
    """Triples that no surviving chunk supports."""
    rows = fx.facts(spark, d)
    gone = read_table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("chunk"))
    return M.unsupported(rows, gone)


@query("document_consistency", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'deleted' WHEN l.quality = 0 THEN 'FAILED' ELSE 'PENDING' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def document_consistency(spark, d):
    docs, full = read_table(spark, d, "documents").select("doc_id"), read_table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(full.withColumn("has", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("has").isNull(), "deleted").when(F.col("quality") == 0, "FAILED").otherwise("PENDING").alias("status"))
