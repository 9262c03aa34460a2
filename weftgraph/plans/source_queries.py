"""Sources and sinks: written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts as fx
from ..session import read_table, shared_dir
from ..sources import formats
from .registry import query

FACTS = fx.SQL


def _path(spark, tag):
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query("embedding_store", "SELECT 'entity-' || md5(vec_id::VARCHAR) AS hash_id, vec_id::VARCHAR AS content, len(embedding) AS dim FROM embeddings")
def embedding_store(spark, d):
    rows = read_table(spark, d, "embeddings").select(T.md5_id(F.col("vec_id").cast("string"), "entity-").alias("hash_id"), F.col("vec_id").cast("string").alias("content"), "embedding")
    store = formats.EmbeddingStore(spark, _path(spark, "vectors"), "entity")
    store.save(rows)
    return store.load().select("hash_id", "content", F.size("embedding").cast("long").alias("dim"))


@query("openie_json", f"WITH {FACTS} SELECT md5(chunk::VARCHAR) AS idx, count(DISTINCT s || '|' || p || '|' || o) AS triples FROM facts GROUP BY chunk")
def openie_json(spark, d):
    """Extraction results as JSON lines, and back as triples."""
    rows = fx.facts(spark, d).groupBy("chunk").agg(F.collect_set(F.array("s", "p", "o")).alias("extracted_triples"))
    docs = rows.select(F.md5(F.col("chunk").cast("string")).alias("idx"), F.col("chunk").cast("string").alias("passage"), F.array_distinct(F.flatten(F.transform("extracted_triples", lambda t: F.array(t[0], t[2])))).alias("extracted_entities"), "extracted_triples")
    path = _path(spark, "openie")
    formats.write_openie(docs, path)
    return formats.read_openie(spark, path).select("idx", F.size("extracted_triples").cast("long").alias("triples"))


@query("triple_file", f"WITH {FACTS} SELECT s, p, o, count(*) AS n FROM facts GROUP BY ALL")
def triple_file(spark, d):
    path = _path(spark, "kg")
    fx.facts(spark, d).select(F.concat_ws(",", "s", "p", "o").alias("value")).write.text(path)
    return formats.read_triples(spark, path).groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n"))


@query("graph_export_csv", f"WITH {FACTS} SELECT s AS source, o AS target, count(*)::VARCHAR AS weight FROM facts GROUP BY s, o")
def graph_export_csv(spark, d):
    edges = fx.facts(spark, d).groupBy(F.col("s").alias("source"), F.col("o").alias("target")).agg(F.count(F.lit(1)).alias("weight"))
    path = _path(spark, "export")
    formats.write_csv(edges, path)
    return spark.read.csv(path, header=True, schema="source string, target string, weight string")


@query("stage1_nodes", "SELECT 'part ' || p_partkey AS name, 'entity' AS type, '{\"brand\":\"' || p_brand || '\",\"size\":\"' || p_size || '\"}' AS attributes FROM part")
def stage1_nodes(spark, d):
    rows = read_table(spark, d, "part").select(F.concat(F.lit("part "), "p_partkey").alias("name"), F.lit("entity").alias("type"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")).alias("attributes"))
    return formats.stage1_nodes(rows)


@query("document_entities", f"WITH {FACTS} SELECT chunk::VARCHAR AS document, array_to_string(list_sort(list(DISTINCT e)), '|') AS entities FROM (SELECT chunk, s AS e FROM facts UNION ALL SELECT chunk, o FROM facts) GROUP BY chunk")
def document_entities(spark, d):
    rows = fx.facts(spark, d).select("chunk", F.explode(F.array("s", "o")).alias("e")).groupBy("chunk").agg(F.array_sort(F.collect_set("e")).alias("entities"))
    path = _path(spark, "doc2ent")
    rows.select(F.col("chunk").cast("string").alias("document"), "entities").write.json(path)
    back = spark.read.schema("document string, entities array<string>").json(path)
    return back.select("document", F.array_join("entities", "|").alias("entities"))


@query("latest_metrics", "SELECT user_id AS name, max_by(event_id, ts) AS newest FROM events GROUP BY user_id")
def latest_metrics(spark, d):
    return read_table(spark, d, "events").groupBy(F.col("user_id").alias("name")).agg(F.max_by("event_id", "ts").alias("newest"))


@query("corpus_normalise", r"SELECT 'docs__chunk_' || lpad(doc_id::VARCHAR, 6, '0') AS chunk_id, source || chr(10) || text AS content FROM documents")
def corpus_normalise(spark, d):
    return read_table(spark, d, "documents").select(F.concat(F.lit("docs__chunk_"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("chunk_id"), F.concat_ws("\n", "source", "text").alias("content"))


@query("ordered_point_reads", "SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS ord, n_chars FROM (SELECT DISTINCT doc_id FROM labels) JOIN documents USING (doc_id)")
def ordered_point_reads(spark, d):
    from pyspark.sql import Window

    rows = read_table(spark, d, "labels").select("doc_id").distinct().join(read_table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("doc_id"))))


@query("entity_rename_history", "SELECT c_custkey, upper(c_name) AS name FROM customer")
def entity_rename_history(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", F.upper("c_name").alias("name"))
