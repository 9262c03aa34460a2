"""Stores, exports and queues: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import extensions as X
from ..operators import facts as fx
from ..operators import hooks
from ..operators import mutate as M
from ..session import read_table, shared_dir
from ..sources import formats
from .registry import query

FACTS = fx.SQL


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("pending_chunks", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending_chunks(spark, d):
    """Chunks without a complete extraction in a stored file; empty extractions are incomplete (survey 1.7, 1.38)."""
    labels = read_table(spark, d, "labels").select("doc_id", "quality").distinct()
    found = F.when(F.col("quality") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    path = _folder(spark, "openie")
    formats.write_openie(labels.select(F.col("doc_id").cast("string").alias("idx"), F.lit("text").alias("passage"), found.alias("extracted_entities"), F.array().cast("array<array<string>>").alias("extracted_triples")), path)
    docs = read_table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("idx"))
    return formats.pending_chunks(docs, formats.read_openie(spark, path)).select("doc_id")


@query("vector_upsert", "SELECT 'chunk-' || md5(text) AS hash_id, max(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS was_stored FROM documents GROUP BY 1")
def vector_upsert(spark, d):
    """Rows whose id a store lacks are added, stored ones stay (survey 1.20, 1.4)."""
    docs = read_table(spark, d, "documents").select(T.md5_id(F.col("text"), "chunk-").alias("hash_id"), "doc_id").groupBy("hash_id").agg(F.max((F.col("doc_id") % 2 == 0).cast("int")).alias("even"))
    row = lambda old: docs.where("even = 1" if old else "even >= 0").select("hash_id", F.lit("old" if old else "new").alias("content"), F.array(F.lit(1.0)).alias("embedding"))
    folder = _folder(spark, "vectors")
    formats.EmbeddingStore(spark, folder, "chunk").upsert(row(True))
    formats.EmbeddingStore(spark, folder, "chunk").upsert(row(False))  # another session's object finds what is stored
    return formats.EmbeddingStore(spark, folder, "chunk").load().select("hash_id", (F.col("content") == "old").cast("int").alias("was_stored"))


@query("vector_delete", "SELECT DISTINCT 'chunk-' || md5(text) AS hash_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)")
def vector_delete(spark, d):
    """Rows deleted by id from a store (survey 1.5)."""
    docs = read_table(spark, d, "documents").select(T.md5_id(F.col("text"), "chunk-").alias("hash_id"), "doc_id", F.lit("").alias("content"), F.array(F.lit(1.0)).alias("embedding"))
    folder = _folder(spark, "vectors")
    formats.EmbeddingStore(spark, folder, "chunk").upsert(docs)
    formats.EmbeddingStore(spark, folder, "chunk").delete(docs.where("doc_id % 3 = 0"))
    return formats.EmbeddingStore(spark, folder, "chunk").load().select("hash_id")


@query(
    "embed_missing",
    "SELECT 'chunk-' || md5(text) AS hash_id, bool_or(doc_id % 2 = 0) AS stored, CASE WHEN bool_or(doc_id % 2 = 0) THEN -1 ELSE length(text) END AS value FROM documents WHERE text IS NOT NULL GROUP BY text",
)
def embed_missing(spark, d):
    """Texts are embedded only where a store lacks them (survey 1.4): stored vectors stay as they were."""
    docs = read_table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("content"))
    store = formats.EmbeddingStore(spark, _folder(spark, "vectors"), "chunk")
    embed = lambda value: lambda rows: rows.withColumn("embedding", F.array(value.cast("float")))
    store.insert_missing(docs.where("doc_id % 2 = 0"), "chunk-", embed(F.lit(-1)))
    again = formats.EmbeddingStore(spark, store.table.folder.rsplit("/", 1)[0], "chunk")
    again.insert_missing(docs, "chunk-", embed(F.length("content")))
    return again.load().select("hash_id", (F.col("embedding")[0] < 0).alias("stored"), F.col("embedding")[0].cast("long").alias("value"))


@query(
    "graph_upsert",
    "WITH e AS (SELECT least('s' || l_suppkey, 'p' || l_partkey) AS src, greatest('s' || l_suppkey, 'p' || l_partkey) AS dst, l_linestatus AS f, max(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2, 3) "
    "SELECT src, dst, coalesce(max(weight) FILTER (WHERE f = 'O'), max(weight)) AS weight FROM e WHERE src <> 's1' AND dst <> 's1' GROUP BY src, dst",
)
def graph_upsert(spark, d):
    """A stored graph gets more edges, which replace those of their pairs, and loses a node, each by another object (survey 1.10, 11.22)."""
    rows = read_table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_quantity").alias("weight"), "l_linestatus")
    folder = _folder(spark, "graph")
    for flag in ("F", "O"):
        edges = rows.where(F.col("l_linestatus") == flag)
        X.ParquetGraph(spark, folder).upsert(edges.select(F.explode(F.array("src", "dst")).alias("node")), edges)
    X.ParquetGraph(spark, folder).delete(spark.range(1).select(F.lit("s1").alias("node")))
    return X.ParquetGraph(spark, folder).edges()


@query("rerank_hook", "SELECT o_custkey AS q, o_orderkey AS id, CASE WHEN o_totalprice > 100000 THEN round(o_totalprice / 1000, 3) END AS rerank_score FROM orders")
def rerank_hook(spark, d):
    """Rows with the scores that a reranker gave, those that it left out without (survey 14.4)."""
    rows = read_table(spark, d, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"), "o_totalprice")
    scores = rows.where("o_totalprice > 100000").select("q", "id", F.round(F.col("o_totalprice") / 1000, 3).alias("score"))
    return hooks.reranked(rows.drop("o_totalprice"), scores).select("q", "id", "rerank_score")


@query("merge_id_lists", "WITH i AS (SELECT o_custkey, o_orderkey, 'id-' || (o_orderkey % 50) AS x, o_orderstatus = 'F' AS old FROM orders), f AS (SELECT o_custkey, x, min(CASE WHEN old THEN 0 ELSE 1000000000 END + o_orderkey) AS pos FROM i GROUP BY 1, 2) SELECT o_custkey, string_agg(x, ',' ORDER BY pos) AS ids FROM f GROUP BY 1")
def merge_id_lists(spark, d):
    """The ordered union of old and new ids (survey 4.14)."""
    listed = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("o_orderkey", F.concat(F.lit("id-"), (F.col("o_orderkey") % 50).cast("string")).alias("x"))))), lambda s: s["x"])
    old = F.col("o_orderstatus") == "F"
    rows = read_table(spark, d, "orders").groupBy("o_custkey").agg(listed(old).alias("old"), listed(~old).alias("new"))
    return rows.select("o_custkey", F.array_join(A.merge_ids(F.col("old"), F.col("new")), ",").alias("ids"))


@query("graph_export_md", f"WITH {FACTS} SELECT '| ' || s || ' | ' || o || ' | ' || count(*) || ' |' AS line FROM facts GROUP BY s, o")
def graph_export_md(spark, d):
    """Edges as lines of a Markdown table, written as text and read again (survey 1.35)."""
    rows = fx.facts(spark, d).groupBy("s", "o").agg(F.count(F.lit(1)).cast("string").alias("n"))
    path = _folder(spark, "export-md")
    formats.write_markdown(rows, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("graph_export_txt", f"WITH {FACTS} SELECT DISTINCT s || chr(9) || p || chr(9) || o AS line FROM facts")
def graph_export_txt(spark, d):
    """Triples as lines of tabbed text, written and read again (survey 1.35)."""
    path = _folder(spark, "export-txt")
    fx.facts(spark, d).select("s", "p", "o").distinct().select(F.concat_ws("\t", "s", "p", "o").alias("value")).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("stage1_relations", f"WITH {FACTS} SELECT p AS name, count(*)::VARCHAR AS uses FROM facts GROUP BY p")
def stage1_relations(spark, d):
    """The relation file of the first stage (survey 1.36)."""
    path = _folder(spark, "relations")
    formats.write_csv(fx.facts(spark, d).groupBy(F.col("p").alias("name")).agg(F.count(F.lit(1)).alias("uses")), path)
    return spark.read.csv(path, header=True)


@query("stage1_edges", f"WITH {FACTS} SELECT DISTINCT s AS source, p AS relation, o AS target FROM facts")
def stage1_edges(spark, d):
    """The edge file of the first stage (survey 1.36)."""
    path = _folder(spark, "edges")
    formats.write_csv(fx.facts(spark, d).select(F.col("s").alias("source"), F.col("p").alias("relation"), F.col("o").alias("target")).distinct(), path)
    return spark.read.csv(path, header=True)


@query(
    "queue_advance",
    "WITH q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'PROCESSED' ELSE 'FAILED' END AS status, (doc_id % 3)::INTEGER AS attempts FROM documents), l AS (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 'rejected' END) AS error, true AS has FROM labels GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN status = 'PROCESSED' THEN status WHEN has AND error IS NOT NULL THEN 'FAILED' WHEN has THEN 'PROCESSED' ELSE 'PENDING' END AS status, attempts + CASE WHEN has AND status <> 'PROCESSED' THEN 1 ELSE 0 END AS attempts, CASE WHEN status <> 'PROCESSED' THEN error END AS error FROM q LEFT JOIN l USING (doc_id)",
)
def queue_advance(spark, d):
    """A round of the document queue: what is done, failed and to be taken up again (survey 13.1, 13.4)."""
    states = F.array(*[F.lit(s) for s in ("PENDING", "PROCESSING", "PROCESSED", "FAILED")])
    queue = read_table(spark, d, "documents").select("doc_id", F.element_at(states, (F.col("doc_id") % 4 + 1).cast("int")).alias("status"), (F.col("doc_id") % 3).cast("int").alias("attempts"))
    return M.advance_queue(queue, read_table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "rejected").alias("error")))


@query("timing_sums", "SELECT event_type, round(sum(value), 6) AS seconds, count(*) AS calls, count(*) FILTER (WHERE (props->>'k')::BIGINT < 50) AS hits FROM events GROUP BY 1")
def timing_sums(spark, d):
    """Time spent, calls and cache hits by step (survey 4.24)."""
    hit = F.get_json_object("props", "$.k").cast("long") < 50
    return read_table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 6).alias("seconds"), F.count(F.lit(1)).alias("calls"), F.count_if(hit).alias("hits"))
