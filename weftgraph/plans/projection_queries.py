"""Projections of samples, metrics and answers; sources; replaceable functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import extensions as X
from ..operators import projections as P
from ..session import read_table, shared_dir
from ..sources import books
from .registry import query


@query("triple_normalise", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber >= 3 AND l_returnflag <> 'A' THEN 's' || l_suppkey || '|has|p' || l_partkey END AS triple FROM lineitem")
def triple_normalise(spark, d):
    """Triples of three or more parts, the first three trimmed, none empty (survey 2.3)."""
    middle = F.when(F.col("l_returnflag") == "A", "  ").otherwise(" has ")
    parts = F.slice(F.array(F.concat(F.lit(" s"), "l_suppkey"), middle, F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("\n")), F.lit("more"), F.lit("")), F.lit(1), F.col("l_linenumber"))
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(P.three_parts(parts), "|").alias("triple"))


def _samples(spark, d):
    """A question for each customer: its orders are paragraphs, those of status F support it."""
    rows = read_table(spark, d, "orders")
    para = F.struct(F.col("o_orderkey").alias("at"), F.concat(F.lit(" order "), (F.col("o_orderkey") % 100).cast("string")).alias("title"), F.array(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("sentences"), (F.col("o_orderstatus") == "F").alias("is_supporting"))
    return rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(para)).alias("paragraphs"))


_SAMPLES = "p AS (SELECT o_custkey, o_orderkey AS pos, ' order ' || (o_orderkey % 100) AS title, o_orderpriority, o_orderstatus, o_orderstatus = 'F' AS good FROM orders)"


@query("gold_documents", f"WITH {_SAMPLES}, g AS (SELECT DISTINCT o_custkey, title FROM p WHERE good), t AS (SELECT p.o_custkey, p.title || chr(10) || o_orderpriority || ' ' || o_orderstatus AS doc, min(pos) AS pos FROM p JOIN g ON g.o_custkey = p.o_custkey AND g.title = p.title GROUP BY 1, 2) SELECT c.o_custkey, coalesce(string_agg(doc, '#' ORDER BY pos, doc), '') AS docs FROM (SELECT DISTINCT o_custkey FROM p) c LEFT JOIN t USING (o_custkey) GROUP BY c.o_custkey")
def gold_documents(spark, d):
    """Whole texts of the supporting paragraphs (survey 2.16)."""
    titles = F.transform(F.filter("paragraphs", lambda p: p["is_supporting"]), lambda p: p["title"])
    return _samples(spark, d).select("o_custkey", F.array_join(P.gold_documents(titles, F.col("paragraphs"), " "), "#").alias("docs"))


@query("support_titles", f"WITH {_SAMPLES}, n AS (SELECT o_custkey, title, row_number() OVER (PARTITION BY o_custkey ORDER BY pos) - 1 AS i FROM p), w AS (SELECT unnest([3, -1, 0, 1000]) AS i, unnest([0, 1, 2, 3]) AS k) SELECT c.o_custkey, coalesce(string_agg(trim(title), ',' ORDER BY k), '') AS titles FROM (SELECT DISTINCT o_custkey FROM p) c LEFT JOIN (SELECT * FROM n JOIN w USING (i)) s USING (o_custkey) GROUP BY c.o_custkey")
def support_titles(spark, d):
    """Titles at the indexes that a question is broken into, those out of bounds skipped (survey 2.17)."""
    return _samples(spark, d).select("o_custkey", F.array_join(P.support_titles(F.array(F.lit(3), F.lit(-1), F.lit(0), F.lit(1000)), F.col("paragraphs")), ",").alias("titles"))


@query("gold_titles", f"WITH {_SAMPLES}, s AS (SELECT o_custkey, CASE o_custkey % 3 WHEN 0 THEN CASE WHEN pos % 2 = 0 THEN trim(title) END WHEN 1 THEN CASE WHEN good THEN trim(title) END ELSE CASE WHEN good THEN trim(title) END END AS t FROM p) SELECT o_custkey, coalesce(string_agg(DISTINCT t, ',' ORDER BY t), '') AS titles FROM s GROUP BY o_custkey")
def gold_titles(spark, d):
    """Gold titles of the first kind of evidence that a sample has (survey 2.20); every third customer has facts, paragraphs or contexts."""
    rows = _samples(spark, d)
    none, kind = F.slice("paragraphs", 1, 0), F.col("o_custkey") % 3
    facts = F.transform(F.filter("paragraphs", lambda p: p["at"] % 2 == 0), lambda p: p["title"])
    # a sample whose facts are all filtered away has no other kind either
    facts = F.when(kind == 0, facts).otherwise(F.array().cast("array<string>"))
    titles = P.gold_titles(facts, F.when(kind == 1, F.col("paragraphs")).otherwise(none), F.when(kind == 2, F.col("paragraphs")).otherwise(none))
    return rows.select("o_custkey", F.array_join(titles, ",").alias("titles"))


@query("numeric_metrics", "SELECT event_id, round(value, 2) AS f1, (event_id % 7)::DOUBLE AS hits, 2 AS n FROM events")
def numeric_metrics(spark, d):
    """Numbers of a metrics object, without private names, counts, texts and truth values (survey 2.18)."""
    made = F.to_json(F.struct(F.round("value", 2).alias("f1"), (F.col("event_id") % 7).alias("hits"), F.lit(9).alias("count"), F.lit(1.5).alias("_own"), F.lit("x").alias("name"), F.lit(True).alias("ok")))
    rows = read_table(spark, d, "events").select("event_id", P.numeric_metrics(made).alias("m"))
    return rows.select("event_id", F.col("m")["f1"].alias("f1"), F.col("m")["hits"].alias("hits"), F.size("m").alias("n"))


@query("ner_response", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name || '|' || p_brand END AS names FROM part")
def ner_response(spark, d):
    """Entity lists found in the text around them (survey 8.14)."""
    made = F.to_json(F.struct(F.array("p_name", "p_brand").alias("named_entities")))
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("none: {"), "p_name")).otherwise(F.concat(F.lit("Sure!\n```json\n"), made, F.lit("\n``` done")))
    return read_table(spark, d, "part").select("p_partkey", F.array_join(P.named_entities(said), "|").alias("names"))


@query(
    "openie_merge",
    "WITH k AS (SELECT doc_id, 'old' AS entities, 0 AS triples FROM documents WHERE doc_id % 3 = 0), n AS (SELECT doc_id, coalesce('q' || quality, '') AS entities, CASE WHEN toxic IS NULL THEN 0 ELSE 1 END AS triples FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 3 <> 0) SELECT * FROM k UNION ALL SELECT * FROM n",
)
def openie_merge(spark, d):
    """New chunks joined with what two extractions found; known chunks stay (survey 1.8)."""
    docs, labels = read_table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("passage")), read_table(spark, d, "labels").withColumnRenamed("doc_id", "chunk_id")
    known = docs.where("chunk_id % 3 = 0").select("chunk_id", "passage", F.array(F.lit("old")).alias("entities"), F.array().cast("array<array<string>>").alias("triples"))
    entities = labels.select("chunk_id", F.array(F.concat(F.lit("q"), "quality")).alias("entities"))
    triples = labels.select("chunk_id", F.array(F.array(F.lit("doc"), F.lit("is"), F.col("toxic").cast("string"))).alias("triples"))
    out = P.openie_merge(known, docs, entities, triples)
    return out.select(F.col("chunk_id").alias("doc_id"), F.array_join("entities", ",").alias("entities"), F.size("triples").alias("triples"))


@query("track_id_lookup", "SELECT event_id, event_type AS status FROM events WHERE user_id = 8")
def track_id_lookup(spark, d):
    """Status rows of one call (survey 13.5)."""
    status = read_table(spark, d, "events").select("event_id", F.col("event_type").alias("status"), F.concat(F.lit("insert_"), "user_id").alias("track_id"))
    return P.by_track_id(status, "insert_8").select("event_id", "status")


@query("list_loss", "WITH s AS (SELECT o_custkey AS q, o_totalprice / 100000 AS score, o_orderstatus = 'F' AS gold FROM orders), m AS (SELECT q, max(score) AS top FROM s GROUP BY q) SELECT q, round(ln(sum(exp(score - top))) - sum(CASE WHEN gold THEN score - top END) / count(*) FILTER (WHERE gold), 6) AS loss FROM s JOIN m USING (q) GROUP BY q HAVING count(*) FILTER (WHERE gold) > 0")
def list_loss(spark, d):
    """Cross entropy over a list of scores (survey 8.34)."""
    rows = read_table(spark, d, "orders").select(F.col("o_custkey").alias("q"), (F.col("o_totalprice") / 100000).alias("score"), (F.col("o_orderstatus") == "F").alias("gold"))
    return P.list_loss(rows).withColumn("loss", F.round("loss", 6))


@query("tokenizer_hook", "SELECT doc_id, octet_length(encode(text))::BIGINT AS tokens, CASE WHEN text = '' THEN 0 ELSE ceil(octet_length(encode(text)) / 900.0) END::BIGINT AS chunks FROM documents")
def tokenizer_hook(spark, d):
    """Chunks by a given tokenizer, here of bytes: their number and the document's tokens (survey 14.5, 14.1)."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    made = X.chunked(docs, X.BytesTokenizer(), X.token_chunker, 1000, 100).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return docs.join(made, "doc_id", "left").select("doc_id", F.octet_length("text").cast("long").alias("tokens"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("split_chunks", "WITH p AS (SELECT item_id, unnest(string_split(text, '.')) AS piece, generate_subscripts(string_split(text, '.'), 1) - 1 AS k FROM benchmark) SELECT item_id, k::INTEGER AS chunk_order_index, octet_length(encode(piece))::INTEGER AS tokens, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS content FROM p")
def split_chunks(spark, d):
    """Pieces between full stops by a chunking function; none is longer than a window here (survey 14.1, 9.1)."""
    docs = read_table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return X.chunked(docs, X.BytesTokenizer(), X.split_chunker("."), 1_000_000, 0).withColumnRenamed("doc_id", "item_id")


@query("metric_hook", "SELECT 'em' AS metric, round(avg((lower(o_orderstatus) = lower(CASE WHEN o_orderkey % 2 = 0 THEN 'f' ELSE 'O' END))::INTEGER), 9) AS score FROM orders UNION ALL SELECT 'length', round(avg(1.0 / length(o_orderpriority)), 9) FROM orders")
def metric_hook(spark, d):
    """Pooled scores of several metrics, one of them given by the caller (survey 14.9)."""
    rows = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("gold"), F.when(F.col("o_orderkey") % 2 == 0, " f ").otherwise("O").alias("predicted"), F.col("o_orderpriority").alias("said"))
    pooled, _ = X.measured(rows, {"em": X.exact_match, "length": lambda r: r.select("id", (1 / F.length("said")).alias("score"))})
    return pooled.withColumn("score", F.round("score", 9))


@query("graph_store", "SELECT least('s' || l_suppkey, 'p' || l_partkey) AS src, greatest('s' || l_suppkey, 'p' || l_partkey) AS dst, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2")
def graph_store(spark, d):
    """A graph written and read as nodes and edges by variant (survey 1.10, 1.23)."""
    rows = read_table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), F.col("l_quantity").alias("weight"), "l_linenumber")
    turn = F.col("l_linenumber") % 2 == 0
    edges = rows.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("dst"), "weight")
    graph = X.STORES["graph", "parquet"](spark, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}", "augmented")
    if graph.edges().isEmpty():
        graph.upsert(rows.select(F.col("a").alias("node")).union(rows.select("b")), edges)
    return graph.edges()


@query("book_samples", "SELECT source AS book, count(*) AS samples, min(doc_id) AS first_id, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def book_samples(spark, d):
    """Raw JSON lines of books to sample and corpus files by book with a manifest, read back by the manifest (survey 1.12, 1.14)."""
    folder = f"{shared_dir(spark)}/books-{uuid.uuid4().hex}"
    read_table(spark, d, "documents").select(F.col("source").alias("book"), "doc_id", "text", "n_chars").write.json(f"{folder}/raw")
    books.convert(spark, f"{folder}/raw", f"{folder}/made")
    return books.load(spark, f"{folder}/made").groupBy("book").agg(F.count(F.lit(1)).alias("samples"), F.min("doc_id").alias("first_id"), F.sum("n_chars").alias("chars"))


@query("directory_scan", "SELECT event_type AS name FROM (SELECT DISTINCT event_type FROM events) WHERE event_type <> 'view'")
def directory_scan(spark, d):
    """Files of a folder whose names have a supported ending and which are not processed yet (survey 1.34)."""
    folder = f"{shared_dir(spark)}/inbox-{uuid.uuid4().hex}"
    read_table(spark, d, "events").select("event_type").distinct().select(F.col("event_type").alias("kind"), F.concat(F.lit("text of "), "event_type").alias("value")).repartition(4).write.partitionBy("kind").text(folder)
    status = spark.createDataFrame([("view", "processed"), ("click", "failed")], "name string, status string")
    files = books.new_files(spark, f"{folder}/*", (".txt",), status, lambda path: F.regexp_extract(path, "kind=([^/]+)/", 1))
    return files.select("name").distinct()
