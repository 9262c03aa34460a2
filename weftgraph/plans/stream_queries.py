"""Structured Streaming over the events table's files; final states equal the batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import read_table, shared_dir
from ..streaming import index as I
from ..streaming import status as S
from .registry import query


def _last(df, *keys):
    whole = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(whole, "batch_").alias("r")).select("r.*").drop("batch_")


def _events(spark, d):
    return S.read_stream(spark, d, "events")


@query("stream_status_latest", "SELECT user_id, max_by(event_type, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY user_id")
def stream_status_latest(spark, d):
    return _last(S.run_to_end(S.latest_status(_events(spark, d)), "update"), "user_id")


@query("stream_dedupe", "SELECT DISTINCT user_id, props FROM events")
def stream_dedupe(spark, d):
    return S.run_to_end(S.deduplicated(_events(spark, d)), "append").drop("batch_")


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    return _last(S.run_to_end(S.windowed(_events(spark, d)), "update"), "start", "event_type")


def _followed(spark, d):
    """Documents that come in three parts and the first of them once more, each seen by a stream of its own run (survey 13.1, 13.3)."""
    folder = f"{shared_dir(spark)}/follow-{uuid.uuid4().hex}"
    labels = read_table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    def outcome(rows):
        ended = F.when(F.col("toxic") == 1, "rejected").when(F.col("doc_id") % 10 == 7, I.UNFINISHED).otherwise(I.DONE)
        return rows.join(labels, "doc_id", "left").select("id", ended.alias("outcome"))

    work = I.Work(
        chunk=lambda rows: rows.select("id", F.explode(F.split("content", "\n")).alias("content")).where("content <> ''"),
        extract=lambda rows: rows.select("chunk", F.element_at(F.split("content", " "), 1).alias("fact")),
        outcome=outcome,
    )
    docs = read_table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    for k in (0, 1, 2, 0):
        docs.where(F.col("doc_id") % 3 == k).write.mode("append").parquet(f"{folder}/in")
        index = I.IncrementalIndex(spark, f"{folder}/index", work, most_attempts=2, time_out=2)
        index.follow(spark.readStream.schema(docs.schema).parquet(f"{folder}/in"), f"{folder}/checkpoint")
    return index


_ARRIVED = "a AS (SELECT md5(coalesce(text, '')) AS h, min(doc_id % 3) AS b FROM documents GROUP BY 1), r AS (SELECT h, b, min(doc_id) AS doc_id FROM documents JOIN a ON h = md5(coalesce(text, '')) AND b = doc_id % 3 GROUP BY h, b)"


@query(
    "incremental_states",
    f"WITH {_ARRIVED}, t AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) SELECT 'doc-' || h AS id, r.doc_id, CASE WHEN toxic = 1 THEN 'FAILED' WHEN r.doc_id % 10 = 7 THEN 'PROCESSING' ELSE 'PROCESSED' END AS status, "
    "(CASE WHEN toxic = 1 THEN least(2, 4 - b) WHEN r.doc_id % 10 = 7 THEN 1 + (3 - b) // 2 ELSE 1 END)::INTEGER AS attempts, CASE WHEN toxic = 1 THEN 'rejected' END AS error FROM r LEFT JOIN t USING (doc_id)",
)
def incremental_states(spark, d):
    return _followed(spark, d).load("states").select("id", "doc_id", "status", "attempts", "error")


@query(
    "incremental_chunks",
    f"WITH {_ARRIVED}, c AS (SELECT 'chunk-' || md5(line) AS chunk, line, b, h FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, b, h FROM documents JOIN a ON h = md5(coalesce(text, ''))) WHERE line <> '') "
    "SELECT chunk, min(b)::BIGINT AS batch, count(DISTINCT h) AS documents, min(string_split(line, ' ')[1]) AS fact FROM c GROUP BY chunk",
)
def incremental_chunks(spark, d):
    """Each chunk with the batch that extracted it, how many documents have it, and its fact."""
    index = _followed(spark, d)
    links = index.load("links").groupBy("chunk").agg(F.count(F.lit(1)).alias("documents"))
    return index.load("chunks").select("chunk", "batch").join(links, "chunk").join(index.load("facts"), "chunk")
