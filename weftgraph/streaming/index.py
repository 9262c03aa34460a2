"""An index that follows a stream of documents: their states, their chunks, and what was extracted from new chunks.

Each batch of the stream is merged by key into tables that change together in one version (states, chunks, facts and the numbers of the
batches that are in). A batch that comes again after a failure finds its number and changes nothing; a batch that
broke off left no version. The number of a batch is also the clock of time-outs.

A document is known by its content. New ones are PENDING; each batch takes up those, the FAILED ones and those PROCESSING for too long, as long as they
have attempts left. A work function says how each ended: done, unfinished, or an error. Chunks are known by content as well,
so a chunk is extracted once, whichever documents have it. Chunks, links and facts only grow: a batch writes its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_staged, staged
from ..sources.versions import Versions

STATES = "id string, doc_id bigint, status string, attempts int, since bigint, error string"
CHUNKS = "chunk string, content string, batch bigint"
LINKS = "id string, chunk string"
DONE, UNFINISHED = "done", "unfinished"
#: New documents of a batch that are broadcast to it, if there are no more; beyond that their texts are shuffled.
FEW_NEW = 2_000_000


@dataclass
class Work:
    """The functions that a document goes through."""

    chunk: Callable[[DataFrame], DataFrame]  # (id, content) -> (id, content) of chunks
    extract: Callable[[DataFrame], DataFrame]  # (chunk, content) -> (chunk, fact)
    outcome: Callable[[DataFrame], DataFrame]  # (id, doc_id) -> (id, outcome): done, unfinished, or an error; null is done


class IncrementalIndex:
    def __init__(self, spark: SparkSession, folder: str, work: Work, most_attempts: int = 3, time_out: int = 2):
        self.spark, self.work, self.most, self.time_out = spark, work, most_attempts, time_out
        self.table = Versions(spark, folder, {"states": STATES, "chunks": CHUNKS, "links": LINKS, "facts": "chunk string, fact string", "batches": "batch bigint"}, grows=("chunks", "links", "facts"))

    def apply(self, batch: DataFrame, number: int) -> bool:
        """Merge documents (doc_id, content); False if this number is in already."""
        if not self.table.load("batches").where(F.col("batch") == number).isEmpty():
            return False
        docs = batch.select("doc_id", F.coalesce("content", F.lit("")).alias("content"), F.concat(F.lit("doc-"), F.md5(F.coalesce("content", F.lit("")))).alias("id"))
        stored, chunks = self.table.load("states"), self.table.load("chunks")
        new = staged(docs.groupBy("id").agg(F.min("doc_id").alias("doc_id")).join(stored.select("id"), "id", "left_anti"), "index-batch")
        count = new.count()
        fresh = new.select("id", "doc_id", F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(number).cast("long").alias("since"), F.lit(None).cast("string").alias("error"))
        late = (F.col("status") == "PROCESSING") & (F.lit(number) - F.col("since") >= self.time_out)
        take = (F.col("status").isin("PENDING", "FAILED") | late) & (F.col("attempts") < self.most)
        every = stored.unionByName(fresh).withColumn("taken", take).withColumn("late", late)
        ended = self.work.outcome(every.where("taken").select("id", "doc_id")).select("id", "outcome")
        rows = every.join(ended, "id", "left")
        o = F.coalesce("outcome", F.lit(DONE))
        after = F.when(o == DONE, "PROCESSED").when(o == UNFINISHED, "PROCESSING").otherwise("FAILED")
        gave_up = F.col("late") & ~F.col("taken")
        states = rows.select(
            "id", "doc_id",
            F.when(F.col("taken"), after).when(gave_up, "FAILED").otherwise(F.col("status")).alias("status"),
            (F.col("attempts") + F.col("taken").cast("int")).alias("attempts"),
            F.when(F.col("taken"), F.lit(number).cast("long")).otherwise(F.col("since")).alias("since"),
            F.when(F.col("taken") & ~o.isin(DONE, UNFINISHED), o).when(F.col("taken"), F.lit(None)).when(gave_up, "timed out").otherwise(F.col("error")).alias("error"),
        )
        # a row of each new text, without sending texts where the new ones are few; rows that repeat one do no harm
        named = new.select(F.col("id").alias("new_id"), F.col("doc_id").alias("new_doc"))
        texts = docs.join(F.broadcast(named) if count <= FEW_NEW else named, (F.col("id") == F.col("new_id")) & F.col("doc_id").eqNullSafe(F.col("new_doc")), "left_semi").select("id", "content")
        made = staged(self.work.chunk(texts).select("id", "content", F.concat(F.lit("chunk-"), F.md5("content")).alias("chunk")), "index-chunks")
        only_new = made.groupBy("chunk").agg(F.first("content").alias("content")).join(chunks.select("chunk"), "chunk", "left_anti")
        self.table.save(
            states=states,
            chunks=only_new.withColumn("batch", F.lit(number).cast("long")),
            links=made.select("id", "chunk").distinct(),
            facts=lambda written: self.work.extract(written("chunks").select("chunk", "content")).select("chunk", "fact"),
            batches=self.table.load("batches").unionByName(self.spark.range(1).select(F.lit(number).cast("long").alias("batch"))),
        )
        drop_staged(new)
        drop_staged(made)
        return True

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Merge what the stream has that this checkpoint has not seen."""
        q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, n: self.apply(rows, n) and None).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()

    def load(self, part: str) -> DataFrame:
        return self.table.load(part)
