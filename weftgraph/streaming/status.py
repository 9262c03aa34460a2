"""Streams of status rows: deduplication, latest state, windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """All of a file stream's output, through a memory-free sink: each batch is written to the shared folder.

    In append mode the batches add up; in update or complete mode the last batch that has a key counts, so
    rows carry ``batch_``.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites what it wrote before
        batch.withColumn("batch_", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/b={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    out = T.StructType([*stream.schema.fields, T.StructField("batch_", T.IntegerType())])
    return spark.read.schema(out).parquet(f"{base}/out/*")


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table as a stream of its files; a pattern stands for the name, as a stream's path must not be a single file."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def latest_status(events: DataFrame) -> DataFrame:
    """Per user the newest event and the number of events; ``ts`` ties go to the greater id."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, delay: str = "3650 days") -> DataFrame:
    """The first row of each (user_id, props) within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "props"]).select("user_id", "props")


def windowed(events: DataFrame, size: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
