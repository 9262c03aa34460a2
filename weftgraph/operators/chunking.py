"""Window chunkers over words or tokens; one row for each chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"


def tokens_of(text: Column) -> Column:
    """The default tokenizer; a byte-pair one may replace it through the tokenizer hook."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_windows(docs: DataFrame, size: int = 1200, overlap: int = 100) -> DataFrame:
    """Windows begin at every stride below the number of tokens, so the last may lie within the one before."""
    rows = docs.select("doc_id", tokens_of(F.col("text")).alias("t")).where(F.size("t") > 0)
    rows = rows.select("doc_id", "t", F.posexplode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(size - overlap))).alias("chunk_order_index", "start"))
    content = F.array_join(F.slice("t", F.col("start") + 1, size), " ")
    return rows.select("doc_id", "chunk_order_index", F.least(F.lit(size), F.size("t") - F.col("start")).alias("tokens"), content.alias("content"), T.md5_id(content, "chunk-").alias("chunk_id"))


def word_windows(docs: DataFrame, size: int = 500, overlap: int = 80, least: int = 80) -> DataFrame:
    """Windows end with the first that reaches the end; a last one of fewer than ``least`` words joins the one before."""
    stride = size - overlap
    rows = docs.select("doc_id", T.words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    count = F.when(F.col("n") <= size, 1).otherwise(1 + F.ceil((F.col("n") - size) / stride)).cast("int")
    rows = rows.withColumn("k", count).withColumn("short", (F.col("k") > 1) & (F.col("n") - (F.col("k") - 1) * stride < least))
    kept = F.col("k") - F.when(F.col("short"), 1).otherwise(0)
    rows = rows.withColumn("kept", kept).select("*", F.explode(F.sequence(F.lit(0), F.col("kept") - 1)).alias("i"))
    start = F.col("i") * stride
    end = F.when(F.col("i") == F.col("kept") - 1, F.col("n")).otherwise(start + size)
    content = F.array_join(F.slice("w", start + 1, end - start), " ")
    return rows.select("doc_id", F.col("i").cast("long").alias("chunk_index"), start.cast("long").alias("word_start"), end.cast("long").alias("word_end"), content.alias("content"))


def rerank_windows(docs: DataFrame, size: int = 480, overlap: int = 32) -> DataFrame:
    """Pieces for a reranker; the overlap stays below the size, and the last piece ends the text."""
    stride = size - min(overlap, size - 1)
    rows = docs.select("doc_id", F.size(tokens_of(F.col("text"))).alias("n"))
    count = F.when(F.col("n") <= size, 1).otherwise(1 + F.ceil((F.col("n") - size) / stride)).cast("int")
    rows = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    return rows.select("doc_id", "piece", F.least(F.lit(size), F.col("n") - F.col("piece") * stride).alias("tokens"))
