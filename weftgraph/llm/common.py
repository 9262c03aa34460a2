"""Shared pieces of the training-data operators: tables, staging, words, bounded broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table as table
from ..session import shared_dir, shuffles_freed

__all__ = ["BLANK", "ascii_lower", "drop_path", "drop_staged", "shared_dir", "shuffles_freed", "small", "staged", "staged_path", "table", "text_or_empty", "words_of"]

#: White space of the word rule; every other character belongs to a word.
BLANK = r"[\x20\x09-\x0D]+"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    path = staged_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_staged(df: DataFrame) -> None:
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (staged, so counting is cheap) with a broadcast hint if it has at most ``rows`` rows.

    Beyond that it is returned as it is and Spark shuffles the join, splitting hot keys at run time.
    """
    return F.broadcast(df) if df.count() <= rows else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The runs of characters that are not white space, in order; none for an empty text."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")
