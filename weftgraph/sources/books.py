"""Books as JSON lines with a manifest, and folders with new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def convert(spark: SparkSession, raw: str, out: str, start: int = 0, most: int | None = None) -> None:
    """Raw JSON lines (book, doc_id, text, n_chars) to ``out``: samples by book, and a manifest of their counts (survey 1.12).

    ``start`` and ``most`` choose books by their rank in name order.
    """
    rows = spark.read.json(raw, schema="book string, doc_id bigint, text string, n_chars bigint")
    counts = rows.groupBy("book").agg(F.count(F.lit(1)).alias("samples"))
    if start or most is not None:
        names = [r["book"] for r in counts.select("book").orderBy("book").limit(start + most if most is not None else 2**31 - 1).collect()][start:]  # a row a book
        rows, counts = rows.where(F.col("book").isin(names)), counts.where(F.col("book").isin(names))
    rows.withColumn("part", F.md5("book")).write.partitionBy("part").json(f"{out}/samples")
    counts.withColumn("path", F.concat(F.lit("samples/part="), F.md5("book"))).write.json(f"{out}/manifest")


def load(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """Samples of the first ``most`` books of the manifest in name order; its paths are relative to the folder (survey 1.14)."""
    manifest = spark.read.json(f"{folder}/manifest", schema="book string, samples bigint, path string").orderBy("book")
    paths = [f"{folder}/{r['path']}" for r in (manifest if most is None else manifest.limit(most)).select("path").collect()]  # a row a book
    schema = "book string, doc_id bigint, text string, n_chars bigint"
    return spark.read.json(paths, schema=schema) if paths else spark.createDataFrame([], schema)


def new_files(spark: SparkSession, folder: str, endings: tuple[str, ...], status: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    """(path, name) of the files with one of the endings whose name ``status`` (name, status) does not list as processed (survey 1.34)."""
    files = spark.read.format("binaryFile").load(folder).select("path")  # the contents are not read
    files = files.where(F.lower("path").rlike("(?:" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")).withColumn("name", name(F.col("path")))
    return files.join(status.where("status = 'processed'").select("name"), "name", "left_anti")
