"""File forms of the stores: embedding tables, extraction JSON, triple lines, CSV exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions

OPENIE = "idx string, passage string, extracted_entities array<string>, extracted_triples array<array<string>>"
VECTORS = "hash_id string, content string, embedding array<float>"


class EmbeddingStore:
    """A table of (hash_id, content, embedding) for a namespace; it is found again by whoever opens the same folder."""

    def __init__(self, spark: SparkSession, root: str, namespace: str):
        self.table = Versions(spark, f"{root}/vdb_{namespace}", {"rows": VECTORS})

    def load(self) -> DataFrame:
        return self.table.load()

    def save(self, rows: DataFrame) -> None:
        self.table.save(rows=rows.select("hash_id", "content", F.col("embedding").cast("array<float>").alias("embedding")))

    def upsert(self, rows: DataFrame) -> None:
        """Rows whose id is not stored yet are added."""
        old = self.load()
        self.save(old.unionByName(rows.dropDuplicates(["hash_id"]).join(old.select("hash_id"), "hash_id", "left_anti").select(*old.columns)))

    def insert_missing(self, contents: DataFrame, prefix: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Only texts that are not stored are embedded: ``embed`` adds ``embedding`` to (hash_id, content). Returns the new rows."""
        ids = contents.select(F.concat(F.lit(prefix), F.md5("content")).alias("hash_id"), "content").dropDuplicates(["hash_id"])
        fresh = ids.join(self.load().select("hash_id"), "hash_id", "left_anti")
        before = self.load()
        self.save(before.unionByName(embed(fresh).select(*before.columns)))
        return self.load().join(before.select("hash_id"), "hash_id", "left_anti")

    def delete(self, ids: DataFrame) -> DataFrame:
        """Delete by id; returns the ids that were not stored."""
        old, gone = self.load(), ids.select("hash_id").distinct()
        self.save(old.join(gone, "hash_id", "left_anti"))
        return gone.join(old.select("hash_id"), "hash_id", "left_anti")


def write_openie(docs: DataFrame, path: str) -> None:
    docs.select("idx", "passage", "extracted_entities", "extracted_triples").write.json(path)


def read_openie(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OPENIE).json(path)


def pending_chunks(chunks: DataFrame, openie: DataFrame) -> DataFrame:
    """Chunks (idx) without a complete extraction; one without entities and triples is incomplete."""
    done = openie.where((F.size("extracted_entities") > 0) | (F.size("extracted_triples") > 0)).select("idx")
    return chunks.join(done, "idx", "left_anti")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``head,relation,tail``; others are left out."""
    rows = spark.read.text(path).select(F.split("value", ",").alias("x")).where(F.size("x") == 3)
    return rows.select(F.col("x")[0].alias("s"), F.col("x")[1].alias("p"), F.col("x")[2].alias("o"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)


def stage1_nodes(nodes: DataFrame) -> DataFrame:
    """name, type and attributes as JSON with sorted keys."""
    entries = F.array_sort(F.map_entries("attributes"))
    return nodes.select("name", "type", F.to_json(F.map_from_entries(entries)).alias("attributes"))


def write_markdown(rows: DataFrame, path: str) -> None:
    """Each row as a line of a Markdown table; bars within values are escaped."""
    cells = [F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")) for c in rows.columns]
    rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.text(path)
