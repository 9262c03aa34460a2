"""Replaceable functions: tokenizers, chunkers, metrics, storage kinds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions


class Tokenizer(Protocol):
    """What a tokenizer must do (survey 14.5); decode(encode(text)) gives the text again."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class BytesTokenizer:
    """The default: UTF-8 bytes are ids."""

    def encode(self, text: str) -> list[int]:
        return list(text.encode())

    def decode(self, ids: list[int]) -> str:
        return bytes(ids).decode(errors="replace")


class FileTokenizer:
    """A tokenizer of the tokenizers library from its file, which is opened once a worker."""

    _open: dict = {}

    def __init__(self, path: str):
        self.path = path

    def _library(self):
        from tokenizers import Tokenizer as Library

        if self.path not in self._open:
            self._open[self.path] = Library.from_file(self.path)
        return self._open[self.path]

    def encode(self, text: str) -> list[int]:
        return self._library().encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self._library().decode(ids)


#: (tokenizer, text, size, overlap) -> [(order, tokens, content)]
Chunker = Callable[[Tokenizer, str, int, int], list[tuple[int, int, str]]]


def token_chunker(tokenizer: Tokenizer, text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """Windows of the tokenizer's ids at every stride below their number, trimmed (survey A1)."""
    ids = tokenizer.encode(text)
    return [(k, min(size, len(ids) - at), tokenizer.decode(ids[at : at + size]).strip()) for k, at in enumerate(range(0, len(ids), size - overlap))]


def split_chunker(mark: str) -> Chunker:
    """Pieces between marks, the longer ones cut into windows, the others whole, empty ones included (survey A1)."""

    def run(tokenizer: Tokenizer, text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
        out = []
        for piece in text.split(mark):
            n = len(tokenizer.encode(piece))
            out += [x[1:] for x in token_chunker(tokenizer, piece, size, overlap)] if n > size else [(n, piece.strip())]
        return [(k, *x) for k, x in enumerate(out)]

    return run


def chunked(docs: DataFrame, tokenizer: Tokenizer | None = None, chunker: Chunker = token_chunker, size: int = 1200, overlap: int = 100) -> DataFrame:
    """(doc_id, chunk_order_index, tokens, content) of ``docs`` (doc_id, text) by any tokenizer and chunker (survey 14.1, 9.1)."""
    tool = tokenizer or BytesTokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = chunker(tool, text or "", size, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), b.schema.field(0).type), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "chunk_order_index", "tokens", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunk_order_index int, tokens int, content string")


#: A metric gives a score for each row of (id, gold, predicted) (survey 14.9).
Metric = Callable[[DataFrame], DataFrame]


def exact_match(rows: DataFrame) -> DataFrame:
    return rows.select("id", (F.lower(F.trim("gold")) == F.lower(F.trim("predicted"))).cast("double").alias("score"))


def measured(rows: DataFrame, metrics: dict[str, Metric]) -> tuple[DataFrame, DataFrame]:
    """(pooled (metric, score), each row's (id, metric, score)) of several metrics."""
    each = None
    for name, metric in metrics.items():
        part = metric(rows).select("id", F.lit(name).alias("metric"), "score")
        each = part if each is None else each.unionByName(part)
    return each.groupBy("metric").agg(F.avg("score").alias("score")), each


#: What a storage kind must do (survey 14.10), by contract.
CONTRACTS = {"kv": ("upsert", "get", "delete"), "vector": ("upsert", "query", "delete"), "graph": ("nodes", "edges", "upsert"), "status": ("upsert", "by_status")}
STORES: dict[tuple[str, str], type] = {}


def store(contract: str, name: str):
    """Registers a storage class under a name; one without all the contract's functions is refused."""

    def add(kind: type) -> type:
        missing = [f for f in CONTRACTS[contract] if not callable(getattr(kind, f, None))]
        if missing:
            raise TypeError(f"{name} lacks {', '.join(missing)}")
        STORES[contract, name] = kind
        return kind

    return add


@store("graph", "parquet")
class ParquetGraph:
    """Nodes and edges as Parquet below a folder, by variant, edges by sorted pair (survey 1.10, 1.23); both change in one version."""

    def __init__(self, spark: SparkSession, folder: str, variant: str = "base"):
        self.table = Versions(spark, f"{folder}/variant={variant}", {"nodes": "node string", "edges": "src string, dst string, weight double"})

    def nodes(self) -> DataFrame:
        return self.table.load("nodes")

    def edges(self) -> DataFrame:
        return self.table.load("edges")

    def _edges_once(self, edges: DataFrame) -> DataFrame:
        return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max(F.col("weight").cast("double")).alias("weight"))

    def upsert(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Adds to what is stored: a new edge replaces the stored one of its pair; of equal new ones, in either direction, the greatest weight stays."""
        new, old = self._edges_once(edges), self.edges()
        kept = old.join(new.select("src", "dst"), ["src", "dst"], "left_anti")
        self.table.save(nodes=self.nodes().union(nodes.select("node")).distinct(), edges=kept.unionByName(new))

    def delete(self, nodes: DataFrame) -> None:
        """Removes nodes (node) and all their edges."""
        gone, edges = nodes.select("node").distinct(), self.edges()
        for end in ("src", "dst"):
            edges = edges.join(gone.select(F.col("node").alias(end)), end, "left_anti")
        self.table.save(nodes=self.nodes().join(gone, "node", "left_anti"), edges=edges.select("src", "dst", "weight"))
