"""Vector search: exact top-k with thresholds, blocked nearest neighbours, synonym edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A

#: Rows of a block of keys or queries.
BLOCK = 4096
#: Scores that a task holds at once.
CELLS = 1 << 20


def top_k(rows: DataFrame, vector: list[float], k: int, threshold: float | None = None) -> DataFrame:
    """(vec_id, score, rank) of the k rows most alike to one query vector; rows need a score of at least ``threshold``."""
    score = F.round(A.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])), 9)
    hits = rows.select("vec_id", score.alias("score"))
    if threshold is not None:
        hits = hits.where(F.col("score") >= threshold)
    best = hits.orderBy(F.desc("score"), "vec_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))


def best_of_rows(score: np.ndarray, take: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's ``take`` greatest scores of at least ``threshold``, equal ones by column; no row is sorted whole."""
    there = score >= threshold
    if take < score.shape[1] and there.sum(axis=1).max(initial=0) > take:
        there &= score >= -np.partition(-score, take - 1, axis=1)[:, take - 1 : take]
    rows, columns = np.nonzero(there)
    order = np.lexsort((columns, -score[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < take
    return rows[keep], columns[keep]


def best_of_block(queries: np.ndarray, keys: np.ndarray, take: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, scores) of each query's best keys; the product of a block is made for a few queries at a time, so it never lies whole in memory."""
    step, found = max(1, CELLS // max(1, len(keys))), []
    for i in range(0, len(queries), step):
        score = np.round(queries[i : i + step] @ keys.T, 9)
        rows, columns = best_of_rows(score, take, threshold)
        found.append((rows + i, columns, score[rows, columns]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def knn(queries: DataFrame, keys: DataFrame, k: int, threshold: float = -1.0, blocks: int | None = None) -> DataFrame:
    """(query_id, key_id, score, rank): the k keys of the greatest cosine for each query.

    Queries and keys are dealt into blocks, each side by its own number of rows; each pair of blocks is one product of matrices in one
    task, a few queries at a time, which passes on its best k a query, so that only queries x blocks x k rows are shuffled. A row is sent once for each block of
    the other side: keys only once where the queries fill one block. Both sides have columns vec_id and embedding.
    """
    n_blocks = {"q": blocks or max(1, -(-queries.count() // BLOCK)), "k": blocks or max(1, -(-keys.count() // BLOCK))}

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.select("vec_id", F.col("embedding").cast("array<float>").alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks[own])).alias("own"))
        cells = F.transform(F.sequence(F.lit(0), F.lit(n_blocks[other] - 1)).cast("array<bigint>"), lambda b: F.struct((F.col("own") if own == "q" else b).alias("q"), (b if own == "q" else F.col("own")).alias("k")))
        return rows.select(F.lit(own).alias("side"), "vec_id", "v", F.explode(cells).alias("cell"))

    both = side(queries, "q", "k").unionByName(side(keys, "k", "q")).select("cell.q", "cell.k", "side", "vec_id", "v")

    def best(table: pa.Table) -> pa.Table:
        is_query = np.array(table.column("side").to_pylist()) == "q"
        ids = table.column("vec_id").to_numpy()
        empty = pa.table({"query_id": pa.array([], pa.int64()), "key_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not is_query.any() or is_query.all():
            return empty
        v = np.stack(table.column("v").combine_chunks().to_numpy(zero_copy_only=False)).astype(np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        key_ids = ids[~is_query]
        order = np.argsort(key_ids, kind="stable")
        key_ids, keys_ = key_ids[order], v[~is_query][order]
        rows, columns, score = best_of_block(v[is_query], keys_, min(k, len(key_ids)), threshold)
        return pa.table({"query_id": ids[is_query][rows], "key_id": key_ids[columns], "score": score})

    found = both.groupBy("q", "k").applyInArrow(best, "query_id bigint, key_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def synonym_edges(near: DataFrame, threshold: float = 0.8, most: int = 100) -> DataFrame:
    """Edges from neighbours in order: not oneself, at least ``threshold``, and at most ``most`` + 1 of them."""
    rows = near.where((F.col("score") >= threshold) & (F.col("query_id") != F.col("key_id")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key_id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most + 1).select(F.col("query_id").alias("src"), F.col("key_id").alias("dst"), F.col("score").alias("weight"))
