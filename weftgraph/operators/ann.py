"""Nearest neighbours by an index of inverted lists, kept as a table that can be opened again.

Centroids of unit length are fitted on a bounded sample; every vector goes to the list of its nearest centroid, which is a partition of the
table. A query looks into the lists of its nearest centroids (probes) and scores their vectors exactly. How many
probes are needed for the wanted recall is measured on the sample when the index is built, so it follows the data: few for clustered vectors, many
for spread ones. All lists as probes give the exact result. A search puts lists together into bins of bounded size, splits larger ones, and deals the
queries of a bin into parts, so neither a list with a third of all vectors nor one that all queries ask for is one task; a query is sent once to a bin
and gets back its best of the bin, however many of the bin's lists it probes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_staged, shared_dir, staged
from .vector import best_of_rows

#: Vectors of the sample, its queries for measuring recall, most lists, rounds of fitting.
SAMPLE, TRIED, MOST_LISTS, FIT_ROUNDS = 20_000, 400, 4096, 8
#: Neighbours for which recall is measured, and its least value.
NEIGHBOURS, RECALL = 10, 0.95
#: Most vectors of a bin of lists, or queries of a part; fewer, but not below LEAST, where they would make less than PARTS bins or parts.
PART, LEAST, PARTS = 16_384, 1024, 8
#: Scores that a task holds at once.
CELLS = 1 << 22


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding as floats; without null, empty and non-finite vectors."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids by rounds of assigning and averaging; the first are the sample's first vectors, and a centroid without vectors stays."""
    out = sample[:lists].copy()
    for _ in range(FIT_ROUNDS):
        at = (sample @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, at, sample)
        there = np.bincount(at, minlength=len(out)) > 0
        out[there] = unit(sums[there])
    return out


def probes_needed(sample: np.ndarray, centroids: np.ndarray, recall: float) -> int:
    """The least number of probes that finds this share of the sample's neighbours within the sample."""
    tried = sample[-TRIED:]
    # a vector finds itself, so one more
    near = np.argsort(-(tried @ sample.T), axis=1, kind="stable")[:, : NEIGHBOURS + 1]
    order = np.argsort(-(tried @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None], axis=1)
    list_of = (sample @ centroids.T).argmax(axis=1)
    need = np.sort(np.take_along_axis(place, list_of[near], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1 if len(need) else 1


class VectorIndex:
    """A table of vectors by list below a path, its centroids and its number of probes."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, probes: int, kind: str):
        self.spark, self.path, self.centroids, self.probes, self.kind = spark, path, centroids, probes, kind

    @classmethod
    def build(cls, rows: DataFrame, path: str, lists: int | None = None, recall: float = RECALL, sample: int = SAMPLE) -> VectorIndex:
        """Fit on the ``sample`` vectors whose ids hash least, and index all; by default as many lists as the root of the number of vectors."""
        spark, rows = rows.sparkSession, usable(rows)
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
        found = unit(np.stack(some.to_list())) if len(some) else np.zeros((0, 1))
        lists = min(lists or int(np.ceil(rows.count() ** 0.5)), MOST_LISTS, len(found))
        centroids = fitted(found, lists) if lists else found
        probes = probes_needed(found, centroids, recall) if lists else 1
        kind = rows.schema["vec_id"].dataType.simpleString()
        meta = spark.createDataFrame([(json.dumps({"probes": probes, "kind": kind}), centroids.ravel().tolist(), lists)], "meta string, centroids array<double>, lists int")
        meta.write.parquet(f"{path}/meta")
        index = cls(spark, path, centroids, probes, kind)
        index.add(rows)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        row = spark.read.parquet(f"{path}/meta").first()
        meta = json.loads(row["meta"])
        return cls(spark, path, np.array(row["centroids"]).reshape(row["lists"], -1 if row["lists"] else 1), meta["probes"], meta["kind"])

    def add(self, rows: DataFrame) -> None:
        """More vectors for the same lists; ids are not looked for, so give new ones."""
        rows = usable(rows)
        listed = self._nearest(rows, 1).select("vec_id", "embedding", F.col("lists")[0].alias("list"))
        listed.hint("rebalance", "list").write.partitionBy("list").mode("append").parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"vec_id {self.kind}, embedding array<float>, list int").parquet(f"{self.path}/vectors")

    def _nearest(self, rows: DataFrame, n: int) -> DataFrame:
        """With ``lists``, those of the n nearest centroids."""
        sent = self.spark.sparkContext.broadcast(self.centroids)
        n = min(n, max(1, len(self.centroids)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                if not len(sent.value):  # an index of nothing
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[]] * b.num_rows, pa.list_(pa.int32()))], ["vec_id", "embedding", "lists"])
                    continue
                v = unit(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
                away = -(v @ sent.value.T)
                at = np.argsort(away, axis=1, kind="stable")[:, :n] if n > 1 else away.argmin(axis=1)[:, None]
                ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * at.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(at.ravel().astype(np.int32)))], ["vec_id", "embedding", "lists"])

        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, embedding array<float>, lists array<int>")

    def _bins(self, counts: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Each list's first bin and its number of bins, 0 for one without vectors; lists of at most ``size`` vectors share bins."""
        first, many = np.zeros(len(self.centroids) or 1, np.int32), np.zeros(len(self.centroids) or 1, np.int32)
        at, room = -1, 0
        # lists in the direction of the first one come together, which lets the probes of a query fall into fewer bins
        toward = self.centroids @ self.centroids[0] if len(self.centroids) else np.zeros(1)
        for name in sorted(counts, key=lambda c: (-toward[c], c)):
            n = -(-counts[name] // size)
            if n > 1 or counts[name] > room:
                first[name], at, room = at + 1, at + n, size - counts[name] if n == 1 else 0
            else:
                first[name], room = at, room - counts[name]
            many[name] = n
        return first, many

    @staticmethod
    def _sent(asked: DataFrame, first: np.ndarray, many: np.ndarray) -> DataFrame:
        """(vec_id, embedding, bin, lists): a row for each bin that has lists of the query, with these; lists are null where all are wanted."""
        kind, bins = asked.schema["vec_id"].dataType.simpleString(), int((first + many).max(initial=0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, lists = b.num_rows, b.column("lists")
                if lists.null_count:
                    row, bin_ = np.repeat(np.arange(n), bins), np.tile(np.arange(bins), n)
                    kept = pa.nulls(len(row), pa.list_(pa.int32()))
                else:
                    names = lists.flatten().to_numpy()
                    row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
                    times = many[names]
                    row, names = np.repeat(row, times), np.repeat(names, times)
                    bin_ = first[names] + np.arange(len(names)) - np.repeat(np.cumsum(times) - times, times)
                    order = np.lexsort((bin_, row))
                    row, bin_, names = row[order], bin_[order], names[order]
                    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1])]) if len(row) else np.zeros(0, int)
                    kept = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)].astype(np.int32)), pa.array(names.astype(np.int32)))
                    row, bin_ = row[starts], bin_[starts]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("embedding").take(at), pa.array(bin_.astype(np.int32)), kept], ["vec_id", "embedding", "bin", "lists"])

        return asked.select("vec_id", "embedding", "lists").mapInArrow(run, f"vec_id {kind}, embedding array<float>, bin int, lists array<int>")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, threshold: float = -1.0) -> DataFrame:
        """(query_id, key_id, score, rank): the k vectors of the greatest cosine in the lists probed; equal scores go by key."""
        kind = queries.schema["vec_id"].dataType.simpleString()
        keys, probes = self.vectors(), probes or self.probes
        every = probes >= len(self.centroids)
        asked = staged(usable(queries).withColumn("lists", F.lit(None).cast("array<int>")) if every else self._nearest(usable(queries), probes), "ann-queries")
        size = lambda n: min(PART, max(LEAST, -(-n // PARTS)))
        # a row a list, at most MOST_LISTS; then a row a bin, which are fewer but for split lists
        counts = {r["list"]: r["n"] for r in keys.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        first, many = self._bins(counts, size(sum(counts.values())))
        of_list = F.broadcast(self.spark.createDataFrame([(c, int(first[c]), int(many[c])) for c in counts], "list int, first int, many int"))
        sent, part = self._sent(asked, first, many), size(asked.count())
        parts = F.broadcast(staged(sent.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")), "ann-parts"))
        left = sent.join(parts, "bin").select("bin", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "embedding", "lists")
        dealt = keys.join(of_list, "list").withColumn("bin", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many")).cast("int")).join(parts, "bin")
        right = dealt.select(F.col("bin").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "vec_id", "embedding", "list")

        def best(q: pa.Table, keys: pa.Table) -> pa.Table:
            names = ["query_id", "key_id", "score"]
            if not (q.num_rows and keys.num_rows):
                return pa.table([q.column("vec_id").slice(0, 0), q.column("vec_id").slice(0, 0), pa.array([], pa.float64())], names=names)
            keys = keys.sort_by("vec_id")
            a, b = (unit(np.stack(t.column("embedding").combine_chunks().to_numpy(zero_copy_only=False))) for t in (q, keys))
            here, list_of = np.unique(keys.column("list").to_numpy(), return_inverse=True)
            lists, out = q.column("lists").combine_chunks(), []
            step = max(1, CELLS // len(b))
            for i in range(0, len(a), step):
                score = np.round(a[i : i + step] @ b.T, 9)
                some = lists.slice(i, step)
                if not some.null_count:
                    wanted = np.zeros((len(score), len(here)), bool)
                    asked_of = some.flatten().to_numpy()
                    row, at = np.repeat(np.arange(len(score)), some.value_lengths().to_numpy()), np.minimum(np.searchsorted(here, asked_of), len(here) - 1)
                    there = here[at] == asked_of
                    wanted[row[there], at[there]] = True
                    score[~wanted[:, list_of]] = -np.inf
                rows, columns = best_of_rows(score, min(k, keys.num_rows), threshold)
                out.append((rows + i, columns, score[rows, columns]))
            rows, columns, score = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.table([q.column("vec_id").take(pa.array(rows)), keys.column("vec_id").take(pa.array(columns)), pa.array(score)], names=names)

        found = left.groupBy("bin", "part").cogroup(right.groupBy("b", "p")).applyInArrow(best, f"query_id {kind}, key_id {kind}, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key_id")
        out = staged(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ann-found")
        drop_staged(asked)
        return out

    def drop(self) -> None:
        """Delete the table."""
        for df in (self.vectors(), self.spark.read.parquet(f"{self.path}/meta")):
            drop_staged(df)


def neighbours_by_index(rows: DataFrame, queries: DataFrame, k: int, probes: int | None = None, threshold: float = -1.0) -> DataFrame:
    """:meth:`VectorIndex.search` over an index that is made for this once."""
    import uuid

    index = VectorIndex.build(rows, f"{shared_dir(rows.sparkSession)}/index-{uuid.uuid4().hex}")
    found = index.search(queries, k, probes, threshold)
    index.drop()
    return found


def candidate_pairs(near: DataFrame, bad: DataFrame, observed: DataFrame, alike: float, most: int) -> DataFrame:
    """(a, b, score): pairs that could hide a relation, from neighbours (query_id, key_id, score).

    Gone are nodes with themselves, those of ``bad`` (id), pairs (a, b) already ``observed`` in either direction, and pairs of cosine ``alike`` or more, as these are
    copies. A pair found from both ends counts once; the score is the logistic of the cosine; the best ``most`` stay, equal scores by ids.
    """
    pairs = near.where((F.col("query_id") != F.col("key_id")) & (F.col("score") < alike)).groupBy(F.least("query_id", "key_id").alias("a"), F.greatest("query_id", "key_id").alias("b")).agg(F.max("score").alias("cosine"))
    known = observed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(bad.select(F.col("id").alias(end)), end, "left_anti")
    left = staged(pairs.join(known, ["a", "b"], "left_anti").select("a", "b", "cosine"), "ann-pairs")
    if left.count() > most:
        # ranges in order, each sorted by itself; the ones before a range say where its places begin
        sorted_ = left.orderBy(F.desc("cosine"), "a", "b").withColumn("n", F.monotonically_increasing_id())
        sorted_ = staged(sorted_.select("a", "b", "cosine", F.shiftright("n", 33).alias("range"), F.col("n").bitwiseAND((1 << 33) - 1).alias("place")), "ann-order")
        sizes = sorted(sorted_.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
        before, at = [], 0
        for r in sizes:
            before.append((r["range"], at))
            at += r["n"]
        before = F.broadcast(left.sparkSession.createDataFrame(before, "range long, before long"))
        left = sorted_.join(before, "range").where(F.col("before") + F.col("place") < most)
    return left.select("a", "b", (1 / (1 + F.exp(-F.col("cosine")))).alias("score"))
