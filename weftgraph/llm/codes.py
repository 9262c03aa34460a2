"""Compression of vectors to codes: product quantisation over integer parts, by weighted Lloyd rounds over distinct parts.

Components become integers (256 x, rounded down), a vector becomes equal parts, and every part position has a codebook. Equal parts of a
position are made one weighted row first, within blocks of vectors and then over all; Lloyd rounds only read these rows and send a sum a
codebook entry and task. In the end each distinct part gets its code and error, which are joined back to the blocks' own distinct parts, and from
these to the vectors. A part that very many vectors share is one row a block, so no key is hot. All arithmetic is of integers, so
results do not depend on order.

Only codebooks (parts x entries rows) reach the driver.

Defined cases: a vector that is null or empty, or has null or non-finite components, is dropped; vec_ids may repeat or be null (null ids count as
largest; among equal ids, components decide which comes first); fewer vectors than entries make smaller codebooks; an
empty table gives an empty result; further columns do not matter. Vectors whose length differs from the others' or is no multiple of the
number of parts raise, as do components of 2 ** 18 and more, whose errors may not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, small, staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components are smaller than this, so that squared distances fit 64 bits.
LARGEST = 1 << 18
#: Rows whose distances to a codebook are held at once.
AT_ONCE = 4096
#: Labels that are broadcast with their sums, if there are no more.
FEW_LABELS = 100_000


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds finite components only."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)


def integers(vectors: np.ndarray) -> np.ndarray:
    out = np.floor(vectors.astype(np.float64) * SCALE)
    if out.size and np.abs(vectors).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST} and more are not supported")
    return out.astype(np.int64)


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, components): the parts of the vectors with the smallest ids; ``rows`` usable."""
    few = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    if not few:
        return np.zeros((parts, 0, 0), np.int64)
    if len({len(r[0]) for r in few}) > 1 or len(few[0][0]) % parts:
        raise ValueError(f"vectors must be of one length, a multiple of {parts}")
    return integers(np.array([r[0] for r in few])).reshape(len(few), parts, -1).transpose(1, 0, 2)


def _packed(rows: np.ndarray) -> list[bytes]:
    """Each row's integers in the fewest of 2, 4 or 8 bytes each, so that equal rows have equal bytes."""
    out: list[bytes] = [b""] * len(rows)
    most = np.maximum(rows.max(axis=1), -1 - rows.min(axis=1))
    width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
    for w in (2, 4, 8):
        at = np.flatnonzero(width == w)
        raw, n = np.ascontiguousarray(rows[at].astype(f"<i{w}")).tobytes(), w * rows.shape[1]
        for k, i in enumerate(at.tolist()):
            out[i] = raw[k * n : (k + 1) * n]
    return out


def _unpacked(some: list[bytes], components: int) -> np.ndarray:
    out = np.zeros((len(some), components), np.int64)
    size = np.array([len(x) for x in some])
    for w in (2, 4, 8):
        at = np.flatnonzero(size == w * components)
        out[at] = np.frombuffer(b"".join([some[i] for i in at.tolist()]), f"<i{w}").reshape(len(at), components)
    return out


BLOCK_SCHEMA = "block bigint, vec_id {id}, label {label}, places binary, part_of array<int>, parts array<binary>, vectors array<bigint>"


def part_blocks(rows: DataFrame, parts: int, length: int) -> DataFrame:
    """A row a vector with its parts as places in its block's list; a block's first row has that list, with how many vectors have each part.

    Blocks are numbered by task, so this must be staged before it is read.
    """
    schema = BLOCK_SCHEMA.format(id=rows.schema["vec_id"].dataType.simpleString(), label=rows.schema["label"].dataType.simpleString())
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            given = b.column(2)
            if set(given.value_lengths().to_pylist()) != {length}:
                raise ValueError("vectors must be of one length")
            x = integers(given.flatten().to_numpy().reshape(b.num_rows, parts, length // parts))
            places, of, kept, many = np.zeros((b.num_rows, parts), np.uint32), [], [], []
            for p in range(parts):
                whole = np.ascontiguousarray(x[:, p])
                _, first, back, n = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 8))).ravel(), return_index=True, return_inverse=True, return_counts=True)
                places[:, p] = len(kept) + back
                kept += _packed(whole[first])
                of += [p] * len(first)
                many += n.tolist()
            rest = [None] * (b.num_rows - 1)
            columns = [pa.array(np.full(b.num_rows, block)), b.column(0), b.column(1), pa.array([r.tobytes() for r in places], pa.binary())]
            columns += [pa.array([of, *rest], pa.list_(pa.int32())), pa.array([kept, *rest], pa.list_(pa.binary())), pa.array([many, *rest], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)
            block += 1

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def nearest(rows: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the lower of equal ones; squared distance) of each row."""
    code, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for at in range(0, len(rows), AT_ONCE):
        away = ((rows[at : at + AT_ONCE, None, :] - codebook[None]) ** 2).sum(axis=2)
        code[at : at + AT_ONCE] = away.argmin(axis=1)
        error[at : at + AT_ONCE] = away.min(axis=1)
    return code, error


def _by_position(batch: pa.RecordBatch, components: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows of the batch that have it, their parts) of columns part_of and part."""
    of = batch.column("part_of").to_numpy()
    parts = _unpacked(batch.column("part").to_pylist(), components)
    for p in np.unique(of).tolist():
        at = np.flatnonzero(of == p)
        yield p, at, parts[at]


def lloyd_round(distinct: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the weighted rows (part_of, part, n); entries that no row chose stay."""
    _, entries, components = codebooks.shape
    sent = distinct.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(codebooks), np.zeros(codebooks.shape[:2], np.int64)
        for b in batches:
            n = b.column("n").to_numpy()
            for p, at, rows in _by_position(b, components):
                code, _ = nearest(rows, sent.value[p])
                np.add.at(sums[p], code, rows * n[at, None])
                np.add.at(counts[p], code, n[at])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], ["p", "e", "n", "sums"])

    found = distinct.mapInArrow(run, "p bigint, e bigint, n bigint, sums array<bigint>")
    total = found.groupBy("p", "e").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(components)]).alias("sums"))
    out = codebooks.copy()
    for r in total.collect():  # a row an entry at most
        out[r["p"], r["e"]] = [s // r["n"] for s in r["sums"]]
    return out


def assigned(distinct: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """part_of, part, code, error."""
    sent = distinct.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for p, at, rows in _by_position(b, codebooks.shape[2]):
                code[at], error[at] = nearest(rows, sent.value[p])
            yield pa.RecordBatch.from_arrays([b.column("part_of"), b.column("part"), pa.array(code, pa.int32()), pa.array(error)], ["part_of", "part", "code", "error"])

    return distinct.select("part_of", "part").mapInArrow(run, "part_of int, part binary, code int, error bigint")


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of each usable row of (vec_id, label, embedding), the final codebooks)."""
    rows = usable(rows.select("vec_id", "label", "embedding"))
    codebooks = first_codebooks(rows, parts, entries)
    if not codebooks.shape[1]:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), codebooks
    blocks = staged(part_blocks(rows, parts, parts * codebooks.shape[2]), "part-blocks")
    own = blocks.where("parts IS NOT NULL").select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("part_of", "parts", "vectors")).alias("place", "x"))
    own = own.select("of", "place", "x.part_of", F.col("x.parts").alias("part"), F.col("x.vectors").alias("n"))
    distinct = staged(own.groupBy("part_of", "part").agg(F.sum("n").alias("n")), "distinct-parts")
    for _ in range(rounds):
        codebooks = lloyd_round(distinct, codebooks)
    coded = assigned(distinct, codebooks).select(F.col("part_of").alias("p"), F.col("part").alias("k"), "code", "error")
    values = own.join(coded, (F.col("part_of") == F.col("p")) & (F.col("part") == F.col("k"))).select("of", "place", "code", "error")
    vectors = blocks.select("block", "vec_id", "label", "places")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("place").to_numpy())
        code, error = right.column("code").to_numpy()[order].astype(np.uint8), right.column("error").to_numpy()[order]
        places = np.frombuffer(b"".join(left.column("places").to_pylist()), np.uint32).reshape(left.num_rows, parts)
        return pa.table([left.column("vec_id"), left.column("label"), pa.array([c.tobytes().hex() for c in code[places]], pa.string()), pa.array(error[places].sum(axis=1))], names=["vec_id", "label", "code", "error"])

    out = staged(vectors.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(look_up, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error bigint"), "codes")
    drop_staged(blocks)
    drop_staged(distinct)
    return out, codebooks


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, codebooks = compressed(table(spark, sf_dir, "embeddings"))
    sums = staged(rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = rows.join(small(sums, FEW_LABELS), F.col("label").eqNullSafe(F.col("l")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
