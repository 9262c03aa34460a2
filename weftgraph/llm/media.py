"""Media columns: payloads as 8-bit audio, stored as content-defined chunks.

A payload becomes a WAV file of 8-bit mono samples. A rolling gear hash over its bytes sets the
cuts, so equal passages give equal chunks wherever they lie. Chunks are known by their SHA-256: a
digest that several files or an earlier store have is kept once, which grouping and an anti join by digest see to.
A manifest has each file's digests in order. Reading joins manifests with chunks, puts a file's chunks in order, and checks the
file's digest, which covers all of its chunks, before the samples are used.

Disk holds one compressed copy of the distinct chunks, and while writing or reading one shuffle of them:
chunk rows that only differ in their place do not carry bytes twice within a task, chunks are bucketed by
digest, and files with equal bytes are read back once for all rows that have them.

Defined cases: a null text is an empty one; its payload is 64 zero bytes; equal texts share one file; equal rows stay rows of
their own; an empty table gives an empty store and result; a very long text is a file of many chunks, of which no task
holds more than one at a time besides the file itself; further columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffles_freed, staged, staged_path, table, text_or_empty

UNIT = 64
RATE = 8000
#: Least and most bytes of a chunk; a cut falls once in 2 ** CUT_BITS bytes between.
LEAST, MOST, CUT_BITS = 2048, 65536, 13
#: Digests that a task remembers as already sent.
SENT = 200_000
#: A chunk that more than one in so many places need is broadcast, if it has this many places at least.
HOT_SHARE, HOT_LEAST = 512, 1000
#: Chunks are compressed with a dictionary made from the beginnings of at most so many texts; it only changes their size on disk.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 2000, 8192, 112_640, 9

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 0) for i in range(256)], dtype=np.uint32)


def payload_of(text: bytes) -> bytes:
    """The bytes, filled up with zeros to a positive multiple of ``UNIT``."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def to_wav(payload: bytes) -> bytes:
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or struct.unpack("<HH", media[20:24]) != (1, 1) or media[34:36] != b"\x08\0":
        raise ValueError("not an 8-bit mono WAV file")
    n = struct.unpack("<I", media[40:44])[0]
    if n != len(media) - 44:
        raise ValueError("the file's length is wrong")
    return media[44:]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The gear hash of the last 32 bytes is summed by doubling: of 1, 2, 4, ... bytes."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, last = [], 0
    for c in at.tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[s:e] for s, e in zip([0, *ends], ends)]


def features(payload: bytes) -> str:
    """Mean, deviation, rate of crossings of the middle, and shares of eight loudness bands."""
    x = np.frombuffer(payload, np.uint8)
    up = x >= 128
    crossings = int((up[1:] != up[:-1]).sum())
    bands = np.bincount(x >> 5, minlength=8) / len(x)
    return f"mean={x.mean():.4f};std={x.std():.4f};cross={crossings / max(1, len(x) - 1):.6f};bands=" + ",".join(f"{b:.4f}" for b in bands)


def manifests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_sha256 (binary), digests (in order) of each text's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, shas, lists = [], [], []
            for t in b.column(1):
                t = t.as_py()
                media = to_wav(payload_of(t))
                sizes.append(len(t))
                shas.append(hashlib.sha256(media).digest())
                lists.append([hashlib.sha256(c).digest() for c in chunks(media)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media", "digests"])

    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary, digests array<binary>")


def make_dictionary(docs: DataFrame) -> bytes:
    """A compression dictionary of the texts; empty where there are too few."""
    n = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64("text", F.lit("dictionary")), F.lit(1_000_000)) < int(2 * 1e6 * SAMPLE / max(1, n)) + 1)
    got = drawn.select(F.substring(text_or_empty().cast("binary"), 1, SAMPLE_BYTES).alias("t")).limit(SAMPLE).collect()  # 16 MB at most
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["t"]) for r in got if r["t"]]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _chunk_rows(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        for b in batches:
            digests, data = [], []
            for t in b.column(0):
                for c in chunks(to_wav(payload_of(t.as_py()))):
                    d = hashlib.sha256(c).digest()
                    if d not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(d)
                        digests.append(d)
                        data.append(packer.compress(c))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], ["digest", "data"])

    return run


def write_chunks(docs: DataFrame, path: str, known: DataFrame | None = None) -> tuple[DataFrame, bytes]:
    """Store the chunks of ``docs`` at ``path`` that ``known`` (digest) lacks.

    Returns the store (digest, data), a table bucketed by digest whose name is of this call, and its dictionary,
    which lies in the folder beside it.
    """
    spark = docs.sparkSession
    dictionary = make_dictionary(docs)
    spark.range(1).select(F.lit(bytearray(dictionary)).alias("dictionary")).write.parquet(f"{path}-dictionary")
    rows = docs.select(text_or_empty().cast("binary").alias("text")).mapInArrow(_chunk_rows(dictionary), "digest binary, data binary")
    if known is not None:
        rows = rows.join(known.select("digest"), "digest", "left_anti")
    name = f"chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.groupBy("digest").agg(F.first("data").alias("data")).write.format("parquet")
    with shuffles_freed(spark):
        writer.option("compression", "uncompressed").option("path", path).bucketBy(buckets, "digest").saveAsTable(name)
    store = spark.table(name)
    return store, dictionary


def _rebuild(dictionary: bytes):
    return lambda batches: _rebuilt(batches, zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)))


def _rebuilt(batches: Iterator[pa.RecordBatch], unpacker: zstandard.ZstdDecompressor) -> Iterator[pa.RecordBatch]:
    media, parts, n = None, [], 0

    def done() -> list:
        whole = b"".join(parts)
        if len(parts) != n or hashlib.sha256(whole).digest() != media:
            raise ValueError("a file's chunks do not give its digest")
        payload = from_wav(whole)
        return [media, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-UNIT:]), len(whole), features(payload)]

    names = ["media", "payload_bytes", "payload", "tail_crc32", "media_bytes", "feature"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
    for b in batches:
        out = []
        for m, size, data in zip(*[b.column(c) for c in ("media", "n", "data")], strict=True):
            m = m.as_py()
            if m != media:
                if media is not None:
                    out.append(done())
                media, parts, n = m, [], size.as_py()
            chunk = unpacker.decompress(data.as_py())
            parts.append(chunk)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if media is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(done(), kinds, strict=True)], names)


def hot_digests(files: DataFrame) -> DataFrame | None:
    """(digest) of the chunks that more than one in ``HOT_SHARE`` places of ``files`` need, so fewer than that; None if there are none."""
    places = files.select(F.explode("digests").alias("digest"))
    total = files.agg(F.coalesce(F.sum(F.size("digests")), F.lit(0))).first()[0]
    hot = places.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HOT_LEAST, total // HOT_SHARE)).select("digest")
    got = [r["digest"] for r in hot.collect()]
    return files.sparkSession.createDataFrame([(d,) for d in got], "digest binary") if got else None


def read_media(files: DataFrame, store: DataFrame, dictionary: bytes) -> DataFrame:
    """By file of ``files`` (media, digests; distinct): what its verified bytes give. See the module; payload is a SHA-256.

    A bucketed store is joined without moving it, so Spark could not split a hot digest; the chunks of these, ``HOT_SHARE`` times
    ``MOST`` bytes at most, are broadcast instead.
    """
    with shuffles_freed(files.sparkSession):
        hot = hot_digests(files)
    places = files.select("media", F.size("digests").alias("n"), F.posexplode("digests").alias("at", "digest"))
    if hot is None:
        rows = places.join(store, "digest").select("media", "at", "n", "data")
    else:
        some = store.join(F.broadcast(hot), "digest", "left_semi")
        rows = places.join(F.broadcast(hot), "digest", "left_anti").join(store, "digest").select("media", "at", "n", "data")
        rows = rows.unionByName(places.join(F.broadcast(some), "digest").select("media", "at", "n", "data"))
    rows = rows.repartition("media").sortWithinPartitions("media", "at").select("media", "n", "data")
    return rows.mapInArrow(_rebuild(dictionary), "media binary, payload_bytes bigint, payload binary, tail_crc32 bigint, media_bytes bigint, feature string")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    listed = staged(manifests(docs), "media-manifests")
    store, dictionary = write_chunks(docs, staged_path(spark, "media-chunks"))
    files = listed.groupBy("media").agg(F.first("digests").alias("digests"))
    back = read_media(files, store, dictionary).withColumnRenamed("media", "m")
    out = listed.select("doc_id", "n_bytes", "media").join(back, F.col("media") == F.col("m"))
    hexed = lambda c, name: F.lower(F.hex(c)).alias(name)
    return out.select("doc_id", "n_bytes", "payload_bytes", hexed("payload", "payload_sha256"), "tail_crc32", "media_bytes", hexed("media", "media_sha256"), "feature")
