"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank among all ids of the corpus, so that the frequent ones need one
byte. A rank takes 1 to 4 bytes; the lengths are not in these bytes but in separate control bytes, two
bits each, four to a byte. A decoder looks the four lengths up by control byte, adds them up, and
gathers all ranks of a block at once in numpy.

Files are Parquet, written by Spark's committer, so that tasks may be repeated anywhere. ``ids``
has a row for each block of whole documents: shard, block, first (ids before it in its shard), doc_ids, counts, control, data
and the crc32 of both. ``ranks`` has the id of each rank. Shards and blocks are in ascending order of doc_id
(null first), equal ids in order of their ids' bytes.

Defined cases: a null text is an empty one and has the end id only; equal rows are documents of their own; an empty
table gives no blocks and an empty result; a document is never split, so a very long one is a block of its own.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, staged, staged_path, table, text_or_empty
from .gather import gathered, offsets_of, slices
from .memo import Memo

#: Ids of a block, but for the last document of it.
BLOCK_IDS = 1 << 16
END_ID = 2
#: Bits of ids: more distinct ids than this are refused, as their ranks are sent to every task.
MOST_IDS = 1 << 22
#: Words remembered in lower case and without a mark, for each of two generations; about 150 bytes each.
CORES = 500_000
#: Texts whose ids are counted together.
TEXTS = 256

_LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.int64)


#: A special token may begin here, or a mark with which letters of ASCII can become one character.
_WHOLE = "<\\||[\u0300-\u036f]"


#: The byte-level alphabet by its rule: printable bytes stand for themselves, the others for what follows 255, in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


def _plain(word: str) -> bool:
    """Latin letters that lower-casing and composition keep one by one."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250" and "\u0130" not in word)


class Encoder:
    """The tokenizers library, asked once for each distinct word of a slice of texts, behind a memo.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its words. A word of Latin
    letters before a full stop or comma is looked up without it, as the vocabulary's own splitter would have it.
    """

    def __init__(self, path: str, kind: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_file(path), "I" if kind == "<u4" else "H"
        self.size = self.library.get_vocab_size()
        self.cores = Memo(CORES)
        self.marks = dict(zip(("", ".", ","), self._direct(["", ".", ","]), strict=True))

    def _direct(self, words: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _cores(self, words: list[str]) -> list[bytes]:
        """Plain lower-case words need no normaliser and splitter: only their bytes' signs and the library's merges."""
        merge, signs, kind = self.library.model.tokenize, _SIGNS, self.kind
        out, other = [], []
        for i, w in enumerate(words):
            if _plain(w):
                out.append(array(kind, [t.id for t in merge(w if w.isascii() else "".join([signs[c] for c in w.encode()]))]).tobytes())
            else:
                out.append(b"")
                other.append(i)
        for i, ids in zip(other, self._direct([words[i] for i in other]) if other else (), strict=True):
            out[i] = ids
        return out

    def _make(self, words: list[str]) -> list[bytes]:
        known, cores, marks = self.marks, [], []
        for w in words:
            mark = b""
            if not w.isalpha() and w[-1:] in known and _plain(w[:-1]):
                w, mark = w[:-1], known[w[-1]]
            cores.append(w if w.isascii() or not _plain(w) else w.lower())
            marks.append(mark)
        return [c + m if m else c for c, m in zip(self.cores.values(cores, self._cores), marks, strict=True)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text, each in the encoder's kind.

        A-Z are lower-cased at once. Texts in which that could matter to the normaliser (marks that join with
        letters) or make a special token are left to the library whole.
        """
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = np.flatnonzero(pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)).tolist()
        aside = dict(zip(whole, self._direct(texts.take(pa.array(whole, pa.int64())).to_pylist()), strict=True)) if whole else {}
        words = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
        out = gathered(words.flatten(), offsets_of(words), self._make).to_pylist()
        for i, ids in aside.items():
            out[i] = ids
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str = "<u4") -> Encoder:
    """One encoder a worker, vocabulary and kind."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def id_kind(path: str) -> str:
    """The numpy type that ids of this vocabulary have between the stages: two bytes are enough for most."""
    return "<u2" if encoder(path).library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _slices(column: pa.Array, n: int) -> Iterator[list]:
    for at in range(0, len(column), n):
        yield column.slice(at, n).to_pylist()


def encoded(docs: DataFrame, path: str, end_id: int | None = END_ID, kind: str = "<u4") -> DataFrame:
    """doc_id and ids (binary, of numpy type ``kind``, <u4 or <u2), the end id included."""
    end = b"" if end_id is None else np.array([end_id], dtype=kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, kind)
        for b in batches:
            for part in slices(b, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x + end for x in coder.encode(part.column(1))], pa.binary())], ["doc_id", "ids"])

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit ranks."""
    length = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = length - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    raw = np.ascontiguousarray(ranks, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < length[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks: lengths by table, places by running sum, bytes gathered for all ranks at once."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(length) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def ranked_ids(ids: DataFrame, kind: str = "<u4") -> DataFrame:
    """(rank, id): the most frequent id has rank 0; equal counts go by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            for some in _slices(b.column(0), TEXTS):
                seen = np.bincount(np.frombuffer(b"".join(some), kind), minlength=len(total))
                seen[: len(total)] += total
                total = seen
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    counts = ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    # as many rows as the vocabulary has ids
    return counts.select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"), "id")


def write_tokens(ids: DataFrame, path: str, shards: int | None = None, kind: str = "<u4") -> None:
    """Write ``ids`` (doc_id, ids of numpy type ``kind``; staged, as it is read twice) to ``path`` in this format."""
    spark = ids.sparkSession
    ranked_ids(ids, kind).write.parquet(f"{path}/ranks")
    table_rows = spark.read.parquet(f"{path}/ranks")
    if table_rows.count() > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} distinct ids")
    got = table_rows.toPandas()
    rank_of = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, np.uint32)
    rank_of[got["id"].to_numpy()] = got["rank"].to_numpy()
    sent = spark.sparkContext.broadcast(rank_of)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"shard int, block int, first bigint, doc_ids array<{ids.schema['doc_id'].dataType.simpleString()}>, counts array<int>, control binary, data binary, crc bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, block, shard = 0, 0, None
        names, id_type = [x.split(" ")[0] for x in schema.split(", ")], None
        width = np.dtype(kind).itemsize
        docs, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal first, block, docs, texts, held
            control, data = pack(sent.value[np.frombuffer(b"".join(texts), kind)])
            row = [[shard], [block], [first], [docs], [[len(t) // width for t in texts]], [control], [data], [zlib.crc32(data, zlib.crc32(control))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(row, kinds, strict=True)], names)
            first, block, docs, texts, held = first + held, block + 1, [], [], 0
            return out

        for b in batches:
            id_type = b.schema.field(0).type
            for d, t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                shard = s
                docs.append(d)
                texts.append(t)
                held += len(t) // width
                if held >= BLOCK_IDS:
                    yield flush()
        if docs:
            yield flush()

    order = ids.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    order.withColumn("shard", F.spark_partition_id()).mapInArrow(run, schema).write.parquet(f"{path}/ids")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (binary, little-endian unsigned 32 bit) of the files at ``path``."""
    blocks = spark.read.parquet(f"{path}/ids")
    ranks = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")
    id_of = spark.sparkContext.broadcast(ranks["id"].to_numpy().astype("<u4"))
    doc_kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in ("shard", "first", "counts", "control", "data", "crc")}
                if zlib.crc32(row["data"], zlib.crc32(row["control"])) != row["crc"]:
                    raise ValueError("a block's checksum is wrong")
                ends = np.cumsum(row["counts"])
                ids = id_of.value[unpack(row["control"], row["data"], int(ends[-1]))]
                starts = [0, *ends[:-1].tolist()]
                raw = [ids[s:e].tobytes() for s, e in zip(starts, ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids")[i].values, pa.array([row["shard"]] * len(raw), pa.int32()), pa.array([row["first"] + s for s in starts], pa.int64()), pa.array(raw, pa.binary())],
                    ["doc_id", "shard", "at", "ids"],
                )

    # one row a shard
    totals = blocks.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = blocks.mapInArrow(run, f"doc_id {doc_kind}, shard int, at bigint, ids binary")
    return rows.join(F.broadcast(offsets), F.col("shard") == F.col("s")).select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "ids")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    kind = id_kind(vocabulary)
    ids = staged(encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, kind=kind), "token-ids")
    path = staged_path(spark, "tokens")
    write_tokens(ids, path, kind=kind)
    for f in {f.rsplit("/", 1)[0] for f in ids.inputFiles()}:
        drop_path(spark, f)
    out = read_tokens(spark, path)
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
