"""Byte-level byte-pair encoding and decoding by the tokenizers library, over Arrow batches.

A vocabulary of ranks (byte strings and their ids) becomes a model of the library: every byte is written as one
printable character by the byte table, and each token longer than a byte has one merge, of the two parts
that merging by lower ranks leaves of it. (Merging is local: if two neighbours make a token, the token's own bytes come to the
same two parts.) A match of the pattern that is a token as a whole is that token, whether merges lead to it or not.

No match of such a pattern reaches over the beginning of a run of white space, nor from a letter to a full stop or comma, so texts are cut
there. The library is asked once for each distinct part of a slice, behind a memo; the texts' ids are gathered by number. Parts that are one
match by their letters go to the library's merges in the byte table's characters, others through its splitter. Decoding reverses the byte table for each id
once and gathers bytes. Tokens may split a character: bytes are exact whatever the cut, offsets name the whole
character, and :class:`TextStream` keeps an unfinished character until its other bytes come.

Defined cases: a null text is an empty one and has no ids; equal rows stay rows of their own; a very long text is a slice of its own;
an empty table gives an empty result; columns named in ``keep`` come along, others do not matter; null ids are decoded as none; an id
that the vocabulary lacks raises.
"""

from __future__ import annotations

import base64
import codecs
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .gather import blank_runs, gathered, give_back, offsets_of, slices
from .memo import Memo

#: Bytes of text encoded together, and ids decoded together.
SLICE, IDS = 4 << 20, 1 << 19
#: Parts between white space that are remembered, for each of two generations; about 200 bytes each.
PARTS = 80_000


def byte_table() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable bytes stand for themselves, the others for what follows 255, in order."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - printed))}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:  # a local tokenizer file, not an input table
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def two_parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging by ranks below the token's own leaves of its bytes; leftmost of equal ranks first."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 1:
        found = [(ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(found)
        if rank >= own:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def library_of(ranks: dict[bytes, int], pattern: str):
    """The tokenizers library's model of these ranks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    signs = byte_table()
    shown = {token: "".join([signs[b] for b in token]) for token in ranks}
    pairs = (two_parts(token, ranks) for token in sorted(ranks, key=ranks.get) if len(token) > 1)
    merges = [(shown[p[0]], shown[p[1]]) for p in pairs if len(p) == 2]
    library = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    library.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return library


def bytes_by_id(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each id; null where there is none."""
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.large_binary())


def ids_of_parts(library, parts: list[str]) -> list[list[int]]:
    """The ids of parts of texts. A part that is one match by its letters needs only the merges, in the byte table's characters."""
    merge, signs = library.model.tokenize, byte_table()
    out, other = [], []
    for i, p in enumerate(parts):
        word = p[1:] if p[:1] == " " else p
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):  # a blank and letters by every version of Unicode
            shown = p.replace(" ", signs[32]) if p.isascii() else "".join([signs[b] for b in p.encode()])
            out.append([t.id for t in merge(shown)])
        else:
            out.append([])
            other.append(i)
    for i, e in zip(other, library.encode_batch_fast([parts[i] for i in other], add_special_tokens=False) if other else (), strict=True):
        out[i] = e.ids
    return out


class Encoder:
    """Ids, and the characters that they lie in, of columns of texts."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.library, self.memo = library_of(ranks, pattern), Memo(PARTS)
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def _make(self, parts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in ids_of_parts(self.library, parts)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, after a 0 the texts' ends among them)."""
        parts, ends = blank_runs(texts, b".,")
        raw = gathered(parts, ends, lambda new: self.memo.values(new, self._make))
        data = raw.buffers()[2]
        return np.frombuffer(data, np.uint32) if data is not None else np.zeros(0, np.uint32), offsets_of(raw).astype(np.int64) // 4

    def characters(self, texts: pa.Array, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each id the first of its characters' places in its text, and the place after the last."""
        at = offsets_of(texts).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if len(ids) else np.zeros(0, np.uint8)
        seen = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # characters begun before each byte
        upto = np.cumsum(self.lengths[ids])
        base = np.repeat(seen[at[:-1] - at[0]], np.diff(ends))
        return seen[upto - self.lengths[ids] + 1] - 1 - base, seen[upto] - base


_MADE: dict = {}


def once(make, *key):
    """One of a kind a worker."""
    if (make, *key) not in _MADE:
        _MADE[make, *key] = make(*key)
    return _MADE[make, *key]


def _list(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def encoded(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), offsets: bool = False) -> DataFrame:
    """The kept columns and ``ids``; with ``offsets`` also ``begins`` and ``ends``, in characters of the text."""
    rows = docs.select(*keep, text_or_empty().alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names = [*keep, "ids", *(["begins", "ends"] if offsets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once(Encoder, path, pattern)
        for b in batches:
            for part in slices(b, len(keep), SLICE):
                texts = part.column(len(keep))
                ids, ends = coder.encode(texts)
                columns = [_list(ids, ends)]
                if offsets:
                    columns += [_list(x, ends) for x in coder.characters(texts, ids, ends)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names)
        give_back()

    return rows.mapInArrow(run, ", ".join([kept, *(f"{n} array<int>" for n in names[len(keep) :])]))


def _table_of(path: str) -> pa.Array:
    return bytes_by_id(read_ranks(path))


def decoded(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``ids``, and ``bytes``, what the ids stand for; these need not be whole characters."""
    rows = rows.select(*keep, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = once(_table_of, path)
        for b in batches:
            for part in slices(b, len(keep), IDS):
                ids = part.column(len(keep))
                ends = offsets_of(ids).astype(np.int64)
                given = ids.flatten()
                known = pc.and_(pc.greater_equal(given, 0), pc.less(given, len(shown)))
                tokens = shown.take(given.filter(known))  # a null id is dropped here, and so found
                if len(tokens) < len(given) or tokens.null_count:
                    raise ValueError("an id is not in the vocabulary")
                at = np.ascontiguousarray(offsets_of(tokens).astype(np.int64)[ends - ends[0]])
                data = tokens.buffers()[2]
                out = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at), data if data is not None else pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([*part.columns, out.cast(pa.binary())], [*keep, "ids", "bytes"])
        give_back()

    return rows.mapInArrow(run, schema + ", bytes binary")


class TextStream:
    """Text of ids that come in parts. A character that a part's end splits comes with the next part; bytes that are none become U+FFFD."""

    def __init__(self, path: str):
        self.shown = once(_table_of, path)
        self.codec = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int], last: bool = False) -> str:
        return self.codec.decode(b"".join(self.shown.take(pa.array(ids, pa.int64())).to_pylist()), last)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = decoded(encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
