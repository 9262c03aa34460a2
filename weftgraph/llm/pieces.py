"""SentencePiece encoding and decoding by a streaming Viterbi search.

A lattice has a node for each character boundary and an edge for each piece. For every boundary
the search keeps one backpointer: of a unigram model the edge of the best sum of scores; of a byte-pair model
the only edge by which the merges of the text so far can end there. A piece has a longest length, so
only the last boundaries of that many can have further edges: these are the survivors. As soon
as their paths back meet in one boundary, the ids up to it are final and leave the window. Texts of any
length so need a window of little more than the longest piece.

(Why one edge, for byte-pair models: merging is local, so a sequence of pieces is what merging yields exactly if each two
neighbours are what merging yields of the two alone, and every prefix of a text has one such sequence.)

No piece but a run of word marks has a mark after another character, so every word boundary is a
boundary in which all paths meet. Between two such lies a run; the streaming search goes once over each distinct
run of a slice of texts, whatever its length, and the texts' ids are gathered from those of their runs.

Defined cases: a null text is an empty one and has no ids; equal rows are encoded alike and stay rows of their own;
very long texts and words are streamed; an empty table gives an empty result; further columns are kept by
:func:`encoded`, whatever their names, and do not matter to :func:`digests`. Characters without a piece become their
UTF-8 bytes' pieces, or the unknown id in models without these.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .gather import gathered, give_back, offsets_of, slices
from .memo import Memo

MARK = "▁"
#: Boundaries between two looks for a common one.
STEP = 64
#: Runs between sure boundaries up to this length are remembered; all are streamed.
KEPT = 64
#: Bytes of text encoded together.
SLICE = 4 << 20
#: Neighbouring pieces remembered as fitting or not.
MOST_PAIRS = 1 << 18
#: Runs without their last mark that are remembered, for each of two generations; about 150 bytes each.
RUNS = 150_000

_RUNS = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceModel:
    """A SentencePiece model file: its pieces, scores and kind, and the functions of this module over them."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(proto if proto is not None else open(path, "rb").read())  # a local tokenizer file, not an input table
        self.unigram = m.trainer_spec.model_type == 1
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and byte-pair models")
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models whose normaliser keeps the text")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.ids, self.score, self.bytes = {}, {}, {}
        self.text: list[bytes] = []
        self.unknown = 0
        for i, p in enumerate(m.pieces):
            shown = p.piece.replace(MARK, " ").encode()
            if p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.ids[p.piece], self.score[p.piece] = i, p.score
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                shown = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.UNKNOWN:
                self.unknown, shown = i, " ⁇ ".encode()
            else:
                shown = b""
            self.text.append(shown)
        self.longest = max(map(len, self.ids), default=1)
        #: Neighbouring characters within pieces; between others no piece reaches, so all paths meet there.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: Finds the pieces of two characters and more in a text.
        self.found = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                self.found.add_word(p, p)
        self.found.make_automaton()
        self.breaks = not any("\n" in p for p in self.ids)  # a line's end is a boundary then
        self.worst = min(self.score.values(), default=0.0) - 10
        self.pairs: dict = {}
        self.memo, self.ends = Memo(RUNS), Memo(RUNS)
        self.shown = pa.array(self.text, pa.large_binary())

    def forget(self) -> None:
        """Give back what was remembered: workers outlive their tasks, and further stages need the memory."""
        self.pairs = {}
        self.memo, self.ends = Memo(RUNS), Memo(RUNS)
        give_back()

    # the lattice

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: best score first, leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging leaves these neighbours as they are; an unknown character merges with nothing."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            one = left if left in self.ids else ""
            known = self.pairs[key] = right not in self.ids or self.merge(one + right) == ([one, right] if one else [right])
        return known

    def out(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]


class Stream:
    """Encodes text (word marks for spaces) that comes in parts; ``push`` and ``close`` return ids as they become final."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.text = ""  # of the window
        self.back = [0]  # for each boundary of the window, where its edge begins
        self.ending = [""]  # and the piece of that edge; first the final one before the window
        self.sums = [0.0]
        self.peak = 0  # the longest window so far

    def push(self, text: str) -> list[int]:
        ids: list[int] = []
        for at in range(0, len(text), STEP):
            self.text += text[at : at + STEP]
            if self.m.unigram:
                self._extend_by_score()
            else:
                self._extend_by_merges()
            n = len(self.text)
            if n > self.peak:
                self.peak = n
            if n > self.m.longest:  # a shorter window is kept: all its boundaries may survive
                ids += self._commit(self._common())
        return ids

    def close(self) -> list[int]:
        return self._commit(len(self.back) - 1)

    def _extend_by_score(self) -> None:
        m, text, back, sums, ending = self.m, self.text, self.back, self.sums, self.ending
        ids, longest = m.ids, m.longest
        for end in range(len(back), len(text) + 1):
            best, begin = sums[end - 1] + (m.score[text[end - 1]] if text[end - 1] in ids else m.worst), end - 1
            for start in range(max(0, end - longest), end - 1):
                s = m.score.get(text[start:end])
                if s is not None and sums[start] + s > best:
                    best, begin = sums[start] + s, start
            sums.append(best)
            back.append(begin)
            ending.append(text[begin:end])

    def _extend_by_merges(self) -> None:
        m, text, back, ending = self.m, self.text, self.back, self.ending
        pairs, done = m.pairs, len(back)  # the first boundary without an edge
        for at, piece in m.found.iter(text, max(0, done - m.longest)):  # for each end the longest piece first
            if at < done - 1:
                continue
            while done <= at:  # no piece of two characters or more fits there
                back.append(done - 1)
                ending.append(text[done - 1])
                done += 1
            start = done - len(piece)
            key = (ending[start], piece)
            if pairs[key] if key in pairs else m.fits(*key):
                back.append(start)
                ending.append(piece)
                done += 1
        for end in range(done, len(text) + 1):
            back.append(end - 1)
            ending.append(text[end - 1])

    def _common(self) -> int:
        """The last boundary on the paths of all survivors."""
        n = len(self.back) - 1
        open_ = set(range(max(0, n - self.m.longest + 1), n + 1))
        while len(open_) > 1:
            top = max(open_)
            open_.remove(top)
            open_.add(self.back[top])
        return open_.pop()

    def _commit(self, upto: int) -> list[int]:
        back, ending, m = self.back, self.ending, self.m
        pieces, end = [], upto
        while end:
            pieces.append(ending[end])
            end = back[end]
        if pieces:
            self.text = self.text[upto:]
            self.back = [0, *[b - upto if b > upto else 0 for b in back[upto + 1 :]]]
            self.ending = ending[upto:]
            if m.unigram:
                self.sums = [s - self.sums[upto] for s in self.sums[upto:]]
        ids = m.ids
        pieces.reverse()
        return [ids[p] for p in pieces] if all([p in ids for p in pieces]) else [i for p in pieces for i in m.out(p)]


def _encode_run(model: PieceModel, run: str) -> bytes:
    s = Stream(model)
    return array("I", s.push(run) + s.close()).tobytes()


def _encode_runs(model: PieceModel, runs: list[str]) -> list[bytes]:
    """Distinct runs; a last character after a sure boundary is parted from its run, which is then looked up alone."""
    cut = [len(r) - (len(r) > 1 and r[-2:] not in model.inside) for r in runs]
    kept = [r[:c] if c <= KEPT else "" for r, c in zip(runs, cut, strict=True)]
    cores = model.memo.values(kept, lambda new: [_encode_run(model, r) for r in new])
    ends = model.ends.values([r[c:] for r, c in zip(runs, cut, strict=True)], lambda new: [_encode_run(model, r) for r in new])
    return [(a if k or not c else _encode_run(model, r[:c])) + b for a, b, k, r, c in zip(cores, ends, kept, runs, cut, strict=True)]


def _runs_of(model: PieceModel, text: str) -> list[str]:
    """The parts of a text between sure boundaries, whatever its characters are."""
    out = []
    for k, line in enumerate((text.split("\n") if model.breaks else [text]) if text else []):
        if k:
            out.append("\n")
        out += _RUNS.findall((model.prefix if k == 0 else "") + line.replace(" ", MARK))
    return out


def encode_column(model: PieceModel, texts: pa.Array) -> pa.Array:
    """Ids of each text as little-endian unsigned 32-bit integers (large binary)."""
    if model.prefix:
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
    # texts without signs of their own that would change where runs begin are cut by Arrow, the others one by one
    odd = pc.match_substring_regex(texts, f"  |{MARK}|\\x00")
    cut = pc.replace_substring(texts, " ", "\0" + MARK)
    if model.breaks:
        cut = pc.replace_substring(cut, "\n", "\0\n\0")
    cut = pc.split_pattern(cut, "\0")
    which = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
    if which:
        unmarked = [t[len(model.prefix) :] for t in texts.take(pa.array(which, pa.int64())).to_pylist()]
        lists = cut.to_pylist()
        for i, t in zip(which, unmarked, strict=True):
            lists[i] = _runs_of(model, t)
        cut = pa.array(lists, pa.list_(pa.string()))
    return gathered(cut.flatten(), offsets_of(cut), lambda runs: _encode_runs(model, runs))


def encode(model: PieceModel, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    return encode_column(model, pa.array(texts, pa.string())).to_pylist()


def decode_column(model: PieceModel, ids: pa.Array) -> list[str]:
    """The texts of ids as :func:`encode_column` gives them; bytes that are no UTF-8 become the replacement character."""
    ends = offsets_of(ids)
    data = ids.buffers()[2]
    every = np.frombuffer(data, "<u4")[ends[0] // 4 : ends[-1] // 4] if data is not None else np.zeros(0, np.uint32)
    shown = model.shown.take(pa.array(every))
    at = offsets_of(shown)[(ends - ends[0]) // 4].tolist()
    raw = memoryview(shown.buffers()[2]) if shown.buffers()[2] is not None else b""
    skip = len(model.prefix)
    parts = [bytes(raw[a:b]) for a, b in zip(at, at[1:])]
    return [(p[skip:] if p.startswith(b" ") else p).decode("utf-8", errors="replace") for p in parts]


def decode(model: PieceModel, ids: bytes) -> str:
    return decode_column(model, pa.array([ids], pa.large_binary()))[0]


_MODELS: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    """One model a worker and file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """The columns of ``docs`` but text, and piece_ids (array of ints); a column of that name must not be there."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for b in batches:
            last = b.num_columns - 1
            for part in slices(b, last, SLICE):
                ids = encode_column(model, part.column(last))
                data = ids.buffers()[2]
                ids = pa.ListArray.from_arrays(pa.array(offsets_of(ids) // 4, pa.int32()), pa.array(np.frombuffer(data, np.int32) if data is not None else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [*b.schema.names[:-1], "ids_"])
        model.forget()

    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}_") for i, c in enumerate(keep)], text_or_empty().alias("text_"))
    out = rows.mapInArrow(run, rows.drop("text_").withColumn("ids_", F.array().cast("array<int>")).schema)
    return out.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(keep)], F.col("ids_").alias("piece_ids"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars, n_ids, ids_crc32, decoded_sha256 and whether decoding gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for b in batches:
            for part in slices(b, 1, SLICE):
                texts = part.column(1).to_pylist()
                coded = encode_column(model, part.column(1))
                back, ids = decode_column(model, coded), coded.to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([x == y for x, y in zip(texts, back, strict=True)])],
                    ["doc_id", "n_chars", "n_ids", "ids_crc32", "decoded_sha256", "same_text"],
                )
        model.forget()

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, same_text boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
