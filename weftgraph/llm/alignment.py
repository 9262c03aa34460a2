"""Alignment of two tokenizers' ids by a transducer over what one side is ahead.

Two sequences of tokens spell the same bytes. The state is the side that leads and its bytes that the other has not reached: the
dangling suffix. The side behind gives the next token; what is left over is the next state. Where nothing dangles, both have
ended a token at the same byte, and the group is closed. States are numbered, and a transition is remembered by state and token.

Neither tokenizer joins anything over the beginning of a run of white space, so both end a token there and texts are cut. (Of the piece model
this is read off its pieces: runs that begin with white space which a piece has after another character, as the carriage return, stay whole.) The transducer runs once over each
distinct part of a slice of texts, behind a memo; what the texts have is gathered by number.

Counts of pairs of ids over the corpus: texts are taken in blocks of a few megabytes. A block sends each of its pairs once, with the number of its texts
that have it; sums over the corpus and each first id's highest sum go back to the block's pairs, and then to its texts. So frequent pairs are
one row a block, and no row is made for a pair of a text.

Defined cases: a null or empty text, and one that a tokenizer does not give back byte for byte, has no tokens: zeros and an empty digest; equal
rows stay rows of their own; a very long text is a block of its own; a group of many tokens has a number for each distinct pair, its
links are counted, not listed; an empty table gives an empty result; further columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import struct
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytelevel import byte_table, ids_of_parts, once
from .common import drop_staged, staged, table, text_or_empty
from .gather import blank_runs, gathered, slices
from .memo import Memo

#: Bytes of text of a block.
BLOCK_BYTES = 8 << 20
#: Transitions that are remembered.
MOST_STEPS = 1 << 19
#: Parts between white space that are remembered, for each of two generations; about 600 bytes each.
PARTS = 100_000
#: Links of a group that are listed one by one, before equal ones are counted.
LISTED = 64
#: Parts whose ids are held at once.
AT_ONCE = 1024
#: Of a part: whether both sides give it back (1 or 0), tokens of both sides, groups, links, distinct or listed pairs.
HEAD = struct.Struct("<6q")
MARKS = ".,"
MARK = "▁"


class Transducer:
    """Groups of two token sequences that spell the same bytes."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.of = (bytes_a, bytes_b)
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]  # (side that leads, what dangles)
        self.number = {(0, b""): 0, (1, b""): 0}
        self.turn = [0]  # the side that gives the next token: the one behind, or the first
        self.steps: list[dict[int, int]] = [{}]  # for each state, the states after the tokens met in it
        self.kept = 0

    def _step(self, state: int, token: int) -> int:
        """The state after the token of the side behind; -1 where the bytes differ."""
        rest, side = self.states[state][1], self.turn[state]
        given = self.of[side][token]
        if rest.startswith(given):
            found = (1 - side, rest[len(given) :])
        elif given.startswith(rest):
            found = (side, given[len(rest) :])
        else:
            return -1
        after = self.number.setdefault(found, len(self.states))
        if after == len(self.states):
            self.states.append(found)
            self.turn.append(1 - found[0])
            self.steps.append({})
        self.steps[state][token] = after
        self.kept += 1
        return after

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """The ends in ``a`` and ``b`` of each group; None if the sequences do not spell the same bytes."""
        if self.kept > MOST_STEPS:
            self.forget()
        out, i, j, state, n_a, n_b = [], 0, 0, 0, len(a), len(b)
        turn, steps = self.turn, self.steps
        while i < n_a or j < n_b:
            if turn[state]:
                if j == n_b:
                    return None
                token = b[j]
                j += 1
            else:
                if i == n_a:
                    return None
                token = a[i]
                i += 1
            after = steps[state].get(token)
            if after is None:
                after = self._step(state, token)
            if after > 0:
                state = after
            elif after == 0:
                state = 0
                out.append((i, j))
            else:
                return None
        return out if state == 0 else None


class Pair:
    """Two tokenizers: a byte-level one of the tokenizers library, and a piece model with a blank before the text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: b for b, c in byte_table().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for shown, i in vocabulary.items():
            # a special token's form may have characters of no byte; it is never given, as its form is ordinary text
            bytes_a[i] = bytes([back[c] for c in shown]) if all(c in back for c in shown) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_b = len(bytes_b)
        self.transducer = Transducer(bytes_a, bytes_b)
        normal = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        inside = {c for p in normal for c in p.lstrip(MARK)[1:] if c == MARK or c.isspace()} | {p.lstrip(MARK)[:1] for p in normal if p[0] == MARK and p.lstrip(MARK)[:1].isspace()}
        #: White space before which the piece model may not end a token; None if that is not only single bytes.
        self.inside = "".join(inside).encode() if all(c.isascii() and c != " " for c in inside) else None
        #: A blank without anything behind it.
        self.alone = [self.b.piece_to_id(MARK)]
        letters = [x for x in map(chr, range(128)) if x.isalpha()]
        inside = {p[i : i + 2] for p in normal for i in range(len(p) - 1)}
        #: Marks that the piece model never joins to a letter of ASCII, so that both sides end a token between them.
        self.marks = "".join(m for m in MARKS if not any(x + m in inside for x in letters)).encode()
        self.memo = Memo(PARTS)

    def ids(self, parts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Both sides' ids of parts, each being the beginning of a text after its blank, or its continuation.

        The piece model writes a blank before what it encodes: that of the part itself, or else one that stays alone and is dropped;
        before a mark, a letter that joins nothing behind it is dropped with the blank.
        """
        a = ids_of_parts(self.a, parts)
        b = self.b.encode([p[1:] if p[0] == " " else "a" + p if p[0] in MARKS else p for p in parts], num_threads=1)
        return [(x, self.alone if p == " " else y if p[0] == " " else y[1:]) for p, x, y in zip(parts, a, b, strict=True)]

    def measure(self, parts: list[str]) -> list[bytes]:
        """What each part has, in one string of bytes: HEAD's numbers, pairs, how many links each, what the groups look like."""
        return [x for at in range(0, len(parts), AT_ONCE) for x in self._measured(parts[at : at + AT_ONCE])]

    def _measured(self, parts: list[str]) -> Iterator[bytes]:
        size, shown_a = self.size_b, self.transducer.of[0]
        for part, (a, b) in zip(parts, self.ids(parts), strict=True):
            ends = self.transducer.groups(a, b)
            # both spell the same; and it is the part
            if ends is None or b"".join([shown_a[i] for i in a]) != part.encode():
                yield HEAD.pack(0, 0, 0, 0, 0, 0)
                continue
            i = j = links = 0
            looks, keys, many = [], [], []
            for m, n in ends:
                if m == i + 1 and n == j + 1:  # most are one to one
                    x, y = a[i], b[j]
                    looks.append(f"{x}|{y};")
                    keys.append(x * size + y)
                    links += 1
                    i, j = m, n
                    continue
                some, other = a[i:m], b[j:n]
                looks.append(f"{','.join(map(str, some))}|{','.join(map(str, other))};")
                links += (m - i) * (n - j)
                if (m - i) * (n - j) <= LISTED:
                    keys += [x * size + y for x in some for y in other]
                else:
                    right = Counter(other)
                    many += [1] * (len(keys) - len(many))
                    for x, k in Counter(some).items():
                        keys += [x * size + y for y in right]
                        many += [k * q for q in right.values()]
                i, j = m, n
            many += [1] * (len(keys) - len(many))
            yield HEAD.pack(1, len(a), len(b), len(ends), links, len(keys)) + array("q", keys).tobytes() + array("q", many).tobytes() + "".join(looks).encode()


BLOCK_SCHEMA = "block bigint, doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups binary, slots binary, many binary, pairs array<bigint>, texts array<bigint>"


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, digest: bool = True) -> DataFrame:
    """A row a text: its numbers, its groups (their digest, or whole), and its pairs as places in its block's list; a block's first row has that list.

    Blocks are numbered by task, so this must be staged before it is read.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    schema = BLOCK_SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block = once(Pair, path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in slices(batch, 1, BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays(_block(both, some, block, digest), names)
                block += 1

    return rows.mapInArrow(run, schema)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[ends[1:]] - total[ends[:-1]]


def _split(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw, at = values.tobytes(), (ends * values.itemsize).tolist()
    return [raw[s:e] for s, e in zip(at, at[1:])]


def _block(both: Pair, some: pa.RecordBatch, block: int, digest: bool) -> list[pa.Array]:
    given = some.column(1)
    texts = pa.array([" " + t if t else "" for t in given.to_pylist()], pa.large_string())
    if both.inside is not None:
        parts, ends = blank_runs(texts, both.marks, both.inside)
    else:
        there = np.array([len(t) > 0 for t in texts.to_pylist()], bool)
        parts, ends = texts.filter(pa.array(there)), np.append(0, np.cumsum(there))
    coded = parts.dictionary_encode()
    known = both.memo.values(coded.dictionary.to_pylist(), both.measure)
    which = coded.indices.to_numpy().astype(np.int64)
    h = HEAD.size
    heads = np.frombuffer(b"".join([k[:h] for k in known]), np.int64).reshape(-1, h // 8)
    same, n_a, n_b, n_groups, n_links, length = heads.T
    middle, last = (h + 8 * length).tolist(), (h + 16 * length).tolist()
    whole = _sums(1 - same[which], ends) == 0
    counts = [np.where(whole, _sums(x[which], ends), 0) for x in (n_a, n_b, n_groups, n_links)]
    # what the groups look like
    shown = gathered(parts, ends, lambda _: [k[e:] for k, e in zip(known, last, strict=True)])
    looks = [bytes(x.as_buffer()[:-1]) if ok and x.as_buffer().size else b"" for x, ok in zip(shown, whole.tolist(), strict=True)]
    if digest:
        looks = [hashlib.sha256(x).hexdigest().encode() if x else b"" for x in looks]
    # pairs of each distinct part, then of each text: equal parts of a text first become one
    text_of = np.repeat(np.arange(len(texts)), np.diff(ends))
    kept = whole[text_of]
    of_text, times = np.unique(text_of[kept] * max(1, len(known)) + which[kept], return_counts=True)
    text, part = np.divmod(of_text, max(1, len(known)))
    keys, slots = np.unique(np.frombuffer(b"".join([k[h:e] for k, e in zip(known, middle, strict=True)]), np.int64), return_inverse=True)
    each = np.frombuffer(b"".join([k[m:e] for k, m, e in zip(known, middle, last, strict=True)]), np.int64)
    begin = np.append(0, np.cumsum(length))
    n = length[part]
    at = np.arange(n.sum()) + np.repeat(begin[part] - np.append(0, np.cumsum(n))[:-1], n)
    linked, back = np.unique(np.repeat(text, n) * max(1, len(keys)) + slots[at], return_inverse=True)
    many = np.bincount(back, each[at] * np.repeat(times, n), len(linked)).astype(np.int64)
    text, slot = np.divmod(linked, max(1, len(keys)))
    texts_with = np.bincount(slot, minlength=len(keys))
    used = np.flatnonzero(texts_with)
    number = np.zeros(len(keys), np.int64)
    number[used] = np.arange(len(used))
    upto = np.searchsorted(text, np.arange(len(texts) + 1))
    first = [keys[used].tolist() if len(texts) else None, *[None] * (len(texts) - 1)]
    first_n = [texts_with[used].tolist() if len(texts) else None, *[None] * (len(texts) - 1)]
    columns = [pa.array(np.full(len(texts), block)), some.column(0), *map(pa.array, counts)]
    columns += [pa.array(looks, pa.binary()), pa.array(_split(number[slot].astype(np.uint32), upto), pa.binary()), pa.array(_split(many, upto), pa.binary())]
    return [*columns, pa.array(first, pa.list_(pa.int64())), pa.array(first_n, pa.list_(pa.int64()))]


def aligned(docs: DataFrame, path_a: str, path_b: str, digest: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and the groups' digest or form, for each text."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    blocks = staged(aligned_blocks(docs, path_a, path_b, digest), "aligned")
    own = blocks.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "texts")).alias("slot", "x")).select(F.col("block").alias("of"), "slot", F.col("x.pairs").alias("pair"), F.col("x.texts").alias("texts"))
    counts = staged(own.groupBy(F.col("pair").alias("p")).agg(F.sum("texts").alias("n")).withColumn("a", F.expr(f"p div {size_b}")), "pair-counts")
    # as many rows as the first vocabulary has ids
    highest = counts.groupBy(F.col("a").alias("h")).agg(F.max("n").alias("most"))
    known = counts.join(F.broadcast(highest), F.col("a") == F.col("h")).select("p", "n", (F.col("n") == F.col("most")).alias("best"))
    values = own.join(known, F.col("pair") == F.col("p")).select("of", "slot", "n", "best")
    texts = blocks.drop("pairs", "texts")
    out_schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups binary"

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("slot").to_numpy())
        n, best = right.column("n").to_numpy()[order], right.column("best").to_numpy()[order]
        slots, many = left.column("slots").to_pylist(), left.column("many").to_pylist()
        ends = np.append(0, np.cumsum([len(s) // 4 for s in slots])).astype(np.int64)
        slot, times = np.frombuffer(b"".join(slots), np.uint32), np.frombuffer(b"".join(many), np.int64)
        sums = [_sums(np.where(best[slot], times, 0), ends), _sums(n[slot] * times, ends)] if len(slot) else [np.zeros(len(slots), np.int64)] * 2
        columns = [left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*columns, *map(pa.array, sums), left.column("groups")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    out = staged(texts.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(look_up, out_schema), "alignment")
    drop_staged(blocks)
    drop_staged(counts)
    return out


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").cast("string").alias("groups_sha256"))
