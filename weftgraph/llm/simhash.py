"""SimHash near-duplicates by a Gray-order hierarchical index.

Every text gets a 64-bit fingerprint. Distinct fingerprints are dealt out so that any two within
``bits`` differences meet: of ``blocks`` blocks of bits, at least ``blocks - bits`` are equal, so a row is
sent once for each choice of that many blocks, keyed by their value. In a task, the fingerprints of
a key are sorted by Gray rank; runs of them are factored into nodes that hold the bits
their members share (a mask and a pattern), and nodes into upper nodes. A search adds up the differences
from the root down, over the bits that each level newly shares, and drops a node with all below
it as soon as they exceed ``bits``. If even all bits that a node leaves open would not exceed them, its members
are linked at once, without looking at them.

Links are united within the task, so at most one row a fingerprint leaves it, never all pairs of a group. A key with
very many fingerprints is split: each pair of its parts meets in one task, and every link is found.

Defined cases: a null text is an empty one; texts without words have fingerprint zero and are linked
like any other; equal rows share a component; the id of a component ignores null ids unless it has no other; an empty table
gives an empty result; very long texts are read whole; further columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, staged, table, text_or_empty
from .components import connected_components
from .gather import give_back

WORDS, SEED, BITS = 4, 42, 4
#: Children of a node of the index, and codes of a lowest node.
FAN = 8
#: Codes searched together; bounds the memory of a search.
BLOCK = 2048
#: Keys are chosen so long that one has about so many fingerprints at most, if they are spread evenly.
KEY_ROWS = 512
#: A key with more fingerprints is split into parts of about half as many, however many parts that makes.
HOT_ROWS = 4096
#: Rows of a task when keys are dealt out.
TASK_ROWS = 1_000_000

#: Set bits of every byte value.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text; ``bytes.split`` cuts at exactly the white space of the word rule."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), seed)]
    else:
        line = b" ".join(parts)
        ends, at = [], -1
        for p in parts:
            at += len(p) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], seed) for s, e in zip(starts, ends[words - 1 :])]
    seen = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
    counts = np.bincount(seen.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (2 * counts.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, words: int = WORDS, name: str = "fp") -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([simhash(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.view(np.int64))], ["doc_id", name])

    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {name} bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order: neighbours in it differ in few bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A hierarchy over distinct codes in Gray order; see the module."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.fan = fan
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        masks, patterns = np.full(len(codes), full), self.codes
        self.levels = [(masks, patterns)]
        while len(patterns) > fan:
            at = np.arange(0, len(patterns), fan)
            same = np.bitwise_and.reduceat(patterns, at) | ~np.bitwise_or.reduceat(patterns, at)
            masks = same & np.bitwise_and.reduceat(masks, at)
            patterns = patterns[at] & masks
            self.levels.append((masks, patterns))

    def links(self, queries: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query index, first code, end) of runs of codes that are all within ``bits`` of the query."""
        top = len(self.levels) - 1
        for begin in range(0, len(queries), BLOCK):
            some = queries[begin : begin + BLOCK]
            roots = len(self.levels[top][1])
            q, node = np.repeat(np.arange(len(some)), roots), np.tile(np.arange(roots), len(some))
            spent, above = np.zeros(len(q), np.uint8), np.zeros(len(q), np.uint64)
            for level in range(top, -1, -1):
                masks, patterns = self.levels[level]
                new = masks[node] & ~above  # bits that this level shares and the level above did not
                spent = spent + np.bitwise_count((some[q] ^ patterns[node]) & new)
                near = spent <= bits
                q, node, spent = q[near], node[near], spent[near]
                open_bits = np.bitwise_count(~masks[node])
                sure = spent + open_bits <= bits
                if sure.any():
                    width = self.fan**level
                    yield begin + q[sure], node[sure] * width, np.minimum((node[sure] + 1) * width, len(self.codes))
                    q, node, spent = q[~sure], node[~sure], spent[~sure]
                if level == 0 or not len(q):
                    break
                above = np.repeat(masks[node], self.fan)
                child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                q, spent = np.repeat(q, self.fan), np.repeat(spent, self.fan)
                real = child < len(self.levels[level - 1][1])
                q, node, spent, above = q[real], child[real], spent[real], above[real]


def unite(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, least code of its component) for the codes that have links within ``bits``."""
    index = GrayIndex(codes)
    codes, parent = index.codes, list(range(len(codes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    joined = [0] * len(codes)  # the end of a run that begins here and is already one component
    for query, first, end in index.links(codes, bits):
        for q, a, e in zip(query.tolist(), first.tolist(), end.tolist()):
            if e - a > 1 and joined[a] >= e:
                e = a + 1
            elif e - a > 1:
                joined[a] = e
            for c in range(a, e):
                if c != q:
                    x, y = find(q), find(c)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
    root = np.array([find(i) for i in range(len(codes))], dtype=np.int64)
    least = np.full(len(codes), np.iinfo(np.int64).max)
    signed = codes.view(np.int64)
    np.minimum.at(least, root, signed)
    other = least[root] != signed
    return signed[other], least[root][other]


def _unite_keys(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes = [], []
        for b in batches:
            keys.append(b.column(0).to_numpy(zero_copy_only=False))
            codes.append(b.column(1).to_numpy(zero_copy_only=False))
        if not keys:
            return
        key, code = np.concatenate(keys), np.concatenate(codes).view(np.uint64)
        order = np.lexsort((code, key))
        key, code = key[order], code[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out_a, out_b = [], []
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
            if e - s > 1:
                a, b = unite(code[s:e], bits)
                if len(a):
                    out_a.append(a)
                    out_b.append(b)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def key_shape(n: int, bits: int) -> tuple[int, int]:
    """(blocks, equal blocks) for ``n`` fingerprints: the fewest copies of a row whose keys stay small."""
    for equal in range(1, 5):
        blocks = bits + equal
        if n / 2 ** (equal * 64 / blocks) <= KEY_ROWS or equal == 4:
            return blocks, equal
    raise AssertionError


def block_masks(blocks: int) -> list[int]:
    edge = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(blocks)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``fps`` (fp, distinct, staged) within ``bits``."""
    n = fps.count()
    blocks, equal = key_shape(n, bits)
    masks = [sum(block_masks(blocks)[i] for i in chosen) for chosen in combinations(range(blocks), equal)]
    copies = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(copies).alias("key"))
    hot = staged(rows.groupBy(F.col("key").alias("hot_key")).count().where(F.col("count") > HOT_ROWS), "sim-hot")
    if hot.count():
        # a part meets each part, itself included, in one task
        rows = rows.join(hot, F.col("key") == F.col("hot_key"), "left")
        parts = F.ceil(F.col("count") * 2 / HOT_ROWS).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit("part")), parts).cast("int")
        meets = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.xxhash64("key", F.least(p, own), F.greatest(p, own)))
        rows = rows.select("fp", F.explode(F.when(F.col("count").isNull(), F.array("key")).otherwise(meets)).alias("key"))
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(masks) * n // TASK_ROWS)
    return rows.select("key", "fp").repartition(tasks, "key").mapInArrow(_unite_keys(bits), "a bigint, b bigint")


def near_components(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that chains of links reach, the row's own included."""
    own = staged(with_fingerprint(docs, words), "sim-docs")
    fps = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "sim-fps")
    roots = connected_components(near_links(fps.select("fp"), bits))
    known = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = known.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    names = staged(known.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "sim-names")
    return own.join(names, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


# near copies by similarity: those within ``BITS`` by the Gray-order index, the others by their rarest shingles; all are verified on their shingles

COPY_WORDS, SIMILARITY = 5, 0.8
#: Texts whose shingles are counted, so that the others are ordered by rarity, and shingles kept as frequent. Any order finds all copies.
COUNTED_TEXTS, FREQUENT = 10_000, 200_000
#: Least and most bits of a text's parity print, as powers of two; 64 at least.
LEAST_PRINT, MOST_PRINT = 6, 14
#: All pairs of a key with at most so many texts are looked at together; longer keys one text at a time.
FEW = 8
#: Rows to go up to which they (24 bytes each) are broadcast.
GONE_ROWS = 1_000_000
#: Texts and shingles of a part of a group that is verified whole, and shingles of a task that does so.
PART_TEXTS, PART_SHINGLES, TASK_SHINGLES = 500, 500_000, 4_000_000


def shingles(text: bytes, words: int = COPY_WORDS) -> np.ndarray:
    """The text's distinct shingle hashes, in order."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    found = {xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), SEED) for i in range(max(1, len(parts) - words + 1))}
    return np.sort(np.array(list(found), dtype=np.uint64))


def prefix(hashes: np.ndarray, similarity: float, frequent: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The rarest shingles, so many that any two texts of at least ``similarity`` have one of theirs in common; a text without any has 0."""
    n = len(hashes)
    if not n:
        return np.zeros(1, np.uint64)
    count = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        count = np.where(frequent[at] == hashes, often[at], 0)
    return hashes[np.lexsort((hashes, count))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def print_level(n: int) -> int:
    """The power of two of the bits in the print of ``n`` shingles: one to two bits for each."""
    return min(MOST_PRINT, max(LEAST_PRINT, int(n).bit_length()))


def parity_print(hashes: np.ndarray) -> np.ndarray:
    """Of each bit, whether an odd number of shingles falls on it: two prints differ in no more bits than the sets in shingles."""
    bits = 1 << print_level(len(hashes))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


class Prints:
    """Prints by level; a print folded in half is the one of the level below, and similar texts are at most a level apart."""

    def __init__(self, n: np.ndarray, prints: list[bytes], similarity: float):
        self.n, self.similarity = n, similarity
        self.level = np.array([len(x).bit_length() + 2 for x in prints])
        self.at, self.words = {}, {}
        for level in np.unique(self.level).tolist():
            own, above = np.flatnonzero(self.level == level), np.flatnonzero(self.level == level + 1)
            half = (1 << level) // 64
            rows = [np.frombuffer(b"".join(prints[i] for i in k.tolist()), "<u8").reshape(len(k), w) for k, w in ((own, half), (above, 2 * half))]
            self.words[level] = np.concatenate([rows[0], rows[1][:, :half] ^ rows[1][:, half:]])
            self.at[level] = np.zeros(len(n), np.int64)
            self.at[level][np.concatenate([own, above])] = np.arange(len(own) + len(above))

    def possible(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of pairs that may be similar, the part of their shingles that differs at least)."""
        n, m = self.n[a], self.n[b]
        keep = np.flatnonzero(np.minimum(n, m) >= self.similarity * np.maximum(n, m) - 1e-9)
        a, b, both = a[keep], b[keep], (n + m)[keep]
        apart, level = np.zeros(len(keep), np.int64), np.minimum(self.level[a], self.level[b])
        for v in np.unique(level).tolist():
            some, words, at = np.flatnonzero(level == v), self.words[v], self.at[v]
            step = max(1, (1 << 20) // words.shape[1])
            for k in range(0, len(some), step):
                x = some[k : k + step]
                apart[x] = np.bitwise_count(words[at[a[x]]] ^ words[at[b[x]]]).sum(axis=1)
        near = apart <= both * (1 - self.similarity) / (1 + self.similarity) + 1e-6
        return keep[near], (apart / np.maximum(both, 1))[near]


def candidate_links(key: np.ndarray, text: np.ndarray, prints: Prints, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts that share a key (sorted) and may be similar: all of short keys, of others links with the same components.

    Texts of one ``group`` are joined already and not looked at together.
    """
    group = np.arange(text.max(initial=-1) + 1) if group is None else group
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    pairs = [np.zeros((2, 0), np.int64)]
    for n in range(2, FEW + 1):
        at = first[size == n]
        pairs += [np.stack([text[at + i], text[at + j]]) for i, j in combinations(range(n), 2)]
    a, b = np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1)
    apart = group[a] != group[b]
    a, b = a[apart], b[apart]
    keep = prints.possible(a, b)[0]
    out = [np.stack([a[keep], b[keep]])]
    for s, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
        some, edges = np.unique(text[s : s + n]), []
        label = np.unique(group[some], return_inverse=True)[1]
        for i in range(len(some) - 1):
            other = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
            if not len(other):
                continue
            keep, apart = prints.possible(np.full(len(other), some[i]), some[other])
            for j in other[keep][np.argsort(apart, kind="stable")].tolist():
                if label[j] != label[i]:
                    edges.append((some[i], some[j]))
                    label[label == label[j]] = label[i]
        if edges:
            out.append(np.array(edges, np.int64).T)
    a, b = np.unique(np.concatenate(out, axis=1), axis=1)
    return a, b


def _candidate_links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tids, known = [], [], {}
        for b in batches:
            keys.append(b.column(0).to_numpy(zero_copy_only=False))
            tids.append(b.column(1).to_numpy(zero_copy_only=False))
            ids, where = np.unique(tids[-1], return_index=True)
            for t, i in zip(ids.tolist(), where.tolist()):
                if t not in known:
                    known[t] = (b.column(2)[i].as_py(), b.column(3)[i].as_py(), b.column(4)[i].as_py())
        if not keys:
            return
        key, tid = np.concatenate(keys), np.concatenate(tids)
        ids, text = np.unique(tid, return_inverse=True)
        prints = Prints(np.array([known[t][0] for t in ids.tolist()], np.int64), [known[t][1] for t in ids.tolist()], similarity)
        order = np.lexsort((text, key))
        a, b = candidate_links(key[order], text[order], prints, np.array([known[t][2] for t in ids.tolist()], np.int64))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])
        del keys, tids, known, key, tid, ids, text, prints, order, a, b
        give_back()

    return run


def frequent_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count), by hash, of the shingles that are in most of about ``COUNTED_TEXTS`` texts of ``rows`` (tid, text)."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), words).view(np.int64))], ["shingle"])

    part = min(1.0, COUNTED_TEXTS / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("tid", F.lit("count")), F.lit(1 << 20)) < int(part * (1 << 20))).groupBy("tid").agg(F.first("text").alias("text"))
    counts = staged(some.mapInArrow(every, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copy-counts")
    least, kept = None, 0
    for n, c in sorted(counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect(), reverse=True):
        if kept + c > FREQUENT:
            break
        least, kept = n, kept + c
    found = counts.where(F.col("n") >= least).toPandas() if kept else None
    if found is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], found["n"].to_numpy(np.int64)[order]


def true_links(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of at least ``similarity`` that join sets of different labels as all such links would; a set's members are distinct.

    Only pairs that earlier links have not joined are looked at, and each of those is.
    """
    size = np.array([len(x) for x in sets])
    label, often = np.unique(labels, return_inverse=True, return_counts=True)[1:]
    order = np.argsort(often[label], kind="stable")  # members of large components last, where nothing is left to join
    label, size = label[order], size[order]
    values, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    end = np.cumsum(size)
    own, edges = np.zeros(len(values), np.int64), []
    for i in range(len(sets) - 1):
        other = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not len(other):
            continue
        mine = ids[end[i] - size[i] : end[i]]
        own[mine] = 1
        seen = np.concatenate([[0], np.cumsum(own[ids[end[i] :]])])
        own[mine] = 0
        common = seen[end[other] - end[i]] - seen[end[other] - size[other] - end[i]]
        total = size[i] + size[other] - common
        for j in other[(total == 0) | (common >= similarity * total)].tolist():
            if label[i] != label[j]:
                edges.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return edges


def _true_links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tids, comps, sets = [], [], [], []
        for b in batches:
            keys.append(b.column(0).to_numpy(zero_copy_only=False))
            tids.append(b.column(1).to_numpy(zero_copy_only=False))
            comps.append(b.column(2).to_numpy(zero_copy_only=False))
            ends = b.column(3).offsets.to_numpy()
            sets += np.split(b.column(3).values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends[1:-1] - ends[0]) if b.num_rows else []
        if not keys:
            return
        key, tid, comp = np.concatenate(keys), np.concatenate(tids), np.concatenate(comps)
        order = np.lexsort((tid, key))
        for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            links = true_links([sets[i] for i in some], comp[some], similarity)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(tid[some[[x[k] for x in links]]]) for k in (0, 1)], ["a", "b"])

    return run


def open_links(candidates: DataFrame, sure: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Links (a, b) between the components ``sure`` of a group of ``candidates``; None if no group has two.

    Of a group whose candidate links did not all hold, every two texts meet in a task that has their shingles, but
    those of its largest component only meet the others. What is within a task is cut into parts by texts and shingles.
    """
    groups = connected_components(candidates).select(F.col("node").alias("g_node"), F.col("root").alias("g_root"))
    known = sure.select(F.col("node").alias("s_node"), F.col("root").alias("s_root"))
    rows = sets.select("tid", F.size("shingles").cast("long").alias("n")).join(groups, F.col("tid") == F.col("g_node"), "left").join(known, F.col("tid") == F.col("s_node"), "left")
    rows = staged(rows.select("tid", "n", F.coalesce("g_root", "tid").alias("group"), F.coalesce("s_root", "tid").alias("comp")), "copy-groups")
    comps = rows.groupBy(F.col("group").alias("of"), "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    largest = F.max(F.struct("c", "n", "comp"))
    shape = comps.groupBy("of").agg(largest.alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    parts = lambda c, n: F.ceil(F.greatest(c / PART_TEXTS, n / PART_SHINGLES, F.lit(1.0))).cast("int")
    shape = shape.select("of", F.col("top.comp").alias("most"), F.col("top.c").alias("c"), F.col("top.n").alias("n"), (F.col("c") - F.col("top.c")).alias("rest_c"), (F.col("n") - F.col("top.n")).alias("rest_n"))
    shape = staged(shape.select("of", "most", "n", "rest_n", parts(F.col("c"), F.col("n")).alias("big"), parts(F.col("rest_c"), F.col("rest_n")).alias("rest")), "copy-open")
    load = shape.agg(F.sum(F.col("n") * F.col("rest") + F.col("rest_n") * (F.col("big") + F.col("rest")))).first()[0]
    if load is None:
        return None
    rows = rows.drop("n").join(shape.drop("n", "rest_n"), F.col("group") == F.col("of"))
    is_big = F.col("comp") == F.col("most")
    own = F.pmod(F.xxhash64("tid", F.lit("part")), F.when(is_big, F.col("big")).otherwise(F.col("rest"))).cast("int")
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    big_meets = F.transform(to("rest"), lambda p: F.xxhash64("group", F.lit("big"), own, p))
    rest_meets = F.concat(F.transform(to("big"), lambda p: F.xxhash64("group", F.lit("big"), p, own)), F.transform(to("rest"), lambda p: F.xxhash64("group", F.least(p, own), F.greatest(p, own))))
    rows = rows.select(F.col("tid").alias("id"), "comp", F.explode(F.when(is_big, big_meets).otherwise(rest_meets)).alias("key"))
    rows = rows.join(sets, F.col("id") == F.col("tid")).select("key", "tid", "comp", "shingles")
    tasks = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), load // TASK_SHINGLES)
    return rows.repartition(tasks, "key").mapInArrow(_true_links(similarity), "a bigint, b bigint")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def text_id(docs: DataFrame) -> Column:
    """An id of the text of a row of ``docs``, equal for equal texts only: its hash, and where two texts share one, a hash of another hash too."""
    text = text_or_empty()
    one, two = text_hash(text), F.xxhash64(F.lit("other"), text)
    pairs = docs.select(one.alias("one"), two.alias("two")).groupBy("one").agg(F.min("two").alias("least"), F.max("two").alias("most"))
    shared = [r["one"] for r in pairs.where("least <> most").select("one").collect()]  # a few in 10^10 texts
    return F.when(one.isin(shared), F.xxhash64(one, two)).otherwise(one) if shared else one


def index_links(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``texts`` (tid, fp, staged) by the Gray-order index: each text with the least of its fingerprint, and of the links of fingerprints."""
    least = staged(texts.groupBy("fp").agg(F.min("tid").alias("least")), "copy-fps")
    of = lambda c: least.select(F.col("fp").alias(f"fp_{c}"), F.col("least").alias(f"t_{c}"))
    same = texts.select("tid", "fp").join(of("a"), F.col("fp") == F.col("fp_a")).where("tid <> t_a").select(F.col("tid").alias("a"), F.col("t_a").alias("b"))
    links = near_links(least.select("fp")).distinct().join(of("a"), F.col("a") == F.col("fp_a")).join(of("b"), F.col("b") == F.col("fp_b"))
    return same.unionByName(links.select(F.col("t_a").alias("a"), F.col("t_b").alias("b")))


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``edges`` (a, b) whose texts' ``sets`` (tid, shingles) are as similar."""
    left, right = [sets.select(F.col("tid").alias(t), F.col("shingles").alias(f"{t}_set")) for t in ("ta", "tb")]
    both = edges.join(left, F.col("a") == F.col("ta")).join(right, F.col("b") == F.col("tb"))
    common = F.size(F.array_intersect("ta_set", "tb_set"))
    total = F.size("ta_set") + F.size("tb_set") - common
    return both.where((total == 0) | (common >= F.lit(similarity) * total)).select("a", "b")


def near_copies(docs: DataFrame, words: int = COPY_WORDS, similarity: float = SIMILARITY, tid: Column | None = None) -> DataFrame:
    """(tid, root) for the texts of ``docs`` that have near copies: tid is the text's id (``text_id``), root that of its group.

    Texts are linked if the Jaccard similarity of their shingle sets is at least ``similarity``; all such links are found.
    Texts whose fingerprints are within ``BITS`` are found by the Gray-order index and verified on their shingles; what this joins is a group.
    Similar texts may differ in more bits, so links between groups are searched by an exact way: candidates share one of their
    rarest shingles (``prefix``), are of like size and differ in few enough bits of
    their parity prints, none of which a link can miss; each task passes on links that join groups, which are
    verified on the shingles. Where such a link does not hold, others that were left out may:
    the texts of such a group are verified whole.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], ["tid", "shingles"])
        give_back()

    text = text_or_empty()
    rows = docs.select((text_id(docs) if tid is None else tid).alias("tid"), text.cast("binary").alias("text"))
    frequent, often = frequent_shingles(rows, words)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, prints, keys, codes = [], [], [], []
            for t in b.column(1):
                hashes = shingles(t.as_py(), words)
                n.append(len(hashes))
                prints.append(parity_print(hashes).tobytes())
                keys.append(prefix(hashes, similarity, frequent, often).view(np.int64))
                codes.append(simhash(t.as_py()))
            fps = pa.array(np.array(codes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), fps], ["tid", "n", "print", "keys", "fp"])
        give_back()

    of = rows.mapInArrow(prefixes, "tid bigint, n bigint, print binary, keys array<bigint>, fp bigint")
    texts = staged(of.groupBy("tid").agg(*[F.first(c).alias(c) for c in ("n", "print", "keys", "fp")]), "copy-prefixes")
    near = staged(index_links(texts), "copy-near")
    near_ids = staged(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "copy-near-ids")
    shingles_of = lambda ids: rows.join(ids, F.col("tid") == F.col("id"), "left_semi").groupBy("tid").agg(F.first("text").alias("text")).mapInArrow(sets, "tid bigint, shingles array<bigint>")
    near_sets = staged(shingles_of(near_ids), "copy-near-shingles")
    groups = connected_components(verified(near, near_sets, similarity))
    joined = groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
    keyed = texts.select("tid", F.explode("keys").alias("key"))
    # a shingle of one text finds nothing; the others meet
    shared = keyed.groupBy(F.col("key").alias("k")).count().where("count > 1")
    met = keyed.join(shared, F.col("key") == F.col("k"))
    parts = F.ceil(F.col("count") * 2 / HOT_ROWS).cast("int")
    own = F.pmod(F.xxhash64("tid", F.lit("part")), parts).cast("int")
    meets = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.xxhash64("key", F.least(p, own), F.greatest(p, own)))
    met = met.select("tid", F.explode(F.when(F.col("count") <= HOT_ROWS, F.array("key")).otherwise(meets)).alias("key"))
    about = texts.select("tid", "n", "print").join(groups, F.col("tid") == F.col("node"), "left").select(F.col("tid").alias("t"), "n", "print", F.coalesce("root", "tid").alias("group"))
    met = met.join(about, F.col("tid") == F.col("t")).select("key", "tid", "n", "print", "group")
    n_keys = texts.agg(F.sum(F.size("keys"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_keys // TASK_ROWS)
    edges = staged(met.repartition(tasks, "key").mapInArrow(_candidate_links(similarity), "a bigint, b bigint").distinct(), "copy-edges")
    met_ids = staged(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(near_ids, "id", "left_anti"), "copy-ids")
    some = near_sets.unionByName(staged(shingles_of(met_ids), "copy-shingles"))
    sure = connected_components(verified(edges, some, similarity).unionByName(joined))
    more = open_links(edges.unionByName(joined), sure, some, similarity)
    if more is not None:
        sure = connected_components(sure.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return sure.select(F.col("node").alias("tid"), "root")


def one_of_each_group(docs: DataFrame, words: int = COPY_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of equal or near texts: that of the least doc_id (null last), and text id.

    Null and empty texts are equal ones; repeated rows are one group; columns keep their names and values, whatever these are; an empty
    table gives an empty result.
    """
    tid = text_id(docs)
    roots = near_copies(docs, words, similarity, tid).select(F.col("tid").alias("t"), "root")
    ids = docs.select("doc_id", tid.alias("tid")).groupBy("doc_id", "tid").agg(F.count(F.lit(1)).alias("n"))
    ids = staged(ids.join(roots, F.col("tid") == F.col("t"), "left").select("doc_id", "tid", "n", F.coalesce("root", "tid").alias("root")), "copy-rows")
    kept = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tid")).alias("x")).select(F.col("x.doc_id").alias("id_"), F.col("x.tid").alias("tid_"), F.lit(True).alias("keep_"))
    gone = ids.join(kept, ids["doc_id"].eqNullSafe(F.col("id_")) & (ids["tid"] == F.col("tid_")), "left").where("keep_ IS NULL OR n > 1")
    # what goes, and kept rows that repeat, are the few: the texts of all others are not touched
    gone = staged(gone.select(F.col("doc_id").alias("id_"), F.col("tid").alias("tid_"), F.col("keep_").isNotNull().alias("repeats_")), "copy-gone")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    rows = docs.select(F.col("doc_id").alias("id"), tid.alias("tid"), whole)
    at = rows["id"].eqNullSafe(gone["id_"]) & (rows["tid"] == gone["tid_"])
    some = small(gone, GONE_ROWS)
    stay = rows.join(some, at, "left_anti")
    again = rows.join(some.where("repeats_"), at, "left_semi").dropDuplicates(["id", "tid"])
    return stay.unionByName(again).select("row_.*")
