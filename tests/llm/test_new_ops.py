"""Byte-level pairs, alignment of tokenizers and vector codes against the libraries and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftgraph.llm import alignment, bytelevel, codes, registry

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = "ab cd'sSe\n\t  .,;)1é́ 　漢字😀\x00\r\x85\x1c<|endoftext|>ΩßİZ  "


def awkward_texts():
    rng = random.Random(5)
    rows = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 70))) for _ in range(400)]
    rows += ["".join(rng.choice(SIGNS + "▁") for _ in range(rng.randint(0, 70))) for _ in range(100)]
    rows += [None, "", " ", "  ", "\n", "a", "hello world.", "hello world.", "don't, we'll. I'M 12,345.67", "x" * 5000, "漢字" * 2000, "word " * 20000, "😀" * 3000, " \r\n\r\n ;\r\nend", "</s> <s> <unk> <0x41> <|endoftext|>"]
    return [(None if i % 97 == 0 else i // 2, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("new"))
    docs = spark.createDataFrame(awkward_texts(), "doc_id bigint, text string").repartition(3)
    docs.withColumn("ids", F.lit("x")).withColumn("block", F.lit(1)).withColumn("groups", F.lit(None).cast("int")).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytelevel.read_ranks(RANKS), special_tokens={})


def test_byte_bpe_query(spark, folder, library):
    got = Counter(tuple(r) for r in registry.queries()["op12_byte_bpe"](spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = Counter()
    for i, t in awkward_texts():
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want


def test_byte_bpe_offsets_and_split_characters(spark, library):
    texts = [t for _, t in awkward_texts() if t][:150]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    own = bytelevel.Encoder(RANKS, public_tokenizers.PATTERN)
    split = 0
    for r in bytelevel.encoded(rows, RANKS, public_tokenizers.PATTERN, offsets=True).collect():
        text = texts[r["doc_id"]]
        assert list(zip(r["begins"], r["ends"])) == own.library.encode(text, add_special_tokens=False).offsets
        stream = bytelevel.TextStream(RANKS)
        parts = [stream.push([i]) for i in r["ids"]] + [stream.push([], last=True)]
        assert "".join(parts) == text
        split += "" in parts[:-1]
    assert split > 20


def test_decoding_of_cut_ids(spark, library):
    ids = library.encode_ordinary("é😀漢")
    rows = spark.createDataFrame([(1, ids[1:]), (2, None), (3, [])], "doc_id int, ids array<int>")
    got = {r["doc_id"]: bytes(r["bytes"]) for r in bytelevel.decoded(rows, RANKS).collect()}
    assert got == {1: b"".join(library.decode_single_token_bytes(i) for i in ids[1:]), 2: b"", 3: b""}
    stream = bytelevel.TextStream(RANKS)
    assert stream.push(library.encode_ordinary("😀")[:1], last=True) == "�"
    with pytest.raises(Exception, match="not in the vocabulary"):
        bytelevel.decoded(spark.createDataFrame([(1, [99999])], "doc_id int, ids array<int>"), RANKS).collect()


def test_merges_of_a_small_vocabulary():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"zz": 259, b"xzzx": 260}
    assert bytelevel.two_parts(b"abc", ranks) == [b"a", b"bc"]
    assert len(bytelevel.two_parts(b"xzzx", ranks)) == 3  # no merge leads to it
    own = bytelevel.library_of(ranks, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for text in ["xzzx", "xzzxx", *("".join(rng.choice("abcxz ") for _ in range(12)) for _ in range(300))]:
        assert own.encode(text, add_special_tokens=False).ids == theirs.encode_ordinary(text)


def aligned_by_force(rows):
    a_side = Tokenizer.from_file(BYTES)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    back = {c: b for b, c in bytelevel.byte_table().items()}

    def piece(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    def ends(tokens):
        return np.cumsum([len(t) for t in tokens]).tolist()

    found, texts_with = [], Counter()
    for d, t in rows:
        a, b, groups = [], [], []
        if t:
            a, b, whole = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t), (" " + t).encode()
            of_a, of_b = [bytes(back[c] for c in a_side.id_to_token(i)) for i in a], [piece(i) for i in b]
            if b"".join(of_a) != whole or b"".join(of_b) != whole:
                a, b = [], []
            else:
                at_a, at_b = {e: i + 1 for i, e in enumerate(ends(of_a))}, {e: i + 1 for i, e in enumerate(ends(of_b))}
                i = j = 0
                for e in sorted(at_a.keys() & at_b.keys()):
                    groups.append((a[i : at_a[e]], b[j : at_b[e]]))
                    i, j = at_a[e], at_b[e]
        links = Counter()
        for g, h in groups:
            for x, k in Counter(g).items():
                for y, q in Counter(h).items():
                    links[x, y] += k * q
        texts_with.update(links.keys())
        found.append((d, a, b, groups, links))
    most = defaultdict(int)
    for (x, _), n in texts_with.items():
        most[x] = max(most[x], n)
    out = Counter()
    for d, a, b, groups, links in found:
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(k for (x, y), k in links.items() if texts_with[x, y] == most[x])
        out[d, len(a), len(b), len(groups), sum(links.values()), best, sum(texts_with[p] * k for p, k in links.items()), hashlib.sha256(shown.encode()).hexdigest() if a else ""] += 1
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query(spark, folder):
    got = Counter(tuple(r) for r in registry.queries()["op11_alignment"](spark, folder).select(*COLUMNS).collect())
    want = aligned_by_force(awkward_texts())
    assert got == want
    assert sum(k[1] == 0 for k in want) > 20 and sum(k[4] > k[3] for k in want) > 200


def test_alignment_gives_its_groups(spark):
    rows = spark.createDataFrame([(1, "tokenizers align"), (2, None)], "doc_id string, text string")
    got = {r["doc_id"]: bytes(r["groups"]).decode() for r in alignment.aligned(rows, BYTES, PIECES, digest=False).collect()}
    assert got["2"] == "" and [p.count("|") for p in got["1"].split(";")] == [1] * len(got["1"].split(";"))


def test_alignment_over_several_blocks(spark, folder, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    rows = alignment.aligned(spark.read.parquet(f"{folder}/documents.parquet"), BYTES, PIECES)
    got = Counter(tuple(r) for r in rows.select(*COLUMNS[:-1], F.col("groups").cast("string")).collect())
    assert got == aligned_by_force(awkward_texts())


def test_transducer_states_are_what_dangles():
    t = alignment.Transducer([b"a", b"ab", b"bcd"], [b"abc", b"d", b"a", b"bx"])
    assert t.groups([1], [2]) is None and t.groups([0, 2], [0, 1]) == [(2, 2)]
    assert t.groups([0, 0], [2, 2]) == [(1, 1), (2, 2)] and t.groups([0, 2], [2, 3]) is None and t.groups([], []) == []
    assert (0, b"bc") not in t.number and (1, b"bc") in t.number  # the second side is ahead by "bc" after "a" and "abc"


def test_a_group_of_many_tokens_is_counted(monkeypatch):
    pair = alignment.Pair(BYTES, PIECES)
    a, b = [5] * 30 + [6] * 10, [7] * 20 + [8]
    pair.transducer = alignment.Transducer([b"", b"", b"", b"", b"", b"x", b"x"], [b""] * 7 + [b"x", b"x" * 20])
    monkeypatch.setattr(pair, "ids", lambda parts: [(a, b)])
    monkeypatch.setattr(pair.transducer, "groups", lambda x, y: [(40, 21)])
    ok, n_a, n_b, groups, links, n = alignment.HEAD.unpack(pair.measure(["x" * 40])[0][: alignment.HEAD.size])
    body = pair.measure(["x" * 40])[0][alignment.HEAD.size :]
    keys, many = np.frombuffer(body[: 8 * n], np.int64), np.frombuffer(body[8 * n : 16 * n], np.int64)
    assert (ok, n_a, n_b, groups, links) == (1, 40, 21, 1, 840)
    assert dict(zip(keys.tolist(), many.tolist())) == {5 * pair.size_b + 7: 600, 5 * pair.size_b + 8: 30, 6 * pair.size_b + 7: 200, 6 * pair.size_b + 8: 10}


def codes_by_force(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v, label in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    w = len(kept[0][2]) // parts
    books = [[r[2][p * w : (p + 1) * w] for r in first] for p in range(parts)]

    def choose(part, book):
        away = [sum((x - y) ** 2 for x, y in zip(part, e)) for e in book]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for p in range(parts):
            chosen = defaultdict(list)
            for *_, v in kept:
                part = v[p * w : (p + 1) * w]
                chosen[choose(part, books[p])[0]].append(part)
            books[p] = [[sum(c) // len(chosen[e]) for c in zip(*chosen[e])] if e in chosen else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = [(i, label, [choose(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]) for i, label, v in kept]
    by_label = Counter()
    for _, label, c in got:
        by_label[label] += sum(e for _, e in c)
    return Counter((i, "".join(f"{k:02x}" for k, _ in c), sum(e for _, e in c), by_label[label], digest) for i, label, c in got)


def vectors(n=300, length=32):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, length)], int(rng.integers(5))) for i in rng.permutation(n) + 10]
    rows += [(i, rows[0][1], None) for i in range(500, 560)] + [(3, rows[1][1], 1), (3, rows[2][1], 1), (3, rows[1][1], 1), (None, rows[4][1], None), (None, rows[3][1], 2)]
    rows += [(1, None, 1), (2, [], 1), (4, [None] * length, 1), (5, [float("nan")] * length, 1), (6, [float("-inf")] + [0.0] * (length - 1), 1)]
    rows += [(700, [200.0] * length, 3), (701, [-130.0] + [0.0] * (length - 1), 3), (702, [9000.0] * length, 4)]
    return rows


@pytest.mark.parametrize("rows", [vectors(), vectors()[:7], vectors(40, 16)])
def test_codes_query(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3).withColumn("code", F.lit(1)).withColumn("part", F.lit("x")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["op13_codes"](spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert Counter(tuple(r) for r in got.collect()) == codes_by_force(rows)


def test_codes_refuse_what_they_cannot_hold(spark):
    for bad in ([0.5] * 17, [1e9] * 16):
        rows = spark.createDataFrame([(1, [0.5] * 16, 1), (2, bad, 1)], "vec_id int, embedding array<float>, label int")
        with pytest.raises(Exception, match="one length|not supported"):
            codes.compressed(rows)


def test_packed_parts_are_whole():
    rows = np.array([[1, -2], [32767, -32768], [32768, 0], [0, -32769], [1 << 40, 5], [-(1 << 31), 0]])
    packed = codes._packed(rows)
    assert [len(p) for p in packed] == [4, 4, 8, 8, 16, 8] and (codes._unpacked(packed, 2) == rows).all()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for n in ("op11_alignment", "op12_byte_bpe", "op13_codes"):
        assert registry.queries()[n](spark, str(tmp_path)).count() == 0


def test_blank_runs_are_those_of_the_pattern():
    import regex

    from weftgraph.llm.gather import blank_runs

    texts = [t or "" for _, t in awkward_texts()]
    for column in (pa.array(texts), pa.array(["x y", *texts]).slice(1), pa.array(texts, pa.large_string())):
        parts, ends = blank_runs(column)
        for i, t in enumerate(texts):
            assert parts.slice(ends[i], ends[i + 1] - ends[i]).to_pylist() == regex.findall(r"^[^\t-\r \x85\p{Z}]+|[\t-\r \x85\p{Z}]+[^\t-\r \x85\p{Z}]*", t)


def test_hosts_of_very_many_labels(spark):
    from weftgraph.llm import urls

    deep = "http://" + "x." * 500_000
    rows = [(1, deep + "example.org/en/12"), (2, deep + "win-prize.example.net"), (3, deep + "com"), (4, deep), (5, "http://" + "y" * 1_000_000 + ".org/" + "z/" * 1_000_000), (6, "http://a..org//"), (7, "http://.")]
    got = {r["page_id"]: (r["rule"], r["verdict"], len(r["host"]), len(r["path"])) for r in urls.judge(spark.createDataFrame(rows, "page_id int, url string")).collect()}
    assert got[1] == ("example.org/en/1", "block", 1_000_011, 6) and got[2] == (None, "block", 1_000_021, 0)
    assert got[3] == (None, "allow", 1_000_003, 0) and got[4] == (None, "allow", 1_000_000, 0)
    assert got[5] == ("org/", "allow", 1_000_004, 2_000_001) and got[6][:2] == ("org/", "allow") and got[7][:2] == (None, "allow")
