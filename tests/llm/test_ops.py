"""Each operator against brute force on small, awkward tables: nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftgraph.llm import components, fingerprints, licenses, media, mixing, pieces, sharding, simhash, tokens, toxicity, urls
from weftgraph.llm.common import text_or_empty

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score_ double"


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def make_docs():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh é日") for _ in range(rng.randint(2, 6))).strip() or "x"
    texts = [None, "", "   ", "one", "one two three", "ONE two Three", " lead and trail \n"]
    for _ in range(60):
        texts.append(" ".join(word() for _ in range(rng.randint(1, 80))))
    long = " ".join(word() for _ in range(6000))
    texts += [long, long + " more"] + [texts[20]] * 5
    base = texts[30].split()
    for k in range(6):
        near = list(base)
        near[rng.randrange(len(near))] = f"new{k}"
        texts.append(" ".join(near))
    rows = [(i, t, "en", ["a", "b", None, "Z", "é"][i % 5], len(t or ""), 0.5) for i, t in enumerate(texts)]
    rows.append(rows[10])  # a row that repeats
    rows.append((None, "no id here at all", "en", "a", 3, None))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def odd_texts():
    rng = random.Random(2)
    fixed = ["", " ", "  ", "a", " a", "a ", "\n", "a\n b", "a \nb", "日本語テキスト", "🙂🙂", "\t\t a", "a" * 300, " " * 37 + "x", "<s></s><unk>", "\x00a", "é" * 200, "ab" * 333 + " " * 5]
    return fixed + ["".join(rng.choice("abcde theris \n  日é🙂123.,") for _ in range(rng.randint(1, 200))) for _ in range(200)]


def test_pieces_equal_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = odd_texts() + [t or "" for _, t, *_ in make_docs()]
    got = [np.frombuffer(x, "<u4").tolist() for x in pieces.encode(model, texts)]
    assert got == library.encode(texts)
    assert [pieces.decode(model, x) for x in pieces.encode(model, texts)] == texts
    assert all(pieces.decode(model, np.array(i, dtype="<u4").tobytes()) == library.decode(i) for i in got)


def test_random_pieces_equal_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(61)
    parts = [*"abcXYZ019 .,;'!?-_#*\n\t\r<|>/", "é", "ß", "Ω", "▁", "\u0301", "\u00a0", "中", "ا", "😀", "the", "ing", "Ção", "'s", "   ", " the ", ". ", "\n\n", "\x01"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 24))) for _ in range(20_000)] + ["a\0b \0 c", "x" * 3000 + " y", "ab" * 500]
    got = pieces.encode(model, texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got[:-3]] == library.encode(texts[:-3])
    assert [np.frombuffer(x, "<u4").tolist() for x in got[-2:]] == library.encode(texts[-2:])
    marked = [t.replace("▁", " ") for t in texts]
    assert [pieces.decode(model, x) for x in got] == marked
    assert pieces.encode(model, []) == []


def test_stream_keeps_a_short_window(model):
    text = "▁" + "abcthe" * 3000
    for part in (1, 7, 1000, len(text)):
        s = pieces.Stream(model)
        ids = [i for at in range(0, len(text), part) for i in s.push(text[at : at + part])] + s.close()
        assert s.peak <= pieces.STEP + 4 * model.longest
        whole = pieces.Stream(model)
        assert ids == whole.push(text) + whole.close()


def test_unigram_best_sum():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1:
            p.score = -(8 + abs(p.score) % 1000 / 100 + len(p.piece) * 0.01) if p.score > -1e8 else -30.0
    model = pieces.PieceModel(proto=proto.SerializeToString())
    score = {model.ids[p]: s for p, s in model.score.items()}
    for text in ["the quick brown fox", "interaction of things", "abcdefgh" * 20]:
        run = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-1e18] * len(run)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - model.longest), end):
                if run[start:end] in model.score:
                    best[end] = max(best[end], best[start] + model.score[run[start:end]])
        ids = np.frombuffer(pieces.encode(model, [text])[0], "<u4").tolist()
        assert abs(sum(score[i] for i in ids) - best[-1]) < 1e-6


def test_pieces_frame(spark, docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.digests(docs.select("doc_id", "text"), path).collect()
    assert len(got) == len(make_docs()) and all(r["same_text"] for r in got)
    assert pieces.encoded(docs, path).columns == ["doc_id", "lang", "source", "n_chars", "score_", "piece_ids"]
    assert pieces.digests(empty, path).count() == 0


# 2


def test_mixing_by_brute_force(spark, docs, empty):
    got = mixing.mix_plan(docs).collect()
    rows = make_docs()
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(word_list(t))
    sources = sorted([s for s in size if s is not None], key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    budget, target, open_ = float(sum(size.values())), {}, set(sources)
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        stop = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not stop:
            break
        target |= {s: 3.0 * size[s] for s in stop}
        open_ -= stop
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in got:
        assert r["size"] <= r["source_size"] == size[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    most = max(len(word_list(t)) for _, t, *_ in rows)
    assert all(abs(taken[s] - target[s]) <= most / 2 + 1 for s in sources)
    again = mixing.mix_plan(docs.repartition(2)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)
    passes = Counter({(r["doc_id"], r["hash"]): r["passes"] for r in got})
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["passes"] for r in got) and passes
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixed(empty).count() == 0


# 3


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    a, b = media.chunks(body), media.chunks(b"some other beginning" + body)
    assert b"".join(a) == body and all(len(c) <= media.MOST for c in a)
    assert len(set(a) & set(b)) >= len(a) - 3
    # the hash of 32 bytes, summed one by one
    data, gear = body[:5000], media._GEAR.astype(np.uint64)
    h = media._GEAR[np.frombuffer(data, np.uint8)].copy()
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    want = sum(int(gear[data[4000 - k]]) << k for k in range(32)) % (1 << 32)
    assert int(h[4000]) == want


def test_media_round_trip(spark, docs, empty):
    from weftgraph.llm.common import staged, staged_path

    listed = staged(media.manifests(docs), "m")
    store, dictionary = media.write_chunks(docs, staged_path(spark, "c"))
    back = {bytes(r["media"]): r for r in media.read_media(listed.select("media", "digests").distinct(), store, dictionary).collect()}
    texts = defaultdict(list)
    for i, t, *_ in make_docs():
        texts[i].append((t or "").encode())
    for r in listed.collect():
        x = back[bytes(r["media"])]
        payload = media.payload_of(next(t for t in texts[r["doc_id"]] if len(t) == r["n_bytes"]))
        assert bytes(x["payload"]) == hashlib.sha256(payload).digest() and x["tail_crc32"] == zlib.crc32(payload[-64:])
        assert x["payload_bytes"] == len(payload) == x["media_bytes"] - 44 and len(payload) % 64 == 0 and payload
    assert store.count() == store.select("digest").distinct().count()
    assert media.write_chunks(docs, staged_path(spark, "c"), known=store)[0].count() == 0
    none, nothing = media.write_chunks(empty, staged_path(spark, "c"))
    assert none.count() == 0 and media.read_media(media.manifests(empty).select("media", "digests"), none, nothing).count() == 0


def test_hot_chunks_are_sent(spark, docs, monkeypatch):
    from weftgraph.llm.common import staged, staged_path

    monkeypatch.setattr(media, "HOT_LEAST", 1)
    body = "".join(random.Random(2).choices("abcdefgh ", k=60_000))
    some = spark.createDataFrame([(i, body + f" {i}") for i in range(30)], "doc_id bigint, text string")
    files = staged(media.manifests(some), "m").select("media", "digests")
    assert media.hot_digests(files).count() >= 1
    store, dictionary = media.write_chunks(some, staged_path(spark, "c"))
    got = media.read_media(files, store, dictionary).collect()
    assert {bytes(r["payload"]) for r in got} == {hashlib.sha256(media.payload_of(f"{body} {i}".encode())).digest() for i in range(30)}


# 4


def test_ranks_pack_and_unpack():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = tokens.pack(ranks)
        assert np.array_equal(tokens.unpack(control, data, n), ranks) and len(control) == -(-n // 4)


def test_token_files(spark, docs, empty):
    from weftgraph.llm.common import staged, staged_path

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = staged_path(spark, "t")
    tokens.write_tokens(staged(tokens.encoded(docs, path), "ids"), out)
    got = sorted(tokens.read_tokens(spark, out).collect(), key=lambda r: r["start"])
    want = Counter((i, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()) for i, t, *_ in make_docs())
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    assert [r["start"] for r in got] == np.cumsum([0] + [len(r["ids"]) // 4 for r in got])[:-1].tolist()
    out = staged_path(spark, "t")
    tokens.write_tokens(staged(tokens.encoded(empty, path), "ids"), out)
    assert tokens.read_tokens(spark, out).count() == 0


def test_word_memo_equals_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = odd_texts() + ["It's I'LL don't 3rd A.B. x,y word. Word, WORD.", "<|endoftext|> a<|startoftext|>b", "e\u0301 H\u0331 \u00a0x\u2003y", "İstanbul ΣΑΣ ſ K"]
    coder, library = tokens.Encoder(path), Tokenizer.from_file(path)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_random_strings_equal_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(60)
    parts = [*"abcXYZ019 .,;'\"!?-_#*\n\t\r<|>/", "é", "ß", "Ω", "ſ", "ı", "İ", "ǅ", "ﬁ", "\u0301", "\u00a0", "\u2003", "中", "ا", "😀", "the", "ing", "Ção", "'s", "'LL", "<|", "|>", "  ", " the ", ". "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 24))) for _ in range(60_000)]
    coder, library = tokens.Encoder(path), Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == want
    small = tokens.Encoder(path, "<u2")
    assert [np.frombuffer(x, "<u2").tolist() for x in small.encode(texts[:2000])] == want[:2000] and small.encode([]) == []


# 5


def shingle_set(text, n=5):
    w = word_list((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints(spark, docs, empty):
    unique = docs.dropDuplicates(["doc_id"])
    rows = sorted({i: t or "" for i, t, *_ in make_docs()}.items(), key=lambda x: (x[0] is None, -(x[0] or 0)))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(unique).collect()}
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingle_set(t), shingle_set(edited), shingle_set(following)
        exact = max(len(a), len(b), len(c)) <= fingerprints.FLOOR
        assert abs(r["near_edited"] - likeness(a, b)) < (1e-9 if exact else 0.2)
        assert abs(r["near_next"] - likeness(a, c)) < (1e-9 if exact else 0.2)
    same = docs.select("text", fingerprints.as_string(fingerprints.sketch(text_or_empty())).alias("f")).distinct()
    assert same.groupBy("text").count().where("count > 1").count() == 0
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[2900:2960])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprints.containment(F.col("b"), F.col("a")).alias("c"), fingerprints.merge(F.col("a"), F.col("b")).alias("m"), "a", "b").first()
    assert abs(r["c"] - 1.0) < 0.01
    assert set(r["m"]["hashes"]) == {x for x in {*r["a"]["hashes"], *r["b"]["hashes"]} if x <= r["m"]["limit"]}


# 6


def test_urls(spark):
    cases = [
        ("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
        ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        ("x://b.com/fr/a", "b.com", "/fr/a", "com/fr/", "allow"),
        ("x://b.com/de/", "b.com", "/de/", "com/de/", "block"),
        ("x://b.com/de", "b.com", "/de", None, "allow"),
        ("x://www.spam-farm.example.com", "www.spam-farm.example.com", "", None, "block"),
        ("x://www.spam-farm.example.com?q=http://a.org/", "www.spam-farm.example.com", "", None, "block"),
        ("x://org", "org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    many = [(f"http://h{i}.example.net/en/{i}", f"h{i}.example.net", f"/en/{i}", None, "allow") for i in range(400)]
    df = spark.createDataFrame([(i, c[0], "extra") for i, c in enumerate(cases + many)], "page_id int, url string, rule_ string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases + many)}
    assert urls.judge(df.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("xxhash64(key) % 3 = 0")
    levels = urls.build_cascade(universe, listed)
    assert len(levels) > 1
    assert {r.key for r in universe.where(urls.listed_by(F.col("key"), levels)).collect()} == {r.key for r in listed.collect()}


# 7


def wrapped(text, width, before="", after=""):
    import textwrap

    return "\n".join(before + line + after if line else before.rstrip() for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""


def license_cases():
    """(text, identifiers or None, licences)."""
    out = [
        ("Intro.\nLicensed under the Apache License, Version 2.0.\nMore text here.", "<Apache-2.0:notice>", "Apache-2.0"),
        ("Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "<Apache-2.0:notice><Apache:file><Apache:copy>", "Apache-2.0"),
        ("Released under the MIT License.\nword\nLicensed under CC BY-NC 4.0.", "<MIT:notice>|<CC-BY-NC-4.0:notice>", "MIT,CC-BY-NC-4.0"),
        ("released  under THE mit license", "<MIT:notice>", "MIT"),
        ("# SPDX-License-Identifier: MPL-2.0\ncode", "<MPL-2.0:notice>", "MPL-2.0"),
        ("We released it under the MIT license yesterday.", "", ""),
        (None, "", ""),
        ("", "", ""),
        ("licenses and software\n\n", "", ""),
        ("Licensed under the Apache License," + " " * 1200 + "Version 2.0.", "<Apache-2.0:notice>", "Apache-2.0"),
        ("*" * 2000 + " Released under the MIT License " + "*" * 2000, "<MIT:notice>", "MIT"),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "<BSD:source>", ""),
    ]
    for text, name in ((MIT, "MIT"), (APACHE, "Apache-2.0"), (BSD, "BSD-3-Clause"), (BSD.replace("3. Neither", "x").split("x")[0] + BSD[BSD.index("THIS SOFTWARE") :], "BSD-2-Clause"), (GPL, "GPL-3.0-or-later")):
        out += [(t, None, name) for t in (text, wrapped(text, 72), wrapped(text, 30), wrapped(text, 60, "// "), wrapped(text, 60, " * "), wrapped(text, 50, "/* ", " */"), wrapped(text, 70, "    # "), "import x\n\n" + wrapped(text, 70, "# ") + "\nclass X:\n    pass", text.upper(), wrapped(text, 72).replace("\n", "\r\n"))]
    return out


def test_licenses(spark, empty):
    texts = license_cases()
    df = spark.createDataFrame([(i, t[0], "x", [1]) for i, t in enumerate(texts)], "doc_id int, text string, found string, identifiers array<int>")
    got = {r["doc_id"]: (r["identifiers"], ",".join(r["found"])) for r in licenses.scan(df).collect()}
    assert {i: (t[1] if t[1] is not None else got[i][0], t[2]) for i, t in enumerate(texts)} == got
    assert licenses.scan(empty).count() == 0
    mit = "<MIT:grant><MIT:keep><MIT:asis><MIT:liable>"
    assert got[[t[0] for t in texts].index(MIT)][0] == mit


def test_licenses_sql(spark, tmp_path):
    import duckdb

    rows = [(i, t[0]) for i, t in enumerate(license_cases())] + [(0, "Released under the MIT License"), (None, "Licence: CC0 1.0")]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter(con.execute(licenses.OP7_SQL).fetchall())
    out = licenses.op7_license_scan(spark, str(tmp_path))
    assert Counter(tuple(r) for r in out.select("doc_id", "identifiers", "licenses", "n_sentences").collect()) == want


# 8


def slow_simhash(text):
    w = word_list((text or "").translate({i: i + 32 for i in range(65, 91)}))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_force(codes, ids, bits):
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(lambda: None)
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return [least[find(i)] for i in range(len(codes))]


def test_simhash_components(spark, docs, empty):
    rows = make_docs()
    codes = [slow_simhash(t) for _, t, *_ in rows]
    want = Counter(zip([r[0] for r in rows], ["%016x" % c for c in codes], components_by_force(codes, [r[0] for r in rows], 4), strict=True))
    out = simhash.near_components(docs)
    assert Counter(tuple(r) for r in out.select("doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id").collect()) == want
    assert simhash.near_components(empty).count() == 0


def test_gray_index_finds_all():
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))) for s in seeds for _ in range(8)]
    codes = np.unique(np.concatenate([seeds, np.array(near, dtype=np.uint64), np.arange(300, dtype=np.uint64)]))
    index = simhash.GrayIndex(codes)
    found = set()
    for q, a, e in index.links(index.codes, 4):
        for x, y, z in zip(q.tolist(), a.tolist(), e.tolist(), strict=True):
            found |= {(x, c) for c in range(y, z)}
    apart = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :])
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(apart <= 4), strict=True)}
    rank = simhash.gray_rank(index.codes)
    assert np.all(rank[1:] > rank[:-1])


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 20)
    codes = [7 << 40 | i for i in range(150)]
    fps = spark.createDataFrame([(c,) for c in codes], "fp bigint")
    roots = components.connected_components(simhash.near_links(fps, 1))
    assert roots.count() == 149 and roots.select("root").distinct().count() == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100}


def groups_by_force(texts):
    """The least number of each text's group: likenesses of at least 0.8 on five-word shingles, chained."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (word_list(t.lower()) for t in texts)]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if root[i] != root[j] and common >= 0.8 * (len(a) + len(sets[j]) - common):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return sorted(r[0] for r in simhash.one_of_each_group(docs).select("doc_id").collect())


def test_copies_around_the_limit(spark, monkeypatch):
    # in a template's group many pairs fail just below the limit, so a forest's links do not suffice
    rng, texts = random.Random(11), []
    for t in range(5):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for k in range(80):
            w = list(base)
            for at in rng.sample(range(300), rng.choice((3, 4, 5, 5, 6))):
                w[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    root = groups_by_force(texts)
    want = sorted(set(root))
    assert 10 < len(want) < 300
    assert kept_of(spark, texts) == want
    monkeypatch.setattr(simhash, "PART_TEXTS", 9)  # groups cut into many parts
    assert kept_of(spark, texts) == want


def test_copies_of_all_lengths(spark, monkeypatch):
    # at exactly 0.8 or just above: 8 words and one more, and longer texts with some of their words changed
    rng, texts = random.Random(12), []
    for k in range(300):
        w = [f"w{rng.randrange(3000)}" for _ in range(8)]
        texts += [" ".join(w), " ".join([*w, f"y{k}"])]
    for n in (14, 49, 300, 1500):
        for _ in range(12):
            w = [f"w{rng.randrange(3000)}" for _ in range(n)]
            v = [*w, *[f"z{rng.randrange(10**6)}" for _ in range((n - 4) // 4)]]
            texts += [" ".join(w), " ".join(v), " ".join([*v, "last"])]
    texts += [" ".join(["same line of seven words in here", *[f"u{rng.randrange(10**6)}" for _ in range(9)]]) for _ in range(60)]
    want = sorted(set(groups_by_force(texts)))
    assert kept_of(spark, texts) == want
    monkeypatch.setattr(simhash, "HOT_ROWS", 20)  # keys cut into parts
    monkeypatch.setattr(simhash, "COUNTED_TEXTS", 50)
    assert kept_of(spark, texts) == want


def test_any_counts_of_shingles_find_all_copies():
    # what is counted only orders a text's shingles: two texts at 0.8 share one of their prefixes by whatever counts, none included
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 10, 40, 41, 500):
        a = np.sort(rng.integers(1, 2**63, n, dtype=np.uint64))
        b = np.sort(rng.permutation(a)[: int(np.ceil(0.8 * n - 1e-9))])
        for counted in (0, 1, n // 2, n):
            frequent = np.sort(rng.permutation(a)[:counted])
            often = rng.integers(2, 9, counted)
            of = [simhash.prefix(x, 0.8, frequent, often) for x in (a, b)]
            assert len(np.intersect1d(*of))


def test_memory_of_one_key():
    # a key of 30,000 near copies: a matrix of distances would take 900 MB
    rng, n = np.random.default_rng(1), 30_000
    base, own = rng.integers(0, 2**63, 100, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64)
    prints = [simhash.parity_print(np.append(base, x)).tobytes() for x in own]
    tracemalloc.start()
    a, b = simhash.candidate_links(np.zeros(n, np.int64), np.arange(n), simhash.Prints(np.full(n, 101), prints, 0.8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == n - 1 and set(a.tolist()) | set(b.tolist()) == set(range(n))
    assert peak < 100e6


def test_copies_go_by_the_gray_index_first(spark, monkeypatch):
    # a changed word of 400 leaves fingerprints within 4 bits, forty of them do not; the exact way only gets what the index does not join
    rng, texts = random.Random(5), []
    for _ in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(400)]
        few, many = list(w), list(w)
        few[200] = "changed"
        many[180:220] = [f"x{rng.randrange(10**6)}" for _ in range(40)]
        texts += [" ".join(x) for x in (w, few, many)]
    written, stage = {}, simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, tag: written.setdefault(tag, stage(df, tag)))
    assert kept_of(spark, texts) == sorted(set(groups_by_force(texts))) == list(range(0, 120, 3))
    code = {r["tid"]: r["fp"] for r in written["copy-prefixes"].select("tid", "fp").collect()}
    apart = lambda r: ((code[r["a"]] ^ code[r["b"]]) & (2**64 - 1)).bit_count()
    near, exact = written["copy-near"].collect(), written["copy-edges"].collect()
    assert sum(apart(r) <= 4 for r in near) >= 30  # the others by way of a third
    assert exact and all(apart(r) > 4 for r in exact)


def test_groups_are_not_looked_at_again():
    prints = [simhash.parity_print(np.arange(100, dtype=np.uint64)).tobytes()] * 12
    for n in (4, 12):
        known = simhash.Prints(np.full(n, 100), prints[:n], 0.8)
        links = lambda group: list(zip(*[x.tolist() for x in simhash.candidate_links(np.zeros(n, np.int64), np.arange(n), known, group)]))  # noqa: B023, E731
        assert links(np.zeros(n, np.int64)) == [] and links(np.arange(n) % 2) and all((a + b) % 2 for a, b in links(np.arange(n) % 2))


def test_one_of_each_group(spark, docs, empty):
    rows = make_docs()
    sets = [shingle_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if both == 0 or len(sets[i] & sets[j]) / both >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append((r[0] is None, r[0] or 0, r[0]))
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(min(g)[2] for g in groups.values())
    assert simhash.one_of_each_group(empty).count() == 0


def test_texts_that_share_a_hash(spark, docs, monkeypatch):
    want = sorted(map(repr, simhash.one_of_each_group(docs).collect()))
    monkeypatch.setattr(simhash, "text_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(7)))
    assert sorted(map(repr, simhash.one_of_each_group(docs).collect())) == want


# 9


def test_toxicity_held_out(spark, empty):
    rng = random.Random(1)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    data, labels = [], []
    for i in range(1500):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for bad in rng.sample(["vileword", "nastyone", "grimthing"], 2):
                w.insert(rng.randrange(len(w)), bad)
        data.append((i, " ".join(w)))
        if rng.random() < 0.7:
            labels.append((i, int(toxic)))
    data += [(9000, None), (9001, "")]
    truth = {i: int("vile" in t or "nasty" in t or "grim" in t) for i, t in data[:1500]}
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    weights, bias = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r["toxicity_score"] for r in toxicity.with_score(docs, weights, bias).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= 0.7) == bool(truth[i]) for i in held) / len(held)
    assert right > 0.97 and got[9000] == got[9001] < 0.7 and all(0 <= s <= 1 for s in got.values())
    assert {r["doc_id"] for r in toxicity.below_threshold(docs, weights, bias).collect()} == {i for i, s in got.items() if s < 0.7}
    marks = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id bigint").select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in marks)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.fit(docs, none) == ({}, 0.0) and toxicity.with_score(empty, weights, bias).count() == 0


def test_risk_is_not_negative():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 20)) < 0.3).astype(np.uint8)
    y = x[:, 0] == 1
    toxic = np.r_[np.ones(int(y.sum()), bool), np.zeros(400, bool)]
    w, b = toxicity.nnpu_fit(np.vstack([x[y], x]), toxic, float(y.mean()), 300)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert ((p >= 0.5) == y).mean() > 0.98


# 10


def test_sharding(spark, docs, empty):
    rows = make_docs() * 4  # every text is now in a group
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", F.md5(text_or_empty()).alias("group"))
    for shards in (3, 24, 1000):
        got = sharding.shard_rows(df, shards).collect()
        counts = Counter(r["shard"] for r in got)
        assert len(got) == len(rows) and max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = sharding.shard_rows(df, 3).collect()
    where = defaultdict(set)
    for r in got:
        where[r["group"]].add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 4  # only what the quotas cut
    assert sharding.shard_rows(df.limit(0), 3).count() == 0


def test_hot_group_fills_whole_shards(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"g{i // 2}") for i in range(1200)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id bigint, group string"), 12).collect()
    hot = Counter(r["shard"] for r in got if r["group"] == "hot")
    assert len(hot) <= 6 and Counter(Counter(r["shard"] for r in got).values()) == {100: 12}
