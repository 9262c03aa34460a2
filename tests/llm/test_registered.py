"""The registered queries over whole awkward tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_ops import components_by_force, license_cases, make_docs, slow_simhash
from tokenizers import Tokenizer

import corpus_pipeline
from weftgraph.llm import registry

#: Columns that operators could be thought to use for themselves.
CLASHING = {"key": "bigint", "shard": "int", "hash": "bigint", "n": "int", "score": "double", "ids": "string", "tid": "bigint", "rule": "string", "at": "int", "group": "string"}


def write(spark, folder, docs, pages, labels):
    more = [F.lit(None).cast(kind).alias(name) for name, kind in CLASHING.items()]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score_ double"
    spark.createDataFrame(docs, schema).select("*", *more).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("rule", F.lit("own")).withColumn("host", F.lit(1)).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def all_docs():
    rows = make_docs()
    texts = [t for t, *_ in license_cases() if t][:20] + ["idiot scum trash " * 5 + f"word{i}" for i in range(12)]
    return rows + [(200 + i, t, "en", "c", len(t), None) for i, t in enumerate(texts)]


def all_pages():
    urls = [None, "", "no host", "http://example.org/en/1x?q#f", "https://A.Example.ORG/es/", "http://free-bets.example.com", "http://x.free-bets.example.com/fr/1", "http://example.com/de/", "ftp://a://b/c", "http://" + "a" * 3000 + ".com/fr/x", "http://org", "http://org/"]
    return [(i, u, "<p>") for i, u in enumerate(urls)] + [(1, "", "<p>"), (None, "http://x.org/y", None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    labels = [(200 + i, None, int(i >= 20)) for i in range(32)] + [(i, 1, 0) for i in range(60)] + [(5, 1, 0), (None, 1, 1), (7, 1, None)]
    return write(spark, str(tmp_path_factory.mktemp("tables")), all_docs(), all_pages(), labels)


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("none")), [], [], [])


def run(spark, folder, n):
    name = next(q for q in registry.queries() if q.startswith(f"op{n}_"))
    return registry.queries()[name](spark, folder)


def by_text(rows):
    """Rows with their text, by doc_id; a row that repeats has one of its kind."""
    texts = {i: t or "" for i, t, *_ in all_docs()}
    return [(r, texts[r["doc_id"]]) for r in rows]


@pytest.mark.parametrize("n", range(1, 11))
def test_empty_tables(spark, empty_folder, n):
    assert run(spark, empty_folder, n).count() == 0


@pytest.mark.parametrize("n", [2, 6, 7])
def test_sql(spark, folder, n):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    name = next(q for q in registry.queries() if q.startswith(f"op{n}_"))
    df = registry.queries()[name](spark, folder)
    got = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(got.fetchall())


def test_op1(spark, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = run(spark, folder, 1).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in all_docs())
    for r, t in by_text(rows):
        ids = library.encode(t)
        assert (r["n_chars"], r["n_ids"], r["same_text"]) == (len(t), len(ids), True)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes()) and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_op3(spark, folder):
    rows = run(spark, folder, 3).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in all_docs())
    for r, t in by_text(rows):
        raw = t.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        wav = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(wav), hashlib.sha256(wav).hexdigest())
        x = np.frombuffer(payload, np.uint8).astype(float)
        feature = dict(part.split("=") for part in r["feature"].split(";"))
        assert abs(float(feature["mean"]) - x.mean()) < 1e-4 and abs(float(feature["std"]) - x.std()) < 1e-4
        assert abs(float(feature["cross"]) - np.mean((x[1:] >= 128) != (x[:-1] >= 128))) < 1e-6
        assert np.allclose([float(b) for b in feature["bands"].split(",")], np.histogram(x, 8, (0, 256))[0] / len(x), atol=1e-4)


def test_op4(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(run(spark, folder, 4).collect(), key=lambda r: r["start"])
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in all_docs())
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    at = 0
    for r, t in by_text(rows):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert order == sorted(order)


def test_op5(spark, folder):
    rows = run(spark, folder, 5).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in all_docs())
    docs = sorted(((d[0], d[1] or "") for d in all_docs()), key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    seen, prints = defaultdict(list), {}
    for k, (i, t) in enumerate(docs):
        n = len(t) // 3
        seen[i].append(hashlib.sha256((t[: len(t) - n] + docs[(k + 1) % len(docs)][1][:n]).encode()).hexdigest())
    assert {i: sorted(x) for i, x in seen.items()} == {i: sorted(r["edited_sha256"] for r in rows if r["doc_id"] == i) for i in seen}
    for r, t in by_text(rows):
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_op8(spark, folder):
    docs = all_docs()
    codes = [slow_simhash(t) for _, t, *_ in docs]
    want = Counter(zip([d[0] for d in docs], ["%016x" % c for c in codes], components_by_force(codes, [d[0] for d in docs], 4), strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, folder, 8).collect()) == want


def test_op9(spark, folder):
    rows = run(spark, folder, 9).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in all_docs())
    scores = defaultdict(set)
    for r, t in by_text(rows):
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        scores[t].add(r["score"])
    assert all(len(s) == 1 for s in scores.values())
    assert all(r["predicted"] == int("scum" in t) for r, t in by_text(rows) if r["held_out"])


def test_op10(spark, folder):
    rows = run(spark, folder, 10).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in all_docs())
    for r, t in by_text(rows):
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "rows", None)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(24)) and max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))


def test_pipeline_cases(spark, folder, empty_folder):
    out = corpus_pipeline.run(spark, folder)
    assert set(CLASHING) - {"ids"} <= set(out.columns) and out.count() > 0
    assert {i for (i,) in out.select("doc_id").distinct().collect()} <= {d[0] for d in all_docs()}
    assert corpus_pipeline.run(spark, empty_folder).count() == 0
