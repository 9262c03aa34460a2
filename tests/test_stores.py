"""Stores that are opened again, and the index that follows a stream."""

import os

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.extensions import ParquetGraph
from weftgraph.sources.formats import EmbeddingStore
from weftgraph.sources.versions import Versions
from weftgraph.streaming import index as I


def vectors(spark, *rows):
    return spark.createDataFrame([(h, h, [float(x)]) for h, x in rows], "hash_id string, content string, embedding array<float>")


def held(store):
    return sorted((r["hash_id"], r["embedding"][0]) for r in store.load().collect())


def test_two_objects_on_one_folder(spark, tmp_path):
    one, two = (EmbeddingStore(spark, str(tmp_path), "x") for _ in range(2))
    assert held(two) == []
    one.upsert(vectors(spark, ("a", 1), ("b", 2), ("b", 2)))
    assert held(two) == [("a", 1.0), ("b", 2.0)]
    two.upsert(vectors(spark, ("a", 9), ("c", 3)))
    assert held(one) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    unknown = one.delete(spark.createDataFrame([("b",), ("z",)], "hash_id string"))
    assert [r["hash_id"] for r in unknown.collect()] == ["z"] and held(two) == [("a", 1.0), ("c", 3.0)]


def test_only_missing_texts_are_embedded(spark, tmp_path):
    store, asked = EmbeddingStore(spark, str(tmp_path), "x"), []

    def embed(rows):
        asked.append(sorted(r["content"] for r in rows.collect()))
        return rows.withColumn("embedding", F.array(F.lit(1.0)))

    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "content string")
    assert store.insert_missing(texts("p", "q", "q"), "chunk-", embed).count() == 2
    new = store.insert_missing(texts("q", "r"), "chunk-", embed)
    assert [r["content"] for r in new.collect()] == ["r"] and asked == [["p", "q"], ["r"]]


def test_versions_skip_what_broke_off_and_clear_up(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"), {"a": "x int", "b": "y int"})
    frame = lambda c, n: spark.createDataFrame([(n,)], f"{c} int")
    assert v.newest() == 0 and v.load("b").count() == 0
    for n in (1, 2, 3):
        v.save(a=frame("x", n), b=frame("y", n))
    assert [n for n, _ in v.found()] == [2, 3]
    frame("x", 99).write.parquet(str(tmp_path / "t" / "v=4" / "a"))  # a save without its last part
    again = Versions(spark, str(tmp_path / "t"), v.parts)
    assert again.newest() == 3 and again.load("a").first()[0] == 3
    again.save(a=again.load("a").withColumn("x", F.col("x") + 1), b=frame("y", 4))
    assert (v.newest(), v.load("a").first()[0], v.load("b").first()[0]) == (4, 4, 4)


def test_graph_upserts_merge(spark, tmp_path):
    e = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string, weight double")
    n = lambda *rows: spark.createDataFrame([(x,) for x in rows], "node string")
    ParquetGraph(spark, str(tmp_path)).upsert(n("a", "b", "c"), e(("b", "a", 1.0), ("a", "b", 2.0), ("b", "c", 5.0)))
    again = ParquetGraph(spark, str(tmp_path))
    again.upsert(n("d"), again.edges().where("src = 'a'").withColumn("weight", F.lit(0.5)).unionByName(e(("d", "a", 1.0))))
    third = ParquetGraph(spark, str(tmp_path))
    assert sorted(map(tuple, third.edges().collect())) == [("a", "b", 0.5), ("a", "d", 1.0), ("b", "c", 5.0)]
    third.delete(n("a"))
    assert sorted(r[0] for r in again.nodes().collect()) == ["b", "c", "d"] and [tuple(r) for r in again.edges().collect()] == [("b", "c", 5.0)]
    assert os.path.isdir(f"{tmp_path}/variant=base")


@pytest.fixture
def index(spark, tmp_path):
    seen = []

    def extract(rows):
        seen.append(sorted(r["content"] for r in rows.collect()))
        return rows.select("chunk", F.upper("content").alias("fact"))

    fails = F.when(F.col("doc_id") == 2, "bad").when(F.col("doc_id") == 3, I.UNFINISHED)
    work = I.Work(lambda rows: rows.select("id", F.explode(F.split("content", " ")).alias("content")), extract, lambda rows: rows.select("id", fails.alias("outcome")))
    return I.IncrementalIndex(spark, str(tmp_path / "index"), work, most_attempts=2, time_out=2), seen


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, content string")


def states(index):
    return {r["doc_id"]: (r["status"], r["attempts"], r["error"]) for r in index.load("states").collect()}


def test_batches_replays_attempts_and_time_outs(spark, index):
    index, seen = index
    assert index.apply(docs(spark, (1, "a b"), (2, "b c"), (3, "c"), (4, "a b")), 0)
    assert states(index) == {1: ("PROCESSED", 1, None), 2: ("FAILED", 1, "bad"), 3: ("PROCESSING", 1, None)}
    before = index.table.newest()
    assert not index.apply(docs(spark, (9, "z")), 0) and index.table.newest() == before  # a replay
    index.apply(docs(spark, (5, "a d"), (1, "a b")), 1)
    assert states(index) == {1: ("PROCESSED", 1, None), 2: ("FAILED", 2, "bad"), 3: ("PROCESSING", 1, None), 5: ("PROCESSED", 1, None)}
    index.apply(docs(spark), 2)
    assert states(index)[3] == ("PROCESSING", 2, None) and states(index)[2] == ("FAILED", 2, "bad")
    index.apply(docs(spark, (6, None)), 4)
    assert states(index)[3] == ("FAILED", 2, "timed out") and states(index)[6] == ("PROCESSED", 1, None)
    assert [s for s in seen if s] == [["a", "b", "c"], ["d"], [""]]
    assert index.load("links").count() == 2 + 2 + 1 + 2 + 1 and sorted(r["fact"] for r in index.load("facts").collect()) == ["", "A", "B", "C", "D"]


def test_growing_parts_hold_new_rows_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("weftgraph.sources.versions.PIECES", 3)
    make = lambda: Versions(spark, str(tmp_path / "t"), {"a": "x int", "b": "y int"}, grows=("a",))
    frame = lambda c, *n: spark.createDataFrame([(i,) for i in n], f"{c} int")
    v = make()
    for n in range(1, 10):
        if n == 5:
            frame("x", 99).write.parquet(str(tmp_path / "t" / "v=5" / "a+"))  # a save that was broken off
        assert v.save(a=frame("x", n), b=lambda written: written("a").select((F.col("x") * 10).alias("y"))) == n
        again = make()
        assert sorted(r["x"] for r in again.load("a").collect()) == list(range(1, n + 1)) and [r["y"] for r in again.load("b").collect()] == [10 * n]
        assert [k for k, whole in again.found() if whole] == [k for k in (n - 1, n) if k]
        assert len(again._pieces("a", n)[1]) <= 3
    assert [r["x"] for r in spark.read.parquet(str(tmp_path / "t" / "v=9" / "a+")).collect()] == [9]


def test_a_batch_writes_its_own_chunks_only(spark, index, tmp_path):
    index, _ = index
    index.apply(docs(spark, (1, "a b"), (2, "b c"), (2, "b c")), 0)
    index.apply(docs(spark, (3, "c d"), (1, "a b")), 1)
    own = lambda part: spark.read.parquet(f"{index.table.folder}/v=2/{part}+")
    assert [r["content"] for r in own("chunks").collect()] == ["d"] and own("links").count() == 2 and [r["fact"] for r in own("facts").collect()] == ["D"]
    assert sorted(r["content"] for r in index.load("chunks").collect()) == ["a", "b", "c", "d"]
