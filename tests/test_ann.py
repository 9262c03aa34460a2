"""The index of inverted lists against all pairs."""

import os
from collections import defaultdict

import numpy as np
import pytest

from weftgraph.operators import ann, vector
from weftgraph.plans import registry

registry.load()
BIG = "/root/testdata/sf0.1"


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")


def pairs(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["key_id"], round(r["score"], 7)))
    return out


@pytest.fixture(scope="module")
def hot():
    """A cluster that holds two thirds of all vectors, copies, and a zero vector."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 0.02, (400, 8)) + 1, rng.normal(size=(180, 8)), np.ones((30, 8)), np.zeros((1, 8))])
    return v.astype(np.float32)


def test_all_lists_are_exact_with_lists_in_parts(spark, hot, monkeypatch):
    monkeypatch.setattr(ann, "PART", 64)
    rows = frame(spark, hot)
    got = pairs(ann.neighbours_by_index(rows, rows, 5, probes=1000).collect())
    assert got == pairs(vector.knn(rows, rows, 5).collect()) and len(got) == len(hot)


def test_probes_follow_the_data(spark, hot, tmp_path):
    index = ann.VectorIndex.build(frame(spark, hot), str(tmp_path / "i"))
    spread = ann.VectorIndex.build(frame(spark, np.random.default_rng(1).normal(size=(600, 32)).astype(np.float32)), str(tmp_path / "j"))
    assert index.probes < spread.probes <= len(spread.centroids)


def test_index_is_opened_again_and_grows(spark, hot, tmp_path):
    path = str(tmp_path / "index")
    ann.VectorIndex.build(frame(spark, hot), path, lists=10)
    again = ann.VectorIndex.open(spark, path)
    more = np.random.default_rng(7).normal(size=(20, 8)).astype(np.float32)
    again.add(frame(spark, more, 5000))
    both = frame(spark, hot).union(frame(spark, more, 5000))
    third = ann.VectorIndex.open(spark, path)
    assert len(third.centroids) == 10 and third.vectors().count() == len(hot) + 20
    asked = frame(spark, more, 9000)
    assert pairs(third.search(asked, 4, probes=10).collect()) == pairs(vector.knn(asked, both, 4).collect())
    third.drop()
    assert not os.path.exists(f"{path}/meta") or not os.listdir(f"{path}/meta")


def test_threshold_nulls_and_empty_tables(spark, hot):
    odd = spark.createDataFrame([(-1, None), (-2, []), (-3, [None] * 8), (-4, [float("nan")] * 8)], "vec_id bigint, embedding array<float>")
    rows = frame(spark, hot[:50]).union(odd)
    got = ann.neighbours_by_index(rows, rows, 60, probes=50, threshold=0.999).collect()
    assert got and min(r["score"] for r in got) >= 0.999 and min(r["key_id"] for r in got) >= 0
    assert ann.neighbours_by_index(rows, odd, 5).count() == 0
    assert ann.neighbours_by_index(odd, rows, 5).count() == 0


@pytest.mark.skipif(not os.path.isdir(BIG), reason="needs the driver's tables")
def test_recall_of_the_registered_queries(spark):
    rows = spark.read.parquet(f"{BIG}/embeddings.parquet").select("vec_id", "embedding")
    want = pairs(vector.knn(rows.where("vec_id % 20 = 0"), rows, 10).collect())
    got = pairs(registry.QUERIES["ann_neighbours"](spark, BIG).collect())
    found = sum(len({k for k, _ in got[q]} & {k for k, _ in want[q]}) for q in want)
    assert set(got) == set(want) and found / sum(map(len, want.values())) >= 0.9
    edges = {(r["src"], r["dst"]) for r in registry.QUERIES["synonym_edges"](spark, BIG).collect()}
    by_index = {(r["src"], r["dst"]) for r in registry.QUERIES["synonym_edges_index"](spark, BIG).collect()}
    assert by_index <= edges and len(by_index) >= 0.9 * len(edges)


def test_candidates(spark):
    near = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.9), (2, 1, 0.9), (1, 3, 0.99), (3, 4, 0.5), (5, 4, 0.9), (4, 6, 0.5), (6, 2, 0.4)], "query_id int, key_id int, score double")
    bad = spark.createDataFrame([(5,)], "id int")
    observed = spark.createDataFrame([(4, 3)], "a int, b int")
    got = [(r["a"], r["b"], round(r["score"], 6)) for r in ann.candidate_pairs(near, bad, observed, 0.98, 2).collect()]
    assert got == [(1, 2, round(1 / (1 + np.exp(-0.9)), 6)), (4, 6, round(1 / (1 + np.exp(-0.5)), 6))]


def test_a_query_gets_its_best_once_a_bin(spark, tmp_path):
    rows = frame(spark, np.random.default_rng(3).normal(size=(900, 8)).astype(np.float32))
    index = ann.VectorIndex.build(rows, str(tmp_path / "i"), lists=30)
    first, many = index._bins({r["list"]: r["count"] for r in index.vectors().groupBy("list").count().collect()}, 1024)
    assert set(many.tolist()) == {1} and set(first.tolist()) == {0}  # 30 lists, one bin
    few, all_ = pairs(index.search(rows, 5, probes=3).collect()), pairs(index.search(rows, 5, probes=30).collect())
    assert all_ == pairs(vector.knn(rows, rows, 5).collect()) and few != all_
    # three probes see only these lists: what an exact search over them gives
    near = {r["vec_id"]: set(r["lists"]) for r in index._nearest(rows, 3).collect()}
    list_of = {r["vec_id"]: r["list"] for r in index.vectors().collect()}
    whole = pairs(vector.knn(rows, rows, 900).collect())
    assert few == {q: [x for x in found if list_of[x[0]] in near[q]][:5] for q, found in whole.items()}


def test_best_candidates_of_many_ranges(spark):
    rng = np.random.default_rng(4)
    near = [(int(a), int(b), round(float(s), 2)) for a, b, s in zip(rng.integers(0, 90, 700), rng.integers(0, 90, 700), rng.random(700), strict=True)]
    none = spark.createDataFrame([], "id int"), spark.createDataFrame([], "a int, b int")
    best = {}
    for a, b, s in near:
        if a != b and s < 0.98:
            best[min(a, b), max(a, b)] = max(s, best.get((min(a, b), max(a, b)), 0))
    want = sorted(best, key=lambda p: (-best[p], p))[:250]
    plan = ann.candidate_pairs(spark.createDataFrame(near, "query_id int, key_id int, score double"), *none, 0.98, 250)
    assert {(r["a"], r["b"]) for r in plan.collect()} == set(want)
    assert "TakeOrdered" not in plan._jdf.queryExecution().toString()  # no task holds them all
