"""Steps whose choices depend on those before, and replaceable functions, on fixed cases."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import extensions, hooks, mining, mutate
from weftgraph.plans import registry
from weftgraph.sources import books

registry.load()


def test_evidence_batches(spark):
    rows = [("r", 1, 1, ["a", "b"]), ("r", 2, 2, ["c", "d"]), ("r", 3, 3, ["b", "e"]), ("r", 4, 4, ["x", "y", "z"]), ("r", 5, 5, ["c", "a"]), ("q", 6, 1, ["a"]), ("r", 7, 6, ["a", "b", "c", "d", "e"])]
    df = spark.createDataFrame(rows, "root string, pair int, seq int, chunks array<string>")
    got = {(r["root"], r["batch"], r["place"]): r["pair"] for r in mining.evidence_batches(df).collect()}
    # 1 and 2 fit one batch of four chunks; 3 would make five; 5 lies whole in the first; 7 is larger than any batch
    assert got == {("q", 0, 0): 6, ("r", 0, 0): 1, ("r", 0, 1): 2, ("r", 0, 2): 5, ("r", 1, 0): 3, ("r", 2, 0): 4, ("r", 3, 0): 7}
    many = spark.createDataFrame([("r", i, i, ["a"]) for i in range(23)], "root string, pair int, seq int, chunks array<string>")
    assert sorted(r["count"] for r in mining.evidence_batches(many).groupBy("batch").count().collect()) == [3, 10, 10]


def test_root_order():
    assert mining.root_order([3, 1, 4, 2], {3: {2}, 2: {1, 4}}) == [3, 2, 1, 4]
    assert mining.root_order([], {}) == []


def test_budget():
    assert [mining.budget(x, 10) for x in (0.5, 0.01, 1.0, 7.9, 0.0)] == [5, 1, 1, 7, 1]


def test_bellman_ford_stops_early(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0), (1, 3, 9.0), (3, 1, 1.0)], "src int, dst int, weight double")
    start = spark.createDataFrame([(1, 0.0)], "node int, cost double")
    want = {1: {1: 0.0, 2: 5.0, 3: 9.0}, 2: {1: 0.0, 2: 5.0, 3: 6.0}, 9: {1: 0.0, 2: 5.0, 3: 6.0}}
    for rounds, costs in want.items():
        assert {r["node"]: r["cost"] for r in mining.bellman_ford(edges, start, rounds).collect()} == costs


def test_overlay_keeps_the_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    edits = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, v string")
    assert sorted(tuple(r) for r in mutate.overlay(rows, edits, "k").collect()) == [(1, "y"), (2, "b")]


def test_storage_contracts():
    with pytest.raises(TypeError):
        extensions.store("kv", "none")(type("None_", (), {"get": lambda self: None}))
    assert ("graph", "parquet") in extensions.STORES


def test_chunkers():
    tool = extensions.BytesTokenizer()
    assert extensions.token_chunker(tool, "abcdefg", 4, 2) == [(0, 4, "abcd"), (1, 4, "cdef"), (2, 3, "efg"), (3, 1, "g")]
    assert extensions.token_chunker(tool, "", 4, 2) == []
    assert extensions.split_chunker("|")(tool, "ab||abcdefg", 4, 0) == [(0, 2, "ab"), (1, 0, ""), (2, 4, "abcd"), (3, 3, "efg")]


def test_books_by_rank(spark, tmp_path):
    rows = [(b, i, "t", 1) for b in ("x", "y", "z") for i in range(3)]
    spark.createDataFrame(rows, "book string, doc_id bigint, text string, n_chars bigint").write.json(f"{tmp_path}/raw")
    books.convert(spark, f"{tmp_path}/raw", f"{tmp_path}/made", start=1, most=1)
    assert {r["book"] for r in books.load(spark, f"{tmp_path}/made").collect()} == {"y"}
    books.convert(spark, f"{tmp_path}/raw", f"{tmp_path}/all")
    assert {r["book"] for r in books.load(spark, f"{tmp_path}/all", most=2).collect()} == {"x", "y"}


def test_judge_of_odd_answers(spark):
    cases = [
        (None, False), ("", False), ('["correct", "x"]', False), ('{"same": null, "label": "correct"}', True), ("{'x'} correct", False), ("Correct!", True), ("in correct", False),
        ('{"same": 1}', True), ('{"same": -1}', False), ('{"same": " YES "}', True), ('{"same": "no", "label": "correct"}', False), ('{"answer": "maybe", "verdict": "Correct"}', True),
        ('{"same": true, "same": false}', False), ('```json\n{"equivalent":\ntrue}\n```', True), ('{"same": {"a": 1}}', False), ("uncorrected", False), ("It is correct. Not incorrect.", False), ('{"other": true} correct', False),
    ]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string").select("i", hooks.judged(F.col("x")).alias("y"))
    got = {r["i"]: r["y"] for r in rows.collect()}
    assert [(x, got[i]) for i, (x, _) in enumerate(cases)] == cases


def test_repaired_json(spark):
    cases = [
        (None, ""), ('{"a": [1, 2]}', '{"a": [1, 2]}'), ('{"a": [1, 2, {"b": "c', '{"a": [1, 2]}'), ('{"a": "x", "b', '{"a": "x"}'), ('[{"a": "q\\", [", "b": 1}, {"c": 2', '[{"a": "q\\", [", "b": 1}]'),
        ('{"a": "open', '{"a": "open"}'), ("[1, 2", "[1]"), ('{"a": [1}', '{"a": [1}}'), ("]", "]"), ('{"k": "é, 漢', '{"k": "é"}'), ("word", "word"), ('"a, b', '"a"'),
    ]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string").select("i", hooks.repaired_json(F.col("x")).alias("y"))
    got = {r["i"]: r["y"] for r in rows.collect()}
    assert [(x, got[i]) for i, (x, _) in enumerate(cases)] == cases


def test_corruption_views(spark):
    members = [("a", x) for x in "abcd"] + [("b", x) for x in "bc"] + [("z", "z")] + [("h", x) for x in "habcdefg"]
    facts = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("b", "c"), ("x", "a"), ("d", "d")] + [("h", x) for x in "abcdefg"]
    rows = mining.corruption_views(spark.createDataFrame(members, "root string, node string"), spark.createDataFrame(facts, "src string, dst string"), delete=0.3).collect()
    views = {}
    for r in rows:
        views.setdefault((r["root"], r["view"]), set()).add((r["src"], r["dst"]))
        assert r["label"] == (r["view"] != "full")
    assert views["a", "full"] == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")} and views["b", "full"] == {("b", "c")}
    assert views["a", "masked"] < views["a", "full"] and len(views["a", "masked"]) == 3
    assert ("b", "masked") not in views and ("b", "deleted") not in views and not any(r == "z" for r, _ in views)
    assert len(views["h", "full"]) == 11 and len(views["h", "masked"]) == 9
    left = {x for e in views["h", "deleted"] for x in e}
    assert views["h", "deleted"] == {e for e in views["h", "full"] if set(e) <= left | {"h"}} and len({*"abcdefg"} - left) >= 2


def test_root_order_keeps_to_what_is_near():
    assert mining.root_order([1, 2, 3, 4, 5], {1: {5, 4}, 4: {2}, 2: {1, 9}}) == [1, 4, 2, 3, 5]


def test_entity_hops_of_few_and_of_many_nodes(spark, monkeypatch):
    from weftgraph.operators import mining as M

    edges = [("a", "c1"), ("b", "c1"), ("b", "c2"), ("d", "c2"), ("d", "c3"), ("d", "c3"), ("e", "c3"), ("b", "gone")]
    nodes = spark.createDataFrame([(n, 0) for n in "abde"] + [(f"c{i}", 1) for i in (1, 2, 3)], "node string, node_type int")
    frames = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a",)], "node string"), nodes
    want = [("a", 0), ("b", 1), ("c1", 0), ("c2", 1), ("c3", 2), ("d", 2)]
    for few in (M.FEW_NODES, 0):
        monkeypatch.setattr(M, "FEW_NODES", few)
        assert sorted((r["node"], r["hop"]) for r in M.entity_hops(*frames, 2).collect()) == want


def test_walks_send_no_edges_in_a_step(spark, monkeypatch):
    from weftgraph.operators import graph

    plans, own = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, tag))
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    assert graph.random_walks(edges, spark.createDataFrame([("a",)], "node string"), 2, 3).count() == 8
    assert len(plans) == 3 and not any("hashpartitioning(src" in p for p in plans)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("walks_")]


def test_easy_edges_go_in_one_aggregation(spark, tmp_path):
    lines = [(1, 1, 50.0), (1, 1, 3.0), (1, 2, 45.0), (1, 2, 1.0), (2, 2, None), (None, 3, 46.0)]
    spark.createDataFrame(lines, "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["remove_easy_edges"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 2), (2, 2, 1), (None, 3, 1)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_candidate_words_once_a_text(spark, tmp_path):
    texts = [(1, "Word word  WORD, 12 a1-b2 \u212a9 \u00e9t\u00e9\nx"), (2, None), (3, " ,;"), (4, "")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["candidate_entity_filter"](spark, str(tmp_path))
    assert {r["entity"] for r in got.collect()} == {"word", "a1", "b2", "k9"}
    assert "array_distinct" in got._jdf.queryExecution().toString()
