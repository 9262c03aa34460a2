"""The completion job: what a second run reads, what a change remakes, and which answers stay."""

import dataclasses

from pyspark.sql import functions as F

from weftgraph.operators import completion as C
from weftgraph.plans import completion_queries as Q


def small(spark):
    rows = [(c, f"s{c % 5}", "has", f"o{(c * 7) % 11}") for c in range(60)] + [(99, "s9", "has", "o1"), (99, "s9", "has", "o2")]
    facts = spark.createDataFrame(rows, "chunk bigint, s string, p string, o string")
    return facts, facts.select(F.col("s").alias("node")).distinct()


def test_stages_are_read_again_and_remade_by_what_changed(spark, tmp_path):
    facts, roots = small(spark)
    calls = []

    def ask(shown):
        calls.append(1)
        return Q.ask(shown)

    every = ["subgraphs", "scores", "selection", "evidence", "completed", "graph"]
    run = lambda f, s, **more: C.complete(f, roots, str(tmp_path), Q.score, ask, s, **more)
    first = run(facts, Q.SETTINGS)
    assert first[2].made == every and not first[2].reused
    again = run(facts.orderBy(F.rand()), Q.SETTINGS)
    assert again[2].reused == every and len(calls) == 1
    assert sorted(map(tuple, again[0].collect())) == sorted(map(tuple, first[0].collect()))
    other = run(facts, dataclasses.replace(Q.SETTINGS, triples=3))
    assert other[2].reused == every[:3] and other[2].made == every[3:] and len(calls) == 2
    assert run(facts, Q.SETTINGS)[2].reused == every
    assert run(facts.limit(50), Q.SETTINGS)[2].made == every and run(facts, Q.SETTINGS, version="2")[2].made == every


def test_a_stage_that_broke_off_is_made_again(spark, tmp_path):
    job = C.StagedJob(spark, str(tmp_path), {"a": 1})
    job.stage("x", {}, lambda: spark.range(3))
    path = next((tmp_path / "x").iterdir())
    (path / "_SUCCESS").unlink()
    assert C.StagedJob(spark, str(tmp_path), {"a": 1}).stage("x", {}, lambda: spark.range(4)).count() == 4


def test_answers_that_stay(spark):
    schema = "root string, s string, p string, o string, chunk bigint"
    shown = spark.createDataFrame([("a", 1, "x", "p", "y", 7), ("b", 1, "x", "p", "z", 1), ("b", 2, "y", "p", "z", 2)], "root string, at int, s string, p string, o string, chunk bigint")
    answers = [("a", " n ", "r", "m", 7), ("a", "n", "r", "k", 99), ("a", "n", "r", "j", None), ("b", "n", "r", "i", 99), ("b", "n", "r", "h", 2), ("b", "n", "r", "n", 2), ("b", None, "r", "q", 2), ("b", "x", "p", "y", 1), ("a", "n", " ", "m", 7)]
    facts = spark.createDataFrame([(7, "x", "p", "y")], "chunk bigint, s string, p string, o string")
    got = sorted(tuple(r) for r in C.valid(spark.createDataFrame(answers, schema), shown, facts).collect())
    assert got == [("n", "r", "h", 2), ("n", "r", "j", 7), ("n", "r", "k", 7), ("n", "r", "m", 7)]


def test_an_empty_graph(spark, tmp_path):
    facts, roots = small(spark)
    graph, hidden, _ = C.complete(facts.limit(0), roots.limit(0), str(tmp_path), Q.score, Q.ask)
    assert graph.count() == 0 and hidden.count() == 0


def test_print_of_a_graph_with_many_facts(spark):
    facts = spark.range(20_000_000, numPartitions=4).select(F.lit("s").alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"), F.col("id").alias("chunk"))
    got = C.graph_print(facts)
    assert got["facts"] == 20_000_000 and got["print"][1] > 1 << 63
