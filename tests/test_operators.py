import numpy as np
from pyspark.sql import functions as F

from weftgraph.operators import chunking, extraction, graph, merge, mutate, ranking, vector


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_word_windows_tail(spark):
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    docs = spark.createDataFrame([(n, text(n)) for n in (0, 5, 10, 11, 18, 19, 25)], "doc_id int, text string")
    got = rows(chunking.word_windows(docs, 10, 2, 4), "doc_id", "word_start", "word_end")

    def brute(n):
        out, s = [], 0
        while n:
            e = min(s + 10, n)
            out.append([s, e])
            if e == n:
                break
            s += 8
        if len(out) > 1 and out[-1][1] - out[-1][0] < 4:
            out[-2][1] = n
            out.pop()
        return out

    assert got == sorted((n, s, e) for n in (0, 5, 10, 11, 18, 19, 25) for s, e in brute(n))


def test_token_windows(spark):
    docs = spark.createDataFrame([(1, ""), (2, "a b c d e")], "doc_id int, text string")
    assert rows(chunking.token_windows(docs, 3, 1), "doc_id", "chunk_order_index", "tokens") == [(2, 0, 3), (2, 1, 3), (2, 2, 1)]


def test_entities_are_built_from_buckets_without_a_shuffle(spark, tmp_path):
    """Rebuilding after a deletion shuffled every list of a name by itself; from rows in buckets by name, with nothing stored, it shuffles none."""
    from weftgraph.operators import lifecycle

    data = [(f"n{i % 5}", f"t{i % 3}", f"d{i % 4}", f"c{i}", f"f{i % 7}", i, i) for i in range(60)]
    new = spark.createDataFrame(data, "name string, type string, description string, source string, file_path string, ts int, seq int")
    new.repartition(4, "name").write.format("parquet").option("path", f"{tmp_path}/new").bucketBy(4, "name").saveAsTable("rebuilt_rows")
    try:
        built = lifecycle.merge_into_entities(spark.table("rebuilt_rows"), None, 3, 2)
        assert "Exchange hashpartitioning" not in built._jdf.queryExecution().executedPlan().toString()
        empty = spark.createDataFrame([], "name string, entity_type string, description string, source_id string, file_path string")
        assert rows(built, *built.columns) == rows(lifecycle.merge_into_entities(new, empty, 3, 2), *built.columns)
        assert {r["n_sources"] for r in built.collect()} == {3}
    finally:
        spark.sql("DROP TABLE rebuilt_rows")


def test_a_block_of_scores_is_never_whole_in_memory():
    """A task held some copies of the scores of a whole block: 128 MB each at 4,096 queries and keys."""
    import tracemalloc

    rng = np.random.default_rng(7)
    queries, keys = rng.normal(size=(4096, 8)), rng.normal(size=(4096, 8))
    tracemalloc.start()
    got = vector.best_of_block(queries, keys, 10, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    score = np.round(queries[3000:3100] @ keys.T, 9)
    want = vector.best_of_rows(score, 10, 0.5)
    mine = (got[0] >= 3000) & (got[0] < 3100)
    assert (got[0][mine] - 3000).tolist() == want[0].tolist() and got[1][mine].tolist() == want[1].tolist()
    assert np.allclose(got[2][mine], score[want], atol=1e-8) and len(got[0]) == 40960


def test_pairs_of_key_meet_as_blocks_in_all_tasks(spark):
    """A key's pairs are many more than its rows: they are not made in one task, none is lost and equal or null rows count each."""
    left = spark.range(150).selectExpr("if(id % 50 = 49, 'rare', 'hot') as k", "if(id % 10 = 0, null, id div 2) as a").repartition(3)
    right = spark.range(90).selectExpr("if(id < 80, 'hot', if(id < 85, 'rare', 'none')) as k", "id as b").repartition(3)
    for block in (16, 1000):
        got = merge.pairs_of_key(left, right, "k", "a", "b", block)
        want = left.join(right, "k").select("a", "b")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == want.count() == 147 * 80 + 3 * 5
    tasks = merge.pairs_of_key(left, right, "k", "a", "b", 16).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pairs_are_made_a_bounded_number_at_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(merge, "PAIRS", 100)
    ours, theirs = [*range(40), None], [f"t{i}" for i in range(30)]
    rows = pa.RecordBatch.from_arrays([pa.array([ours, [7], []]), pa.array([theirs, theirs, theirs])], ["as", "bs"])
    out = list(merge._crossed("a", "b")(iter([rows])))
    assert max(b.num_rows for b in out) <= 100
    got = [(r["a"], r["b"]) for b in out for r in b.to_pylist()]
    assert got == [(a, b) for a in [*ours, 7] for b in theirs]


def test_phrase_containment_of_odd_parts(spark, tmp_path):
    """Null parts of a text leave it without rows, as in SQL; parts of equal ids count each as texts and once as entities."""
    import duckdb

    from weftgraph.plans import registry

    registry.load()
    data = [(1, "Red Bolt", "STEEL"), (2, "red-bolt", None), (3, None, "red bolt"), (4, "ab", "red bolt"), (5, "steel", "x  y"), (5, "steel", "x  y"), (6, "x  y", "red bolt"), (None, "bolt", "red")]
    spark.createDataFrame(data, "p_partkey bigint, p_name string, p_type string").withColumn("p_brand", F.lit("b")).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(registry.SQL["phrase_containment"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["phrase_containment"](spark, str(tmp_path)).collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(want)


def test_entity_merge_ties(spark):
    data = [("e", "b", "same", "s1", 1, 1), ("e", "a", "longer text", "s2", 1, 2), ("e", "a", "same", "s1", 0, 3), ("e", "b", "z", "s3", 1, 4)]
    got = merge.merge_entities(spark.createDataFrame(data, "name string, type string, description string, source string, ts int, seq int"), 2).first()
    assert got.entity_type == "b" and got.description == "same<SEP>longer text<SEP>z" and got.source_id == "s2<SEP>s3"


def test_records(spark):
    lines = ["entity<|#|>A b<|#|>Type X<|#|>d", "entity<|#|>A<|#|>bad|type<|#|>d", "entity<|#|><|#|>t<|#|>d", "entity<|#|>x<|#|>t", "relation<|#|>a<|#|>a<|#|>k<|#|>d", "relation<|#|>a<|#|>b<|#|>k，l<|#|>2.5"]
    df = spark.createDataFrame([("\n".join(lines) + "<|COMPLETE|>",)], "result string")
    recs = extraction.split_records(df, "result")
    assert rows(extraction.entity_records(recs), "entity_name", "entity_type") == [("A b", "typex")]
    assert rows(extraction.relation_records(recs), "src_id", "keywords", "weight") == [("a", "k,l", 2.5)]


def test_pagerank_matches_dense_solution(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "b", 1.0), ("c", "d", 0.5)]
    names = "abcde"
    w = np.zeros((5, 5))
    for s, t, x in edges:
        w[names.index(s), names.index(t)] += x
        w[names.index(t), names.index(s)] += x
    reset = np.array([1.0, 0, 0, 0, 3.0]) / 4
    out = w.sum(axis=1)
    p = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    r = reset.copy()
    for _ in range(80):
        r = 0.5 * reset + 0.5 * (r @ p + r[out == 0].sum() * reset)
    got = graph.personalised_pagerank(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([(0, "a", 1.0), (0, "e", 3.0), (0, "b", float("nan"))], "q int, node string, weight double"), rounds=20)
    for x in got.collect():
        assert abs(x["score"] - r[names.index(x["node"])]) < 1e-5


def test_bfs_hops_and_walks(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("x", "y", 1.0)], "src string, dst string, weight double")
    assert rows(graph.hop_distance(edges, spark.createDataFrame([("a",)], "node string"), 2), "node", "hop") == [("a", 0), ("b", 1), ("c", 2)]
    view, cut = graph.bfs_view(edges, "a", 3, 3)
    assert view.count() == 3 and cut
    walks = graph.random_walks(edges, spark.createDataFrame([("a",)], "node string"), 2, 2)
    again = graph.random_walks(edges.repartition(3), spark.createDataFrame([("a",)], "node string"), 2, 2)
    assert rows(walks, "walk", "step", "node") == rows(again, "walk", "step", "node")


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)], "vec_id bigint, embedding array<float>")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    score = np.round(u @ u.T, 9)
    want = sorted((i, int(j)) for i in range(60) for j in np.lexsort((np.arange(60), -score[i]))[:5])
    assert rows(vector.knn(df, df, 5, blocks=3), "query_id", "key_id") == want


def test_polling_quotas(spark):
    have = [0, 1, 5, 9]
    data = [(0, i, p) for i, n in enumerate(have) for p in range(1, n + 1)]
    got = ranking.weighted_polling(spark.createDataFrame(data, "q int, item int, pos int"), "q", "item", "pos", 5, 1)
    # item 0 has no rows, so quotas are those of the items that have some
    assert got.where("round = 1").count() == min(1, 4) + min(5, 2) + min(9, 1)


def test_mutations(spark):
    src = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 3)], "name string, source int")
    assert rows(mutate.deletion_plan(src, spark.createDataFrame([(1,)], "source int")), "name", "action") == [("a", "rebuild"), ("b", "delete"), ("c", "untouched")]
    edges = spark.createDataFrame([(2, 3, 1.0), (2, 9, 1.0), (9, 3, 4.0)], "src int, tgt int, weight double")
    assert rows(mutate.merge_nodes(edges, [2, 3], 1), "src", "tgt", "weight") == [(1, 9, 4.0)]


def test_covered_length(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 20, 21)], "k int, s int, e int")
    assert rows(ranking.covered(df, ["k"], "s", "e"), "covered") == [(10,)]


def test_labels(spark):
    df = spark.createDataFrame([("cat",), ("cats",), ("a cat",), ("concat",)], "label string")
    assert rows(graph.label_search(df, "cat"), "label", "score") == [("a cat", 145), ("cat", 1000), ("cats", 500), ("concat", 94)]




def test_collated_pages(spark):
    labels = ["中", "阿", "北京", "b", "A", "a", "é", "e", "Z", "中文", "a", None]
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    want = ["阿", "北京", "中", "中文", "a", "A", "b", "é", "e", "Z"]  # by the sounds of Han characters, then letters; this order has é before e
    got, after = [], None
    for _ in range(6):
        page = [r[0] for r in graph.collated_page(rows, 2, after).collect()]
        got += sorted(page, key=want.index)
        after = max(page, key=want.index) if page else after
    assert got == want


def test_mean_places_of_ties_over_many_ranges(spark):
    from weftgraph.operators import ranking

    values = [("a", i % 13) for i in range(200)] + [("b", i % 7) for i in range(50)] + [("b", None), (None, 3), (None, 3)]
    got = {(r["g"], r["x"]): r["place"] for r in ranking.mean_places(spark.createDataFrame(values, "g string, x int"), "g", "x", "place").collect()}
    for g, x in set(values):
        mine = sorted((v for k, v in values if k == g), key=lambda v: (v is not None, v or 0))
        places = [i + 1 for i, v in enumerate(mine) if v == x]
        assert got[g, x] == sum(places) / len(places)


def test_best_of_rows_is_the_stable_sort():
    import numpy as np

    from weftgraph.operators import vector

    score = np.round(np.random.default_rng(5).uniform(-1, 1, (40, 60)), 1)
    score[3] = 0.5
    for take in (1, 7, 60):
        for threshold in (-1.0, 0.4):
            rows, columns = vector.best_of_rows(score, take, threshold)
            at = np.argsort(-score, axis=1, kind="stable")[:, :take]
            want = [(i, j) for i in range(40) for j in at[i].tolist() if score[i, j] >= threshold]
            assert list(zip(rows.tolist(), columns.tolist())) == want
