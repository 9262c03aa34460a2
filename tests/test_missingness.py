"""The subgraph model against arrays, one subgraph at a time."""

import math
from collections import defaultdict

import numpy as np
import pytest

from weftgraph.operators import missingness as Q
from weftgraph.plans import mining_queries, registry

registry.load()


def by_force(nodes, edges, m):
    by_graph, near = defaultdict(dict), defaultdict(list)
    for g, n, kind, x in nodes:
        by_graph[g][n] = np.array(x) @ m.projection.T + m.projection_bias + m.kinds[kind]
    for g, s, r, t in edges:
        near[g].append((s, r, t))
    gelu = np.vectorize(lambda z: z * 0.5 * (1 + math.erf(z / math.sqrt(2))))
    out = {}
    for g, h in by_graph.items():
        for c in m.layers:
            new = {}
            for n in h:
                y = c.root @ h[n] + c.bias
                for r in range(len(c.relations)):
                    got = [h[s] for s, q, t in near[g] if q == r and t == n and s in h]
                    if got:
                        y = y + c.relations[r] @ np.mean(got, axis=0)
                y = gelu(y)
                new[n] = (y - y.mean()) / math.sqrt(y.var() + 1e-5) * c.gain + c.shift
            h = new
        v = np.array(list(h.values()))
        y = m.out @ gelu(m.head @ np.concatenate([v.mean(0), v.max(0)]) + m.head_bias) + m.out_bias
        out[g] = 1 / (1 + math.exp(-y))
    return out


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    nodes, edges = mining_queries.model_input(spark, d)
    want = by_force([tuple(r) for r in nodes.collect()], [tuple(r) for r in edges.collect()], Q.random_model(3, 16, 2, 4))
    got = {r["graph"]: r["score"] for r in registry.QUERIES["missingness_forward"](spark, d).collect()}
    assert set(got) == set(want) and len(want) > 1000 and max(abs(got[g] - want[g]) for g in want) < 1e-9
    assert np.std(list(got.values())) > 1e-3


def test_lone_nodes_outer_edges_and_repeated_edges(spark):
    nodes = [("a", 1, 0, [1.0, 2.0]), ("a", 2, 1, [0.0, 1.0]), ("b", 1, 0, [3.0, -1.0])]
    edges = [("a", 1, 0, 2), ("a", 1, 0, 2), ("a", 2, 1, 2), ("a", 9, 0, 1), ("b", 1, 0, 7), ("c", 1, 0, 2)]
    m = Q.random_model(2, 4, 2, 2)
    frames = spark.createDataFrame(nodes, "graph string, node int, kind int, x array<double>"), spark.createDataFrame(edges, "graph string, src int, rel int, dst int")
    got = {r["graph"]: r["score"] for r in Q.forward(*frames, m).collect()}
    want = by_force(nodes, edges, m)
    assert set(got) == {"a", "b"} and all(abs(got[g] - want[g]) < 1e-12 for g in want)
    assert Q.forward(frames[0].limit(0), frames[1], m).count() == 0


def test_too_many_weights(spark, monkeypatch):
    monkeypatch.setattr(Q, "MOST_WEIGHTS", 10)
    nodes = spark.createDataFrame([], "graph string, node int, kind int, x array<double>")
    with pytest.raises(ValueError):
        Q.forward(nodes, spark.createDataFrame([], "graph string, src int, rel int, dst int"), Q.random_model(2, 4, 2, 2))


def test_small_subgraphs_stay_whole_and_large_ones_are_spread(spark, monkeypatch):
    rng = np.random.default_rng(5)
    nodes = [(g, f"n{i}", int(rng.integers(2)), rng.normal(size=2).tolist()) for g, n in ((1, 3), (2, 60), (3, 1), (None, 2)) for i in range(n)]
    edges = [(g, f"n{rng.integers(n)}", int(rng.integers(2)), f"n{rng.integers(n + 1)}") for g, n in ((1, 3), (2, 60), (4, 5)) for _ in range(4 * n)] + [(1, None, 0, "n1")]
    m = Q.random_model(2, 4, 2, 2)
    frames = spark.createDataFrame(nodes, "graph int, node string, kind int, x array<double>"), spark.createDataFrame(edges, "graph int, src string, rel int, dst string")
    want = by_force(nodes, edges, m)
    spread, seen = Q._spread, []
    monkeypatch.setattr(Q, "_spread", lambda n, e, m: seen.append({r["graph"] for r in n.collect()}) or spread(n, e, m))
    for limit, alone in ((1 << 22, []), (400, [{2}])):  # states of 4 numbers: over 50 rows are many
        monkeypatch.setattr(Q, "BUCKET", limit)
        seen.clear()
        got = {r["graph"]: r["score"] for r in Q.forward(*frames, m).collect()}
        assert seen == alone and set(got) == set(want) and all(abs(got[g] - want[g]) < 1e-12 for g in want)
