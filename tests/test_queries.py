"""Every registered core query against its SQL over the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from weftgraph.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def text(x):
        if isinstance(x, bool):
            return str(x)
        return repr(round(float(x), 6)) if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)

    out = pd.DataFrame()
    for c in sorted(df.columns):
        kind = df[c].dtype.kind
        out[c] = df[c].astype(float).round(6).map(repr) if kind in "fiu" else df[c].astype("datetime64[us]").astype(str) if kind == "M" else df[c].map(text)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sql, name):
    got, want = plain(registry.QUERIES[name](spark, DATA).toPandas()), plain(sql.sql(registry.SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def dense_pagerank(edges, reset):
    """{node: score} of the solved equation; edges are (a, b, weight), both ways, reset {node: weight}."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | set(reset))
    at = {x: i for i, x in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b, x in edges:
        w[at[a], at[b]] += x
        w[at[b], at[a]] += x
    start = np.zeros(len(nodes))
    for x, v in reset.items():
        start[at[x]] = max(v, 0.0)
    start /= start.sum()
    out = w.sum(axis=1)
    p = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    p[out == 0] = start
    return dict(zip(nodes, np.linalg.solve(np.eye(len(nodes)) - 0.5 * p.T, 0.5 * start)))


def test_ppr_is_the_dense_solution(spark, sql):
    edges = sql.sql("SELECT 'supplier ' || l_suppkey, 'part ' || l_partkey, 1.0::DOUBLE FROM lineitem UNION ALL SELECT 'customer ' || o_custkey, 'order ' || o_orderkey, 1.0::DOUBLE FROM orders").fetchall()
    homes = sql.sql("SELECT n_regionkey, 'supplier ' || s_suppkey, s_acctbal::DOUBLE FROM supplier JOIN nation ON n_nationkey = s_nationkey").fetchall()
    got = {(r["q"], r["node"]): r["score"] for r in registry.QUERIES["ppr"](spark, DATA).collect()}
    regions = {q for q, _, v in homes if v > 0}
    assert {q for q, _ in got} == regions
    for q in regions:
        want = dense_pagerank(edges, {x: v for r, x, v in homes if r == q})
        assert all(abs(got.get((q, x), 0.0) - v) < 2e-9 for x, v in want.items())


def test_ppr_retrieve_is_the_dense_solution(spark, sql):
    edges = sql.sql("SELECT 's' || l_suppkey, 'o' || l_orderkey, 1.0::DOUBLE FROM lineitem").fetchall()
    seeds = sql.sql("WITH p AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), h AS (SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS score FROM embeddings e, p) SELECT 's' || vec_id, score FROM h WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT 5").fetchall()
    want = {x: v for x, v in dense_pagerank(edges, dict(seeds)).items() if x.startswith("o")}
    got = registry.QUERIES["ppr_retrieve"](spark, DATA).collect()
    assert len(got) == min(200, sum(v > 0 for v in want.values()))
    assert all(abs(r["score"] - want[r["node"]]) < 2e-9 for r in got)


def test_bfs_view_has_up_to_1000_nodes(spark, sql):
    near = {}
    for a, b in sql.sql("SELECT DISTINCT l_suppkey, -1 - l_partkey FROM lineitem").fetchall():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen = {1}
    for _ in range(3):
        seen |= {y for x in seen for y in near.get(x, ())}
    got = registry.QUERIES["bfs_view"](spark, DATA).collect()
    assert len(seen) > 200 and len(got) == min(1000, len(seen))
    assert {r["is_truncated"] for r in got} == {len(seen) > 1000}
