"""The completion job over suppliers, parts and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import completion as C
from ..operators import mining
from ..session import read_table, shared_dir
from .registry import query

SETTINGS = C.Settings(width=8, threshold=0.75, overlap=0.1, budget=20, triples=12, chunks=5)


def inputs(spark, d):
    rows = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.concat(F.lit("supplier "), "l_suppkey").alias("s"), F.lit("supplies").alias("p"), F.concat(F.lit("part "), "l_partkey").alias("o"))
    return rows, rows.select(F.col("s").alias("node")).distinct()


def score(members, facts):
    """A logistic function of the number of facts between a subgraph's nodes."""
    inside = C.evidence(facts, members, 1 << 30, 1 << 30).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return mining.missingness(inside, {"n": 0.15}, 0.0).select("root", F.round("score", 9).alias("score"))


def ask(shown):
    """Neighbouring objects of the evidence go together; and answers that validation must drop."""
    after = Window.partitionBy("root").orderBy("at")
    pairs = shown.select("root", F.col("o").alias("s"), F.lit("goes with").alias("p"), F.lead("o").over(after).alias("o"), "chunk")
    known = shown.select("root", "s", "p", "o", "chunk")
    uncited = shown.select("root", F.col("o").alias("s"), F.lit("lacks").alias("p"), F.col("s").alias("o"), F.lit(-1).cast("long").alias("chunk"))
    return pairs.union(known).union(uncited).union(pairs.select("root", "s", F.lit(" "), "o", "chunk"))


def completed(spark, d):
    facts, roots = inputs(spark, d)
    return C.complete(facts, roots, f"{shared_dir(spark)}/completion-{uuid.uuid4().hex}", score, ask, SETTINGS)


_S = SETTINGS
_SQL = f"""WITH RECURSIVE fa AS MATERIALIZED (SELECT l_orderkey AS chunk, 'supplier ' || l_suppkey AS s, 'part ' || l_partkey AS o FROM lineitem),
m AS MATERIALIZED (SELECT s AS root, o AS node FROM (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY count(*) DESC, o) AS k FROM fa GROUP BY s, o) WHERE k <= {_S.width}),
ev AS MATERIALIZED (SELECT root, o, chunk, row_number() OVER (PARTITION BY root ORDER BY chunk, o) AS n, dense_rank() OVER (PARTITION BY root ORDER BY chunk) AS c FROM (SELECT DISTINCT root, o, chunk FROM fa JOIN m ON s = root AND o = node)),
sc AS (SELECT root, round(1 / (1 + exp(-0.15 * count(*))), 9) AS score FROM ev GROUP BY root),
ca AS MATERIALIZED (SELECT root, score, list_append(list(node), root) AS members, row_number() OVER (ORDER BY score DESC, root) AS i FROM m JOIN sc USING (root) WHERE score >= {_S.threshold} GROUP BY root, score),
g AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS ids, []::VARCHAR[][] AS sets UNION ALL SELECT i, CASE WHEN ok THEN list_append(ids, root) ELSE ids END, CASE WHEN ok THEN list_append(sets, members) ELSE sets END FROM (SELECT ca.*, g.ids, g.sets,
  NOT list_contains(list_transform(g.sets, lambda x: len(list_intersect(x, ca.members)) > {_S.overlap} * len(list_distinct(list_concat(x, ca.members)))), true) AS ok FROM g JOIN ca ON ca.i = g.i + 1 WHERE len(g.ids) < {_S.budget})),
best AS (SELECT unnest(ids) AS root FROM (SELECT ids FROM g ORDER BY i DESC LIMIT 1)),
shown AS MATERIALIZED (SELECT root, n, o, chunk FROM ev WHERE root IN (SELECT root FROM best) AND n <= {_S.triples} AND c <= {_S.chunks}),
pairs AS (SELECT root, o AS s, 'goes with' AS p, lead(o) OVER (PARTITION BY root ORDER BY n) AS o, chunk FROM shown),
lone AS (SELECT root, min(chunk) AS chunk FROM shown GROUP BY root HAVING count(DISTINCT chunk) = 1),
hidden AS MATERIALIZED (SELECT DISTINCT s, p, o, chunk FROM (SELECT s, p, o, chunk FROM pairs WHERE s <> o UNION ALL SELECT x.o, 'lacks', x.root, l.chunk FROM shown x JOIN lone l USING (root)))"""


@query("completed_graph", f"{_SQL} SELECT src, dst, count(*) AS weight FROM (SELECT s AS src, o AS dst FROM fa UNION ALL SELECT s, o FROM hidden) GROUP BY src, dst")
def completed_graph(spark, d):
    """Edges of the graph with the hidden triples (survey 10.12, 12.9)."""
    return completed(spark, d)[0]


@query("completed_triples", f"{_SQL} SELECT s, p, o, chunk FROM hidden")
def completed_triples(spark, d):
    return completed(spark, d)[1]


@query(
    "corruption_views",
    f"""WITH fa AS MATERIALIZED (SELECT l_orderkey AS chunk, 'supplier ' || l_suppkey AS s, 'part ' || l_partkey AS o FROM lineitem),
    m AS MATERIALIZED (SELECT s AS root, o AS node FROM (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY count(*) DESC, o) AS k FROM fa GROUP BY s, o) WHERE k <= {_S.width}),
    e AS MATERIALIZED (SELECT root, node AS src, root AS dst, row_number() OVER (PARTITION BY root ORDER BY md5('42-' || root || '-' || node || '-' || root), node) AS k, count(*) OVER (PARTITION BY root) AS n FROM m),
    g AS (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY md5('42-' || root || '-' || node), node) AS k, count(*) OVER (PARTITION BY root) AS n FROM m),
    d AS (SELECT root, src, dst, count(*) OVER (PARTITION BY root) AS n FROM e ANTI JOIN (SELECT root, node AS src FROM g WHERE k <= greatest(1, round_even(n * 0.08, 0))) x USING (root, src))
    SELECT root, 'full' AS view, 0 AS label, src, dst FROM e UNION ALL SELECT root, 'masked', 1, src, dst FROM e WHERE n > 1 AND k > least(n - 1, greatest(1, round_even(n * 0.2, 0))) UNION ALL SELECT root, 'deleted', 1, src, dst FROM d WHERE n >= 1""",
)
def corruption_views(spark, d):
    """Training views of every supplier's subgraph (survey 11.11)."""
    facts, roots = inputs(spark, d)
    return mining.corruption_views(C.subgraphs(facts, roots, SETTINGS.width), facts.select(F.col("s").alias("src"), F.col("o").alias("dst")))
