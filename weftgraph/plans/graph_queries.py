"""Graph queries over the star schema's facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as fx
from ..operators import graph as G
from ..operators import selection
from ..session import read_table
from .registry import query

FACTS = fx.SQL


def _edges(spark, d):
    return fx.facts(spark, d).groupBy(F.col("s").alias("src"), F.col("o").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


_EDGES = f"{FACTS}, edges AS (SELECT s AS src, o AS dst, count(*)::DOUBLE AS weight FROM facts GROUP BY s, o)"


@query("degree", f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node")
def degree(spark, d):
    return G.degree(_edges(spark, d))


@query("edge_degree", f"WITH {_EDGES}, g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node) SELECT src, dst, a.n + b.n AS degree FROM edges JOIN g a ON src = a.node JOIN g b ON dst = b.node")
def edge_degree(spark, d):
    edges = _edges(spark, d)
    own = G.degree(edges)
    a, b = own.select(F.col("node").alias("src"), F.col("degree").alias("a")), own.select(F.col("node").alias("dst"), F.col("degree").alias("b"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("a") + F.col("b")).alias("degree"))


@query("edge_union", f"WITH {FACTS}, e AS (SELECT s AS src, o AS dst, count(*)::DOUBLE AS weight, 0 AS k FROM facts GROUP BY 1, 2 UNION ALL SELECT DISTINCT 'order ' || chunk, s, 1.0::DOUBLE, 1 FROM facts UNION ALL SELECT DISTINCT 'supplier ' || l_suppkey, 'part ' || l_partkey, 0.5::DOUBLE, 2 FROM lineitem WHERE l_quantity = 50) SELECT src, dst, max_by(weight, k) AS weight FROM e WHERE src <> dst GROUP BY src, dst")
def edge_union(spark, d):
    """Fact, passage and synonym edges; a later producer overwrites."""
    passages = fx.facts(spark, d).select(F.concat(F.lit("order "), "chunk").alias("src"), F.col("s").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    near = read_table(spark, d, "lineitem").where("l_quantity = 50").select(F.concat(F.lit("supplier "), "l_suppkey").alias("src"), F.concat(F.lit("part "), "l_partkey").alias("dst")).distinct().withColumn("weight", F.lit(0.5))
    return G.union_edges(_edges(spark, d), passages, near)


@query("hetero_graph", f"WITH {FACTS} SELECT least(s, o) AS a, greatest(s, o) AS b, 0 AS kind, count(*)::DOUBLE AS weight, least(count(*), 5)::DOUBLE AS walk_weight FROM facts WHERE s <> o GROUP BY 1, 2")
def hetero_graph(spark, d):
    rows = fx.facts(spark, d).where("s <> o").groupBy(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return rows.withColumn("kind", F.lit(0)).withColumn("walk_weight", F.least("weight", F.lit(5.0)))


@query("node_type", f"WITH {FACTS} SELECT DISTINCT n, CASE WHEN starts_with(n, 'entity-') THEN 0 WHEN starts_with(n, 'chunk-') THEN 1 ELSE 2 END AS node_type FROM (SELECT 'entity-' || md5(s) AS n FROM facts UNION ALL SELECT 'chunk-' || md5(chunk::VARCHAR) FROM facts UNION ALL SELECT p FROM facts)")
def node_type(spark, d):
    rows = fx.facts(spark, d).select(F.explode(F.array(F.concat(F.lit("entity-"), F.md5("s")), F.concat(F.lit("chunk-"), F.md5(F.col("chunk").cast("string"))), "p")).alias("n")).distinct()
    return rows.select("n", F.when(F.col("n").startswith("entity-"), 0).when(F.col("n").startswith("chunk-"), 1).otherwise(2).alias("node_type"))


def _ppr_sql(rounds: int) -> str:
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT q, node, sum(x) AS score FROM (SELECT q, dst AS node, 0.5 * score * p AS x FROM r{k - 1} JOIN step ON src = node UNION ALL SELECT q, node, score FROM base) GROUP BY q, node)")
    return f"""WITH {_EDGES}, b AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges), strength AS (SELECT src, sum(weight) AS s FROM b GROUP BY src),
    step AS MATERIALIZED (SELECT src, dst, weight / s AS p FROM b JOIN strength USING (src)),
    seeds AS (SELECT n_regionkey AS q, 'supplier ' || s_suppkey AS node, s_acctbal AS weight FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0),
    r0 AS MATERIALIZED (SELECT q, node, weight / sum(weight) OVER (PARTITION BY q) AS score FROM seeds),
    alone AS (SELECT q, sum(score) AS f FROM r0 WHERE node NOT IN (SELECT src FROM strength) GROUP BY q),
    base AS MATERIALIZED (SELECT r0.q, node, score * 0.5 / (1 - 0.5 * coalesce(f, 0)) AS score FROM r0 LEFT JOIN alone ON alone.q = r0.q), {", ".join(steps)}
    SELECT q, node, round(score, 9) AS score FROM r{rounds}"""


@query("ppr", _ppr_sql(G.SETTLED))
def ppr(spark, d):
    """PageRank from each region's suppliers, all regions in one job."""
    edges = _edges(spark, d)
    homes = read_table(spark, d, "supplier").join(read_table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    reset = homes.select(F.col("n_regionkey").alias("q"), F.concat(F.lit("supplier "), "s_suppkey").alias("node"), F.greatest("s_acctbal", F.lit(0.0)).alias("weight"))
    return G.personalised_pagerank(edges, reset, rounds=G.SETTLED).select("q", "node", F.round("score", 9).alias("score"))


@query(
    "hop_distance",
    f"WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT 'supplier 1' AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM w JOIN b ON src = node WHERE hop < 3) SELECT node, min(hop) AS hop FROM w GROUP BY node",
)
def hop_distance(spark, d):
    return G.hop_distance(_edges(spark, d), spark.range(1).select(F.lit("supplier 1").alias("node")), 3)


@query(
    "bfs_view",
    f"WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT 'supplier 1' AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM w JOIN b ON src = node WHERE hop < 3), l AS (SELECT node, min(hop) AS hop FROM w GROUP BY node), "
    "g AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node), r AS (SELECT node, hop, row_number() OVER (ORDER BY hop, coalesce(d, 0) DESC, node) AS place FROM l LEFT JOIN g USING (node)) "
    "SELECT node, hop, place::INTEGER AS place, (SELECT max(place) FROM r) > 1000 AS is_truncated FROM r WHERE place <= 1000",
)
def bfs_view(spark, d):
    view, cut = G.bfs_view(_edges(spark, d), "supplier 1", 3, 1000)
    return view.withColumn("is_truncated", F.lit(cut))


@query("random_walk_nodes")
def random_walk_nodes(spark, d):
    roots = read_table(spark, d, "supplier").select(F.concat(F.lit("supplier "), "s_suppkey").alias("node"))
    return G.random_walks(_edges(spark, d), roots, 3, 4)


@query("message_passing_sum", f"WITH {_EDGES} SELECT node, round(sum(value), 4) AS value FROM (SELECT dst AS node, weight * s_acctbal AS value FROM edges JOIN supplier ON src = 'supplier ' || s_suppkey UNION ALL SELECT 'supplier ' || s_suppkey, s_acctbal FROM supplier) GROUP BY node")
def message_passing_sum(spark, d):
    state = read_table(spark, d, "supplier").select(F.concat(F.lit("supplier "), "s_suppkey").alias("node"), F.col("s_acctbal").alias("value"))
    return G.message_passing(_edges(spark, d), state).select("node", F.round("value", 4).alias("value"))


_TRIPLES = "t AS (SELECT l_orderkey AS s, 'has-' || l_returnflag AS p, l_partkey AS o FROM lineitem UNION SELECT o_orderkey, 'by-' || o_orderstatus, o_custkey FROM orders)"


@query(
    "relation_graph",
    f"WITH {_TRIPLES}, h AS (SELECT DISTINCT s AS n, p AS r FROM t), l AS (SELECT DISTINCT o AS n, p AS r FROM t) SELECT DISTINCT a.r AS r1, b.r AS r2, 0 AS kind FROM h a JOIN h b USING (n) UNION ALL SELECT DISTINCT a.r, b.r, 1 FROM l a JOIN l b USING (n) UNION ALL SELECT DISTINCT a.r, b.r, 2 FROM h a JOIN l b USING (n) UNION ALL SELECT DISTINCT a.r, b.r, 3 FROM l a JOIN h b USING (n)",
)
def relation_graph(spark, d):
    a = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("s"), F.concat(F.lit("has-"), "l_returnflag").alias("p"), F.col("l_partkey").alias("o"))
    b = read_table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("by-"), "o_orderstatus"), "o_custkey")
    return G.relation_graph(a.union(b))


@query("inverse_edges", f"WITH {FACTS} SELECT s, p, o FROM facts UNION ALL SELECT o, 'inverse_' || p, s FROM facts")
def inverse_edges(spark, d):
    rows = fx.facts(spark, d).select("s", "p", "o")
    return rows.union(rows.select("o", F.concat(F.lit("inverse_"), "p"), "s"))


@query("typed_edges", "SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, l_returnflag AS kind, sum(l_quantity) AS weight FROM lineitem WHERE l_suppkey <> l_partkey AND l_quantity > 0 GROUP BY 1, 2, 3")
def typed_edges(spark, d):
    rows = read_table(spark, d, "lineitem").where("l_suppkey <> l_partkey AND l_quantity > 0")
    return rows.groupBy(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b"), F.col("l_returnflag").alias("kind")).agg(F.sum("l_quantity").alias("weight"))


@query("doc_entity_incidence", f"WITH {FACTS} SELECT entity, count(DISTINCT chunk) AS df FROM (SELECT chunk, s AS entity FROM facts UNION ALL SELECT chunk, o FROM facts) GROUP BY entity")
def doc_entity_incidence(spark, d):
    return fx.facts(spark, d).select("chunk", F.explode(F.array("s", "o")).alias("entity")).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("df"))


@query("logical_query_2i", "SELECT a.l_partkey AS answer FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 1) a JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') b USING (l_partkey)")
def logical_query_2i(spark, d):
    rows = read_table(spark, d, "lineitem")
    return rows.where("l_suppkey = 1").select(F.col("l_partkey").alias("answer")).intersect(rows.where("l_returnflag = 'R'").select("l_partkey"))


@query("logical_query_2u", "SELECT l_partkey AS answer FROM lineitem WHERE l_suppkey = 1 UNION SELECT l_partkey FROM lineitem WHERE l_suppkey = 2")
def logical_query_2u(spark, d):
    rows = read_table(spark, d, "lineitem")
    return rows.where("l_suppkey = 1").select(F.col("l_partkey").alias("answer")).union(rows.where("l_suppkey = 2").select("l_partkey")).distinct()


@query("logical_query_2in", "SELECT DISTINCT l_orderkey AS answer FROM lineitem WHERE l_suppkey = 1 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def logical_query_2in(spark, d):
    rows = read_table(spark, d, "lineitem")
    flagged = rows.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("answer"))
    return rows.where("l_suppkey = 1").select(F.col("l_orderkey").alias("answer")).distinct().join(flagged, "answer", "left_anti")


@query("logical_query_2p", "SELECT DISTINCT c_nationkey AS answer FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_suppkey = 1")
def logical_query_2p(spark, d):
    rows = read_table(spark, d, "lineitem").where("l_suppkey = 1").join(read_table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(read_table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(F.col("c_nationkey").alias("answer")).distinct()


@query("subgraph_filter", "SELECT l_orderkey AS root, count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) AS nodes, count(*) AS fact_edges FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) >= 4")
def subgraph_filter(spark, d):
    rows = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("root")).agg((F.countDistinct("l_partkey") + F.countDistinct("l_suppkey")).alias("nodes"), F.count(F.lit(1)).alias("fact_edges"))
    return rows.where("nodes >= 4")


@query(
    "greedy_selection",
    "WITH RECURSIVE m AS (SELECT l_orderkey AS id, round(avg(l_discount) * 10, 6)::DOUBLE AS score, list(DISTINCT l_partkey) AS members FROM lineitem GROUP BY 1), c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS i FROM m WHERE score >= 0.3), "
    "g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS ids, []::BIGINT[][] AS sets UNION ALL SELECT c.i, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, CASE WHEN ok THEN list_append(sets, members) ELSE sets END FROM (SELECT c.*, g.ids, g.sets, "
    "NOT list_contains(list_transform(g.sets, lambda s: len(list_intersect(s, c.members)) > 0.1 * len(list_distinct(list_concat(s, c.members)))), true) AS ok FROM g JOIN c ON c.i = g.i + 1 WHERE len(g.ids) < 50) c) "
    "SELECT generate_subscripts(ids, 1)::INTEGER AS place, unnest(ids) AS subgraph FROM (SELECT ids FROM g ORDER BY i DESC LIMIT 1)",
)
def greedy_selection(spark, d):
    """Orders as subgraphs of their parts: 50 by falling score, none sharing more than a tenth with a better one."""
    rows = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.avg("l_discount") * 10, 6).cast("double").alias("score"), F.collect_set("l_partkey").alias("members"), F.collect_set("l_suppkey").alias("evidence"))
    return selection.greedy(rows, 0.3, 0.1, 50).select("place", F.col("id").alias("subgraph"))


#: Names of the regions' numbers in Han characters, so that labels are of mixed scripts; fixed values.
HAN = ("阿", "北", "中", "东", "欧")
_HAN = ", ".join(f"'{h}'" for h in HAN)


@query(
    "collated_labels",
    f"WITH l AS (SELECT DISTINCT label FROM (SELECT string_split(text, ' ')[1] AS label FROM documents WHERE text IS NOT NULL UNION ALL SELECT [{_HAN}][n_regionkey % 5 + 1] || n_name FROM nation UNION ALL SELECT n_name FROM nation) WHERE label <> ''), "
    "p AS (SELECT label, row_number() OVER (ORDER BY label COLLATE zh, label) AS n FROM l) SELECT label, ceil(n / 100)::INTEGER AS page FROM p WHERE n <= 300",
)
def collated_labels(spark, d):
    """Three pages of labels in Chinese order, each found from the last label of the one before (survey 6.12)."""
    nations = read_table(spark, d, "nation")
    han = F.element_at(F.array(*[F.lit(h) for h in HAN]), (F.col("n_regionkey") % 5 + 1).cast("int"))
    words = read_table(spark, d, "documents").where("text IS NOT NULL").select(F.element_at(F.split("text", " "), 1).alias("label"))
    labels = words.union(nations.select(F.concat(han, "n_name"))).union(nations.select("n_name")).where("label <> ''")
    out, after = None, None
    for page in (1, 2, 3):
        rows = G.staged(G.collated_page(labels, 100, after), "label-page")
        # a page's last label, in the page's order
        last = rows.orderBy(F.collate("label", "zh").desc(), F.desc("label")).first()
        if last is None:
            break
        after = last[0]
        rows = rows.withColumn("page", F.lit(page))
        out = rows if out is None else out.unionByName(rows)
    return out
