"""Hidden-triple mining and searches over rounds of edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as fx
from ..operators import mining as M
from ..operators import missingness as Q
from ..session import read_table
from .registry import query

FACTS = fx.SQL
_PAIRS = f"{FACTS}, pairs AS (SELECT DISTINCT s AS src, o AS dst FROM facts)"


def _pairs(spark, d):
    return fx.facts(spark, d).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()


@query("graph_snapshot", f"WITH {FACTS}, n AS (SELECT s AS node, 0 AS node_type FROM facts UNION SELECT CASE WHEN chunk % 9 = 0 THEN ' ' ELSE o END, 0 FROM facts UNION SELECT 'chunk-' || chunk, 1 FROM facts) SELECT node, node_type FROM n WHERE trim(node) <> ''")
def graph_snapshot(spark, d):
    """Typed nodes of a graph, without blank ones (survey 11.6)."""
    rows = fx.facts(spark, d)
    o = F.when(F.col("chunk") % 9 == 0, " ").otherwise(F.col("o"))
    nodes, _ = M.snapshot(rows.select(F.col("s").alias("name")).union(rows.select(o)), rows.select(F.col("s").alias("src"), o.alias("dst")), rows.select(F.concat(F.lit("chunk-"), "chunk").alias("chunk")))
    return nodes


@query("graph_snapshot_edges", f"WITH {FACTS}, e AS (SELECT s AS src, CASE chunk % 9 WHEN 0 THEN ' ' WHEN 1 THEN s ELSE o END AS dst, chunk FROM facts) SELECT src, dst, count(*) AS n FROM e WHERE trim(dst) <> '' AND src <> dst GROUP BY src, dst")
def graph_snapshot_edges(spark, d):
    """Edges of a graph, without self loops and blank ends (survey 11.6)."""
    rows = fx.facts(spark, d)
    at = F.col("chunk") % 9
    edges = rows.select(F.col("s").alias("src"), F.when(at == 0, " ").when(at == 1, F.col("s")).otherwise(F.col("o")).alias("dst"))
    _, kept = M.snapshot(rows.select(F.col("s").alias("name")), edges, rows.select(F.col("chunk").cast("string").alias("chunk")))
    return kept.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(
    "equivalent_edges",
    "WITH s AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS score FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2), n AS (SELECT *, score / max(score) OVER (PARTITION BY src) AS norm FROM s), "
    "k AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM n WHERE norm >= 0.8) WHERE r <= 6), b AS (SELECT l_suppkey AS src, l_partkey AS dst, max(l_returnflag) AS relation FROM lineitem GROUP BY 1, 2) "
    "SELECT src, dst, CASE WHEN (src, dst) IN (SELECT (src, dst) FROM k) THEN 'equivalent' ELSE relation END AS relation FROM b",
)
def equivalent_edges(spark, d):
    """Like neighbours become equivalent; the relation of such a pair is replaced (survey 11.4)."""
    rows = read_table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("score"), F.max("l_returnflag").alias("relation"))
    return M.equivalent_edges(rows, rows, 0.8, 5)


@query(
    "entity_hop_distance",
    f"WITH {FACTS}, e AS (SELECT DISTINCT s AS n, 'chunk-' || chunk AS c FROM facts UNION SELECT o, 'chunk-' || chunk FROM facts), r AS (SELECT 'supplier 1' AS node, 0 AS hop), "
    "c0 AS (SELECT DISTINCT c FROM e WHERE n = 'supplier 1'), n1 AS (SELECT DISTINCT n FROM e JOIN c0 USING (c) WHERE n <> 'supplier 1'), c1 AS (SELECT DISTINCT c FROM e JOIN n1 USING (n) WHERE c NOT IN (SELECT c FROM c0)) "
    "SELECT node, hop FROM r UNION ALL SELECT c, 0 FROM c0 UNION ALL SELECT n, 1 FROM n1 UNION ALL SELECT c, 1 FROM c1",
)
def entity_hop_distance(spark, d):
    """Distances in entities entered; chunks on the way cost nothing (survey 11.9)."""
    rows = fx.facts(spark, d).select(F.concat(F.lit("chunk-"), "chunk").alias("dst"), F.explode(F.array("s", "o")).alias("src"))
    nodes = rows.select(F.col("src").alias("node"), F.lit(0).alias("node_type")).union(rows.select("dst", F.lit(1))).distinct()
    return M.entity_hops(rows, spark.createDataFrame([("supplier 1",)], "node string"), nodes, 1)


@query("call_budget", f"WITH {FACTS}, n AS (SELECT count(DISTINCT chunk) AS chunks, count(DISTINCT s) AS entities FROM facts) SELECT raw::DOUBLE AS raw, greatest(1, CASE WHEN raw < 1 THEN floor(raw * chunks * 2) ELSE floor(raw) END)::BIGINT AS calls, greatest(1, CASE WHEN raw < 1 THEN floor(raw * entities) ELSE floor(raw) END)::BIGINT AS roots FROM n, (SELECT unnest([0.25, 0.00001, 3.0, 7.5]) AS raw)")
def call_budget(spark, d):
    """Budgets as shares of chunks and entities, or as numbers (survey 11.16)."""
    rows = fx.facts(spark, d)
    chunks, entities = rows.agg(F.countDistinct("chunk"), F.countDistinct("s")).first()
    return spark.createDataFrame([(raw, M.budget(raw, 2 * chunks), M.budget(raw, entities)) for raw in (0.25, 0.00001, 3.0, 7.5)], "raw double, calls bigint, roots bigint")


@query("missingness_score", f"WITH {_PAIRS} SELECT src AS root, count(*) AS edges, round(1 / (1 + exp(-(-2.0 + 0.05 * count(*)))), 9) AS score FROM pairs GROUP BY src")
def missingness_score(spark, d):
    """The default scorer over a subgraph's features (survey 11.12)."""
    features = _pairs(spark, d).groupBy(F.col("src").alias("root")).agg(F.count(F.lit(1)).alias("edges"))
    return M.missingness(features, {"edges": 0.05}, -2.0).withColumn("score", F.round("score", 9))


def model_input(spark, d):
    """Orders as subgraphs: suppliers (kind 0) and parts (kind 1) with their numbers in the order, edges both ways by return flag."""
    rows = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph"), F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("p"), "l_quantity", "l_discount", (F.locate("R", "l_returnflag") > 0).cast("int").alias("rel"))
    ends = rows.select("graph", "l_quantity", "l_discount", F.explode(F.array(F.struct(F.col("s").alias("node"), F.lit(0).alias("kind")), F.struct(F.col("p").alias("node"), F.lit(1).alias("kind")))).alias("e"))
    nodes = ends.groupBy("graph", "e.node", "e.kind").agg(F.array((F.avg("l_quantity") / 50).cast("double"), F.sum("l_discount").cast("double"), F.count(F.lit(1)).cast("double")).alias("x"))
    edges = rows.select("graph", F.col("s").alias("src"), "rel", F.col("p").alias("dst")).union(rows.select("graph", "p", F.col("rel") + 2, "s"))
    return nodes, edges


@query("missingness_forward")
def missingness_forward(spark, d):
    """Probability that an order lacks a fact, by two relational convolutions of weights from outside (survey 11.12); a test holds it against arrays."""
    return Q.forward(*model_input(spark, d), Q.random_model(3, 16, 2, 4))


@query("evidence_batches")
def evidence_batches(spark, d):
    """Pairs of an order's parts in batches that share chunks (survey 11.19); each choice depends on those before."""
    rows = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("root"), F.col("l_partkey").alias("pair"), "l_orderkey").distinct()
    pairs = rows.groupBy("root", "pair").agg(F.slice(F.array_sort(F.collect_set("l_orderkey")), 1, 3).alias("chunks"))
    return M.evidence_batches(pairs.withColumn("seq", F.col("pair")))


@query("epoch_masks", "WITH p AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem), r AS (SELECT epoch, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY epoch ORDER BY md5(epoch || '-' || l_suppkey || '-' || l_returnflag), l_suppkey, l_returnflag) AS n FROM p, (SELECT unnest(range(3)) AS epoch)) SELECT epoch, l_suppkey, l_returnflag FROM r WHERE n <= greatest(1, floor((SELECT count(*) FROM p) * 0.15))")
def epoch_masks(spark, d):
    """Pairs held out in each epoch (survey 11.36)."""
    return M.epoch_masks(read_table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct(), 3)


_LINKS = "new AS (SELECT DISTINCT 'n' || c_nationkey AS src, 'n' || (c_custkey % 25) AS tgt FROM customer WHERE c_acctbal < 2000), old AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS tgt FROM (SELECT 'n' || c_nationkey AS a, 'n' || (c_custkey % 25) AS b FROM customer WHERE c_acctbal > 8000) WHERE a <> b)"


def _injected(spark, d):
    rows = read_table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("n"), (F.col("c_custkey") % 25).cast("string")).alias("tgt"), "c_acctbal", "c_custkey")
    old = rows.where("c_acctbal > 8000 AND src <> tgt").select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct()
    old = old.select("*", F.lit(1.0).alias("weight"), F.lit("old").alias("keywords"), F.lit("old").alias("description"), F.lit("old").alias("source_id"), F.lit("old").alias("file_path"))
    new = rows.where("c_acctbal < 2000").select("src", "tgt").distinct()
    new = new.select("*", F.lit(1.0).alias("weight"), F.lit("hidden").alias("keywords"), F.concat("src", F.lit(" near "), "tgt").alias("description"), F.lit("mined").alias("source"), F.lit("hidden").alias("file_path"), F.lit(0).alias("ts"), F.lit(0).alias("seq"))
    nodes = spark.range(20).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("nation").alias("entity_type"))
    return M.inject(nodes, old, new)


@query("inject_report", f"WITH {_LINKS}, p AS (SELECT DISTINCT least(src, tgt) AS src, greatest(src, tgt) AS tgt FROM new) SELECT src, tgt, CASE WHEN src = tgt THEN 'self loop' WHEN (src, tgt) IN (SELECT (src, tgt) FROM old) THEN 'merged' ELSE 'new' END AS status FROM p")
def inject_report(spark, d):
    """What became of each completed relation (survey 11.18)."""
    return _injected(spark, d)[2]


@query("inject_edges", f"WITH {_LINKS}, n AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, count(*) AS c FROM new WHERE src <> tgt GROUP BY 1, 2) SELECT coalesce(n.src, old.src) AS src, coalesce(n.tgt, old.tgt) AS tgt, (coalesce(c, 0) + CASE WHEN old.src IS NULL THEN 0 ELSE 1 END)::DOUBLE AS weight, CASE WHEN n.src IS NULL THEN 'old' WHEN old.src IS NULL THEN 'hidden' ELSE 'hidden,old' END AS keywords, CASE WHEN n.src IS NULL THEN 'old' WHEN old.src IS NULL THEN 'mined' ELSE 'old<SEP>mined' END AS source_id FROM n FULL JOIN old ON n.src = old.src AND n.tgt = old.tgt")
def inject_edges(spark, d):
    """Edges after injection: stored ones, merged ones, new ones (survey 11.18)."""
    return _injected(spark, d)[1].select("src", "tgt", "weight", "keywords", "source_id")


@query("inject_nodes", f"WITH {_LINKS}, e AS (SELECT src AS name FROM new WHERE src <> tgt UNION SELECT tgt FROM new WHERE src <> tgt) SELECT 'n' || i AS name, 'nation' AS entity_type FROM range(20) t(i) UNION ALL SELECT name, 'UNKNOWN' FROM e WHERE name NOT IN (SELECT 'n' || i FROM range(20) t(i))")
def inject_nodes(spark, d):
    """Nodes after injection, unknown ends included (survey 11.18)."""
    return _injected(spark, d)[0]


@query(
    "augmented_documents",
    "WITH t AS (SELECT l_orderkey AS chunk, list(DISTINCT 's' || l_suppkey || '|has|p' || l_partkey) AS old FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), h AS (SELECT l_orderkey AS chunk, list(DISTINCT 's' || l_suppkey || '|has|p' || l_partkey) AS new FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3 GROUP BY 1), "
    "b AS (SELECT t.chunk, list_distinct(list_concat(old, coalesce(new, []))) AS triples, list_distinct(list_concat(list_transform(old, lambda x: split_part(x, '|', 1)), list_transform(coalesce(new, []), lambda x: split_part(x, '|', 1)), list_transform(coalesce(new, []), lambda x: split_part(x, '|', 3)))) AS entities FROM t LEFT JOIN h USING (chunk)) "
    "SELECT chunk, array_to_string(list_sort(triples), ',') AS triples, array_to_string(list_sort(entities), ',') AS entities FROM b",
)
def augmented_documents(spark, d):
    """Hidden triples put into the documents that they cite (survey 7.4)."""
    rows = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), "l_linenumber", F.array(F.concat(F.lit("s"), "l_suppkey"), F.lit("has"), F.concat(F.lit("p"), "l_partkey")).alias("triple"))
    docs = rows.where("l_linenumber <= 2").groupBy("chunk").agg(F.collect_set("triple").alias("triples"), F.collect_set(F.col("triple")[0]).alias("entities"))
    out = M.augmented_documents(docs, rows.where("l_linenumber BETWEEN 2 AND 3").select("chunk", "triple"))
    return out.select("chunk", F.array_join(F.array_sort(F.transform("triples", lambda t: F.array_join(t, "|"))), ",").alias("triples"), F.array_join(F.array_sort("entities"), ",").alias("entities"))


@query("relation_file_path", f"WITH {FACTS}, c AS (SELECT doc_id AS chunk, source AS file_path FROM documents), o AS (SELECT s, file_path, min(f.chunk) AS a FROM facts f JOIN c ON c.chunk = f.chunk WHERE file_path <> '' GROUP BY s, file_path), l AS (SELECT s, string_agg(file_path, '<SEP>' ORDER BY a, file_path) AS p FROM o GROUP BY s) SELECT DISTINCT facts.s AS relation, coalesce(l.p, 'hidden') AS file_path FROM facts LEFT JOIN l USING (s)")
def relation_file_path(spark, d):
    """Paths of the documents that speak of a relation (survey 2.21)."""
    rows = fx.facts(spark, d).select(F.col("s").alias("relation"), F.col("chunk").alias("at"), "chunk")
    return M.relation_paths(rows, read_table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), F.col("source").alias("file_path")))


@query("mining_cache_match", "WITH n AS (SELECT count(DISTINCT l_suppkey) AS nodes, count(*) AS edges FROM lineitem) SELECT k, CASE k WHEN 'same' THEN true ELSE false END AS fits, sha256('{\"hops\":2,\"seed\":' || CASE k WHEN 'seed' THEN 43 ELSE 42 END || '}') AS signature FROM n, (SELECT unnest(['same', 'seed', 'edges']) AS k)")
def mining_cache_match(spark, d):
    """Cached results are used for the same configuration and graph only (survey 12.10)."""
    nodes, edges = read_table(spark, d, "lineitem").agg(F.countDistinct("l_suppkey"), F.count(F.lit(1))).first()
    config = {"seed": 42, "hops": 2}
    now = {"same": (config, edges), "seed": ({"hops": 2, "seed": 43}, edges), "edges": (config, edges + 1)}
    summary = {"signature": M.signature(config), "nodes": nodes, "edges": edges}
    return spark.createDataFrame([(k, M.cache_fits(summary, c, nodes, e), M.signature(c)) for k, (c, e) in now.items()], "k string, fits boolean, signature string")


_ROADS = "e AS (SELECT c_nationkey AS src, c_custkey % 25 AS dst, min(round(c_acctbal + 1000)) AS weight FROM customer GROUP BY 1, 2)"


def _roads(spark, d):
    return read_table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("src"), (F.col("c_custkey") % 25).alias("dst")).agg(F.min(F.round(F.col("c_acctbal") + 1000)).alias("weight"))


def _relaxed(rounds: int) -> str:
    steps = ["r0 AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS cost)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS (SELECT node, min(cost) AS cost FROM (SELECT * FROM r{k - 1} UNION ALL SELECT dst, cost + weight FROM e JOIN r{k - 1} ON src = node) GROUP BY node)")
    return f"WITH {_ROADS}, {', '.join(steps)} SELECT node, cost FROM r{rounds}"


@query("bellman_ford", _relaxed(3))
def bellman_ford(spark, d):
    """Least costs over three rounds from a node (survey 11.26)."""
    return M.bellman_ford(_roads(spark, d), spark.range(1).select(F.col("id").alias("node"), F.lit(0.0).alias("cost")), 3)


def _beam_sql(layers: int, beam: int, most: int) -> str:
    steps = ["t AS (SELECT i::BIGINT AS target FROM range(20, 25) x(i))", "k0 AS (SELECT 0::BIGINT AS node, [0::BIGINT] AS path, 0.0::DOUBLE AS s)"]
    for k in range(1, layers + 1):
        steps.append(f"k{k} AS (SELECT node, path, s FROM (SELECT dst AS node, list_append(path, dst) AS path, s + weight AS s, row_number() OVER (PARTITION BY dst ORDER BY round(s + weight, 9) DESC, list_append(path, dst)) AS n FROM k{k - 1} JOIN e ON src = node WHERE node NOT IN (SELECT target FROM t)) WHERE n <= {beam})")
    found = " UNION ALL ".join(f"SELECT node AS target, path, round(s / {k}, 9) AS score FROM k{k} WHERE node IN (SELECT target FROM t)" for k in range(1, layers + 1))
    return f"WITH {_ROADS}, {', '.join(steps)}, f AS ({found}), o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, path) AS place FROM f) SELECT target, place::INTEGER AS place, array_to_string(path, '>') AS path, score FROM o WHERE place <= {most}"


@query("path_beam", _beam_sql(3, 4, 3))
def path_beam(spark, d):
    """The best three paths to each target over three layers of beams (survey 11.27, 11.35)."""
    targets = spark.range(20, 25).withColumnRenamed("id", "node")
    start = F.lit(0).cast("long")
    out = M.path_beams(_roads(spark, d), start, targets, 3, 4, 3)
    return out.select("target", "place", F.array_join("path", ">").alias("path"), "score")


_RELATED = "r AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'made by' AS relation, 's' || l_suppkey AS dst FROM lineitem UNION SELECT 's' || l_suppkey, 'flag ' || l_returnflag, 'p' || l_partkey FROM lineitem UNION SELECT 'c' || o_custkey, 'placed', 'o' || o_orderkey FROM orders)"


def _related(spark, d):
    lines, orders = read_table(spark, d, "lineitem"), read_table(spark, d, "orders")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    rows = lines.select(name("o", "l_orderkey").alias("src"), F.lit("made by").alias("relation"), name("s", "l_suppkey").alias("dst"))
    rows = rows.union(lines.select(name("s", "l_suppkey"), F.concat(F.lit("flag "), "l_returnflag"), name("p", "l_partkey")))
    return rows.union(orders.select(name("c", "o_custkey"), F.lit("placed"), name("o", "o_orderkey"))).distinct()


def _step(relation: str, inner: str) -> str:
    return f"SELECT DISTINCT dst AS node FROM r WHERE relation = '{relation}' AND src IN ({inner})"


_ORDERS_OF = lambda c: _step("placed", f"SELECT 'c{c}' AS node")


@query("logical_query_3p", f"WITH {_RELATED} {_step('flag R', _step('made by', _ORDERS_OF(1)))}")
def logical_query_3p(spark, d):
    """Three steps in a row (survey 11.30)."""
    return M.logical_answers(_related(spark, d), ("step", "flag R", ("step", "made by", ("step", "placed", ("node", "c1")))))


@query("logical_query_up", f"WITH {_RELATED} {_step('made by', _ORDERS_OF(1) + ' UNION ' + _ORDERS_OF(2))}")
def logical_query_up(spark, d):
    """A step from a union (survey 11.30)."""
    placed = lambda c: ("step", "placed", ("node", c))
    return M.logical_answers(_related(spark, d), ("step", "made by", ("or", placed("c1"), placed("c2"))))


@query("logical_query_pni", f"WITH {_RELATED} SELECT node FROM ({_step('flag A', _step('made by', _ORDERS_OF(1)))}) WHERE node NOT IN ({_step('flag R', _step('made by', _ORDERS_OF(2)))}) AND node IN ({_step('flag N', _step('made by', _ORDERS_OF(1)))})")
def logical_query_pni(spark, d):
    """Answers of two queries that a third does not have (survey 11.30)."""
    made = lambda c: ("step", "made by", ("step", "placed", ("node", c)))
    return M.logical_answers(_related(spark, d), ("and", ("but", ("step", "flag A", made("c1")), ("step", "flag R", made("c2"))), ("step", "flag N", made("c1"))))


@query(
    "deletable_candidates",
    f"WITH {FACTS}, m AS (SELECT 'supplier ' || s_suppkey AS node FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'part ' || p_partkey FROM part WHERE p_size > 45 UNION ALL SELECT 'chunk-' || o_orderkey FROM orders WHERE o_orderkey < 50), i AS (SELECT s, o FROM facts WHERE s IN (SELECT node FROM m) AND o IN (SELECT node FROM m)) "
    "SELECT node FROM m WHERE node <> 'supplier 1' AND NOT starts_with(node, 'chunk-') AND node IN (SELECT s FROM i UNION SELECT o FROM i)",
)
def deletable_candidates(spark, d):
    """Entities of a subgraph that may be hidden (survey 11.34)."""
    own = lambda kind, name, key, where: read_table(spark, d, kind).where(where).select(F.concat(F.lit(name), key).alias("node"))
    members = own("supplier", "supplier ", "s_suppkey", "s_acctbal > 0").union(own("part", "part ", "p_partkey", "p_size > 45")).union(own("orders", "chunk-", "o_orderkey", "o_orderkey < 50"))
    nodes = members.select("node", F.when(F.col("node").startswith("chunk-"), 1).otherwise(0).alias("node_type"))
    return M.deletable(members, "supplier 1", _pairs(spark, d), nodes)


@query(
    "edge_type",
    "WITH e AS (SELECT DISTINCT 'entity-' || l_suppkey AS src, CASE WHEN l_linenumber = 1 THEN 'chunk-' WHEN l_linenumber = 2 THEN 'other-' ELSE 'entity-' END || l_partkey AS dst, l_discount * 20 AS w FROM lineitem) SELECT src, dst, w AS weight, CASE WHEN starts_with(dst, 'chunk-') THEN 2 WHEN starts_with(dst, 'other-') THEN NULL WHEN w >= 1 THEN 0 WHEN w <> floor(w) THEN 1 END AS edge_type FROM e",
)
def edge_type(spark, d):
    """Edges typed by their ends and weight (survey 2.9)."""
    kind = F.when(F.col("l_linenumber") == 1, "chunk-").when(F.col("l_linenumber") == 2, "other-").otherwise("entity-")
    rows = read_table(spark, d, "lineitem").select(F.concat(F.lit("entity-"), "l_suppkey").alias("src"), F.concat(kind, F.col("l_partkey").cast("string")).alias("dst"), (F.col("l_discount") * 20).alias("weight")).distinct()
    return rows.withColumn("edge_type", M.edge_kind(F.col("src"), F.col("dst"), F.col("weight")))


@query("segment_sum_mean", "SELECT l_orderkey AS segment, sum(l_quantity) AS total, round(avg(l_quantity), 9) AS mean FROM lineitem GROUP BY 1")
def segment_sum_mean(spark, d):
    """Sums and means of segments (survey 4.29)."""
    by = dict(M.segments(read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("segment"), F.col("l_quantity").alias("value"))))
    return by["sum"].withColumnRenamed("value", "total").join(by["mean"].withColumnRenamed("value", "mean"), "segment").withColumn("mean", F.round("mean", 9))
