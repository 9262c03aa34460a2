"""Windows, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import facts as fx
from ..operators import ranking as R
from ..operators import vector
from ..session import read_table
from .registry import query

FACTS = fx.SQL


@query("fact_rank", "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5")
def fact_rank(spark, d):
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), F.desc("event_id"))
    return read_table(spark, d, "events").select("user_id", "event_id", F.row_number().over(order).alias("rank")).where("rank <= 5")


@query("min_max_ones", "SELECT event_id, round(CASE WHEN h = l THEN 1.0 ELSE (value - l) / (h - l) END, 9) AS score FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS l, max(value) OVER (PARTITION BY user_id) AS h FROM events)")
def min_max_ones(spark, d):
    return read_table(spark, d, "events").select("event_id", F.round(R.min_max(F.col("value"), Window.partitionBy("user_id"), 1.0), 9).alias("score"))


@query("min_max_zeros", "SELECT event_id, round(CASE WHEN h = l THEN 0.0 ELSE (value - l) / (h - l) END, 9) AS score FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS l, max(value) OVER (PARTITION BY user_id) AS h FROM events)")
def min_max_zeros(spark, d):
    return read_table(spark, d, "events").select("event_id", F.round(R.min_max(F.col("value"), Window.partitionBy("user_id"), 0.0), 9).alias("score"))


@query("relative_score", "SELECT event_id, round(value / max(value) OVER (PARTITION BY user_id), 9) AS norm_score FROM events WHERE value > 0")
def relative_score(spark, d):
    best = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return read_table(spark, d, "events").where("value > 0").select("event_id", F.round(F.col("value") / F.first("value").over(best), 9).alias("norm_score"))


@query("dpr_rank", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events")
def dpr_rank(spark, d):
    return read_table(spark, d, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"))


_ROBIN = "SELECT user_id, props AS key, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS pos FROM events"


@query(
    "round_robin",
    f"WITH s AS ({_ROBIN}), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY pos, event_type) AS n FROM s) SELECT user_id, key, event_type, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos, event_type, key) AS place FROM f WHERE n = 1",
)
def round_robin(spark, d):
    own = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    rows = read_table(spark, d, "events").select("user_id", F.col("props").alias("key"), "event_type", F.row_number().over(own).alias("pos"))
    return R.round_robin(rows, ["user_id"], "key", "pos", "event_type")


@query("token_budget", "SELECT conv_id, turn, spent FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM conversations) WHERE spent <= 2000")
def token_budget(spark, d):
    rows = read_table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("tokens"))
    return R.within_budget(rows, ["conv_id"], ["turn"], "tokens", 2000).select("conv_id", "turn", "spent")


_POLL = "SELECT o_custkey AS q, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS item, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS pos, o_orderkey FROM orders"


@query(
    "weighted_polling",
    f"""WITH r AS ({_POLL}), i AS (SELECT q, item, count(*) AS have, max(item) OVER (PARTITION BY q) + 1 AS n FROM r GROUP BY q, item),
    u AS (SELECT q, item, have, CASE WHEN n = 1 THEN 5 ELSE round_even(5 - item::DOUBLE / (n - 1) * 4, 0)::INTEGER END AS quota FROM i),
    l AS (SELECT q, sum(greatest(0, quota - have)) AS spare FROM u GROUP BY q),
    o AS (SELECT r.*, row_number() OVER (PARTITION BY q ORDER BY item, pos) AS n FROM r JOIN u USING (q, item) WHERE pos > quota)
    SELECT q, item, pos, o_orderkey, 1 AS round FROM r JOIN u USING (q, item) WHERE pos <= quota
    UNION ALL SELECT q, item, pos, o_orderkey, 2 FROM o JOIN l USING (q) WHERE n <= spare""",
)
def weighted_polling(spark, d):
    rows = read_table(spark, d, "orders").select(F.col("o_custkey").alias("q"), (F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")) - 1).alias("item"), F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")).alias("pos"), "o_orderkey")
    return R.weighted_polling(rows, "q", "item", "pos", 5, 1).select("q", "item", "pos", "o_orderkey", "round")


@query("filtered_rank", "SELECT event_id, 1 + (SELECT count(*) FROM events n WHERE n.user_id = e.user_id AND n.event_type <> e.event_type AND n.value >= e.value) AS rank FROM events e WHERE event_type = 'purchase'")
def filtered_rank(spark, d):
    """Pessimistic rank of each positive among the negatives of its query."""
    rows = read_table(spark, d, "events").select("event_id", "user_id", "value", (F.col("event_type") == "purchase").alias("positive"))
    # within a query by falling value, negatives of equal value before the positive
    upto = Window.partitionBy("user_id").orderBy(F.desc("value"), "positive").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("rank", 1 + F.sum(F.when(F.col("positive"), 0).otherwise(1)).over(upto))
    return ranked.where("positive").select("event_id", "rank")


@query("multi_answer_rank", "SELECT event_id, (g - a + 1)::BIGINT AS rank FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS g, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS a FROM events) WHERE event_type = 'purchase'")
def multi_answer_rank(spark, d):
    order = [F.desc("value"), "event_id"]
    rows = read_table(spark, d, "events").select("event_id", "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(*order)) + 1).cast("long").alias("rank"))
    return rows.where("event_type = 'purchase'").select("event_id", "rank")


@query("spearman", "SELECT l_returnflag, round(corr(a, b), 6) AS rho FROM (SELECT l_returnflag, avg(x) OVER (PARTITION BY l_returnflag, l_quantity) AS a, avg(y) OVER (PARTITION BY l_returnflag, l_extendedprice) AS b FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS y FROM lineitem)) GROUP BY l_returnflag")
def spearman(spark, d):
    rows = read_table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    for c, place in (("l_quantity", "a"), ("l_extendedprice", "b")):
        ranks = R.mean_places(rows, "l_returnflag", c, place).select(F.col("l_returnflag").alias("f"), F.col(c).alias("c"), place)
        rows = rows.join(ranks, F.col("l_returnflag").eqNullSafe(F.col("f")) & F.col(c).eqNullSafe(F.col("c"))).drop("f", "c")
    return rows.groupBy("l_returnflag").agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query("auroc", "WITH r AS (SELECT user_id, event_type = 'purchase' AS p, rank() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id, value) AS t FROM events), s AS (SELECT user_id, sum(CASE WHEN p THEN r + (t - 1) / 2.0 END) AS w, count(*) FILTER (WHERE p) AS n, count(*) FILTER (WHERE NOT p) AS m FROM r GROUP BY user_id) SELECT user_id, round((w - n * (n + 1) / 2.0) / (n * m), 6) AS auroc FROM s WHERE n > 0 AND m > 0")
def auroc(spark, d):
    own = Window.partitionBy("user_id")
    rows = read_table(spark, d, "events").select("user_id", (F.col("event_type") == "purchase").alias("p"), F.rank().over(own.orderBy("value")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("user_id", "value")).alias("t"))
    s = rows.groupBy("user_id").agg(F.sum(F.when(F.col("p"), F.col("r") + (F.col("t") - 1) / 2.0)).alias("w"), F.count_if("p").alias("n"), F.count_if(~F.col("p")).alias("m")).where("n > 0 AND m > 0")
    return s.select("user_id", F.round((F.col("w") - F.col("n") * (F.col("n") + 1) / 2.0) / (F.col("n") * F.col("m")), 6).alias("auroc"))


@query("interval_union", "WITH p AS (SELECT DISTINCT user_id, unnest(range(event_id, event_id + 50)) AS x FROM events) SELECT user_id, count(*) AS covered FROM p GROUP BY user_id")
def interval_union(spark, d):
    rows = read_table(spark, d, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 50).alias("end"))
    return R.covered(rows, ["user_id"], "start", "end")


@query("segment_extend", "SELECT conv_id, array_to_string(list(role ORDER BY turn) || ['end'], ',') AS roles, count(*) + 1 AS size FROM conversations GROUP BY conv_id")
def segment_extend(spark, d):
    rows = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"), F.count(F.lit(1)).alias("n"))
    return rows.select("conv_id", F.array_join(F.concat(F.transform("x", lambda s: s["role"]), F.array(F.lit("end"))), ",").alias("roles"), (F.col("n") + 1).alias("size"))


@query("vector_topk", "SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score, row_number() OVER (ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank FROM (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) a, embeddings b WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.2 ORDER BY rank LIMIT 40")
def vector_topk(spark, d):
    rows = read_table(spark, d, "embeddings")
    one = rows.orderBy("vec_id").select("embedding").first()[0]
    return vector.top_k(rows, one, 40, 0.2)


@query("vector_topk_batch", "WITH q AS (SELECT label, min_by(embedding, vec_id) AS e, min(vec_id) AS i FROM embeddings GROUP BY label), p AS (SELECT i AS query_id, vec_id AS key_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 9) AS score FROM q, embeddings) SELECT query_id, key_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS rank FROM p WHERE score >= 0.2) WHERE rank <= 40")
def vector_topk_batch(spark, d):
    rows = read_table(spark, d, "embeddings")
    some = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))
    return vector.knn(some.select("vec_id", "embedding"), rows.select("vec_id", "embedding"), 40, 0.2).withColumn("score", F.round("score", 6))


@query("popular_labels", f"WITH {FACTS}, n AS (SELECT s AS label FROM facts UNION ALL SELECT o FROM facts) SELECT label, count(*) AS degree FROM n GROUP BY label ORDER BY degree DESC, label LIMIT 300")
def popular_labels(spark, d):
    ends = fx.facts(spark, d).select(F.explode(F.array("s", "o")).alias("label"))
    return ends.groupBy("label").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "label").limit(300)


@query(
    "label_search",
    "SELECT label, CASE WHEN l = 'part 12' THEN 1000 WHEN starts_with(l, 'part 12') THEN 500 ELSE 100 - length(label) + CASE WHEN contains(l, ' part 12') OR contains(l, '_part 12') THEN 50 ELSE 0 END END AS score FROM (SELECT 'part ' || p_partkey AS label, lower('part ' || p_partkey) AS l FROM part UNION ALL SELECT 'a part ' || p_partkey, lower('a part ' || p_partkey) FROM part) WHERE contains(l, 'part 12') ORDER BY score DESC, label LIMIT 50",
)
def label_search(spark, d):
    from ..operators import graph

    rows = read_table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("part "), "p_partkey"), F.concat(F.lit("a part "), "p_partkey"))).alias("label"))
    return graph.label_search(rows, "part 12", 50)


@query("all_labels", f"WITH {FACTS} SELECT DISTINCT label FROM (SELECT s AS label FROM facts UNION ALL SELECT o FROM facts)")
def all_labels(spark, d):
    return fx.facts(spark, d).select(F.explode(F.array("s", "o")).alias("label")).distinct().orderBy("label")


@query("paginated_status", "SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def paginated_status(spark, d):
    rows = read_table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50).crossJoin(total)


@query("norm_score_topk", "WITH m AS (SELECT *, min(value) OVER (PARTITION BY user_id) AS l, max(value) OVER (PARTITION BY user_id) AS h, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) SELECT user_id, event_id, value, round(CASE WHEN h = l THEN 0.0 ELSE (value - l) / (h - l) END, 9) AS norm_score, rank FROM m WHERE rank <= 3")
def norm_score_topk(spark, d):
    own = Window.partitionBy("user_id")
    rows = read_table(spark, d, "events").select("user_id", "event_id", "value", F.round(R.min_max(F.col("value"), own, 0.0), 9).alias("norm_score"), F.row_number().over(own.orderBy(F.desc("value"), "event_id")).alias("rank"))
    return rows.where("rank <= 3")


@query("link_topk_weights", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 2 THEN value ELSE 0.0 END AS weight FROM events")
def link_topk_weights(spark, d):
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return read_table(spark, d, "events").select("event_id", F.when(F.row_number().over(order) <= 2, F.col("value")).otherwise(0.0).alias("weight"))


@query("merged_topk", "SELECT event_type, title, norm_score FROM (SELECT event_type, props AS title, max(value) AS norm_score FROM events GROUP BY event_type, props) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY norm_score DESC, title) <= 10")
def merged_topk(spark, d):
    best = read_table(spark, d, "events").groupBy("event_type", F.col("props").alias("title")).agg(F.max("value").alias("norm_score"))
    order = Window.partitionBy("event_type").orderBy(F.desc("norm_score"), "title")
    return best.withColumn("n", F.row_number().over(order)).where("n <= 10").drop("n")


@query("reference_list", "WITH c AS (SELECT source, count(*) AS n, min(doc_id) AS f FROM documents WHERE source <> '' GROUP BY source), r AS (SELECT source, row_number() OVER (ORDER BY n DESC, f) AS reference_id FROM c) SELECT d.doc_id, coalesce(reference_id::VARCHAR, '') AS reference_id FROM documents d LEFT JOIN r USING (source)")
def reference_list(spark, d):
    from ..operators import retrieve

    rows = read_table(spark, d, "documents").select("doc_id", F.col("source").alias("file_path"), F.col("doc_id").alias("pos"))
    return retrieve.with_references(rows).select("doc_id", "reference_id")


@query("node_split", "SELECT p_partkey, CASE WHEN substr(md5('split-42-' || p_partkey), 1, 2) < 'cc' THEN 'train' ELSE 'test' END AS side FROM part")
def node_split(spark, d):
    """A seeded split by hash, the same whatever the partitioning (survey 6.16)."""
    side = F.substring(F.md5(F.concat(F.lit("split-42-"), "p_partkey")), 1, 2) < "cc"
    return read_table(spark, d, "part").select("p_partkey", F.when(side, "train").otherwise("test").alias("side"))


@query(
    "seeded_negatives",
    "WITH e AS (SELECT DISTINCT l_suppkey AS h, l_partkey AS t FROM lineitem), s AS (SELECT DISTINCT l_suppkey AS h FROM lineitem), n AS (SELECT count(*) AS n FROM part), "
    "c AS (SELECT h, k, ('0x' || substr(md5('neg-' || h || '-' || k), 1, 8))::BIGINT % n AS t FROM s, (SELECT unnest(range(8)) AS k), n) SELECT h, min(k) AS k, t FROM c WHERE (h, t) NOT IN (SELECT (h, t) FROM e) GROUP BY h, t",
)
def seeded_negatives(spark, d):
    """Tails drawn by hash for each head, without those that are true (survey 6.16)."""
    edges = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("h"), F.col("l_partkey").alias("t")).distinct()
    n = read_table(spark, d, "part").count()
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit("neg-"), "h", F.lit("-"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long") % n
    rows = edges.select("h").distinct().select("h", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")).alias("k")).withColumn("t", drawn)
    return rows.join(edges, ["h", "t"], "left_anti").groupBy("h", "t").agg(F.min("k").alias("k"))


@query("title_window", r"SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents")
def title_window(spark, d):
    """Numbered fallback titles by source."""
    return read_table(spark, d, "documents").select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("n"))


