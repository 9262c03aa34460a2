"""Aggregations: graph statistics, keyed merges, metric roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import facts as fx
from ..operators import merge
from ..session import read_table
from .registry import query

FACTS = fx.SQL


@query("fact_edges", f"WITH {FACTS}, d AS (SELECT DISTINCT * FROM facts) SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT s AS src, o AS dst FROM d UNION ALL SELECT o, s FROM d) GROUP BY src, dst")
def fact_edges(spark, d):
    rows = fx.facts(spark, d).distinct()
    both = rows.select(F.col("s").alias("src"), F.col("o").alias("dst")).union(rows.select("o", "s"))
    return both.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query("passage_edges", f"WITH {FACTS} SELECT DISTINCT chunk, entity, 1.0::DOUBLE AS weight FROM (SELECT chunk, s AS entity FROM facts UNION ALL SELECT chunk, o FROM facts)")
def passage_edges(spark, d):
    return fx.facts(spark, d).select("chunk", F.explode(F.array("s", "o")).alias("entity")).distinct().withColumn("weight", F.lit(1.0))


@query("unique_entities", f"WITH {FACTS} SELECT entity, 'entity-' || md5(entity) AS hash_id, count(DISTINCT chunk) AS chunks FROM (SELECT chunk, s AS entity FROM facts UNION ALL SELECT chunk, o FROM facts) GROUP BY entity")
def unique_entities(spark, d):
    rows = fx.facts(spark, d).select("chunk", F.explode(F.array("s", "o")).alias("entity"))
    return rows.groupBy("entity").agg(F.countDistinct("chunk").alias("chunks")).withColumn("hash_id", T.md5_id(F.col("entity"), "entity-"))


@query("unique_facts", f"WITH {FACTS} SELECT DISTINCT s, p, o, 'fact-' || md5('(''' || s || ''', ''' || p || ''', ''' || o || ''')') AS fact_id FROM facts")
def unique_facts(spark, d):
    return fx.facts(spark, d).select("s", "p", "o").distinct().withColumn("fact_id", T.md5_id(T.fact_text(F.col("s"), F.col("p"), F.col("o")), "fact-"))


@query(
    "graph_info",
    f"WITH {FACTS}, e AS (SELECT DISTINCT chunk, entity FROM (SELECT chunk, s AS entity FROM facts UNION ALL SELECT chunk, o FROM facts)) "
    "SELECT (SELECT count(DISTINCT entity) FROM e) AS phrase_nodes, (SELECT count(DISTINCT chunk) FROM e) AS passage_nodes, (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM facts)) AS facts, (SELECT count(*) FROM e) AS passage_links",
)
def graph_info(spark, d):
    rows = fx.facts(spark, d)
    links = rows.select("chunk", F.explode(F.array("s", "o")).alias("entity")).distinct()
    return links.agg(F.countDistinct("entity").alias("phrase_nodes"), F.countDistinct("chunk").alias("passage_nodes"), F.count(F.lit(1)).alias("passage_links")).crossJoin(rows.agg(F.countDistinct("s", "p", "o").alias("facts")))


_ENTITY_ROWS = "SELECT l_partkey::VARCHAR AS name, l_returnflag AS type, l_linestatus || '-' || (l_quantity::INTEGER % 7) AS description, l_orderkey::VARCHAR AS source, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"


def _entity_rows(spark, d):
    rows = read_table(spark, d, "lineitem")
    said = F.concat("l_linestatus", F.lit("-"), F.pmod(F.col("l_quantity").cast("int"), F.lit(7)))
    return rows.select(F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").alias("type"), said.alias("description"), F.col("l_orderkey").cast("string").alias("source"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


@query(
    "entity_merge",
    f"""WITH r AS ({_ENTITY_ROWS}),
    k AS (SELECT name, type, count(*) AS n, min(seq) AS f FROM r GROUP BY ALL), kind AS (SELECT name, first(type ORDER BY n DESC, f) AS entity_type FROM k GROUP BY name),
    s AS (SELECT name, description, ts, seq, row_number() OVER (PARTITION BY name, description ORDER BY ts, seq) AS rn FROM r),
    said AS (SELECT name, string_agg(description, '<SEP>' ORDER BY ts, -length(description), seq) AS description FROM s WHERE rn = 1 GROUP BY name),
    i AS (SELECT name, source, min(seq) AS at_ FROM r GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY at_ DESC) AS back FROM i),
    ids AS (SELECT name, string_agg(source, '<SEP>' ORDER BY at_) AS source_id, count(*) AS n_sources FROM o WHERE back <= 20 GROUP BY name)
    SELECT * FROM kind JOIN said USING (name) JOIN ids USING (name)""",
)
def entity_merge(spark, d):
    return merge.merge_entities(_entity_rows(spark, d), max_sources=20)


@query(
    "relation_merge",
    "WITH r AS (SELECT 'supplier ' || l_suppkey AS a, 'part ' || l_partkey AS b, l_quantity AS w, l_returnflag || ',' || l_linestatus AS kw, l_linenumber::VARCHAR AS description, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), "
    "k AS (SELECT a, b, string_agg(DISTINCT x, ',' ORDER BY x) AS keywords FROM (SELECT a, b, unnest(string_split(kw, ',')) AS x FROM r) GROUP BY a, b) "
    "SELECT least(a, b) AS src, greatest(a, b) AS tgt, sum(w) AS weight, any_value(keywords) AS keywords, min_by(description, seq) AS description FROM r JOIN k USING (a, b) GROUP BY a, b",
)
def relation_merge(spark, d):
    rows = read_table(spark, d, "lineitem").select(F.concat(F.lit("supplier "), "l_suppkey").alias("src"), F.concat(F.lit("part "), "l_partkey").alias("tgt"), F.col("l_quantity").alias("weight"), F.concat_ws(",", "l_returnflag", "l_linestatus").alias("keywords"), F.col("l_linenumber").cast("string").alias("description"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return merge.merge_relations(rows)


_IDS = "SELECT o_custkey, list(o_orderkey::VARCHAR ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey"


def _order_ids(spark, d):
    return read_table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("ids"))


@query("source_id_fifo", f"SELECT o_custkey, array_to_string(ids[greatest(len(ids) - 4, 1):], ',') AS kept FROM ({_IDS})")
def source_id_fifo(spark, d):
    return _order_ids(spark, d).select("o_custkey", F.array_join(A.cap_ids(F.col("ids"), 5, "FIFO"), ",").alias("kept"))


@query("source_id_keep", f"SELECT o_custkey, array_to_string(ids[:5], ',') AS kept FROM ({_IDS})")
def source_id_keep(spark, d):
    return _order_ids(spark, d).select("o_custkey", F.array_join(A.cap_ids(F.col("ids"), 5, "KEEP"), ",").alias("kept"))


@query("incremental_ids", f"SELECT o_custkey, array_to_string(list_filter(ids, lambda x: NOT list_contains(ids[:2], x)) || ['new'], ',') AS ids_now, array_to_string(ids[3:], ',') AS subtracted FROM ({_IDS})")
def incremental_ids(spark, d):
    ids = F.col("ids")
    now = A.incremental_ids(ids, F.slice(ids, 1, 3), F.concat(F.filter(F.slice(ids, 1, 3), lambda x: ~F.array_contains(F.slice(ids, 1, 2), x)), F.array(F.lit("new"))))
    return _order_ids(spark, d).select("o_custkey", F.array_join(now, ",").alias("ids_now"), F.array_join(A.subtract_ids(ids, F.slice(ids, 1, 2)), ",").alias("subtracted"))


@query("rerank_aggregate", "SELECT user_id, round(max(value), 6) AS top, round(avg(value), 6) AS mean, round(min_by(value, event_id), 6) AS first FROM events GROUP BY user_id")
def rerank_aggregate(spark, d):
    return read_table(spark, d, "events").groupBy("user_id").agg(F.round(F.max("value"), 6).alias("top"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min_by("value", "event_id"), 6).alias("first"))


@query(
    "status_counts",
    "SELECT coalesce(s, 'all') AS status, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'FAILED']) AS s) LEFT JOIN orders ON s = o_orderstatus GROUP BY GROUPING SETS ((s), ())",
)
def status_counts(spark, d):
    """Every known state with its count, absent ones 0, and the total."""
    known = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in ("F", "O", "P", "FAILED")])).alias("s"))
    counts = read_table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("c"))
    rows = known.join(counts, F.col("s") == F.col("o_orderstatus"), "left")
    return rows.rollup("s").agg(F.sum(F.coalesce("c", F.lit(0))).alias("n")).select(F.coalesce("s", F.lit("all")).alias("status"), "n")


@query("weighted_metric", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS discount, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS tax FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag")
def weighted_metric(spark, d):
    rows = read_table(spark, d, "lineitem").where("l_quantity > 0")
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("l_quantity")) / F.sum("l_quantity"), 6)
    return rows.groupBy("l_returnflag").agg(mean("l_discount").alias("discount"), mean("l_tax").alias("tax"))


@query("idf_weights", "SELECT p_partkey, CASE WHEN count(DISTINCT l_orderkey) > 0 THEN round(1.0::DOUBLE / count(DISTINCT l_orderkey), 9) ELSE 0.0 END AS weight FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def idf_weights(spark, d):
    df = read_table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("df"))
    rows = read_table(spark, d, "part").join(df, F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.select("p_partkey", F.when(F.col("df") > 0, F.round(1 / F.col("df"), 9)).otherwise(0.0).alias("weight"))


@query("score_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY event_type")
def score_summary(spark, d):
    return read_table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@query("snapshot_top_chunks", f"WITH {FACTS} SELECT chunk, count(*) AS n FROM facts GROUP BY chunk ORDER BY n DESC, chunk LIMIT 10")
def snapshot_top_chunks(spark, d):
    return fx.facts(spark, d).groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "chunk").limit(10)


@query("segment_softmax", "SELECT event_id, round(exp(value - m) / s, 9) AS p FROM (SELECT event_id, value, m, sum(exp(value - m)) OVER (PARTITION BY user_id) AS s FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events))")
def segment_softmax(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id")
    rows = read_table(spark, d, "events").withColumn("m", F.max("value").over(own)).withColumn("e", F.exp(F.col("value") - F.col("m")))
    return rows.select("event_id", F.round(F.col("e") / F.sum("e").over(own), 9).alias("p"))


@query("masked_mean", "SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS mean FROM events GROUP BY user_id")
def masked_mean(spark, d):
    return read_table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(F.when(F.col("event_type") == "click", F.col("value"))), 6).alias("mean"))


@query("pna_aggregate", "SELECT user_id, round(avg(value), 6) AS mean, round(max(value), 6) AS high, round(min(value), 6) AS low, round(sqrt(greatest(avg(value * value) - avg(value) * avg(value), 1e-6)), 4) AS spread, round(ln(count(*) + 1), 6) AS scale FROM events GROUP BY user_id")
def pna_aggregate(spark, d):
    v = F.col("value")
    spread = F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(1e-6)))
    return read_table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.max(v), 6).alias("high"), F.round(F.min(v), 6).alias("low"), F.round(spread, 4).alias("spread"), F.round(F.log(F.count(F.lit(1)) + 1), 6).alias("scale"))


@query("max_weight_pairs", "SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, max(l_extendedprice) AS weight FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2")
def max_weight_pairs(spark, d):
    rows = read_table(spark, d, "lineitem").where("l_suppkey <> l_partkey")
    return rows.groupBy(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).agg(F.max("l_extendedprice").alias("weight"))


@query("custom_kg_last_wins", "SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS priority, max(o_orderkey) AS seq FROM orders GROUP BY o_custkey")
def custom_kg_last_wins(spark, d):
    rows = read_table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("seq"))
    return merge.last_wins(rows, "o_custkey").select("o_custkey", "priority", "seq")


@query("attribute_merge", "SELECT o_custkey, string_agg(o_orderstatus, '<SEP>' ORDER BY o_orderkey) AS joined, min_by(o_orderpriority, o_orderkey) AS kept_first, max_by(o_orderpriority, o_orderkey) AS kept_last, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS unique_sorted, max(o_totalprice) AS most FROM orders GROUP BY o_custkey")
def attribute_merge(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda s: s["o_orderstatus"])
    return read_table(spark, d, "orders").groupBy("o_custkey").agg(T.join_list(ordered).alias("joined"), F.min_by("o_orderpriority", "o_orderkey").alias("kept_first"), F.max_by("o_orderpriority", "o_orderkey").alias("kept_last"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("unique_sorted"), F.max("o_totalprice").alias("most"))


@query("gleaning_merge", "SELECT user_id, event_type, max_by(props, (length(props), -event_id)) AS props FROM events GROUP BY user_id, event_type")
def gleaning_merge(spark, d):
    """The longer description wins, of equals the earlier pass."""
    return read_table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("props", F.struct(F.length("props"), -F.col("event_id"))).alias("props"))


@query("cache_counts", "SELECT event_type AS mode, (props->>'k')::BIGINT % 2 = 0 AS extract_cache, count(*) AS n FROM events GROUP BY ALL")
def cache_counts(spark, d):
    rows = read_table(spark, d, "events")
    return rows.groupBy(F.col("event_type").alias("mode"), (F.get_json_object("props", "$.k").cast("long") % 2 == 0).alias("extract_cache")).agg(F.count(F.lit(1)).alias("n"))


@query("cache_list_append", "SELECT conv_id, array_to_string(list_sort(list(DISTINCT 'default:extract:' || md5(text))), ',') AS llm_cache_list, count(DISTINCT text) AS n FROM conversations GROUP BY conv_id")
def cache_list_append(spark, d):
    rows = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set(T.md5_id(F.col("text"), "default:extract:"))).alias("x"))
    return rows.select("conv_id", F.array_join("x", ",").alias("llm_cache_list"), F.size("x").cast("long").alias("n"))


@query("extraction_stats", r"SELECT round(avg(length(p_name)), 6) AS avg_ent_chars, round(avg(len(string_split(p_name, ' '))), 6) AS avg_ent_words, count(*) AS entities FROM part")
def extraction_stats(spark, d):
    return read_table(spark, d, "part").agg(F.round(F.avg(F.length("p_name")), 6).alias("avg_ent_chars"), F.round(F.avg(F.size(F.split("p_name", " "))), 6).alias("avg_ent_words"), F.count(F.lit(1)).alias("entities"))
