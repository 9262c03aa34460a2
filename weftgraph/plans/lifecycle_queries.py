"""Merges into stored rows, deletions with rebuild, creation and lookups; each oracle gives whole rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..session import drop_staged, read_table, staged
from .registry import query

# mentions of parts in chunks (orders); odd chunks are the stored past, even ones are new
_MENTIONS = (
    "m AS (SELECT DISTINCT 'part ' || l_partkey AS name, l_returnflag AS type, 'seen ' || l_linestatus || ' in ' || l_linenumber || CASE WHEN l_tax > 0.04 THEN ' taxed' ELSE '' END AS description, "
    "'chunk-' || l_orderkey AS source, 'file-' || (l_orderkey % 40) AS file_path, l_orderkey AS chunk, l_orderkey // 3 AS ts, l_orderkey * 100 + l_linenumber * 10 + ascii(l_returnflag) % 3 AS seq FROM lineitem)"
)


def _mentions(spark, d, by: str | None = None):
    """Rows of (name, type, description, source, file_path, chunk, ts, seq); rows of equal seq differ in nothing that is ordered by it but the description.

    They are told apart where rows of equal ``by`` are, if it is given, so that a join by it needs no other shuffle.
    """
    rows = read_table(spark, d, "lineitem")
    taxed = F.when(F.col("l_tax") > 0.04, " taxed").otherwise("")
    rows = rows.select(
        F.concat(F.lit("part "), "l_partkey").alias("name"), F.col("l_returnflag").alias("type"), F.concat(F.lit("seen "), "l_linestatus", F.lit(" in "), "l_linenumber", taxed).alias("description"),
        F.concat(F.lit("chunk-"), "l_orderkey").alias("source"), F.concat(F.lit("file-"), (F.col("l_orderkey") % 40).cast("string")).alias("file_path"), F.col("l_orderkey").alias("chunk"),
        F.floor(F.col("l_orderkey") / 3).alias("ts"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.ascii("l_returnflag") % 3).alias("seq"),
    )
    return (rows.repartition(by) if by else rows).distinct()


def _merge_sql(new: str, stored: str, sources: int, paths: int, method: str, keys: str = "name") -> str:
    """CTEs over ``new`` and ``stored`` (with lists) up to ``ids``, ``paths``, ``kept`` and ``said``."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    down = "DESC" if method == "FIFO" else "ASC"
    keep = f"SELECT a.* FROM {new} a WHERE EXISTS (SELECT 1 FROM (SELECT {keys}, unnest(items) AS source FROM ids UNION ALL SELECT {keys}, source FROM old_ids) b WHERE {on} AND a.source = b.source)" if method == "KEEP" else f"SELECT * FROM {new}"
    split = lambda c: f"SELECT * FROM (SELECT {keys}, unnest(string_split({c}, '<SEP>')) AS x, generate_subscripts(string_split({c}, '<SEP>'), 1) - 1 AS pos FROM {stored} a WHERE EXISTS (SELECT 1 FROM {new} b WHERE {on})) WHERE x <> '...truncated'"
    union = lambda own, rows, item, limit: (
        f"SELECT {keys}, list(x ORDER BY part, pos, x) AS items, max(total) AS total FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY part {down}, pos {down}, x {down}) AS n, count(*) OVER (PARTITION BY {keys}) AS total FROM "
        f"(SELECT {keys}, x, min(part * 1000000000000 + pos) // 1000000000000 AS part, min(part * 1000000000000 + pos) % 1000000000000 AS pos FROM (SELECT {keys}, x, 0 AS part, pos FROM ({own}) UNION ALL SELECT {keys}, {item}, 1, seq FROM {rows}) GROUP BY {keys}, x)) WHERE n <= {limit} GROUP BY {keys}"
    )
    return f"""old_ids AS (SELECT {keys}, x AS source FROM ({split("source_id")})),
    ids AS ({union(split("source_id"), new, "source", sources)}),
    kept AS ({keep}),
    paths AS (SELECT {keys}, array_to_string(items, '<SEP>') || CASE WHEN total > {paths} THEN '<SEP>...truncated' ELSE '' END AS file_path FROM ({union(split("file_path"), "kept", "file_path", paths)})),
    listed AS (SELECT {keys}, list(x ORDER BY part, a, b, c, x) AS items FROM (SELECT {keys}, x, 0 AS part, pos AS a, 0 AS b, 0 AS c FROM ({split("description")}) UNION ALL SELECT {keys}, description, 1, min(ts * 1000000000000 + seq) // 1000000000000, -length(description), min(ts * 1000000000000 + seq) % 1000000000000 FROM kept WHERE description <> '' GROUP BY {keys}, description) GROUP BY {keys}),
    said AS (SELECT {keys}, CASE WHEN len(items) = 1 OR len(items) < 8 AND len(regexp_extract_all(whole, '\\w+|[^\\w\\s]')) < 1200 THEN whole WHEN length(whole) <= 250 THEN whole ELSE substr(whole, 1, 250) || '...' END AS description FROM (SELECT *, array_to_string(items, '<SEP>') AS whole FROM listed))"""


_STORED = "stored AS (SELECT name, max(type) AS entity_type, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, string_agg(DISTINCT source, '<SEP>' ORDER BY source) AS source_id, string_agg(DISTINCT file_path, '<SEP>' ORDER BY file_path) AS file_path FROM m WHERE chunk % 4 = 1 GROUP BY name)"


def _stored(rows):
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "<SEP>").alias(c)
    past = rows.where("chunk % 4 = 1").groupBy("name").agg(F.max("type").alias("entity_type"), joined("description"), joined("source").alias("source_id"), joined("file_path"))
    return past


def _entity_sql(method: str, sources: int, paths: int) -> str:
    return f"""WITH {_MENTIONS}, {_STORED}, new AS (SELECT * FROM m WHERE chunk % 2 = 0),
    {_merge_sql("new", "stored", sources, paths, method)},
    kinds AS (SELECT name, type, count(*) AS n, min(part * 1000000000000 + seq) AS f FROM (SELECT name, type, 0 AS part, seq FROM kept UNION ALL SELECT name, entity_type, 1, 0 FROM stored WHERE name IN (SELECT name FROM new)) GROUP BY name, type),
    kind AS (SELECT name, first(type ORDER BY n DESC, f) AS entity_type FROM kinds GROUP BY name)
    SELECT k.name, entity_type, coalesce(description, 'Entity ' || k.name) AS description, array_to_string(items, '<SEP>') AS source_id, len(items) AS n_sources, coalesce(file_path, '') AS file_path FROM kind k JOIN ids USING (name) LEFT JOIN said USING (name) LEFT JOIN paths USING (name)"""


@query("entity_merge_stored", _entity_sql("FIFO", 8, 5))
def entity_merge_stored(spark, d):
    """New mentions merged into stored entities; the newest sources and paths stay (survey 4.6)."""
    rows = _mentions(spark, d)
    return L.merge_into_entities(rows.where("chunk % 2 = 0"), _stored(rows), 8, 5, "FIFO")


@query("entity_merge_keep", _entity_sql("KEEP", 8, 5))
def entity_merge_keep(spark, d):
    """As entity_merge_stored, but the oldest sources stay and mentions of other chunks are dropped (survey 4.6)."""
    rows = _mentions(spark, d)
    return L.merge_into_entities(rows.where("chunk % 2 = 0"), _stored(rows), 8, 5, "KEEP")


# links between the parts of neighbouring lines
_LINKS = (
    "l AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS tgt, w AS weight, keywords, description, source, file_path, chunk, ts, seq FROM (SELECT 'part ' || l_partkey % 300 AS a, 'part ' || (l_partkey + l_suppkey) % 300 AS b, l_quantity AS w, l_returnflag || ', ' || l_linestatus AS keywords, "
    "'link ' || l_linenumber AS description, 'chunk-' || l_orderkey AS source, 'file-' || (l_orderkey % 40) AS file_path, l_orderkey AS chunk, l_orderkey // 3 AS ts, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) WHERE a <> b)"
)


def _links(spark, d):
    rows = read_table(spark, d, "lineitem")
    part = lambda c: F.concat(F.lit("part "), (c % 300).cast("string"))
    a, b = part(F.col("l_partkey")), part(F.col("l_partkey") + F.col("l_suppkey"))
    rows = rows.where(a != b)
    return rows.select(
        F.least(a, b).alias("src"), F.greatest(a, b).alias("tgt"), F.col("l_quantity").alias("weight"), F.concat_ws(", ", "l_returnflag", "l_linestatus").alias("keywords"), F.concat(F.lit("link "), "l_linenumber").alias("description"),
        F.concat(F.lit("chunk-"), "l_orderkey").alias("source"), F.concat(F.lit("file-"), (F.col("l_orderkey") % 40).cast("string")).alias("file_path"), F.col("l_orderkey").alias("chunk"), F.floor(F.col("l_orderkey") / 3).alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    ).distinct()


_OLD_LINKS = "stored AS (SELECT src, tgt, sum(weight) AS weight, string_agg(DISTINCT keywords, ',' ORDER BY keywords) AS keywords, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, string_agg(DISTINCT source, '<SEP>' ORDER BY source) AS source_id, string_agg(DISTINCT file_path, '<SEP>' ORDER BY file_path) AS file_path FROM l WHERE chunk % 4 = 1 GROUP BY src, tgt)"


def _old_links(rows):
    joined = lambda c, sep="<SEP>": F.array_join(F.array_sort(F.collect_set(c)), sep).alias(c)
    return rows.where("chunk % 4 = 1").groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), joined("keywords", ","), joined("description"), joined("source").alias("source_id"), joined("file_path"))


_LINK_SQL = _merge_sql("new", "stored", 300, 100, "FIFO", "src, tgt")
_MERGED_LINKS = """both_ AS (SELECT src, tgt, weight, keywords FROM kept UNION ALL SELECT src, tgt, weight, keywords FROM stored WHERE (src, tgt) IN (SELECT (src, tgt) FROM new)),
    words AS (SELECT src, tgt, string_agg(DISTINCT trim(w), ',' ORDER BY trim(w)) AS keywords FROM (SELECT src, tgt, unnest(string_split(keywords, ',')) AS w FROM both_) WHERE trim(w) <> '' GROUP BY src, tgt),
    links AS (SELECT b.src, b.tgt, b.weight, keywords, description, array_to_string(items, '<SEP>') AS source_id, len(items) AS n_sources, file_path FROM (SELECT src, tgt, sum(weight) AS weight FROM both_ GROUP BY src, tgt) b JOIN words USING (src, tgt) JOIN ids USING (src, tgt) JOIN said USING (src, tgt) JOIN paths USING (src, tgt))"""


@query("relation_merge_stored", f"WITH {_LINKS}, {_OLD_LINKS}, new AS (SELECT * FROM l WHERE chunk % 2 = 0), {_LINK_SQL}, {_MERGED_LINKS} SELECT * FROM links")
def relation_merge_stored(spark, d):
    """New links merged into stored relations (survey 4.7)."""
    rows = _links(spark, d)
    return L.merge_into_relations(rows.where("chunk % 2 = 0"), _old_links(rows))


@query(
    "two_phase_merge",
    f"WITH {_LINKS}, stored AS (SELECT src, tgt, weight, keywords, description, source AS source_id, file_path FROM l LIMIT 0), new AS (SELECT * FROM l WHERE chunk % 2 = 0), {_LINK_SQL}, {_MERGED_LINKS}, "
    "known AS (SELECT DISTINCT 'part ' || l_partkey AS name, l_returnflag AS type FROM lineitem WHERE l_orderkey % 2 = 0 AND l_partkey % 3 <> 0), ends AS (SELECT src AS name, * FROM links UNION ALL SELECT tgt, * FROM links), "
    "first_ AS (SELECT name, first(description ORDER BY source_id, description) AS description FROM ends WHERE name NOT IN (SELECT name FROM known) GROUP BY name) "
    "SELECT name, 'UNKNOWN' AS entity_type, description FROM first_ UNION ALL SELECT name, NULL, NULL FROM known GROUP BY name",
)
def two_phase_merge(spark, d):
    """Entities first, then relations; ends that no entity row names become UNKNOWN entities (survey 4.8)."""
    mentions, links = _mentions(spark, d).where("chunk % 2 = 0 AND cast(substring(name, 6) as bigint) % 3 <> 0"), _links(spark, d).where("chunk % 2 = 0")
    nodes, _ = L.two_phase_merge(mentions, links, _stored(mentions).limit(0), _old_links(links).limit(0))
    own = F.col("entity_type") == "UNKNOWN"
    return nodes.select("name", F.when(own, F.col("entity_type")).alias("entity_type"), F.when(own, F.col("description")).alias("description"))


@query(
    "delete_and_rebuild",
    f"""WITH {_MENTIONS}, everything AS (SELECT name, 'old' AS entity_type, 'old text' AS description, string_agg(DISTINCT source, '<SEP>' ORDER BY source) AS source_id, 'old' AS file_path FROM m GROUP BY name),
    gone AS (SELECT 'chunk-' || o_orderkey AS source FROM orders WHERE o_orderkey % 10 < 4), sources AS (SELECT name, unnest(string_split(source_id, '<SEP>')) AS source FROM everything),
    plan AS (SELECT name, count(*) AS n, count(*) FILTER (WHERE source IN (SELECT source FROM gone)) AS g FROM sources GROUP BY name),
    new AS (SELECT * FROM m WHERE source NOT IN (SELECT source FROM gone) AND name IN (SELECT name FROM plan WHERE g > 0 AND g < n)), stored AS (SELECT * FROM everything LIMIT 0),
    {_merge_sql("new", "stored", 300, 100, "FIFO")},
    kinds AS (SELECT name, type, count(*) AS n, min(seq) AS f FROM kept GROUP BY name, type), kind AS (SELECT name, first(type ORDER BY n DESC, f) AS entity_type FROM kinds GROUP BY name)
    SELECT name, entity_type, description, array_to_string(items, '<SEP>') AS source_id, len(items) AS n_sources, file_path FROM kind JOIN ids USING (name) JOIN said USING (name) JOIN paths USING (name)
    UNION ALL SELECT e.name, entity_type, description, source_id, len(string_split(source_id, '<SEP>')), file_path FROM everything e JOIN plan USING (name) WHERE g = 0""",
)
def delete_and_rebuild(spark, d):
    """Entities after documents are deleted: untouched rows, and rows built anew from the extractions that are left (survey 12.2, 4.11)."""
    rows = _mentions(spark, d, "source")
    stored = rows.groupBy("name").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    stored = stored.select("name", F.array_join("sources", "<SEP>").alias("source_id"), F.size("sources").cast("long").alias("n_sources"))
    stored = stored.select("name", F.lit("old").alias("entity_type"), F.lit("old text").alias("description"), "source_id", "n_sources", F.lit("old").alias("file_path"))
    gone = read_table(spark, d, "orders").where("o_orderkey % 10 < 4").select(F.concat(F.lit("chunk-"), "o_orderkey").alias("source"))
    stored = staged(stored, "deletion-stored")
    out = L.delete_documents(stored, rows, gone)
    drop_staged(stored)
    return out


@query("create_entity", "SELECT 'part ' || p_partkey AS name, p_type AS entity_type, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_name END AS description, 'manual_creation' AS source_id, CASE WHEN p_size % 5 = 0 THEN 'no description' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 4 = 1) THEN 'exists' ELSE 'created' END AS outcome FROM part")
def create_entity(spark, d):
    """Entities wanted by hand, each with its outcome (survey 12.6)."""
    wanted = read_table(spark, d, "part").select(F.concat(F.lit("part "), "p_partkey").alias("name"), F.col("p_type").alias("entity_type"), F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name")).alias("description"))
    return L.create_entities(_mentions(spark, d).where("chunk % 4 = 1").select("name"), wanted)


@query(
    "create_relation",
    f"WITH {_LINKS}, n AS (SELECT DISTINCT 'part ' || p_partkey AS name FROM part WHERE p_size > 10), old AS (SELECT DISTINCT src, tgt FROM l WHERE chunk % 4 = 1), w AS (SELECT least(a, b) AS src, greatest(a, b) AS tgt, p_name AS description FROM (SELECT 'part ' || p_partkey AS a, 'part ' || (p_partkey + 7) % 300 AS b, p_name FROM part WHERE p_partkey < 300)) "
    "SELECT src, tgt, description, 1.0::DOUBLE AS weight, 'manual_creation' AS source_id, CASE WHEN src NOT IN (SELECT name FROM n) OR tgt NOT IN (SELECT name FROM n) THEN 'no end' WHEN (src, tgt) IN (SELECT (src, tgt) FROM old) THEN 'exists' ELSE 'created' END AS outcome FROM w",
)
def create_relation(spark, d):
    """Relations wanted by hand, each with its outcome (survey 12.6)."""
    parts = read_table(spark, d, "part")
    names = parts.where("p_size > 10").select(F.concat(F.lit("part "), "p_partkey").alias("name"))
    wanted = parts.where("p_partkey < 300").select(F.concat(F.lit("part "), "p_partkey").alias("src"), F.concat(F.lit("part "), ((F.col("p_partkey") + 7) % 300).cast("string")).alias("tgt"), F.col("p_name").alias("description"))
    return L.create_relations(names, _links(spark, d).where("chunk % 4 = 1"), wanted)


@query("entity_info", f"WITH {_MENTIONS}, {_STORED} SELECT s.name, entity_type, source_id, label::BIGINT AS vector_label FROM stored s LEFT JOIN embeddings ON name = 'part ' || vec_id")
def entity_info(spark, d):
    """Stored entities with what their vector row says, if there is one (survey 12.8)."""
    vectors = read_table(spark, d, "embeddings").select(F.concat(F.lit("part "), "vec_id").alias("name"), F.col("label").cast("long").alias("vector_label"))
    return _stored(_mentions(spark, d)).join(vectors, "name", "left").select("name", "entity_type", "source_id", "vector_label")


@query("relation_info", f"WITH {_LINKS}, {_OLD_LINKS} SELECT src, tgt, weight, keywords, source_id FROM stored WHERE src = 'part 1' OR tgt = 'part 1'")
def relation_info(spark, d):
    """Stored relations of an entity (survey 12.8)."""
    return _old_links(_links(spark, d).where("src = 'part 1' OR tgt = 'part 1'")).select("src", "tgt", "weight", "keywords", "source_id")


@query("chunk_tracking_seed", f"WITH {_MENTIONS}, {_STORED} SELECT name, source_id AS chunk_ids, len(string_split(source_id, '<SEP>'))::BIGINT AS count FROM stored")
def chunk_tracking_seed(spark, d):
    """Chunk lists and counts derived from the sources of stored entities; kept as they are where tracking rows exist (survey 4.33)."""
    return L.tracking_seed(_stored(_mentions(spark, d)), spark.createDataFrame([], "name string, chunk_ids string, count bigint"))
