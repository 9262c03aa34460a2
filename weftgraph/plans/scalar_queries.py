"""Row-level derivations over the driver tables: normalisers, ids, parsers, chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import chunking, extraction
from ..session import read_table
from .registry import query


def _docs(spark, d):
    return read_table(spark, d, "documents")


@query("md5_chunk_id", "SELECT doc_id, 'chunk-' || md5(text) AS chunk_id, 'doc-' || md5(text) AS full_doc_id FROM documents")
def md5_chunk_id(spark, d):
    return _docs(spark, d).select("doc_id", T.md5_id(F.col("text"), "chunk-").alias("chunk_id"), T.md5_id(F.col("text"), "doc-").alias("full_doc_id"))


@query(
    "relation_id",
    "SELECT o_orderkey, 'rel-' || md5(least(a, b) || greatest(a, b)) AS id, 'rel-' || md5(greatest(a, b) || least(a, b)) AS reversed_id, least(a, b) || '<SEP>' || greatest(a, b) AS chunk_key "
    "FROM (SELECT o_orderkey, 'customer ' || o_custkey AS a, 'order ' || o_orderkey AS b FROM orders)",
)
def relation_id(spark, d):
    a, b = F.concat(F.lit("customer "), F.col("o_custkey")), F.concat(F.lit("order "), F.col("o_orderkey"))
    return read_table(spark, d, "orders").select("o_orderkey", T.relation_ids(a, b).alias("r"), T.pair_key(a, b).alias("chunk_key")).select("o_orderkey", "r.id", "r.reversed_id", "chunk_key")


@query("phrase_normalise", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g')) AS phrase FROM documents")
def phrase_normalise(spark, d):
    return _docs(spark, d).select("doc_id", T.phrase(F.col("text")).alias("phrase"))


@query("compat_phrase", r"SELECT doc_id, trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')), '[^a-z0-9 ]', ' ', 'g')) AS phrase FROM documents")
def compat_phrase(spark, d):
    return _docs(spark, d).select("doc_id", T.compat_phrase(F.col("text")).alias("phrase"))


@query(
    "answer_normalise",
    r"SELECT doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS answer FROM documents",
)
def answer_normalise(spark, d):
    return _docs(spark, d).select("doc_id", T.answer(F.col("text")).alias("answer"))


@query(
    "title_compact",
    r"SELECT doc_id, CASE WHEN length(f) > 120 THEN substr(f, 1, 117) || '...' ELSE f END AS title, split_part(text, chr(10), 1) AS first_line FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)",
)
def title_compact(spark, d):
    return _docs(spark, d).select("doc_id", T.compact_title(F.col("text")).alias("title"), T.first_line(F.col("text")).alias("first_line"))


@query(
    "content_summary",
    r"SELECT doc_id, CASE WHEN length(f) <= 250 THEN f ELSE substr(f, 1, 250) || '...' END AS summary, n_chars AS content_length FROM (SELECT doc_id, n_chars, regexp_replace(text, '^\s+|\s+$', '', 'g') AS f FROM documents)",
)
def content_summary(spark, d):
    return _docs(spark, d).select("doc_id", T.summary(F.col("text")).alias("summary"), F.col("n_chars").alias("content_length"))


@query("slugify", "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages")
def slugify(spark, d):
    return read_table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("clean_title", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages")
def clean_title(spark, d):
    return read_table(spark, d, "pages").select("page_id", T.collapse(F.regexp_replace("html", "<[^>]*>", " ")).alias("plain"))


@query(
    "sanitise_text",
    r"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM conversations",
)
def sanitise_text(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", T.sanitise(F.col("text")).alias("clean"))


@query("think_tag_strip", rf"SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS spoken FROM conversations")
def think_tag_strip(spark, d):
    rows = read_table(spark, d, "conversations")
    noisy = F.concat(F.lit("plan</think><think>"), "role", F.lit("</think>"), "text", F.lit("<think>x\ny</think>"))
    return rows.select("conv_id", "turn", T.without_thoughts(noisy).alias("spoken"))


@query("answer_extract", r"SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS answer FROM conversations")
def answer_extract(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", T.answer_part(F.concat(F.lit("Thought: so. Answer: "), "text")).alias("answer"))


@query("source_id_codec", "SELECT o_custkey, string_agg(k, '<SEP>' ORDER BY i) AS joined, count(*) AS n FROM (SELECT o_custkey, o_orderpriority AS k, min(o_orderkey) AS i FROM orders GROUP BY ALL) GROUP BY o_custkey")
def source_id_codec(spark, d):
    rows = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    parts = T.split_list(F.array_join(F.transform("x", lambda s: s["o_orderpriority"]), T.SEP))
    return rows.select("o_custkey", T.join_list(parts).alias("joined"), F.size(parts).cast("long").alias("n"))


@query("float_parse", r"SELECT event_id, CASE WHEN regexp_full_match(s, '[-+]?[0-9]*\.?[0-9]+') THEN s::DOUBLE ELSE 1.0 END AS weight FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN round(value, 2)::VARCHAR ELSE event_type END AS s FROM events)")
def float_parse(spark, d):
    rows = read_table(spark, d, "events")
    # the text form of a double with two decimals, as both engines write it
    s = F.when(F.col("user_id") % 2 == 0, F.format_string("%s", F.round("value", 2).cast("string"))).otherwise(F.col("event_type"))
    return rows.select("event_id", T.float_or(s).alias("weight"))


@query("token_count", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]'))::BIGINT AS tokens FROM documents")
def token_count(spark, d):
    return _docs(spark, d).select("doc_id", F.regexp_count("text", F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")).cast("long").alias("tokens"))


@query("truncate_identifier", "SELECT doc_id, substr(text, 1, 256) AS identifier FROM documents")
def truncate_identifier(spark, d):
    return _docs(spark, d).select("doc_id", T.cut_identifier(F.col("text")).alias("identifier"))


@query(
    "candidate_entity_filter",
    "SELECT DISTINCT w AS entity FROM (SELECT unnest(string_split_regex(trim(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g')), ' +')) AS w FROM documents) WHERE length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+')",
)
def candidate_entity_filter(spark, d):
    """A text's words go through one split, and each once to the rows."""
    words = _docs(spark, d).select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("entity")).distinct()
    return words.where(extraction.is_candidate(F.col("entity")))


@query("epoch_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created FROM orders")
def epoch_format(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("cache_key_codec", "SELECT event_id, event_type || ':extract:' || md5(props) AS key, event_type AS mode, 'extract' AS kind, md5(props) AS hash FROM events")
def cache_key_codec(spark, d):
    rows = read_table(spark, d, "events").select("event_id", F.concat_ws(":", "event_type", F.lit("extract"), F.md5("props")).alias("key"))
    return rows.withColumn("p", F.split("key", ":", 3)).select("event_id", "key", F.col("p")[0].alias("mode"), F.col("p")[1].alias("kind"), F.col("p")[2].alias("hash"))


@query(
    "word_windows",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
    n AS (SELECT doc_id, ws, len(ws) AS n, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 200 THEN 1 ELSE 1 + ((len(ws) - 200 + 159) // 160) END AS k FROM w),
    e AS (SELECT doc_id, ws, n, k, unnest(range(k)) AS i FROM n),
    m AS (SELECT *, i * 160 AS s, least(i * 160 + 200, n) AS e, (n - (k - 1) * 160 < 80 AND k > 1) AS tail FROM e)
    SELECT doc_id, i AS chunk_index, s AS word_start, CASE WHEN tail AND i = k - 2 THEN n ELSE e END AS word_end, array_to_string(ws[s + 1 : CASE WHEN tail AND i = k - 2 THEN n ELSE e END], ' ') AS content
    FROM m WHERE NOT (tail AND i = k - 1)""",
)
def word_windows(spark, d):
    return chunking.word_windows(_docs(spark, d).select("doc_id", "text"), size=200, overlap=40, least=80)


@query(
    "token_windows",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]') AS ts FROM documents),
    e AS (SELECT doc_id, ts, unnest(range(0, len(ts), 270)) AS s FROM w WHERE len(ts) > 0)
    SELECT doc_id, (s // 270)::INTEGER AS chunk_order_index, least(300, len(ts) - s)::INTEGER AS tokens, 'chunk-' || md5(array_to_string(ts[s + 1 : s + 300], ' ')) AS chunk_id FROM e""",
)
def token_windows(spark, d):
    return chunking.token_windows(_docs(spark, d).select("doc_id", "text"), size=300, overlap=30).drop("content")


@query(
    "rerank_windows",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]') AS ts FROM documents),
    e AS (SELECT doc_id, ts, unnest(range(CASE WHEN len(ts) <= 480 THEN 1 ELSE 1 + ((len(ts) - 480 + 447) // 448) END)) AS i FROM w)
    SELECT doc_id, i::INTEGER AS piece, least(480, len(ts) - i * 448)::INTEGER AS tokens FROM e""",
)
def rerank_windows(spark, d):
    return chunking.rerank_windows(_docs(spark, d).select("doc_id", "text"), size=480, overlap=32)


@query("chunk_compaction", r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 400) AS compact FROM documents")
def chunk_compaction(spark, d):
    return _docs(spark, d).select("doc_id", F.substring(T.collapse(F.col("text")), 1, 400).alias("compact"))


_RECORDS = "SELECT p_partkey, 'entity<|#|>' || p_name || '<|#|>' || CASE WHEN p_size % 7 = 0 THEN 'bad|type' ELSE p_type END || '<|#|>' || CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS r FROM part"


@query(
    "entity_record_parse",
    f"SELECT p_partkey, f[2] AS entity_name, lower(replace(f[3], ' ', '')) AS entity_type, f[4] AS description FROM (SELECT p_partkey, string_split(r, '<|#|>') AS f FROM ({_RECORDS})) WHERE len(f) = 4 AND f[2] <> '' AND NOT regexp_matches(f[3], '[''()<>|/\\\\]') AND f[4] <> ''",
)
def entity_record_parse(spark, d):
    kind = F.when(F.col("p_size") % 7 == 0, F.lit("bad|type")).otherwise(F.col("p_type"))
    said = F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_brand"))
    rows = read_table(spark, d, "part").select("p_partkey", F.concat_ws(T.FIELD_MARK, F.lit("entity"), "p_name", kind, said).alias("record"))
    return extraction.entity_records(rows).drop("record")


@query(
    "relation_record_parse",
    "SELECT o_orderkey, 'customer ' || o_custkey AS src_id, 'order ' || o_orderkey AS tgt_id, replace(o_orderpriority, '-', ',') AS keywords, o_orderstatus AS description, 1.0::DOUBLE AS weight FROM orders",
)
def relation_record_parse(spark, d):
    rows = read_table(spark, d, "orders").select(
        "o_orderkey",
        F.concat_ws(T.FIELD_MARK, F.lit("relation"), F.concat(F.lit("customer "), "o_custkey"), F.concat(F.lit("order "), "o_orderkey"), F.translate("o_orderpriority", "-", "，"), "o_orderstatus").alias("record"),
    )
    return extraction.relation_records(rows).drop("record")


@query(
    "extraction_split",
    "SELECT o_custkey, count(*) AS records, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS entities, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS relations FROM orders GROUP BY o_custkey",
)
def extraction_split(spark, d):
    record = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(T.FIELD_MARK, F.lit("entity"), "o_orderkey", F.lit("order"), F.lit("d"))).otherwise(F.concat_ws(T.FIELD_MARK, F.lit("relation"), "o_orderkey", F.lit("x"), F.lit("k"), F.lit("d")))
    texts = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.concat_ws("\n", F.collect_list(record)), F.lit("\n" + T.END_MARK)).alias("result"))
    out = extraction.split_records(texts, "result")
    kind = F.substring_index("record", T.FIELD_MARK, 1)
    return out.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("records"), F.count_if(kind == "entity").alias("entities"), F.count_if(kind == "relation").alias("relations"))


@query("delimiter_repair", "SELECT p_partkey, 'entity<|#|>' || p_name || '<|#|>' || p_type || '<|#|>' || p_brand AS record, 4 AS fields FROM part")
def delimiter_repair(spark, d):
    """Damaged marks between the parts of a record; the repaired record is as if they had never been (survey 8.10)."""
    damaged = ["<|#|>", "<|##|>", "<|#||#|>", r"<|\#|>", "<|>", "<||>", "<X|#|>", "<|#|Y>", "<X|#|Y>", "<||#||>", "<#|>", "<|#>", "<#>", "<X#|>", "<|#X>", "|#|>", "<|#|", "<|#||", "||#|>"]
    bad = F.element_at(F.array(*[F.lit(x) for x in damaged]), (F.pmod("p_partkey", F.lit(len(damaged))) + 1).cast("int"))
    rows = read_table(spark, d, "part").select("p_partkey", F.concat(F.lit("entity"), bad, "p_name", bad, "p_type", bad, "p_brand").alias("record"))
    fixed = T.repair_marks(F.col("record"))
    return rows.select("p_partkey", fixed.alias("record"), F.size(F.split(fixed, r"<\|#\|>")).alias("fields"))


#: Raw names and what is left of them; {} is a part's name.
NAMES = (
    ('"{}"', "{}"), ("'it's {}'", "'it's {}'"), ("<p>{}</p><br/><p/>", "{}"), ("《{}》", "{}"), ("北京 {}", "北京{}"), ("\"{}'", "\"{}'"), ("12", ""), ("1.2.3", ""), ("Ａ１—{}", "A1-{}"), ("{}，x", "{}，x"),
    ("{} 北 京", "{}北京"), ("“a “{}” b”", "“a “{}” b”"), ("‘{}’", "{}"), ("（{}）", "({})"), ("1234", "1234"), ("<P >{}</BR >", "{}"), ("  {}　", "{}"),
)


def _named(templates, sql: bool):
    if sql:
        cases = " ".join("WHEN {} THEN {}".format(i, "replace('" + t.replace("'", "''") + "', '{}', p_name)") for i, t in enumerate(templates))
        return f"CASE p_partkey % {len(templates)} {cases} END"
    raw = F.element_at(F.array(*[F.lit(t) for t in templates]), (F.pmod("p_partkey", F.lit(len(templates))) + 1).cast("int"))
    return F.replace(raw, F.lit("{}"), F.col("p_name"))


@query("extracted_normalise", f"SELECT p_partkey, {_named([n for _, n in NAMES], True)} AS name FROM part")
def extracted_normalise(spark, d):
    """Names as a model gives them, without tags, wide signs and quotes (survey 8.9)."""
    return read_table(spark, d, "part").select("p_partkey", T.extracted(_named([r for r, _ in NAMES], False)).alias("name"))


@query("triple_filter", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT 's' || l_suppkey || '|supplies|' || 'p' || l_partkey)), ';') AS triples FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY l_orderkey")
def triple_filter(spark, d):
    s, o = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    triple = F.when(F.col("l_linenumber") % 3 == 0, F.array(s, o)).otherwise(F.array(s, F.lit("supplies"), o))
    rows = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(triple).alias("triples"))
    kept = rows.select("l_orderkey", extraction.valid_triples(F.col("triples")).alias("triples")).where(F.size("triples") > 0)
    return kept.select("l_orderkey", F.array_join(F.array_sort(F.transform("triples", lambda t: F.array_join(t, "|"))), ";").alias("triples"))


@query("string_to_bool", "SELECT o_orderkey, lower(trim(o_orderstatus)) IN ('true', '1', 'yes', 't', 'on') AS truth FROM orders")
def string_to_bool(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", T.truth(F.col("o_orderstatus")).alias("truth"))


@query(
    "vector_normalise",
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS squared, round(sqrt(list_sum(list_transform(embedding, lambda x: (2 * x::DOUBLE) ** 2))) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: (2 * x::DOUBLE) ** 2))), 1e-12), 6) AS length FROM embeddings",
)
def vector_normalise(spark, d):
    rows = read_table(spark, d, "embeddings").withColumn("u", A.unit(F.transform("embedding", lambda x: x * 2)))
    return rows.select("vec_id", F.round(A.dot(F.col("embedding"), F.col("embedding")), 6).alias("squared"), F.round(A.norm(F.col("u")), 6).alias("length"))


@query("json_extract_object", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_extract_object(spark, d):
    """The first JSON object within a longer answer."""
    noisy = F.concat(F.lit("Sure: "), "props", F.lit(" as asked."))
    return read_table(spark, d, "events").select("event_id", F.get_json_object(F.regexp_extract(noisy, r"(\{(?:[^{}]|\{[^{}]*\})*\})", 1), "$.k").cast("long").alias("k"))
