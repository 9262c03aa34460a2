"""Neighbours by the index of inverted lists, and what is built on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann, vector
from ..session import read_table, staged
from .registry import query

#: Neighbours asked for candidates, from how alike a pair is a copy, and candidates by observed pair.
ASKED, ALIKE, SHARE = 69, 0.98, 0.2


def _vectors(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", "embedding")


@query("ann_neighbours")
def ann_neighbours(spark, d):
    """Ten neighbours of each vector whose id is divisible by 20; tests hold its recall."""
    rows = _vectors(spark, d)
    return ann.neighbours_by_index(rows, rows.where("vec_id % 20 = 0"), 10).withColumn("score", F.round("score", 6))


@query("ann_all_lists", "WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS key_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) SELECT query_id, key_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key_id) AS rank FROM p) WHERE rank <= 10")
def ann_all_lists(spark, d):
    """The same with every list probed, which is exact."""
    rows = _vectors(spark, d)
    return ann.neighbours_by_index(rows, rows.where("vec_id % 20 = 0"), 10, probes=ann.MOST_LISTS).withColumn("score", F.round("score", 6))


@query("synonym_edges_index")
def synonym_edges_index(spark, d):
    """Synonym edges from the index instead of all pairs; tests hold their recall."""
    rows = _vectors(spark, d)
    return vector.synonym_edges(ann.neighbours_by_index(rows, rows, 102, threshold=0.3), threshold=0.3).withColumn("weight", F.round("weight", 6))


_OBSERVED = "o AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem)"


@query(
    "candidate_pairs",
    f"WITH {_OBSERVED}, p AS (SELECT a.vec_id AS s, b.vec_id AS t, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c FROM embeddings a, embeddings b), "
    f"n AS (SELECT s, t, c FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY c DESC, t) AS k FROM p) WHERE k <= {ASKED} AND s <> t AND c < {ALIKE}), bad AS (SELECT p_partkey AS id FROM part WHERE p_size <= 2), "
    "m AS (SELECT least(s, t) AS a, greatest(s, t) AS b, max(c) AS c FROM n WHERE s NOT IN (SELECT id FROM bad) AND t NOT IN (SELECT id FROM bad) GROUP BY 1, 2) "
    f"SELECT a, b, round(1 / (1 + exp(-c)), 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY c DESC, a, b) AS k FROM m ANTI JOIN o USING (a, b)) WHERE k <= (SELECT ceil({SHARE} * count(*)) FROM o)",
)
def candidate_pairs(spark, d):
    """Entity pairs that may hide a relation: neighbours without nodes of bad names, pairs already seen, and copies."""
    rows = _vectors(spark, d)
    seen = read_table(spark, d, "lineitem").select(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).distinct()
    seen = staged(seen, "index-observed")
    bad = read_table(spark, d, "part").where("p_size <= 2").select(F.col("p_partkey").alias("id"))
    most = -(-seen.count() * int(SHARE * 10) // 10)
    near = ann.neighbours_by_index(rows, rows, ASKED, probes=ann.MOST_LISTS)
    return ann.candidate_pairs(near, bad, seen, ALIKE, most).withColumn("score", F.round("score", 6))
