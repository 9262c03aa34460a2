"""Hidden-triple mining: snapshots, scores, batches, injection; and searches over rounds of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import staged
from . import lifecycle

#: Pairs and chunks of a batch of evidence.
BATCH_PAIRS, BATCH_CHUNKS = 10, 4
#: Nodes of a step that are broadcast, if there are no more.
FEW_NODES = 200_000


def snapshot(entities: DataFrame, edges: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, node_type), edges) of a graph: entities 0, chunks 1; self loops and edges with a blank end go (survey 11.6)."""
    nodes = entities.select(F.col("name").alias("node"), F.lit(0).alias("node_type")).unionByName(chunks.select(F.col("chunk").alias("node"), F.lit(1).alias("node_type"))).where("trim(node) <> ''").distinct()
    return nodes, edges.where("trim(src) <> '' AND trim(dst) <> '' AND src <> dst")


def equivalent_edges(scores: DataFrame, base: DataFrame, least: float = 0.8, most: int = 100) -> DataFrame:
    """``base`` (src, dst, relation) with an edge ``equivalent`` to each like neighbour, which replaces what the pair had (survey 11.4).

    Scores (src, dst, score) are taken relative to a node's best; those below ``least`` and beyond ``most`` + 1 neighbours do not count.
    """
    own = Window.partitionBy("src")
    rows = scores.where("src <> dst").withColumn("norm", F.col("score") / F.max("score").over(own)).where(F.col("norm") >= least)
    rows = rows.withColumn("n", F.row_number().over(own.orderBy(F.desc("score"), "dst"))).where(F.col("n") <= most + 1)
    near = rows.select("src", "dst", F.lit("equivalent").alias("relation"))
    return base.select("src", "dst", "relation").join(near.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(near)


def entity_hops(edges: DataFrame, roots: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """(node, hop): the least number of entities entered on the way from a root, at most ``hops`` (survey A13).

    ``nodes`` (node, node_type): entering an entity (0) costs 1, other nodes nothing; a node whose distance falls is followed again.
    """
    # read in every step, and not shuffled where the step's nodes are few
    cost = staged(nodes.select(F.col("node").alias("to"), F.when(F.col("node_type") == 0, 1).otherwise(0).alias("cost")), "hop-nodes")
    edges = staged(edges.select("src", "dst"), "hop-edges")
    few = lambda df: F.broadcast(df) if df.count() <= FEW_NODES else df
    seen = staged(roots.select("node").distinct().withColumn("hop", F.lit(0)), "hop")
    frontier = seen
    while not frontier.isEmpty():
        near = few(frontier)
        along = lambda a, b, near=near: edges.join(near, F.col(a) == F.col("node")).groupBy(F.col(b).alias("end")).agg(F.min("hop").alias("hop"))
        ends = staged(along("src", "dst").unionByName(along("dst", "src")), "hop-ends")
        reached = cost.join(few(ends), F.col("to") == F.col("end")).select(F.col("to").alias("node"), (F.col("hop") + F.col("cost")).alias("hop")).where(F.col("hop") <= hops)
        reached = reached.groupBy("node").agg(F.min("hop").alias("hop"))
        known = seen.select("node", F.col("hop").alias("old"))
        frontier = staged(reached.join(known, "node", "left").where("old IS NULL OR hop < old").select("node", "hop"), "hop")
        seen = staged(seen.unionByName(frontier).groupBy("node").agg(F.min("hop").alias("hop")), "hop")
    return seen


def budget(raw: float, basis: int) -> int:
    """A number of calls: a whole number of 1 or more as it is, below 1 a share of ``basis``; never less than 1 (survey 11.16)."""
    return max(1, int(raw * basis if 0 < raw < 1 else raw))


def missingness(features: DataFrame, weights: dict[str, float], bias: float = 0.0) -> DataFrame:
    """``features`` with score: the probability that a subgraph lacks a fact, by a logistic model of weights given from outside (survey 11.12).

    Missing features count as 0; other models have the same shape: a frame of features in, a score out.
    """
    total: Column = F.lit(float(bias))
    for name, w in weights.items():
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * F.lit(float(w))
    return features.withColumn("score", 1 / (1 + F.exp(-total)))


def root_order(roots: list, near: dict, first=None) -> list:
    """Each next root is the first unused one that is in ``near`` of the current, else the first unused (survey 11.10).

    ``roots`` (shuffled by seed beforehand) and ``near`` are of the size of a budget of roots, not of the graph.
    """
    left = dict.fromkeys(roots)
    place = {r: i for i, r in enumerate(left)}
    out: list = []
    now = first if first in left else next(iter(left), None)
    while now is not None:
        out.append(now)
        del left[now]
        now = min((r for r in near.get(now, ()) if r in left), key=place.get, default=next(iter(left), None))
    return out


def evidence_batches(pairs: DataFrame, max_pairs: int = BATCH_PAIRS, max_chunks: int = BATCH_CHUNKS) -> DataFrame:
    """(root, batch, place, pair): each pair joins the batch of its root that shares most chunks with it, within the limits (survey 11.19).

    ``pairs`` (root, pair, seq, chunks) are few a root (the budget of candidates); roots are independent, so they are dealt out.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        batches: list[tuple[list, set]] = []
        for r in group.sort_values("seq").itertuples():
            own = set(r.chunks)
            open_ = [(len(held & own), -i) for i, (members, held) in enumerate(batches) if len(members) < max_pairs and len(held | own) <= max_chunks]
            at = -max(open_)[1] if open_ else len(batches)
            if at == len(batches):
                batches.append(([], set()))
            batches[at][0].append(r.pair)
            batches[at][1].update(own)
        rows = [(group["root"].iloc[0], b, p, pair) for b, (members, _) in enumerate(batches) for p, pair in enumerate(members)]
        return pd.DataFrame(rows, columns=["root", "batch", "place", "pair"])

    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.groupBy("root").applyInPandas(run, f"root {kind['root']}, batch int, place int, pair {kind['pair']}")


def epoch_masks(pairs: DataFrame, epochs: int, share: float = 0.15) -> DataFrame:
    """(epoch, pairs' columns) held out in each epoch: the first by hash, a share of all and one at least (survey 11.36)."""
    keys = pairs.columns
    most = max(1, int(pairs.count() * share))
    rows = pairs.crossJoin(F.broadcast(pairs.sparkSession.range(epochs).withColumnRenamed("id", "epoch")))  # a copy an epoch
    rows = rows.withColumn("h", F.md5(F.concat_ws("-", "epoch", *keys)))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("epoch").orderBy("h", *keys))).where(F.col("n") <= most).select("epoch", *keys)


def inject(nodes: DataFrame, edges: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report) after completed relations are put into a stored graph (survey 11.18).

    Relations merge as extracted ones do; ends that no node has become UNKNOWN nodes. The report has each relation's status:
    self loop, merged into a stored edge, or new.
    """
    merged = lifecycle.merge_into_relations(relations, edges)
    kept = edges.join(merged.select("src", "tgt"), ["src", "tgt"], "left_anti").select("src", "tgt", "weight", "keywords", "description", "source_id")
    ends = merged.select(F.explode(F.array("src", "tgt")).alias("name")).distinct().join(nodes.select("name"), "name", "left_anti")
    all_nodes = nodes.select("name", "entity_type").unionByName(ends.withColumn("entity_type", F.lit("UNKNOWN")))
    pair = relations.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct()
    stored = edges.select("src", "tgt").distinct().withColumn("has", F.lit(True))
    status = F.when(F.col("src") == F.col("tgt"), "self loop").when(F.col("has"), "merged").otherwise("new")
    report = pair.join(stored, ["src", "tgt"], "left").select("src", "tgt", status.alias("status"))
    return all_nodes, kept.unionByName(merged.select(*kept.columns)), report


def augmented_documents(docs: DataFrame, hidden: DataFrame) -> DataFrame:
    """``docs`` (chunk, triples, entities) with the ``hidden`` triples (chunk, triple) that cite them, each once, and their ends as entities (survey 7.4)."""
    more = hidden.groupBy("chunk").agg(F.array_sort(F.collect_set("triple")).alias("new"))
    rows = docs.join(more, "chunk", "left").withColumn("new", F.coalesce("new", F.array().cast("array<array<string>>")))
    ends = F.array_sort(F.array_distinct(F.flatten(F.transform("new", lambda t: F.array(t[0], t[2])))))
    return rows.select("chunk", F.array_union("triples", "new").alias("triples"), F.array_union("entities", ends).alias("entities"))


def relation_paths(relations: DataFrame, chunks: DataFrame, otherwise: str = "hidden") -> DataFrame:
    """(relation, file_path): the distinct paths of its evidence chunks in order, or a constant (survey 2.21). relations: relation, at, chunk; chunks: chunk, file_path."""
    rows = relations.join(chunks, "chunk", "left")
    once = rows.where("file_path <> ''").groupBy("relation", "file_path").agg(F.min("at").alias("at"))
    lists = once.groupBy("relation").agg(F.array_sort(F.collect_list(F.struct("at", "file_path"))).alias("x"))
    joined = T.join_list(F.transform("x", lambda s: s["file_path"]))
    return relations.select("relation").distinct().join(lists, "relation", "left").select("relation", F.coalesce(joined, F.lit(otherwise)).alias("file_path"))


def signature(config: dict) -> str:
    """SHA-256 of a configuration, whatever the order of its keys (survey 12.10)."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def cache_fits(summary: dict, config: dict, nodes: int, edges: int) -> bool:
    """Whether cached results are of this configuration and of a graph of this size (survey 12.10)."""
    return (summary.get("signature"), summary.get("nodes"), summary.get("edges")) == (signature(config), nodes, edges)


def bellman_ford(edges: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """(node, cost): least sum of weights over at most ``rounds`` edges (src, dst, weight) from ``start`` (node, cost) (survey 11.26).

    Only nodes whose cost fell in a round are followed in the next; it ends early when none did.
    """
    best = staged(start.groupBy("node").agg(F.min("cost").alias("cost")), "relax")
    moved = best
    for _ in range(rounds):
        reached = edges.join(moved, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("weight")).alias("cost"))
        old = best.select("node", F.col("cost").alias("old"))
        moved = staged(reached.join(old, "node", "left").where("old IS NULL OR cost < old").select("node", "cost"), "relax")
        if moved.isEmpty():
            break
        best = staged(best.unionByName(moved).groupBy("node").agg(F.min("cost").alias("cost")), "relax")
    return best


def path_beams(edges: DataFrame, start, targets: DataFrame, layers: int, beam: int, most: int) -> DataFrame:
    """(target, place, path, score) of the best paths from ``start`` to ``targets`` (node) by mean edge weight (survey A18).

    In each layer a node keeps its ``beam`` best sums; no path leaves a target; ``most`` paths a target are given. Paths are ordered by
    score, then as lists.
    """
    ends = targets.select(F.col("node").alias("target")).distinct()
    now = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.array(F.lit(start)).alias("path"), F.lit(0.0).alias("sum"))
    found = None
    for layer in range(1, layers + 1):
        steps = now.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), (F.col("sum") + F.col("weight")).alias("sum"))
        order = Window.partitionBy("node").orderBy(F.desc(F.round("sum", 9)), "path")
        kept = staged(steps.withColumn("n", F.row_number().over(order)).where(F.col("n") <= beam).drop("n"), "beam")
        here = kept.join(ends, F.col("node") == F.col("target")).select("target", "path", F.round(F.col("sum") / layer, 9).alias("score"))
        found = here if found is None else found.unionByName(here)
        now = kept.join(ends, F.col("node") == F.col("target"), "left_anti")
    order = Window.partitionBy("target").orderBy(F.desc("score"), "path")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("target", "place", "path", "score")


def logical_answers(edges: DataFrame, query: tuple) -> DataFrame:
    """(node) that answer a nested query over ``edges`` (src, relation, dst) (survey 11.30).

    ("node", value); ("step", relation, query): what the relation leads to from its answers; ("and", ...), ("or", ...) of queries;
    ("but", query, other): answers of the first that are not answers of the other.
    """
    kind, *parts = query
    if kind == "node":
        return edges.sparkSession.range(1).select(F.lit(parts[0]).alias("node"))
    if kind == "step":
        from_ = logical_answers(edges, parts[1])
        return edges.where(F.col("relation") == parts[0]).join(from_, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
    sides = [logical_answers(edges, q) for q in parts]
    out = sides[0]
    for other in sides[1:]:
        out = out.join(other, "node", "left_semi") if kind == "and" else out.join(other, "node", "left_anti") if kind == "but" else out.union(other).distinct()
    return out


def deletable(members: DataFrame, root, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node) of a subgraph's ``members`` that may be hidden: entities but the root with a fact edge (src, dst) inside it (survey 11.34)."""
    inside = facts.join(members.select(F.col("node").alias("src")), "src", "left_semi").join(members.select(F.col("node").alias("dst")), "dst", "left_semi")
    ends = inside.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return members.join(nodes.where("node_type = 0"), "node", "left_semi").where(F.col("node") != root).join(ends, "node", "left_semi").select("node")


def corruption_views(members: DataFrame, facts: DataFrame, seed: int = 42, mask: float = 0.2, delete: float = 0.08, least: int = 1) -> DataFrame:
    """(root, view, label, src, dst): the fact edges of each subgraph (root, node) as they are (full, 0), and with parts taken away (1) (survey 11.11).

    Masked views lack a share of the edges, deleted ones a share of the nodes with an edge, but not the root; one at least, chosen by the order of hashes, so
    that reruns agree. At least ``least`` edges must stay: fewer are masked then, and a deleted view that would have fewer is not given. ``facts``
    (src, dst) count once in either direction.
    """
    ends = [members.select(F.col("root").alias(f"root_{i}"), F.col("node").alias(f"node_{i}")) for i in (0, 1)]
    once = facts.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    inside = once.join(ends[0], F.col("src") == F.col("node_0")).join(ends[1], (F.col("dst") == F.col("node_1")) & (F.col("root_0") == F.col("root_1")))
    edges = staged(inside.select(F.col("root_0").alias("root"), "src", "dst").distinct(), "views")
    by_hash = lambda *c: Window.partitionBy("root").orderBy(F.md5(F.concat_ws("-", F.lit(seed), "root", *c)), *c)
    of_root = Window.partitionBy("root")
    quota = lambda n, share: F.greatest(F.lit(1), F.bround(n * share).cast("int"))
    ranked = edges.withColumn("k", F.row_number().over(by_hash("src", "dst"))).withColumn("n", F.count(F.lit(1)).over(of_root))
    masked = ranked.where((F.col("n") > least) & (F.col("k") > F.least(F.col("n") - least, quota(F.col("n"), mask)))).select("root", "src", "dst")
    nodes = edges.select("root", F.explode(F.array("src", "dst")).alias("node")).distinct().where("node <> root")
    gone = nodes.withColumn("k", F.row_number().over(by_hash("node"))).withColumn("n", F.count(F.lit(1)).over(of_root)).where(F.col("k") <= quota(F.col("n"), delete)).select("root", "node")
    kept = edges.join(gone.select("root", F.col("node").alias("src")), ["root", "src"], "left_anti").join(gone.select("root", F.col("node").alias("dst")), ["root", "dst"], "left_anti")
    kept = kept.withColumn("n", F.count(F.lit(1)).over(of_root)).where(F.col("n") >= least)
    view = lambda df, name, label: df.select("root", F.lit(name).alias("view"), F.lit(label).alias("label"), "src", "dst")
    return view(edges, "full", 0).unionByName(view(masked, "masked", 1)).unionByName(view(kept, "deleted", 1))


def edge_kind(src: Column, dst: Column, weight: Column) -> Column:
    """0 facts between entities (weight 1 or more), 1 synonyms (a fraction below 1), 2 an entity and a chunk, else null (survey 2.9)."""
    entity, chunk = lambda c: c.startswith("entity-"), lambda c: c.startswith("chunk-")
    both = entity(src) & entity(dst)
    mixed = entity(src) & chunk(dst) | chunk(src) & entity(dst)
    return F.when(both & (weight >= 1), 0).when(both & (weight < 1) & (weight != F.floor(weight)), 1).when(mixed, 2)


def segments(values: DataFrame) -> Iterator[tuple[str, DataFrame]]:
    """Sum and mean of each segment of (segment, value) (survey 4.29)."""
    yield "sum", values.groupBy("segment").agg(F.sum("value").alias("value"))
    yield "mean", values.groupBy("segment").agg(F.avg("value").alias("value"))
