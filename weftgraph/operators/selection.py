"""Greedy selection of sets that overlap little, in rounds of joins instead of one walk down the list.

Taken by falling score, a set is chosen if it is not too alike to a chosen one. That is the independent set of the graph of too similar sets that
prefers better ones, and it can be found in rounds: whatever has no better undecided neighbour is chosen, its neighbours
are dropped. The result is the sequential one, whatever the order of work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_staged, staged

#: Candidates of the first slice at least, and of a slice that is still sorted; beyond, all that are left are compared at once.
FIRST_SLICE, MOST_SLICE = 1024, 1 << 20


def _best_of_equal(rows: DataFrame) -> DataFrame:
    """Of sets with the same members only the best can be chosen; empty sets are alike to nothing."""
    some = rows.where(F.size("members") > 0)
    best = some.groupBy("members").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("x")).select("x.id", (-F.col("x.s")).alias("score"), "members")
    return best.unionByName(rows.where(F.size("members") == 0))


def conflicts(rows: DataFrame, overlap: float) -> DataFrame:
    """(better, worse): pairs of (id, score, members) whose sets' Jaccard similarity is above ``overlap``.

    Members are ordered from the rarest; two such sets share one of their first |set| - ceil(overlap |set|) + 1 members, so only sets that
    meet there and are of like size are compared.
    """
    each = rows.select("id", "score", F.size("members").alias("n"), F.explode("members").alias("m"))
    often = each.groupBy(F.col("m").alias("m_")).agg(F.count(F.lit(1)).alias("f"))
    ordered = each.join(often, F.col("m") == F.col("m_")).groupBy("id", "score", "n").agg(F.array_sort(F.collect_list(F.struct("f", "m"))).alias("x"))
    upto = F.col("n") - F.ceil(F.lit(overlap) * F.col("n") - 1e-9) + 1
    short = staged(ordered.select("id", "score", "n", F.explode(F.slice("x", F.lit(1), F.least(upto, F.col("n")).cast("int"))).alias("y")).select("id", "score", "n", "y.m"), "selection-prefix")
    a, b = (short.select(*[F.col(c).alias(f"{c}_{side}") for c in ("id", "score", "n", "m")]) for side in "ab")
    better = (F.col("score_a") > F.col("score_b")) | ((F.col("score_a") == F.col("score_b")) & (F.col("id_a") < F.col("id_b")))
    sizes = (F.col("n_a") >= overlap * F.col("n_b")) & (F.col("n_b") >= overlap * F.col("n_a"))
    met = a.join(b, (F.col("m_a") == F.col("m_b")) & better & sizes).select("id_a", "id_b").distinct()
    sets = [rows.select(F.col("id").alias(f"i_{side}"), F.col("members").alias(f"s_{side}")) for side in "ab"]
    whole = met.join(sets[0], F.col("id_a") == F.col("i_a")).join(sets[1], F.col("id_b") == F.col("i_b"))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    out = staged(whole.where(shared > overlap * (F.size("s_a") + F.size("s_b") - shared)).select(F.col("id_a").alias("better"), F.col("id_b").alias("worse")), "selection-conflicts")
    drop_staged(short)
    return out


def _chosen(rows: DataFrame, overlap: float, budget: int) -> DataFrame:
    """(id, score) of the sets of ``rows`` (id, score, members) that are chosen; of more than ``budget``, at least the best so many.

    Rounds end when nothing is undecided, or when as many as the budget are chosen above everything undecided.
    """
    order = [F.desc("score"), F.asc("id")]
    rows = staged(_best_of_equal(rows), "selection-rows")
    edges = conflicts(rows, overlap)
    open_, chosen = rows.select("id", "score"), None
    while True:
        winners = open_.join(edges.select(F.col("worse").alias("id")), "id", "left_anti")
        won = staged(winners, "selection-won")
        chosen = won if chosen is None else chosen.unionByName(won)
        gone = edges.join(won.select(F.col("id").alias("better")), "better", "left_semi").select(F.col("worse").alias("id")).distinct()
        out = staged(gone.union(won.select("id")), "selection-decided")
        left = staged(open_.join(out, "id", "left_anti"), "selection-open")
        kept = edges.join(out.select(F.col("id").alias("better")), "better", "left_anti").join(out.select(F.col("id").alias("worse")), "worse", "left_anti")
        kept = staged(kept.select("better", "worse"), "selection-conflicts")
        for df in (edges, out, open_):
            drop_staged(df)
        open_, edges = left, kept
        best = open_.orderBy(*order).first()
        if best is None:
            break
        above = (F.col("score") > best["score"]) | ((F.col("score") == best["score"]) & (F.col("id") < best["id"]))
        if chosen.where(above).limit(budget).count() >= budget:
            chosen = chosen.where(above)
            break
    out = staged(chosen, "selection-chosen")
    for df in (open_, edges, chosen):
        drop_staged(df)
    return out


def _too_alike(rows: DataFrame, chosen: DataFrame, overlap: float) -> DataFrame:
    """(id) of ``rows`` that are more alike to a set of ``chosen`` than ``overlap``; both have (id, members)."""
    a = rows.select("id", F.size("members").alias("n"), F.explode("members").alias("m"))
    b = chosen.select(F.col("id").alias("c"), F.size("members").alias("k"), F.explode("members").alias("m_"))
    shared = a.join(b, F.col("m") == F.col("m_")).groupBy("id", "c", "n", "k").agg(F.count(F.lit(1)).alias("x"))
    return shared.where(F.col("x") > overlap * (F.col("n") + F.col("k") - F.col("x"))).select("id").distinct()


def greedy(candidates: DataFrame, threshold: float, overlap: float, budget: int) -> DataFrame:
    """(place, id, score) of at most ``budget`` of (id, score, members, evidence), best score first, equal scores by id.

    A candidate needs a score of at least ``threshold`` and some evidence, and must not be more alike to a chosen one than ``overlap``.
    What is chosen depends on better sets only, so candidates are compared slice by slice from the best, each slice four times the one before
    and without the sets that are too alike to those chosen above it, until the budget is full or no candidate is left.
    """
    fit = candidates.where((F.col("score") >= threshold) & (F.size("evidence") > 0)).select("id", "score", F.array_sort(F.array_distinct(F.coalesce("members", F.array()))).alias("members"))
    order = [F.desc("score"), F.asc("id")]
    if overlap >= 1:
        chosen = fit.select("id", "score")
    else:
        fit = staged(fit, "selection-fit")
        rest, chosen, found, size = fit, None, 0, max(FIRST_SLICE, 4 * budget)
        while found < budget:
            part = staged(rest.orderBy(*order).limit(size) if size <= MOST_SLICE else rest, "selection-slice")
            last = part.orderBy(F.asc("score"), F.desc("id")).first()
            if last is None:
                drop_staged(part)
                break
            won = _chosen(part, overlap, budget - found)
            with_members = staged(part.join(won.select("id"), "id", "left_semi"), "selection-chosen")
            drop_staged(part)
            drop_staged(won)
            chosen = with_members if chosen is None else chosen.unionByName(with_members)
            found += with_members.count()
            if size > MOST_SLICE:
                break
            below = fit.where((F.col("score") < last["score"]) | ((F.col("score") == last["score"]) & (F.col("id") > last["id"])))
            rest, size = below.join(_too_alike(below, chosen, overlap), "id", "left_anti"), 4 * size
        drop_staged(fit)
        chosen = fit.sparkSession.createDataFrame([], fit.schema) if chosen is None else chosen
    return chosen.orderBy(*order).limit(budget).select(F.row_number().over(Window.orderBy(*order)).alias("place"), "id", "score")
