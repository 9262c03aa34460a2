"""Greedy selection in rounds against the walk down the list."""

import random

import pytest

from weftgraph.operators import selection


def by_force(rows, threshold, overlap, budget):
    chosen = []
    for i, score, members, evidence in sorted(rows, key=lambda r: (-r[1], r[0])):
        m = set(members or [])
        if len(chosen) < budget and score >= threshold and evidence and not any(len(m & c) > overlap * len(m | c) for _, c in chosen):
            chosen.append((i, m))
    return [i for i, _ in chosen]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, score double, members array<int>, evidence array<int>")


@pytest.mark.parametrize("overlap, budget", [(0.5, 1000), (0.0, 1000), (0.3, 7), (0.8, 40), (1.0, 25)])
def test_equals_the_walk(spark, overlap, budget):
    rng = random.Random(int(overlap * 10) + budget)
    rows = []
    for i in range(260):
        base = rng.choice([0, 5, 10, 40])
        members = [base + rng.randrange(12) for _ in range(rng.randrange(0, 9))]
        rows.append((i, rng.choice([0.1, 0.4, 0.5, 0.5, 0.9]), members if i % 50 else None, [1] if rng.random() < 0.9 else []))
    rows += [(1000 + i, 0.5, [1, 2, 3, 4], [1]) for i in range(60)]  # copies
    got = selection.greedy(frame(spark, rows), 0.3, overlap, budget).orderBy("place").collect()
    assert [r["id"] for r in got] == by_force(rows, 0.3, overlap, budget)
    assert [r["place"] for r in got] == list(range(1, len(got) + 1))


def test_a_chain_takes_many_rounds(spark):
    rows = [(i, 1 - i / 100, [i, i + 1], [1]) for i in range(14)]  # each overlaps its neighbours
    got = selection.greedy(frame(spark, rows), 0.0, 0.2, 100).orderBy("place").collect()
    assert [r["id"] for r in got] == list(range(0, 14, 2))


def test_nothing_to_choose(spark):
    assert selection.greedy(frame(spark, []), 0.0, 0.5, 3).count() == 0
    assert selection.greedy(frame(spark, [(1, 0.1, [1], [1])]), 0.5, 0.5, 3).count() == 0


@pytest.mark.parametrize("budget", [3, 40, 1000])
def test_slices_equal_the_walk(spark, budget, monkeypatch):
    monkeypatch.setattr(selection, "FIRST_SLICE", 4)
    monkeypatch.setattr(selection, "MOST_SLICE", 200)
    rng = random.Random(budget)
    rows = [(i, rng.choice([0.5, 0.6, 0.7, 0.8]), [rng.randrange(60) for _ in range(rng.randrange(0, 6))], [1]) for i in range(300)]
    got = selection.greedy(frame(spark, rows), 0.3, 0.2, budget).orderBy("place").collect()
    assert [r["id"] for r in got] == by_force(rows, 0.3, 0.2, budget)


def test_a_small_budget_compares_only_the_best(spark, monkeypatch):
    seen = []
    own = selection.conflicts
    monkeypatch.setattr(selection, "conflicts", lambda rows, overlap: seen.append(rows.count()) or own(rows, overlap))
    rows = [(i, 0.5 + i / 100_000, [i, i + 1], [1]) for i in range(5000)]
    got = selection.greedy(frame(spark, rows), 0.3, 0.2, 5).orderBy("place").collect()
    assert [r["id"] for r in got] == [4999, 4997, 4995, 4993, 4991] and max(seen) < 2000
