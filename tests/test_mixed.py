"""Chunk choice against a walk in Python, and the defined cases of a context."""

import random
from collections import defaultdict

import pytest

from weftgraph.operators import mixed


def by_force(items, lists, most, without=()):
    """Chunks in order of choice for one query: items in order, their chunk lists."""
    votes, own = defaultdict(int), []
    for i in items:
        mine = []
        for c in lists.get(i, []):
            if c in without:
                continue
            votes[c] += 1
            if votes[c] == 1:
                mine.append(c)
        own.append(mine)
    # without others there, an item that lists chunks keeps its quota even if earlier items have them all
    own = [m for i, m in zip(items, own) if (m if without is not None and without != () else lists.get(i))]
    own = [sorted(m, key=lambda c: -votes[c]) for m in own]
    n = len(own)
    if n == 0:
        return []
    if n == 1:
        return own[0][:most]
    quota = [int(round(most - i / (n - 1) * (most - 1))) for i in range(n)]
    out, used, spare = [], [], 0
    for m, q in zip(own, quota):
        out += m[:q]
        used.append(min(q, len(m)))
        spare += max(0, q - len(m))
    for _ in range(spare):
        for k, m in enumerate(own):
            if used[k] < len(m):
                out.append(m[used[k]])
                used[k] += 1
                break
    return out


@pytest.mark.parametrize("excluding", [False, True])
def test_chosen_chunks(spark, excluding):
    rng = random.Random(9)
    items, lists, gone = {}, {}, {}
    for i in range(40):
        lists[i] = rng.sample(range(60), rng.choice([0, 1, 2, 5, 9]))
    for q in range(14):
        items[q] = rng.sample(range(40), q % 9)
        gone[q] = set(rng.sample(range(60), 20)) if excluding else ()
    frame = spark.createDataFrame([(q, i, p + 1) for q, found in items.items() for p, i in enumerate(found)], "q int, id int, place int")
    listed = spark.createDataFrame([(i, at, c) for i, cs in lists.items() for at, c in enumerate(cs)], "id int, at int, chunk int")
    without = spark.createDataFrame([(q, c) for q in gone for c in gone[q]], "q int, id int") if excluding else None
    got = defaultdict(list)
    for r in mixed.chosen_chunks(frame, listed, 4, without).orderBy("q", "pos").collect():
        got[r["q"]].append(r["id"])
    for q in items:
        assert got[q] == by_force(items[q], lists, 4, gone[q])


def test_modes_nulls_and_budgets(spark):
    v = lambda *x: [float(y) for y in x]
    schema = "id bigint, embedding array<float>, tokens int"
    entities = spark.createDataFrame([(1, v(1, 0), 10), (2, v(0.9, 0.1), 10), (3, None, 10)], schema)
    relations = spark.createDataFrame([(10, 1, 3, 1.0, v(0, 1), 10), (11, 2, 3, 2.0, None, 10)], "id bigint, src bigint, dst bigint, weight double, embedding array<float>, tokens int")
    lists = spark.createDataFrame([(1, 0, 100), (2, 0, 101), (3, 0, 101)], "id bigint, at int, chunk bigint")
    of_relations = spark.createDataFrame([(10, 0, 102)], "id bigint, at int, chunk bigint")
    chunks = spark.createDataFrame([(100, None, 50, "x"), (101, v(1, 0), 50, "y"), (102, v(1, 1), 50, None)], "id bigint, embedding array<float>, tokens int, file_path string")
    stores = mixed.Stores(entities, relations, lists, of_relations, chunks)
    asks = [(0, "local", v(1, 0)), (1, "global", v(0, 1)), (2, "naive", v(1, 0)), (3, "bypass", v(1, 0)), (4, "other", v(1, 0)), (5, "mix", None), (6, "mix", v(1, 0.0))]
    queries = spark.createDataFrame([(q, m, 5, e, e, e) for q, m, e in asks], "q bigint, mode string, tokens int, low array<float>, high array<float>, asked array<float>")
    rows = mixed.context(queries, stores, mixed.Limits(total_tokens=10_000)).orderBy("q", "kind", "place").collect()
    got = defaultdict(list)
    for r in rows:
        got[r["q"], r["kind"]].append((r["id"], r["reference_id"]))
    assert set(q for q, _ in got) == {0, 1, 2, 6}
    assert got[0, "entity"] == [(1, None), (2, None)] and got[0, "relation"] == [(11, None), (10, None)]
    assert got[0, "chunk"] == [(100, "1"), (102, ""), (101, "2")]
    assert got[1, "entity"] == [(1, None), (3, None)] and got[1, "relation"] == [(10, None)]
    assert got[2, "chunk"] == [(101, "1"), (102, "")] and (2, "entity") not in got
    tight = mixed.context(queries, stores, mixed.Limits(entity_tokens=10, relation_tokens=0, total_tokens=270)).collect()
    assert {(r["kind"], r["id"]) for r in tight if r["q"] == 0} == {("entity", 1), ("chunk", 100)}
