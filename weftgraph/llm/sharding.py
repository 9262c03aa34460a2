"""Sharding by balanced label propagation.

Linked documents (here: equal texts) start in shards dealt by hash. Each round joins every linked
row with its group's tally by shard and lets it move to the shard where most of its neighbours
are, under quotas: for each shard, arrivals are summed by hash bucket and only the buckets that fit
its room may enter. Groups that fill a good part of a shard by themselves (there are at most a few
per shard, whatever the input) are laid out over whole shards first. Unlinked rows have no
neighbours; they fill the rooms that are left, which makes the counts of rows even: law ``rows``.

Defined cases: a null text is an empty one, for size, checksum and links; equal rows are rows of
their own; null ids are allowed; an empty table gives an empty result; with fewer rows than shards some shards
stay empty; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_staged, small, staged, table, text_or_empty

SHARDS = 24
#: Rounds of propagation at most; it ends when nothing wishes to move, or nothing could in two rounds.
ROUNDS = 40
#: Groups of linked rows that are broadcast to their rows at most (some 60 bytes each); more are joined by shuffle, hot ones split.
SENT_GROUPS = 200_000
#: A group of more than this part of a shard's quota is laid out by itself.
LARGE = 0.5
#: Hash buckets in which arrivals are summed: shards x BUCKETS sums reach the driver, whatever the input.
BUCKETS = 256
#: Rows of one sorted run when rows are numbered.
RUN_ROWS = 20_000
#: Runs that laid-out rows, and likewise other ones, of a shard have at least, and rows of a group that always stay in one.
LEAST_RUNS, RUN_GROUP = 32, 16
#: Runs whose beginnings (some 24 bytes each) are broadcast at most; more are joined by shuffle.
SENT_RUNS = 1_000_000


def _pick(options: list, of: Column) -> Column:
    """The option at index ``of``."""
    return F.element_at(F.array(*[F.lit(int(x)) for x in options]), (of + 1).cast("int"))


def ranked(df: DataFrame, by: list[str], order: list, runs: int, name: str, keys: int) -> DataFrame:
    """``df`` (staged) with its rows numbered from 0 within ``by`` (of ``keys`` values at most), in hash order of runs, then ``order``.

    No task sorts all of a shard: rows are numbered within (by, run), and the runs' counts, of which
    there are keys x runs at most, give where each run begins.
    """
    df = df.withColumn("run_", F.pmod("hash", F.lit(runs)))
    counts = df.groupBy(*by, "run_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(*by).orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"{c}_k") for c in by], F.col("run_").alias("run_k"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    inside = Window.partitionBy(*by, "run_").orderBy(*order)
    df = df.withColumn("at_", F.row_number().over(inside) - 1)
    on = F.col("run_") == F.col("run_k")
    for c in by:
        on = on & (F.col(c) == F.col(f"{c}_k"))
    return df.join(F.broadcast(starts) if keys * runs <= SENT_RUNS else starts, on).withColumn(name, F.col("start_") + F.col("at_")).drop("run_", "run_k", "at_", "start_", *[f"{c}_k" for c in by])


def lay_out(large: list, room: list[int]) -> dict:
    """For each large group, [(end of its rows' numbers, shard)]: emptiest shards first, filled to their room."""
    plan = {}
    for group, n in large:
        left, done, parts = n, 0, []
        while left > 0:
            shard = max(range(len(room)), key=lambda s: (room[s], -s))
            take = min(left, room[shard]) if room[shard] > 0 else left
            room[shard] -= take
            left -= take
            done += take
            parts.append((done, shard))
        plan[group] = parts
    return plan


def propagate(rows: DataFrame, quota: list[int], rounds: int = ROUNDS, runs: int = 16) -> DataFrame:
    """Linked rows (group, hash, ...) with columns shard and fixed (laid out by itself); about at most ``quota`` rows a shard.

    ``rows`` has only groups of two rows or more, and a column n with their group's size.
    """
    shards = len(quota)
    large = rows.where(F.col("n") > F.lit(LARGE * min(q for q in quota) if min(quota) else 0)).groupBy("group").agg(F.first("n").alias("n"))
    # at most shards / LARGE groups can be that large, and a few rows more when quotas are tiny
    large = [(r["group"], r["n"]) for r in large.orderBy(F.desc("n"), "group").limit(int(shards / LARGE) + 1).collect()]
    room = list(quota)
    plan = lay_out(large, room)
    start = F.pmod("hash", F.lit(shards)).cast("int")
    fixed = F.col("group").isin(list(plan)) if plan else F.lit(False)
    state = rows.where(~fixed).withColumn("shard", start).withColumn("fixed", F.lit(False))
    if plan:
        # rows of a large group are numbered, so that each of its shards gets exactly what was laid out
        many = ranked(rows.where(fixed), ["group"], ["hash"], runs, "at", len(plan))
        to = F.lit(0)
        for group, parts in plan.items():
            inside = F.lit(parts[-1][1])
            for end, shard in reversed(parts[:-1]):
                inside = F.when(F.col("at") < end, F.lit(shard)).otherwise(inside)
            to = F.when(F.col("group") == group, inside).otherwise(to)
        state = state.unionByName(many.withColumn("shard", to.cast("int")).withColumn("fixed", F.lit(True)).drop("at"))
    state, idle = staged(state, "shard-round"), 0
    for r in range(rounds):
        loads = {x["shard"]: x["n"] for x in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        tally = state.where(~F.col("fixed")).groupBy("group", "shard").agg(F.count(F.lit(1)).alias("here"))
        mix = F.xxhash64("group", "shard")
        # staged, so that both sides of the join are shuffles of their own, which can be split at a hot group
        best = staged(tally.groupBy(F.col("group").alias("g")).agg(F.max_by("shard", F.struct("here", mix)).alias("to")), "shard-best")
        wish = state.join(small(best, SENT_GROUPS), F.col("group") == F.col("g"), "left").drop("g")
        wish = wish.withColumn("to", F.when(F.col("to") != F.col("shard"), F.col("to"))).withColumn("bucket", F.pmod(F.xxhash64("group", F.lit(r)), F.lit(BUCKETS)).cast("int"))
        wish = staged(wish, "shard-wish")
        flows = wish.where("to IS NOT NULL").groupBy("shard", "to", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # shards x shards x BUCKETS sums at most
        drop_staged(best)
        if not flows:
            drop_staged(wish)
            break
        arrive = [[0] * BUCKETS for _ in quota]
        leave = [0] * shards
        for x in flows:
            arrive[x["to"]][x["bucket"]] += x["n"]
            leave[x["shard"]] += x["n"]
        ends = []
        for s in range(shards):
            space, end = quota[s] - loads.get(s, 0) + leave[s], 0
            while end < BUCKETS and arrive[s][end] <= space:
                space -= arrive[s][end]
                end += 1
            ends.append(end)
        moved = sum(sum(a[:e]) for a, e in zip(arrive, ends, strict=True))
        idle = 0 if moved else idle + 1
        if idle:  # nothing fits; other buckets come first in the next round
            drop_staged(wish)
            if idle > 1:
                break
            continue
        goes = F.col("to").isNotNull() & (F.col("bucket") < _pick(ends, F.coalesce("to", F.lit(0))))
        previous, state = state, staged(wish.withColumn("shard", F.when(goes, F.col("to")).otherwise(F.col("shard"))).drop("to", "bucket"), "shard-round")
        drop_staged(previous)
        drop_staged(wish)
    return state


def shard_rows(base: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``base`` (group, ...) with shard and slot; counts of rows differ by one at most.

    Rows with equal ``group`` are linked; a null group links nothing.
    """
    keep = list(base.columns)
    base = staged(base.withColumn("hash", F.xxhash64(*[c for c in keep])), "shard-base")
    sizes = base.where("group IS NOT NULL").groupBy(F.col("group").alias("g")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = staged(sizes, "shard-sizes")
    marked = staged(base.join(small(sizes, SENT_GROUPS), F.col("group") == F.col("g"), "left").drop("g"), "shard-marked")
    drop_staged(sizes)
    total = marked.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    part = max(LEAST_RUNS, total // (2 * shards * RUN_ROWS))
    runs = 3 * part
    linked = propagate(marked.where("n IS NOT NULL"), quota, rounds, runs)
    # laid-out rows come first in a shard's order, then groups too large for one run, dealt over several, then whole
    # small groups, so that what exceeds its quota is few groups' rows
    order = ["group", *[c for c in keep if c != "group"]]
    many = F.col("n") > max(RUN_GROUP, min(quota) // (4 * part))
    place = F.when(F.col("fixed") | many, F.pmod("hash", F.lit(part)) + F.when(F.col("fixed"), 0).otherwise(part))
    place = place.otherwise(2 * part + F.pmod(F.xxhash64("group"), F.lit(part)))
    linked = linked.withColumn("own_", F.col("hash")).withColumn("hash", place)
    linked = staged(ranked(linked, ["shard"], order, runs, "at", shards).withColumn("hash", F.col("own_")).drop("own_", "fixed"), "shard-linked")
    stay = F.col("at") < _pick(quota, F.col("shard"))
    counts = {x["shard"]: x["n"] for x in linked.where(stay).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = [counts.get(s, 0) for s in range(shards)]
    ends, end = [], 0
    for s in range(shards):
        end += quota[s] - held[s]
        ends.append(end)
    fill = marked.where("n IS NULL").unionByName(linked.where(~stay).drop("shard", "at")).withColumn("all_", F.lit(0))
    fill = ranked(fill, ["all_"], ["hash", *keep], runs * shards, "at", 1).drop("all_")
    to = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("at")))
    fill = fill.withColumn("shard", F.least(to, F.lit(shards - 1)).cast("int"))
    starts = [0, *ends[:-1]]
    fill = fill.withColumn("slot", F.col("at") - _pick(starts, F.col("shard")) + _pick(held, F.col("shard")))
    both = linked.where(stay).withColumn("slot", F.col("at")).unionByName(fill.select(*linked.columns, "slot"))
    return both.select(*keep, F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    base = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("group"))
    out = shard_rows(base)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
