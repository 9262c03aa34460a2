"""Hidden-triple completion as one job: subgraphs, scores, selection, evidence, completed triples, the graph with them.

Every stage is a table below a folder, under a signature of the stage's settings, of the input graph and of all stages before it. A run reads
the stages that are there and makes the others, so a job that broke off goes on where it was, and a changed setting
remakes what depends on it and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import mining, selection


@dataclass
class Settings:
    width: int = 60  # neighbours of a root in its subgraph
    threshold: float = 0.7  # least score
    overlap: float = 0.5  # most likeness of two chosen subgraphs
    budget: int = 100  # chosen subgraphs
    triples: int = 120  # of a subgraph's evidence
    chunks: int = 15


class StagedJob:
    """Tables by name and signature; ``reused`` and ``made`` tell what a run did."""

    def __init__(self, spark: SparkSession, folder: str, start: dict):
        self.spark, self.folder, self.before = spark, folder.rstrip("/"), mining.signature(start)
        self.reused: list[str] = []
        self.made: list[str] = []

    def stage(self, name: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
        self.before = mining.signature({"stage": name, "settings": settings, "after": self.before})
        path = f"{self.folder}/{name}/{self.before}"
        sc = self.spark.sparkContext
        done = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done):
            self.reused.append(name)
        else:
            make().write.mode("overwrite").parquet(path)  # a stage that broke off has no success file
            self.made.append(name)
        return self.spark.read.parquet(path)


def graph_print(facts: DataFrame) -> dict:
    """What tells one graph from another, whatever the order of its rows."""
    row = facts.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("s", "p", "o", "chunk")).alias("x"), F.sum(F.pmod(F.xxhash64("chunk", "o", "p", "s"), F.lit(1 << 40)).cast("decimal(20,0)")).alias("y")).first()
    return {"facts": row["n"], "print": [row["x"], None if row["y"] is None else int(row["y"])]}  # a sum of longs would overflow from 16 million facts


def subgraphs(facts: DataFrame, roots: DataFrame, width: int) -> DataFrame:
    """(root, node): each root and the ``width`` neighbours with which it has most facts; equal numbers go by name."""
    ends = facts.select(F.col("s").alias("node"), F.col("o").alias("other")).union(facts.select("o", "s")).where("node <> other")
    near = ends.join(roots.select(F.col("node").alias("root")), F.col("node") == F.col("root"), "left_semi").groupBy("node", "other").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("node").orderBy(F.desc("n"), "other")
    kept = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= width).select(F.col("node").alias("root"), F.col("other").alias("node"))
    return kept.union(kept.select("root", "root").distinct())


def evidence(facts: DataFrame, members: DataFrame, triples: int, chunks: int) -> DataFrame:
    """(root, at, s, p, o, chunk): a subgraph's facts in order of chunks, at most so many, of at most so many chunks."""
    ends = [members.select(F.col("root").alias(f"root_{c}"), F.col("node").alias(f"node_{c}")) for c in "so"]
    inside = facts.join(ends[0], F.col("s") == F.col("node_s")).join(ends[1], (F.col("o") == F.col("node_o")) & (F.col("root_s") == F.col("root_o")))
    rows = inside.select(F.col("root_s").alias("root"), "s", "p", "o", "chunk").distinct()
    order = Window.partitionBy("root").orderBy("chunk", "s", "p", "o")
    placed = rows.withColumn("at", F.row_number().over(order)).withColumn("c", F.dense_rank().over(Window.partitionBy("root").orderBy("chunk")))
    return placed.where((F.col("at") <= triples) & (F.col("c") <= chunks)).select("root", "at", "s", "p", "o", "chunk")


def valid(answers: DataFrame, shown: DataFrame, facts: DataFrame) -> DataFrame:
    """(s, p, o, chunk) of answers (root, s, p, o, chunk) that are new, between two names, and cited.

    A citation counts if the root's evidence has the chunk; without a valid one a triple stays only if its evidence is a single chunk, and cites that.
    """
    given = F.coalesce(F.trim("s"), F.lit("")).alias("s"), F.coalesce(F.trim("p"), F.lit("")).alias("p"), F.coalesce(F.trim("o"), F.lit("")).alias("o")
    rows = answers.select("root", *given, "chunk").where("s <> '' AND p <> '' AND o <> '' AND s <> o")
    of_root = shown.select(F.col("root").alias("r"), F.col("chunk").alias("c")).distinct()
    single = of_root.groupBy(F.col("r").alias("r1")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("only")).where("n = 1")
    cited = rows.join(of_root, (F.col("root") == F.col("r")) & (F.col("chunk") == F.col("c")), "left").join(single, F.col("root") == F.col("r1"), "left")
    kept = cited.select("s", "p", "o", F.coalesce("c", "only").alias("chunk")).where("chunk IS NOT NULL").distinct()
    return kept.join(facts.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti").select("s", "p", "o", "chunk")


def complete(facts: DataFrame, roots: DataFrame, folder: str, score: Callable[[DataFrame, DataFrame], DataFrame], ask: Callable[[DataFrame], DataFrame], settings: Settings | None = None, version: str = "1") -> tuple[DataFrame, DataFrame, StagedJob]:
    """(edges (src, dst, weight) of the graph with the hidden triples, these triples, the job).

    ``facts`` (chunk, s, p, o); ``score`` gives (root, score) of subgraphs (root, node) and facts; ``ask`` completes evidence to answers
    (root, s, p, o, chunk). ``version`` stands for what these two are: change it with them.
    """
    settings = settings or Settings()
    s = asdict(settings)
    job = StagedJob(facts.sparkSession, folder, graph_print(facts) | {"version": version})
    members = job.stage("subgraphs", {"width": s["width"]}, lambda: subgraphs(facts, roots, settings.width))
    scores = job.stage("scores", {}, lambda: score(members, facts))

    def chosen() -> DataFrame:
        there = evidence(facts, members, 1, 1).select(F.col("root").alias("e"), "chunk")
        sets = members.groupBy("root").agg(F.collect_list("node").alias("members"))  # width + 1 nodes at most
        rows = sets.join(scores, "root").join(there, F.col("root") == F.col("e"), "left")
        rows = rows.select(F.col("root").alias("id"), "score", "members", F.when(F.col("chunk").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("chunk").cast("string"))).alias("evidence"))
        return selection.greedy(rows, settings.threshold, settings.overlap, settings.budget)

    best = job.stage("selection", {k: s[k] for k in ("threshold", "overlap", "budget")}, chosen)
    shown = job.stage("evidence", {k: s[k] for k in ("triples", "chunks")}, lambda: evidence(facts, members.join(best.select(F.col("id").alias("root")), "root", "left_semi"), settings.triples, settings.chunks))
    hidden = job.stage("completed", {}, lambda: valid(ask(shown), shown, facts))
    both = lambda: facts.select("s", "o").union(hidden.select("s", "o"))
    graph = job.stage("graph", {}, lambda: both().where("s <> o").groupBy(F.col("s").alias("src"), F.col("o").alias("dst")).agg(F.count(F.lit(1)).alias("weight")))
    return graph, hidden, job
