"""A graph model's forward pass over many subgraphs at once: does a subgraph lack a fact?

Node features are projected, two relational convolutions follow (of each relation the mean of the neighbours' states, mapped by the relation's matrix,
and the own state by the root's), each with GELU and layer normalisation; the mean and the greatest of each component over a subgraph's nodes
go through a small head to a probability. Weights come from outside and are checked for size before they are sent to
all tasks. Subgraphs are dealt whole into buckets of bounded size, so their rows are shuffled once and a bucket's layers are arrays in one task. Those too
large for that go the other way: messages are joined and summed by (graph, node), partly before the shuffle, so a subgraph or a hub may be of any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_staged, staged

#: Numbers in all weights together; 8 bytes each.
MOST_WEIGHTS = 1 << 25
#: Numbers of the states of a bucket's nodes and edges, on average; a subgraph with half as many is dealt whole.
BUCKET = 1 << 22
_erf = np.frompyfunc(math.erf, 1, 1)


@dataclass
class Convolution:
    relations: np.ndarray  # (relations, hidden, hidden)
    root: np.ndarray  # (hidden, hidden)
    bias: np.ndarray
    gain: np.ndarray  # of the normalisation
    shift: np.ndarray


@dataclass
class Model:
    projection: np.ndarray  # (hidden, features)
    projection_bias: np.ndarray
    kinds: np.ndarray  # (node kinds, hidden)
    layers: list[Convolution]
    head: np.ndarray  # (hidden, 2 hidden)
    head_bias: np.ndarray
    out: np.ndarray  # (hidden)
    out_bias: float

    def size(self) -> int:
        arrays = [getattr(x, f.name) for x in (self, *self.layers) for f in fields(x)]
        return sum(np.size(a) for a in arrays if isinstance(a, np.ndarray))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)).astype(np.float64)) if x.size else x


def normalised(x: np.ndarray, layer: Convolution) -> np.ndarray:
    return (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5) * layer.gain + layer.shift


def _mapped(rows: DataFrame, keep: list[str], out: str, f: Callable[..., np.ndarray], *columns: str) -> DataFrame:
    """``keep`` and a vector (or, if ``out`` is a double, a number) that ``f`` makes of the columns' arrays."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (*keep, *columns)}
    number = out.endswith(" double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            given = [b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) if kinds[c].startswith("array") else b.column(c).to_numpy() for c in columns]
            y = f(*given)
            made = pa.array(y) if number else pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * y.shape[1]), pa.array(np.ascontiguousarray(y).ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), made], [*keep, out.split(" ")[0]])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), out]))


def forward(nodes: DataFrame, edges: DataFrame, model: Model) -> DataFrame:
    """(graph, score) of subgraphs: ``nodes`` (graph, node, kind, x), ``edges`` (graph, src, rel, dst), kinds and relations counted from 0.

    Edges with an end that is no node of their subgraph do not count; equal edges count each.
    """
    if model.size() > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} weights")
    rows = staged(nodes.select("graph", "node", F.col("kind").cast("int").alias("kind"), F.col("x").cast("array<double>").alias("x")), "model-nodes")
    inner = edges.select("graph", "src", F.col("rel").cast("int").alias("rel"), "dst").dropna()
    limit = BUCKET // len(model.out)
    sizes = rows.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).unionByName(inner.groupBy("graph").agg(F.count(F.lit(1)).alias("n")))
    sizes = staged(sizes.groupBy("graph").agg(F.sum("n").alias("n")), "model-sizes")
    large = sizes.where(F.col("n") > limit // 2).select(F.col("graph").alias("g"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    buckets = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // limit))
    if most <= limit // 2:
        out = staged(_whole(rows, inner, model, buckets), "model-score")
    else:
        same = F.col("graph").eqNullSafe(F.col("g"))
        some = _whole(rows.join(large, same, "left_anti"), inner.join(large, same, "left_anti"), model, buckets)
        out = staged(some.unionByName(_spread(rows.join(large, same, "left_semi"), inner.join(large, same, "left_semi"), model)), "model-score")
    drop_staged(rows)
    drop_staged(sizes)
    return out


def _whole(nodes: DataFrame, edges: DataFrame, model: Model, buckets: int) -> DataFrame:
    """(graph, score); all rows of a subgraph are in one bucket."""
    sent = nodes.sparkSession.sparkContext.broadcast(model)
    kind = nodes.schema["graph"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64("graph"), F.lit(buckets)).cast("int")

    def codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
        """The same number for the same value in all columns."""
        kinds = {c.type for c in columns}
        both = pa.chunked_array([x for c in columns for x in c.chunks], kinds.pop()).dictionary_encode("encode").combine_chunks()
        both = (both if isinstance(both, pa.DictionaryArray) else both.chunk(0)).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return np.split(both, np.cumsum([len(c) for c in columns])[:-1])

    def judged(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        m = sent.value
        if not nodes.num_rows:
            return pa.table([nodes.column("graph"), pa.array([], pa.float64())], names=["graph", "score"])
        graph, of_edge = codes(nodes.column("graph"), edges.column("graph"))
        order = np.argsort(graph, kind="stable")
        nodes, graph = nodes.take(pa.array(order)), graph[order]
        name, src, dst = codes(nodes.column("node"), edges.column("src"), edges.column("dst"))
        wide = max(x.max(initial=0) for x in (name, src, dst)) + 1
        keys = graph * wide + name
        by_key = np.argsort(keys, kind="stable")
        keys = keys[by_key]

        def found(end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, of_edge * wide + end), len(keys) - 1)
            return by_key[at], keys[at] == of_edge * wide + end

        (src, has_src), (dst, has_dst) = found(src), found(dst)
        there = has_src & has_dst
        src, dst, rel = src[there], dst[there], edges.column("rel").to_numpy()[there]
        order = np.lexsort((dst, rel))
        src, dst, rel = src[order], dst[order], rel[order]
        starts = np.flatnonzero(np.r_[True, (rel[1:] != rel[:-1]) | (dst[1:] != dst[:-1])]) if len(rel) else np.zeros(0, int)
        many = np.diff(np.r_[starts, len(rel)])[:, None]
        to, of = dst[starts], rel[starts]
        x = np.stack(nodes.column("x").combine_chunks().to_numpy(zero_copy_only=False))
        v = x @ m.projection.T + m.projection_bias + m.kinds[nodes.column("kind").to_numpy()]
        for layer in m.layers:
            after = v @ layer.root.T + layer.bias
            if len(starts):
                mean = np.add.reduceat(v[src], starts, axis=0) / many
                for r in np.unique(of).tolist():
                    after[to[of == r]] += mean[of == r] @ layer.relations[r].T
            v = normalised(gelu(after), layer)
        firsts = np.flatnonzero(np.r_[True, graph[1:] != graph[:-1]])
        n = np.diff(np.r_[firsts, len(graph)])[:, None]
        pooled = np.concatenate([np.add.reduceat(v, firsts, axis=0) / n, np.maximum.reduceat(v, firsts, axis=0)], axis=1)
        y = gelu(pooled @ m.head.T + m.head_bias) @ m.out + m.out_bias
        return pa.table([nodes.column("graph").take(pa.array(firsts)), pa.array(1 / (1 + np.exp(-y)))], names=["graph", "score"])

    left, right = nodes.withColumn("bucket", bucket).groupBy("bucket"), edges.withColumn("bucket", bucket).groupBy("bucket")
    return left.cogroup(right).applyInArrow(judged, f"graph {kind}, score double")


def _spread(nodes: DataFrame, edges: DataFrame, model: Model) -> DataFrame:
    """(graph, score); a subgraph's rows are spread over all tasks."""
    sent = nodes.sparkSession.sparkContext.broadcast(model)
    hidden = len(model.out)
    over = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(hidden)])
    states = staged(_mapped(nodes, ["graph", "node"], "v array<double>", lambda k, x: x @ sent.value.projection.T + sent.value.projection_bias + sent.value.kinds[k], "kind", "x"), "model-state")
    inner = edges
    ends = states.select("graph", "node")
    for end in ("src", "dst"):
        inner = inner.join(ends.withColumnRenamed("node", end), ["graph", end], "left_semi")
    inner = staged(inner, "model-edges")
    many = inner.groupBy(*[F.col(c).alias(f"{c}_") for c in ("graph", "dst", "rel")]).agg((1 / F.count(F.lit(1))).alias("share"))
    shared = inner.join(many, (F.col("graph") == F.col("graph_")) & (F.col("dst") == F.col("dst_")) & (F.col("rel") == F.col("rel_"))).select("graph", "src", "rel", "dst", "share")
    shared = staged(shared, "model-edges")
    drop_staged(inner)
    for k in range(len(model.layers)):

        def message(rel: np.ndarray, share: np.ndarray, v: np.ndarray, k: int = k) -> np.ndarray:
            out = np.zeros((len(v), hidden))
            for r in np.unique(rel).tolist():
                at = rel == r
                out[at] = v[at] @ sent.value.layers[k].relations[r].T
            return out * share[:, None]

        def own(v: np.ndarray, k: int = k) -> np.ndarray:
            return v @ sent.value.layers[k].root.T + sent.value.layers[k].bias

        def active(v: np.ndarray, k: int = k) -> np.ndarray:
            return normalised(gelu(v), sent.value.layers[k])

        met = shared.join(states.select(F.col("graph").alias("g"), F.col("node").alias("n"), "v"), (F.col("graph") == F.col("g")) & (F.col("src") == F.col("n")))
        messages = _mapped(met.select("graph", F.col("dst").alias("node"), "rel", "share", "v"), ["graph", "node"], "m array<double>", message, "rel", "share", "v")
        sums = messages.unionByName(_mapped(states, ["graph", "node"], "m array<double>", own, "v")).groupBy("graph", "node").agg(over(F.sum, "m").alias("v"))
        after = staged(_mapped(sums, ["graph", "node"], "v array<double>", active, "v"), "model-state")
        drop_staged(states)
        states = after
    pooled = states.groupBy("graph").agg(over(F.avg, "v").alias("mean"), over(F.max, "v").alias("most"))

    def judged(mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        m = sent.value
        y = gelu(np.concatenate([mean, most], axis=1) @ m.head.T + m.head_bias) @ m.out + m.out_bias
        return 1 / (1 + np.exp(-y))

    out = staged(_mapped(pooled, ["graph"], "score double", judged, "mean", "most"), "model-score")
    for df in (states, shared):
        drop_staged(df)
    return out


def random_model(features: int, hidden: int, kinds: int, relations: int, seed: int = 42) -> Model:
    """Weights where none are given: drawn by a seed, as an untrained model has them."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / math.sqrt(shape[-1]), shape)
    layers = [Convolution(draw(relations, hidden, hidden), draw(hidden, hidden), draw(hidden), 1 + draw(hidden) / 4, draw(hidden)) for _ in range(2)]
    return Model(draw(hidden, features), draw(hidden), draw(kinds, hidden), layers, draw(hidden, 2 * hidden), draw(hidden), draw(hidden), 0.1)
