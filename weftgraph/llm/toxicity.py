"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples count as labels; every other training text is unlabelled, toxic ones
among them included. With class prior p, the risk is p R+(toxic) + max(0, R-(unlabelled) - p R-(toxic)): the
second part estimates the risk on clean texts, and where it would turn negative (which is overfitting) its gradient is
followed upwards instead. The prior is the share of toxic rows among the labelled training rows.

Features are the presence of words, and of one, two, three or five different words of a beginning. A first pass over the sample counts in how many toxic and
unlabelled texts each of them occurs; the ``FEATURES`` that tell most are kept, and a linear
model over them is trained in numpy on the driver.

The fit uses at most ``MOST_TOXIC`` toxic and ``MOST_UNLABELLED`` unlabelled labelled rows, chosen by hash; scoring
reads every whole text. Defined cases: a null text is an empty one and has the score of no words; a
null doc_id is never held out and never labelled; repeated labels of an id count as toxic if any is; without
toxic or without unlabelled training rows every score is the prior (0.5 if unknown); an empty table gives an empty result; equal
texts have equal scores, repeated rows stay rows of their own, and further columns are kept, whatever their names.

Unlabelled texts are drawn from the labelled rows, their labels hidden: the prior is known of these only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, text_or_empty
from .gather import give_back, offsets_of

MOST_TOXIC, MOST_UNLABELLED = 4_000, 12_000
FEATURES = 512
#: Lengths in bytes of the word beginnings that are features, and how many different words of a text must begin so. A feature's
#: name is the beginning, a star, and that number if it is not 1.
HEADS, TIMES = (4, 5, 6, 7, 8), (1, 2, 3, 5)
#: Texts whose features are held at once.
TEXTS = 32
#: A feature must be in so many toxic texts of the sample.
LEAST_TEXTS = 5
STEPS, RATE, DECAY = 600, 0.3, 1e-5
THRESHOLD = 0.7

#: ASCII punctuation and control characters part words; letters of other scripts stay.
_PARTS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes) -> set[bytes]:
    return set(text.lower().translate(_PARTS).split())


def _name(head: bytes, times: int) -> bytes:
    return head + (b"*" if times == 1 else b"*%d" % times)


def features(text: bytes) -> set[bytes]:
    """Names of the words and word beginnings of a text."""
    whole = words(text)
    out = set(whole)
    for n in HEADS:
        for head, k in Counter([w[:n] for w in whole if len(w) > n]).items():
            out.update([_name(head, t) for t in TIMES if k >= t])
    return out


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def nnpu_fit(x: np.ndarray, toxic: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear model; rows of ``x`` with ``toxic`` are positive, the others unlabelled."""
    x = x.astype(np.float32)
    n_toxic, n_other = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    w, b = np.zeros(x.shape[1]), math.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        f = x @ w.astype(np.float32) + b
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        # logistic losses: of calling a text toxic, log(1 + e^-f); of calling it clean, log(1 + e^f)
        clean_risk = np.logaddexp(0, f[~toxic]).sum() / n_other - prior * np.logaddexp(0, f[toxic]).sum() / n_toxic
        on_toxic = prior * (p[toxic] - 1) / n_toxic
        clean_toxic, clean_other = -prior * p[toxic] / n_toxic, p[~toxic] / n_other
        g = np.zeros(len(f), np.float32)
        if clean_risk >= 0:
            g[toxic], g[~toxic] = on_toxic + clean_toxic, clean_other
        else:
            g[toxic], g[~toxic] = -clean_toxic, -clean_other
        grad = np.append(x.T @ g + DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float] | None:
    """(text, toxic) of the training sample, and the prior."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~is_held_out(F.col("doc_id")))
    known = staged(known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "tox-labels")
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        return None
    order = [F.xxhash64("doc_id", F.lit("sample")), "doc_id"]
    positive = known.where("toxic = 1").orderBy(*order).limit(MOST_TOXIC).select("doc_id", F.lit(True).alias("toxic"))
    # unlabelled rows are drawn from all labelled ones, with their labels hidden
    other = known.orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(MOST_UNLABELLED).select("doc_id", F.lit(False).alias("toxic"))
    ids = staged(positive.unionByName(other), "tox-ids").select(F.col("doc_id").alias("id"), "toxic")
    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    # MOST_TOXIC + MOST_UNLABELLED rows at most
    return rows.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("text", "toxic"), n_toxic / n


def _words_of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            part = b.slice(at, TEXTS)
            found = [list(features(t)) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary())), part.column(1)], ["words", "toxic"])
    give_back()


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[bytes, float], float]:
    """Word weights and bias from the texts of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) that are not held out."""
    drawn = _sample(docs, labels)
    if drawn is None:
        return {}, 0.0
    sample, prior = drawn
    sample = staged(sample.mapInArrow(_words_of_sample, "words array<binary>, toxic boolean"), "tox-sample")
    n_toxic, n = sample.agg(F.sum(F.col("toxic").cast("int")), F.count(F.lit(1))).first()
    if not n_toxic or n_toxic == n:
        return {}, math.log(prior / (1 - prior))
    counted = sample.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(F.sum(F.col("toxic").cast("int")).alias("t"), F.count(F.lit(1)).alias("n"))
    rate_toxic, rate_other = (F.col("t") + 0.5) / (n_toxic + 1), (F.col("n") - F.col("t") + 0.5) / (n - n_toxic + 1)
    gain = F.abs(rate_toxic * F.log(rate_toxic / rate_other))
    best = counted.where(F.col("t") >= LEAST_TEXTS).orderBy(F.desc(gain), "word").limit(FEATURES).select("word").collect()
    at = {bytes(r["word"]): i for i, r in enumerate(best)}
    if not at:
        return {}, math.log(prior / (1 - prior))

    names = pa.array(list(at), pa.binary())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pc.fill_null(pc.index_in(b.column(0).flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(b.num_rows), np.diff(offsets_of(b.column(0))))
            bits = np.zeros((b.num_rows, len(names)), np.uint8)
            bits[text[found >= 0], found[found >= 0]] = 1
            packed = [x.tobytes() for x in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), b.column(1)], ["bits", "toxic"])

    got = sample.mapInArrow(rows, "bits binary, toxic boolean").toPandas()  # a few dozen bytes for each row of the sample
    got = got.assign(key=got["bits"].map(bytes)).sort_values(["toxic", "key"])
    x = np.unpackbits(np.frombuffer(b"".join(got["key"]), np.uint8).reshape(len(got), -1), axis=1)[:, : len(at)]
    w, b = nnpu_fit(x, got["toxic"].to_numpy(dtype=bool), prior)
    return {word: float(w[i]) for word, i in at.items()}, b


def lookup(weights: dict[bytes, float]) -> dict[int, dict]:
    """Weights of whole words at 0; by length of beginning, [(different words needed, weight)] of each."""
    out: dict = {n: {} for n in (0, *HEADS)}
    for name, w in sorted(weights.items()):
        head, star, times = name.partition(b"*")
        if star:
            out[len(head)].setdefault(head, []).append((int(times or 1), w))
        else:
            out[0][name] = w
    return out


def score(text: bytes, known: dict[int, dict], bias: float) -> float:
    """The probability of being toxic; ``known`` is of :func:`lookup`."""
    whole = words(text)
    hits = [known[0][w] for w in whole.intersection(known[0])]
    for n in HEADS:
        if table_n := known[n]:
            for head, k in Counter([h for w in whole if len(w) > n and (h := w[:n]) in table_n]).items():
                hits += [x for times, x in table_n[head] if k >= times]
    # sorted, so that equal texts have equal sums
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(sorted(hits))))))


def with_score(docs: DataFrame, weights: dict[bytes, float], bias: float) -> DataFrame:
    """The columns of ``docs`` and score (0 to 1); ``weights`` has ``FEATURES`` words at most."""
    sent = docs.sparkSession.sparkContext.broadcast(lookup(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            out = []
            for t in b.column(b.num_columns - 1).to_pylist():
                out.append(score(t, known, bias))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], [*b.schema.names[:-1], "score_"])

    keep = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}_") for i, c in enumerate(keep)], text_or_empty().cast("binary").alias("text_"))
    schema = rows.drop("text_").withColumn("score_", F.lit(0.0)).schema
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(keep)], F.col("score_").alias("toxicity_score"))


def below_threshold(docs: DataFrame, weights: dict[bytes, float], bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``."""
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(lookup(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            keep = [score((t.as_py() or "").encode(), known, bias) < threshold for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, bias = fit(docs, table(spark, sf_dir, "labels"))
    out = with_score(docs, weights, bias).withColumnRenamed("toxicity_score", "score")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
