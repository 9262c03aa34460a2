"""Replaceable model hooks with deterministic defaults: embedding, extraction, reranking, cached calls.

A hook is a plain function over lists; it is run on Arrow batches, so a model is loaded once a worker.
"""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
Texts = Callable[[list[str]], list[str]]


def hashed_embedder(dim: int = 64) -> Embedder:
    """Signed word hashes, normalised: equal texts have equal vectors, and alike ones near ones."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % dim] += 1.0 if h >> 32 & 1 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(df: DataFrame, column: str, hook: Embedder | None = None, dim: int = 64) -> DataFrame:
    """``df`` with ``embedding`` of ``column``; a hook that gives another shape is refused."""
    hook = hook or hashed_embedder(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(hook(b.column(b.schema.get_field_index(column)).to_pylist()), np.float32)
            if v.shape != (b.num_rows, dim):
                raise ValueError(f"the embedder gave {v.shape}, not {(b.num_rows, dim)}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(v), pa.list_(pa.float32()))], [*b.schema.names, "embedding"])

    return df.mapInArrow(run, df.withColumn("embedding", F.array().cast("array<float>")).schema)


def cached_calls(prompts: DataFrame, cache: DataFrame, hook: Texts) -> tuple[DataFrame, DataFrame]:
    """(answers, cache): only prompts whose md5 the cache (key, answer) lacks reach the hook, each once."""
    keyed = prompts.select("prompt", F.md5("prompt").alias("key")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(hook(b.column(0).to_pylist()), pa.string())], ["key", "answer"])

    new = keyed.join(cache.select("key"), "key", "left_anti").select("prompt", "key").mapInArrow(run, "key string, answer string")
    full = cache.select("key", "answer").unionByName(new)
    return prompts.withColumn("key", F.md5("prompt")).join(full, "key", "left").drop("key"), full


def repaired_json(text: Column) -> Column:
    """JSON that was cut off, made whole: valid JSON as it is, else without what follows the last comma, and with what is open closed.

    One pass over the characters keeps the closers that are still needed, the latest first. A closing bracket ends the latest open one, of
    whichever kind; one that ends nothing stays as it is. An open string is closed before all brackets. Null counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    cut = F.when(text.contains(","), F.regexp_extract(text, "(?s)^(.*),", 1)).otherwise(text)
    start = F.struct(F.lit("").alias("closers"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def step(now: Column, c: Column) -> Column:
        quoted, escaped, closers = now["quoted"], now["escaped"], now["closers"]
        plain = F.when(c == "{", F.concat(F.lit("}"), closers)).when(c == "[", F.concat(F.lit("]"), closers)).when(c.isin("}", "]"), F.substring(closers, 2, 1 << 30)).otherwise(closers)
        turns = (c == '"') & ~(quoted & escaped)
        return F.struct(F.when(quoted, closers).otherwise(plain).alias("closers"), (quoted != turns).alias("quoted"), (quoted & ~escaped & (c == "\\")).alias("escaped"))

    closed = F.aggregate(F.split(cut, ""), start, step, lambda end: F.concat(F.when(end["quoted"], F.lit('"')).otherwise(F.lit("")), end["closers"]))
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.concat(cut, closed))


def closest(text: str, candidates: list[str]) -> int:
    """Index of the candidate most alike by matching blocks; the first of equals."""
    return max(range(len(candidates)), key=lambda i: (difflib.SequenceMatcher(None, text, candidates[i]).ratio(), -i))


#: Fields of a judge's answer that hold a truth value, those that hold a label, and words for true.
TRUTH_FIELDS, LABEL_FIELDS = ("same", "equivalent", "consistent", "is_same", "is_equivalent"), ("answer", "judgment", "judgement", "verdict", "label", "result")
TRUE_WORDS = ("true", "yes", "y", "1", "same", "equivalent", "consistent")


def judged(text: Column) -> Column:
    """Whether a judge's answer says that it is right; false if it says nothing.

    An answer that is one word but for marks is that word. Else the first to the last brace are read as an object: the first of its truth fields
    that is there decides (a word for true, or a number above 0), without one the first label. Text without an object, unless it is a list, says
    so by the word, if its opposite is nowhere.
    """
    text = F.coalesce(text, F.lit(""))
    word = F.regexp_replace(F.lower(text), "[^a-z]", "")
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    fields = F.from_json(found, ", ".join(f"{f} string" for f in (*TRUTH_FIELDS, *LABEL_FIELDS)))
    value = lambda f: F.lower(F.trim(fields[f]))
    truth = F.coalesce(*[value(f) for f in TRUTH_FIELDS])
    label = F.coalesce(*[F.when(value(f).isin("correct", "incorrect"), value(f)) for f in LABEL_FIELDS])
    by_fields = F.when(truth.isNotNull(), truth.isin(*TRUE_WORDS) | F.coalesce(truth.try_cast("double") > 0, F.lit(False))).otherwise(F.coalesce(label == "correct", F.lit(False)))
    by_word = text.rlike(r"(?i)\bcorrect\b") & ~text.rlike(r"(?i)\bincorrect\b") & ~F.ltrim(text).startswith("[")
    return F.when(word.isin("correct", "incorrect"), word == "correct").when(found != "", by_fields).otherwise(by_word)


def map_text(df: DataFrame, column: str, f: Callable, name: str, kind: str) -> DataFrame:
    """``df`` with f(column), on Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([f(x) for x in b.column(b.schema.get_field_index(column)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, name])

    return df.mapInArrow(run, df.withColumn(name, F.lit(None).cast(kind)).schema)


def reranked(rows: DataFrame, scores: DataFrame | None) -> DataFrame:
    """``rows`` (q, id, pos) with rerank_score of ``scores`` (q, id, score); without any the input order holds."""
    if scores is None:
        return rows.withColumn("rerank_score", F.lit(None).cast("double"))
    s = scores.select(F.col("q").alias("sq"), F.col("id").alias("sid"), F.col("score").alias("rerank_score"))
    return rows.join(s, (F.col("q") == F.col("sq")) & (F.col("id") == F.col("sid")), "left").drop("sq", "sid")
