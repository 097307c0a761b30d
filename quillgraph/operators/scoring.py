"""Content scores of few texts against many, with numpy inside a block.

The texts are profiled in Spark (normalised text, formulas, operator contexts);
here the tokens that two profiles share are counted through incidence rows, so a
block of questions is held against a block of entries without a join a token.
Pairs that are known beforehand are scored one by one (pair_scores).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import textfeat as tf
from quillgraph.runtime import checkpoint

#: Questions that are held against entries at once, and token places at once.
ROWS, MOST_TOKENS = 64, 4_000_000
PROFILE = ("norm", "formulas", "contexts")


def profiled(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with what is compared in place of the text."""
    norm = texts.withColumn("norm", tf.normalize_for_match(F.col(text)))
    held = norm.withColumn("formulas", tf.normalize_for_match(F.array_join(tf.math_fragments(F.col("norm")), " ")))
    none: Column = F.array().cast("array<string>")
    return held.withColumn("contexts", F.when(F.col("formulas") != "", tf.symbol_contexts(F.col("norm"))).otherwise(none)).drop(text)


def bigram_codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return c[:-1] << 21 | c[1:]


def numbered(codes: np.ndarray) -> np.ndarray:
    """Each repeated code with its number, so that shared elements of multisets are shared elements of sets."""
    codes = np.sort(codes)
    new = np.concatenate([[True], codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, dtype=bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0)) if len(codes) else codes
    return codes << 20 | np.minimum(np.arange(len(codes)) - first, (1 << 20) - 1)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each left text shares with each right one."""
    out = np.zeros((len(left), len(right)))
    known = np.unique(np.concatenate([*left, np.zeros(0, dtype=np.int64)]))
    if not len(known):
        return out
    held = np.zeros((len(left), len(known)), dtype=np.float32)
    for k, tokens in enumerate(left):
        held[k, np.searchsorted(known, tokens)] = 1.0
    start = 0
    while start < len(right):
        end, size = start, 0
        while end < len(right) and (end == start or (size + len(right[end])) * len(left) <= MOST_TOKENS):
            size += len(right[end])
            end += 1
        tokens = np.concatenate([*right[start:end], np.zeros(0, dtype=np.int64)])
        owner = np.repeat(np.arange(end - start), [len(t) for t in right[start:end]])
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        met = known[at] == tokens
        at, owner = at[met], owner[met]
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[:, start + owner[first]] = np.add.reduceat(held[:, at], first, axis=1)
        start = end
    return out


class Side(NamedTuple):
    """The profiles of some texts as arrays."""

    norm: np.ndarray
    formulas: np.ndarray
    prose: list[np.ndarray]
    math: list[np.ndarray]
    context: list[np.ndarray]

    def rows(self, a: int, b: int) -> Side:
        return Side(*(x[a:b] for x in self))


def side_of(frame: pd.DataFrame, names: dict[str, int]) -> Side:
    """names numbers the contexts of both sides."""
    contexts = [numbered(np.array([names.setdefault(c, len(names)) for c in held], dtype=np.int64)) for held in frame["contexts"]]
    norm, formulas = (frame[c].to_numpy(dtype=object) for c in ("norm", "formulas"))
    prose, math = ([numbered(bigram_codes(t)) for t in texts] for texts in (norm, formulas))
    return Side(norm, formulas, prose, math, contexts)


def dice(a: np.ndarray, b: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The Dice coefficients of texts a and b over their tokens."""
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    out = 2.0 * shared_counts(left, right) / np.maximum(1, total)
    short = (np.array([len(x) < 2 for x in a])[:, None]) | (np.array([len(x) < 2 for x in b])[None, :])
    out[short] = 0.0
    out[a[:, None] == b[None, :]] = 1.0
    out[np.array([x == "" for x in a], dtype=bool), :] = 0.0
    out[:, np.array([x == "" for x in b], dtype=bool)] = 0.0
    return out


def score_rows(left: Side, right: Side) -> np.ndarray:
    """The content score of each left text with each right one, weighted toward formulas where both have some."""
    prose = dice(left.norm, right.norm, left.prose, right.prose)
    fragments = dice(left.formulas, right.formulas, left.math, right.math)
    na, nb = (np.array([len(x) for x in side.context]) for side in (left, right))
    context = 2.0 * shared_counts(left.context, right.context) / np.maximum(1, na[:, None] + nb[None, :])
    enough = (na >= tf.LEAST_CONTEXTS)[:, None] & (nb >= tf.LEAST_CONTEXTS)[None, :]
    math = np.where(enough, tf.SYMBOL_SHARE * context + (1 - tf.SYMBOL_SHARE) * fragments, fragments)
    without = (left.formulas == "")[:, None] | (right.formulas == "")[None, :]
    return np.where(without, prose, tf.MATH_WEIGHT * math + (1 - tf.MATH_WEIGHT) * prose)


#: The normalised texts and formulas of a pair.
PAIR_TEXTS = ("l_norm", "l_formulas", "r_norm", "r_formulas")
OPERATOR = re.compile(f"[{tf.SKELETON}()]")


def bigram_dice(a: str, b: str) -> float:
    """Multiset Dice of two normalised strings over their bigrams."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = ([t[k : k + 2] for k in range(len(t) - 1)] for t in (a, b))
    return 2.0 * common(x, y) / (len(x) + len(y))


def common(x: list[str], y: list[str]) -> int:
    """How many elements two multisets share."""
    a, b = Counter(x), Counter(y)
    return sum(min(a[t], b[t]) for t in a.keys() & b.keys())


def operator_contexts(norm: str) -> list[str]:
    """What tf.symbol_contexts() finds, by code points."""
    padded = tf.PAD * tf.RADIUS + norm + tf.PAD * tf.RADIUS
    return [padded[m.start() : m.start() + 2 * tf.RADIUS + 1] for m in OPERATOR.finditer(norm)]


def pair_score(l_norm: str, l_formulas: str, r_norm: str, r_formulas: str) -> float:
    """What score_rows() gives for one pair."""
    prose = bigram_dice(l_norm, r_norm)
    if not l_formulas or not r_formulas:
        return prose
    math = bigram_dice(l_formulas, r_formulas)
    x, y = operator_contexts(l_norm), operator_contexts(r_norm)
    if min(len(x), len(y)) >= tf.LEAST_CONTEXTS:
        math = tf.SYMBOL_SHARE * (2.0 * common(x, y) / (len(x) + len(y))) + (1 - tf.SYMBOL_SHARE) * math
    return tf.MATH_WEIGHT * math + (1 - tf.MATH_WEIGHT) * prose


def pair_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The content score of each row's two texts, in place of PAIR_TEXTS."""
    for batch in batches:
        texts = (batch.column(c).to_pylist() for c in PAIR_TEXTS)
        scores = pa.array([pair_score(*t) for t in zip(*texts)], pa.float64())
        kept = [c for c in batch.schema.names if c not in PAIR_TEXTS]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), scores], names=[*kept, "score"])


#: The most bytes of query texts that a task holds at once; more queries come in further passes.
MOST_QUERY_BYTES = 16 * 1024 * 1024


def top_similar(queries: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(q, t, shared, similarity, k): of each query (q, text) the most similar texts (t, text) by the Dice coefficient of their bigrams.

    Every query is held against every text; a task keeps its own best ones, so
    what is shuffled is as many rows as there are queries and tasks. Ties fall to
    the smaller t; a text that shares no bigram is not listed. q and t are numbers.
    """
    held = queries.select("q", tf.normalize_for_match(F.col("text")).alias("norm")).filter("length(norm) > 1").distinct()
    held = checkpoint(held)
    size = held.agg(F.sum(F.length("norm") * 12)).first()[0] or 0
    slices = max(1, -(-int(size) // MOST_QUERY_BYTES))
    spark = queries.sparkSession
    norms = texts.select("t", tf.normalize_for_match(F.col("text")).alias("norm")).filter("t is not null and length(norm) > 1")
    out: DataFrame | None = None
    for k in range(slices):
        own = held.filter(F.pmod(F.xxhash64("q"), F.lit(slices)) == k).orderBy("q").toArrow()
        found = norms.mapInArrow(best_of(spark.sparkContext.broadcast((own["q"].to_pylist(), own["norm"].to_pylist())), most), "q long, t long, shared long, similarity double")
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.round("similarity", 9).desc(), "t"))
    return out.distinct().withColumn("k", place).filter(F.col("k") <= most)


def best_of(shared: Any, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For a task: the best texts of each query among its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, norms = shared.value
        left = [numbered(bigram_codes(t)) for t in norms]
        size = np.array([len(x) for x in left], dtype=np.int64)[:, None]
        # similarity, text and shared tokens of the best so far
        best = [np.zeros((len(names), 0)), np.zeros((len(names), 0), dtype=np.int64), np.zeros((len(names), 0))]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts = (batch.column(c).slice(at, 500).to_pylist() for c in ("t", "norm"))
                right = [numbered(bigram_codes(t)) for t in texts]
                counts = shared_counts(left, right)
                similar = 2.0 * counts / (size + np.array([len(x) for x in right], dtype=np.int64)[None, :])
                joined = [np.concatenate([a, b], axis=1) for a, b in zip(best, (similar, np.broadcast_to(np.array(ids, dtype=np.int64), counts.shape), counts))]
                # a text that stands twice is listed once, so one place more is kept for each
                order = np.lexsort((joined[1], -np.round(joined[0], 9)), axis=1)[:, : 4 * most]
                best = [np.take_along_axis(x, order, axis=1) for x in joined]
        rows = sorted({(names[i], int(t), int(n), float(s)) for i in range(len(names)) for s, t, n in zip(*(x[i] for x in best)) if n > 0})
        columns = list(zip(*rows)) if rows else [(), (), (), ()]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["q", "t", "shared", "similarity"])

    return run
