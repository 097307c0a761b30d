"""Order-dependent operators: alignments of sequences, greedy comparison of formula sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import textfeat as tf
from quillgraph.operators import scoring
from quillgraph.operators.matching import gram_similarity
from quillgraph.operators.scoring import bigram_dice

TITLE_GAP, TITLE_LEAST = -0.05, 0.45
GAP, LEAST_PAIR, LABEL_BONUS, MOST_CANDIDATES, BAND = -0.18, 0.12, 0.45, 400, 64
#: Cells of one alignment of entries, in place of a clock; a larger one leaves all unpaired and says so, unless asked for whole.
#: Titles are aligned at every size: beyond so many cells over the scored pairs alone.
MOST_CELLS = 4_000_000
SAME_EXPRESSION = 0.8


def aligned(n: int, m: int, scores: dict[tuple[int, int], float], gap: float, least: float, band: int | None = None) -> list[tuple[int, int]]:
    """Pairs of a best monotonic alignment; on the way back a pair goes before skipping left, that before skipping right."""
    width = max(band, abs(n - m) + 1) if band is not None else max(n, m)
    none = float("-inf")
    best = [[none] * (m + 1) for _ in range(n + 1)]
    best[0] = [j * gap for j in range(m + 1)]
    for i in range(1, n + 1):
        best[i][0] = i * gap
        for j in range(max(1, i - width), min(m, i + width) + 1):
            s = scores.get((i - 1, j - 1), 0.0)
            best[i][j] = max(best[i - 1][j - 1] + s if s >= least else none, best[i - 1][j] + gap, best[i][j - 1] + gap)
    out, i, j = [], n, m
    while i > 0 and j > 0:
        s = scores.get((i - 1, j - 1), 0.0)
        if abs(i - j) <= width and s >= least and best[i][j] == best[i - 1][j - 1] + s:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j] + gap:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def chained(n: int, m: int, scores: dict[tuple[int, int], float], gap: float, least: float, band: int | None = None) -> list[tuple[int, int]]:
    """What aligned() finds, in memory of the scored pairs instead of all cells.

    Every pair saves two gaps, so the best alignment is the heaviest chain of
    pairs that ascend on both sides; ties are settled as on aligned()'s way back.
    """
    width = max(band, abs(n - m) + 1) if band is not None else max(n, m)
    rows: dict[int, list[tuple[int, float]]] = {}
    for (i, j), s in scores.items():
        if s >= least and s > 2 * gap and abs(i - j) <= width:
            rows.setdefault(i, []).append((j, s - 2 * gap))
    tree = [0.0] * (m + 1)
    before: dict[tuple[int, int], float] = {}
    level: dict[float, list[tuple[int, int]]] = {}
    for i in sorted(rows):
        new = []
        for j, w in rows[i]:
            top, k = 0.0, j
            while k > 0:
                top = max(top, tree[k])
                k &= k - 1
            before[i, j] = top
            level.setdefault(top + w, []).append((i, j))
            new.append((j, top + w))
        for j, total in new:
            k = j + 1
            while k <= m:
                tree[k] = max(tree[k], total)
                k += k & -k
    out: list[tuple[int, int]] = []
    i, j, total = n - 1, m - 1, max(level, default=0.0)
    while total > 0:
        held = [x for x in level[total] if x[0] <= i and x[1] <= j]
        # a pair in the last column is met on the way up, else the first row that reaches the total is searched from its end
        i, j = max((x for x in held if x[1] == j), default=None) or min(held, key=lambda x: (x[0], -x[1]))
        out.append((i, j))
        total = before[i, j]
        i, j = i - 1, j - 1
    return out[::-1]


def aligned_titles(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """(q_doc, a_doc, depth, q_node, a_node, score): sections of two books aligned in order, of each depth by itself.

    Similarities come from an inverted-index join within a pair of books and a
    depth; only the alignment itself, small by nature, runs in pandas.
    """
    left = pairs.join(sections.select(F.col("doc_id").alias("q_doc"), "depth", F.col("node_id").alias("q_node"), F.col("page").alias("q_page"), F.col("title").alias("text")), "q_doc")
    right = pairs.join(sections.select(F.col("doc_id").alias("a_doc"), "depth", F.col("node_id").alias("a_node"), F.col("page").alias("a_page"), F.col("title").alias("text")), "a_doc")
    block = ["q_doc", "a_doc", "depth"]
    met = gram_similarity(left, right, "q_node", "a_node", block).filter(F.col("similarity") >= TITLE_LEAST).select(*block, "q_node", "a_node", "similarity")
    q = left.select(*block, "q_node", "q_page")
    a = right.select(*block, "a_node", "a_page")
    rows = (
        q.select(*block, F.lit("q").alias("kind"), F.col("q_node").alias("x"), F.lit(0).cast("long").alias("y"), F.coalesce(F.col("q_page"), F.lit(0)).cast("double").alias("v"))
        .unionByName(a.select(*block, F.lit("a").alias("kind"), F.col("a_node").alias("x"), F.lit(0).cast("long").alias("y"), F.coalesce(F.col("a_page"), F.lit(0)).cast("double").alias("v")))
        .unionByName(met.select(*block, F.lit("s").alias("kind"), F.col("q_node").alias("x"), F.col("a_node").alias("y"), F.col("similarity").alias("v")))
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        q = frame[frame.kind == "q"].sort_values(["v", "x"]).x.tolist()
        a = frame[frame.kind == "a"].sort_values(["v", "x"]).x.tolist()
        q_at, a_at = {x: k for k, x in enumerate(q)}, {x: k for k, x in enumerate(a)}
        s = frame[frame.kind == "s"]
        scores = {(q_at[x], a_at[y]): v for x, y, v in zip(s.x, s.y, s.v)}
        found = (aligned if len(q) * len(a) <= MOST_CELLS else chained)(len(q), len(a), scores, TITLE_GAP, TITLE_LEAST)
        head = frame.iloc[0]
        return pd.DataFrame([(head.q_doc, head.a_doc, head.depth, q[i], a[j], scores[i, j]) for i, j in found], columns=["q_doc", "a_doc", "depth", "q_node", "a_node", "score"])

    return rows.groupBy(*block).applyInPandas(run, "q_doc long, a_doc long, depth int, q_node long, a_node long, score double")


def banded_scores(left: pd.DataFrame, right: pd.DataFrame, comparable: np.ndarray, width: int) -> dict[tuple[int, int], float]:
    """Content scores with the bonus for a common label, of the pairs within the band that are worth a place."""
    names: dict[str, int] = {}
    a, b = scoring.side_of(left, names), scoring.side_of(right, names)
    own, other = left["label_id"].to_numpy(dtype=object), right["label_id"].to_numpy(dtype=object)
    out: dict[tuple[int, int], float] = {}
    for at in range(0, len(left), scoring.ROWS):
        to = min(len(left), at + scoring.ROWS)
        low, high = max(0, at - width), min(len(right), to + width)
        if low >= high:
            continue
        scores = scoring.score_rows(a.rows(at, to), b.rows(low, high)) * comparable[at:to, None]
        same = (own[at:to, None] == other[None, low:high]) & (own[at:to, None] != "")
        scores = scores + LABEL_BONUS * same
        for i, j in zip(*np.nonzero(scores >= LEAST_PAIR)):
            if abs(at + i - low - j) <= width:
                out[int(at + i), int(low + j)] = float(scores[i, j])
    return out


def aligned_entries(questions: DataFrame, answers: DataFrame, block: list[str], whole: bool = False) -> DataFrame:
    """(block, q, a, score, timed_out, truncated): questions and answer entries aligned in book order within a block.

    Scored by content, and a bonus for a common label, within the band.
    whole: all entries are candidates and no size is refused.

    questions: (block, q, q_seq, label_id, text) and, where texts may not be compared
    everywhere, comparable; answers: (block, a, a_seq, label_id, text); q and a are
    numbers. A question without a partner has a null a.
    """
    if "comparable" not in questions.columns:
        questions = questions.withColumn("comparable", F.lit(True))
    names = [*block, "q", "a", "score", "timed_out", "truncated"]
    types = dict(questions.dtypes)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["q_seq", "q"], kind="stable")
        right = right.sort_values(["a_seq", "a"], kind="stable")
        truncated = not whole and len(right) > MOST_CANDIDATES
        if truncated:
            right = right.iloc[:MOST_CANDIDATES]
        n, m = len(left), len(right)
        large = n * m > MOST_CELLS
        late = large and not whole
        found: dict[int, int] = {}
        scores: dict[tuple[int, int], float] = {}
        if n and m and not late:
            scores = banded_scores(left, right, left["comparable"].fillna(False).to_numpy(dtype=bool), max(BAND, abs(n - m) + 1))
            found = dict((chained if large else aligned)(n, m, scores, GAP, LEAST_PAIR, BAND))
        head = tuple(left.iloc[0][block]) if n else ()
        a = right["a"].tolist()
        rows = [(*head, x, a[found[i]] if i in found else None, scores[i, found[i]] if i in found else 0.0, late, truncated) for i, x in enumerate(left["q"].tolist())]
        return pd.DataFrame(rows, columns=names).astype({"a": "Int64"})

    schema = ", ".join([*[f"{b} {types[b]}" for b in block], "q long, a long, score double, timed_out boolean, truncated boolean"])
    sides = [scoring.profiled(df.select(*block, *columns, "label_id", "text")) for df, columns in ((questions, ("q", "q_seq", "comparable")), (answers, ("a", "a_seq")))]
    right = sides[1].toDF(*sides[1].columns)
    return sides[0].groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(run, schema)


def compared_formulas(question: list[str], candidate: list[str], skeletons: dict[str, str]) -> tuple[int, int, int]:
    """(matched, conflicts, missing): each expression takes the best unused partner, else an unused one of its shape conflicts."""
    free = list(range(len(candidate)))
    matched = conflicts = missing = 0
    for f in question:
        best, score = None, 0.0
        for k in free:
            s = bigram_dice(f, candidate[k])
            if s > score:
                best, score = k, s
        if best is not None and score >= SAME_EXPRESSION:
            free.remove(best)
            matched += 1
        elif (near := next((k for k in free if skeletons[candidate[k]] == skeletons[f]), None)) is not None:
            free.remove(near)
            conflicts += 1
        else:
            missing += 1
    return matched, conflicts, missing


def formula_ceilings(texts: DataFrame, policy: str = "STRICT", coverage: float = 0.1) -> DataFrame:
    """texts (q, q_text, a_text) with matched, conflicts, missing and the ceiling that formulas put on a match."""
    sides = texts.select(
        "q",
        tf.formula_fragments(F.col("q_text")).alias("qf"),
        tf.formula_fragments(F.col("a_text")).alias("af"),
        (tf.brackets_balance(F.col("q_text")) & tf.brackets_balance(F.col("a_text"))).alias("complete"),
        (F.coalesce("a_text", F.lit("")) != "").alias("has_answer"),
    )
    sides = sides.withColumns({"qs": F.transform("qf", tf.skeleton), "as": F.transform("af", tf.skeleton)})

    @F.pandas_udf("matched int, conflicts int, missing int")
    def compared(qf: pd.Series, af: pd.Series, qs: pd.Series, as_: pd.Series) -> pd.DataFrame:
        rows = [compared_formulas(list(a), list(b), dict(zip(b, y)) | dict(zip(a, x))) for a, b, x, y in zip(qf, af, qs, as_)]
        return pd.DataFrame(rows, columns=["matched", "conflicts", "missing"])

    out = sides.withColumn("c", compared("qf", "af", "qs", "as")).withColumn("total", F.size("qf"))
    need = 1.0 if policy == "STRICT" else coverage
    idle = (F.col("total") == 0) | ~F.col("has_answer")
    reason = (
        F.when(idle, F.lit(None))
        .when(F.col("c.conflicts") > 0, "FORMULA_CONFLICT")
        .when(~F.col("complete"), "FORMULA_EXTRACTION_INCOMPLETE")
        .when(F.col("c.matched") < need * F.col("total"), "FORMULA_SET_MISSING")
    )
    return out.select("q", "total", "c.*", F.when(reason.isNotNull(), "REVIEW").alias("ceiling"), reason.alias("ceiling_reason"))
