"""Broken glyphs: learning a substitution table from pages with a readable twin, and applying it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.ids import WS
from quillgraph.runtime import broadcast_if_small, checkpoint

# Characters that a broken font keeps, and plausible replacements.
SURVIVES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+-*/=^_(){}[]<>|∫∑∏√±×÷≤≥≠∞→"
PLAUSIBLE = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x3000, 0x303F), (0xFF01, 0xFF65))
LEAST_VOTES, AGREE, LEAST_ANCHORS, LONGEST_SPAN, MOST_ANCHORS = 3, 0.8, 8, 24, 3_000


def anchor_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence; on the way back the left side is left first."""
    right = np.array(b)
    rows = [np.zeros(len(b) + 1, dtype=np.int32)]
    for x in a:
        last, row = rows[-1], np.zeros(len(b) + 1, dtype=np.int32)
        np.maximum.accumulate(np.maximum(last[1:], last[:-1] + (right == x)), out=row[1:])
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def page_votes(broken: str, readable: str) -> list[tuple[str, str]]:
    """(glyph, replacement) between pinned characters, where both sides hold equally many broken ones."""
    sides = []
    for text in (broken, readable):
        at = [k for k, c in enumerate(text) if c in SURVIVES][:MOST_ANCHORS]
        sides.append((text, at, [text[k] for k in at]))
    if min(len(sides[0][1]), len(sides[1][1])) < LEAST_ANCHORS:
        return []
    pinned = anchor_pairs(sides[0][2], sides[1][2])
    if len(pinned) < LEAST_ANCHORS:
        return []
    out = []
    for (a0, b0), (a1, b1) in zip(pinned, pinned[1:]):
        spans = [[c for c in text[at[x] + 1 : at[y]] if not c.isspace() and c not in SURVIVES] for (text, at, _), x, y in ((sides[0], a0, a1), (sides[1], b0, b1))]
        if spans[0] and len(spans[0]) == len(spans[1]) <= LONGEST_SPAN:
            out += [(x, y) for x, y in zip(*spans) if any(lo <= ord(y) <= hi for lo, hi in PLAUSIBLE)]
    return out


def votes(pages: DataFrame) -> DataFrame:
    """(glyph, cand, n) from pages (broken, readable); counts add up, so new pages only add votes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = [p for a, b in zip(frame["broken"], frame["readable"]) if a and b for p in page_votes(a, b)]
            yield pd.DataFrame(pairs, columns=["glyph", "cand"])

    return pages.select("broken", "readable").mapInPandas(run, "glyph string, cand string").groupBy("glyph", "cand").agg(F.count("*").alias("n"))


def glyph_table(counted: DataFrame, least: int = LEAST_VOTES, agree: float = AGREE) -> DataFrame:
    """(glyph, cand, n, total) of glyphs whose votes agree; ties fall to the smaller character."""
    best = counted.groupBy("glyph").agg(F.sum("n").alias("total"), F.max_by("cand", F.struct("n", (-F.ascii("cand")).alias("o"))).alias("cand"), F.max("n").alias("n"))
    return best.filter((F.col("n") >= least) & (F.col("n") >= agree * F.col("total"))).select("glyph", "cand", "n", "total")


def repaired(lines: DataFrame, table: DataFrame) -> DataFrame:
    """lines with each glyph of the table substituted; the table is one row of a map, at most one entry a character."""
    packed = table.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("glyph", "cand"))).alias("glyphs"))
    each = F.transform(F.split("text", ""), lambda c: F.coalesce(F.try_element_at("glyphs", c), c))
    # one row: what joins to all lines is the map, whose size the characters bound
    return lines.join(broadcast_if_small(checkpoint(packed), 64)).withColumn("text", F.when(F.col("text").isNotNull(), F.array_join(each, ""))).drop("glyphs")


def evidence(counted: DataFrame, most: int = 5) -> DataFrame:
    """(glyph, cand, n, place): the replacements with most votes of each glyph, at most `most` of them."""
    best = counted.groupBy("glyph").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "cand"))), 1, most).alias("x"))
    return best.select("glyph", F.posexplode("x").alias("k", "x")).select("glyph", "x.cand", (-F.col("x.o")).alias("n"), (F.col("k") + 1).alias("place"))


def progress(counted: DataFrame, table: DataFrame) -> DataFrame:
    """(glyphs_seen, glyphs_confident, glyphs_pending, votes) of a learner: one row."""
    seen = counted.groupBy("glyph").agg(F.sum("n").alias("n")).join(table.select("glyph", F.lit(1).alias("sure")), "glyph", "left")
    return seen.agg(F.count("*").alias("glyphs_seen"), F.count("sure").alias("glyphs_confident"), (F.count("*") - F.count("sure")).alias("glyphs_pending"), F.coalesce(F.sum("n"), F.lit(0)).alias("votes"))


def coverage_share(covered: DataFrame, most: int = 50) -> DataFrame:
    """(covered, total, coverage, missing): one row; missing are the most frequent characters that the table lacks.

    covered: as of coverage(), one row a character; the missing ones are picked by a top-k, so no list of all is made.
    """
    sums = covered.agg(F.coalesce(F.sum(F.when(F.col("covered"), F.col("n"))), F.lit(0)).alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    top = covered.filter(~F.col("covered")).orderBy(F.desc("n"), "glyph").limit(most)
    missing = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "glyph"))).alias("x")).select(F.transform("x", lambda v: v["glyph"]).alias("missing"))
    share = F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("covered") / F.col("total"), 4))
    return sums.join(missing).select("covered", "total", share.alias("coverage"), "missing")


def coverage(lines: DataFrame, table: DataFrame) -> DataFrame:
    """(glyph, n, covered): characters that a broken font could have changed, and whether the table has them."""
    kept = "[" + "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in SURVIVES) + r"\x{20}-\x{7e}" + WS[1:-1] + "]"
    chars = lines.select(F.explode(F.filter(F.split("text", ""), lambda c: (c != "") & ~c.rlike(kept))).alias("glyph")).groupBy("glyph").agg(F.count("*").alias("n"))
    return chars.join(table.select("glyph", F.lit(True).alias("covered")), "glyph", "left").fillna(False, ["covered"])
