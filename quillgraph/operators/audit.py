"""Audits of matches: order of the printed numbers, counts against a truth, leaks between pairs of books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_audit(events: DataFrame, by: list[str], order: list[str], rank: str) -> DataFrame:
    """(by, n, breaks, inversions): adjacent steps back, and pairs in the wrong order.

    Two ranks differ first in one bit: of each bit, events that agree in the bits
    above it form a group, in which an event without the bit counts the earlier
    ones with it. That takes as many rows an event as ranks have bits.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    held = events.withColumns({"k": F.row_number().over(w), "last": F.lag(rank).over(w)})
    breaks = held.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(rank) < F.col("last")).alias("breaks"))
    own = events.select(*by, rank).distinct().withColumn("_rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(rank)) - 1)
    bits = own.groupBy(*by).agg(F.length(F.bin(F.max("_rank").cast("long"))).alias("bits"))
    placed = held.select(*by, "k", rank).join(own, [*by, rank]).join(bits, by)
    spread = placed.withColumn("bit", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)))
    spread = spread.select(*by, "k", "bit", F.expr("shiftright(_rank, bit + 1)").alias("above"), F.expr("shiftright(_rank, bit) & 1").alias("set"))
    before = F.sum("set").over(Window.partitionBy(*by, "bit", "above").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    inversions = spread.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("set") == 0).groupBy(*by).agg(F.sum("before").alias("inversions"))
    return breaks.join(inversions, by, "left").fillna(0, ["inversions"])


def break_examples(events: DataFrame, by: list[str], order: list[str], rank: str, most: int = 5) -> DataFrame:
    """(by, k, last, rank): the first steps back of each group, at most `most` of them."""
    w = Window.partitionBy(*by).orderBy(*order)
    held = events.withColumns({"k": F.row_number().over(w), "last": F.lag(rank).over(w)}).filter(F.col(rank) < F.col("last"))
    first = held.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct("k", "last", F.col(rank).alias("rank")))), 1, most).alias("x"))
    return first.select(*by, F.explode("x").alias("x")).select(*by, "x.*")


def start_alignment(events: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, starts, continuations, labels, start_labels) of events (doc_id, label, page) against pages that print the label."""
    flagged = events.join(headings.select("doc_id", "label", "page", F.lit(True).alias("printed")).distinct(), ["doc_id", "label", "page"], "left")
    printed = F.coalesce("printed", F.lit(False))
    return flagged.groupBy("doc_id").agg(
        F.count_if(printed).alias("starts"), F.count_if(~printed).alias("continuations"), F.count_distinct("label").alias("labels"), F.count_distinct(F.when(printed, F.col("label"))).alias("start_labels")
    )


def strict_metrics(matches: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """(by, accepted, confirmed, wrong_page, unidentifiable): matches (by, label, page) against spans (by, label, from_page, to_page)."""
    held = matches.join(truth, [*by, "label"], "left")
    inside = F.col("page").between(F.col("from_page"), F.col("to_page"))
    return held.groupBy(*by).agg(
        F.count("*").alias("accepted"), F.count_if(inside).alias("confirmed"), F.count_if(~inside).alias("wrong_page"), F.count_if(F.col("from_page").isNull()).alias("unidentifiable")
    )


def rung_histogram(matches: DataFrame, by: list[str]) -> DataFrame:
    return matches.groupBy(*by, "rung").agg(F.count("*").alias("n"))
