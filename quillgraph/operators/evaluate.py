"""Measures of matches against a truth, of located regions, and of what was read of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters counted as Chinese, and titles of worked examples.
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
EXAMPLE_TITLE = r"例\s*题"
SLOW = 0.95


def inside(page: Column, first: Column, last: Column) -> Column:
    return F.coalesce((page >= first) & (page <= last), F.lit(False))


def regime_metrics(matches: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """(by, accepted, confirmed, wrong_page, unidentifiable, distinct, gold, strict, recall).

    matches: (by, label, q_page, a_page), the accepted ones; truth: (by, label, q_from,
    q_to, a_from, a_to). A match is identified if its label stands on that page in the
    truth, and confirmed if its answer's page lies in the truth's range.
    """
    held = matches.join(truth, [*by, "label"], "left")
    known = inside(F.col("q_page"), F.col("q_from"), F.col("q_to"))
    right = known & inside(F.col("a_page"), F.col("a_from"), F.col("a_to"))
    counts = held.groupBy(*by).agg(
        F.count("*").alias("accepted"),
        F.count_if(right).alias("confirmed"),
        F.count_if(known & ~right).alias("wrong_page"),
        F.count_if(~known).alias("unidentifiable"),
        F.count_distinct(F.when(right, F.col("label"))).alias("distinct"),
    )
    gold = truth.groupBy(*by).agg(F.count_distinct("label").alias("gold"))
    out = gold.join(counts, by, "full_outer").fillna(0)
    return out.select(
        *by, "accepted", "confirmed", "wrong_page", "unidentifiable", "distinct", "gold",
        F.when(F.col("accepted") > 0, F.col("confirmed") / F.col("accepted")).alias("strict"), F.when(F.col("gold") > 0, F.col("distinct") / F.col("gold")).alias("recall"),
    )


def slow_share(times: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, p95, most): the value at the place floor(0.95 n) of the sorted ones, and the largest."""
    held = times.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    # counts by value keep the sorted list short, however many measurements there are
    sorted_ = held.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "c"))).alias("x"), F.sum("c").alias("n"), F.max(value).alias("most"))
    place = F.floor(F.col("n") * SLOW)
    reached = F.aggregate("x", F.struct(F.lit(0).cast("long").alias("sofar"), F.lit(None).cast(dict(times.dtypes)[value]).alias("v")), lambda s, x: F.struct((s["sofar"] + x["c"]).alias("sofar"), F.coalesce(s["v"], F.when(s["sofar"] + x["c"] > place, x["v"])).alias("v")))
    return sorted_.select(*by, "n", reached["v"].alias("p95"), "most")


def located_metrics(results: DataFrame, truth: DataFrame, entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, auto, auto_correct, review, review_hit, located, located_correct, refused, recoverable, irreducible, unidentifiable).

    results: (by, label, q_page, rung, a_pages, from_page, to_page), a_pages the pages of
    the entry or the candidates; truth as of regime_metrics(); entries: (by, page,
    end_page) of the answer book. A refused question is recoverable if the index that
    was searched has an entry on the answer's pages.
    """
    spans = truth.select(*by, "label", "a_from", "a_to").join(entries.select(*by, "page", F.coalesce("end_page", "page").alias("last")), by)
    reached = spans.filter("page <= a_to and last >= a_from").select(*by, "label", F.lit(True).alias("reachable")).distinct()
    held = results.join(truth, [*by, "label"], "left").join(reached, [*by, "label"], "left")
    known = inside(F.col("q_page"), F.col("q_from"), F.col("q_to"))
    hit = F.coalesce(F.exists("a_pages", lambda p: inside(p, F.col("a_from"), F.col("a_to"))), F.lit(False))
    there = inside(F.col("a_from"), F.col("from_page"), F.col("to_page"))
    rung = F.col("rung")
    refused = ~rung.isin("AUTO_MATCH", "REVIEW", "LOCATED")
    reachable = F.coalesce("reachable", F.lit(False))
    counts = {
        "auto": rung == "AUTO_MATCH", "auto_correct": (rung == "AUTO_MATCH") & hit, "review": rung == "REVIEW", "review_hit": (rung == "REVIEW") & hit, "located": rung == "LOCATED", "located_correct": (rung == "LOCATED") & there,
        "refused": refused, "recoverable": refused & reachable, "irreducible": refused & ~reachable,
    }
    return held.groupBy(*by).agg(*[F.count_if(known & x).alias(n) for n, x in counts.items()], F.count_if(~known).alias("unidentifiable"))


def truncated(nodes: DataFrame) -> DataFrame:
    """An outline without its questions: chapters and sections alone, which have no children any more."""
    held = nodes.filter("depth < 2")
    return held.withColumn("child_count", F.when(F.col("depth") == 1, 0).otherwise(F.col("child_count")))


def page_only(regions: DataFrame, questions: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """(by, pages, with_region, covered, correct, distinct): page in, region out, without any question index.

    regions: (by, page, from_page, to_page), questions: (by, label, page), truth: (by, label, a_from).
    """
    pages = questions.select(*by, "page").distinct().join(regions, [*by, "page"], "left")
    first = pages.groupBy(*by).agg(F.count("*").alias("pages"), F.count("from_page").alias("with_region"))
    held = questions.join(regions, [*by, "page"]).join(truth, [*by, "label"])
    right = inside(F.col("a_from"), F.col("from_page"), F.col("to_page"))
    counts = held.groupBy(*by).agg(F.count("*").alias("covered"), F.count_if(right).alias("correct"), F.count_distinct(F.when(right, F.col("label"))).alias("distinct"))
    return first.join(counts, by, "left").fillna(0, ["covered", "correct", "distinct"])


def corpus_summary(lines: DataFrame, outline: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, pages, lines, chars, han_percent, outline, examples, unresolved) of what was read of each book."""
    text = F.coalesce("text", F.lit(""))
    read = lines.select("doc_id", "line_no", "text").filter("doc_id is not null and line_no is not null").distinct()
    counts = read.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length(text)).alias("chars"), F.sum(F.regexp_count(text, F.lit(HAN))).alias("han"))
    nodes = outline.select("doc_id", "node_id", "title", "page").distinct()
    tree = nodes.groupBy("doc_id").agg(F.count("*").alias("outline"), F.count_if(F.coalesce("title", F.lit("")).rlike(EXAMPLE_TITLE)).alias("examples"), F.count_if(F.col("page").isNull()).alias("unresolved"))
    books = docs.groupBy("doc_id").agg(F.max("num_pages").alias("pages"))
    out = books.join(counts, "doc_id", "left").join(tree, "doc_id", "left").fillna(0, ["lines", "chars", "han", "outline", "examples", "unresolved"])
    percent = F.when(F.col("chars") > 0, F.round(100 * F.col("han") / F.col("chars"), 2)).otherwise(0.0)
    return out.select("doc_id", "pages", "lines", "chars", percent.alias("han_percent"), "outline", "examples", "unresolved")
