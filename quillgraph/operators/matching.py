"""Joins of questions with answers, and the decisions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import ids
from quillgraph.functions import textfeat as tf
from quillgraph.operators import scoring
from quillgraph.runtime import spread

#: Rungs from the strongest to the weakest.
RUNGS = ("AUTO_MATCH", "REVIEW", "LOCATED", "REFUSED", "BLOCKED")
STRONG, WEAK, MARGIN_SAME_LABEL, MARGIN_CONTENT = 0.55, 0.3, 0.15, 0.12
MOST_REVIEWED = 5
ENTRY_COLUMNS = ("doc_id", "id", "label", "ordinal", "page", "end_page", "text", "scoped_text", "answer", "source", "structural")


def book_entries(entries: DataFrame) -> DataFrame:
    """Entries of books with the canonical label; repeated rows once."""
    held = entries.select(*ENTRY_COLUMNS).filter("doc_id is not null").distinct()
    return held.withColumn("label_id", ids.normalize_id(F.regexp_extract(F.coalesce("id", F.lit("")), r"([0-9]{1,4}(?:[.．][0-9]{1,4})*)", 1)))


def label_lookup(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, label) with status and number of entries: MATCHED, AMBIGUOUS, NOT_FOUND or NO_INDEX."""
    asked = wanted.select("doc_id", "label").distinct().withColumn("label_id", ids.normalize_id(F.col("label")))
    hits = entries.filter("label_id <> ''").groupBy("doc_id", "label_id").agg(F.count("*").alias("hits"), F.min("ordinal").alias("ordinal"))
    books = entries.select("doc_id", F.lit(True).alias("has_index")).distinct()
    out = asked.join(hits, ["doc_id", "label_id"], "left").join(books, "doc_id", "left")
    n = F.coalesce("hits", F.lit(0))
    status = F.when(F.col("has_index").isNull(), "NO_INDEX").when((F.col("label_id") == "") | (n == 0), "NOT_FOUND").when(n > 1, "AMBIGUOUS").otherwise("MATCHED")
    return out.select("doc_id", "label", status.alias("status"), n.alias("hits"), F.when(n == 1, F.col("ordinal")).alias("ordinal"))


def questions_on_pages(entries: DataFrame, pages: DataFrame, width: int = 16) -> DataFrame:
    """(doc_id, page, id, ordinal) of the entries that lie on each asked page, one row a page; joined by page buckets."""
    held = entries.filter("page is not null").withColumn("last", F.coalesce("end_page", "page")).filter("last >= page")
    spread = held.select("doc_id", "id", "ordinal", F.col("page").alias("first"), "last", F.explode(F.sequence(F.floor(F.col("page") / width), F.floor(F.col("last") / width))).alias("bucket"))
    asked = pages.select("doc_id", "page").distinct().withColumn("bucket", F.floor(F.col("page") / width))
    return asked.join(spread, ["doc_id", "bucket"]).filter("page between first and last").select("doc_id", "page", "id", "ordinal")


def gram_table(texts: DataFrame, key: str) -> DataFrame:
    """(key, gram, n, total, norm) of normalised texts: the inverted form of their bigrams."""
    norm = texts.select(key, tf.normalize_for_match(F.col("text")).alias("norm")).filter("norm <> ''")
    return norm.select(key, "norm", F.explode(tf.bigrams(F.col("norm"))).alias("gram"), F.greatest(F.length("norm") - 1, F.lit(0)).alias("total")).groupBy(key, "gram", "total").agg(F.count("*").alias("n"))


def gram_similarity(left: DataFrame, right: DataFrame, lkey: str, rkey: str, block: list[str] | None = None) -> DataFrame:
    """(lkey, rkey, shared, similarity) of texts that share a bigram, through an inverted-index join within a block.

    left: (lkey, text, *block), right: (rkey, text, *block). Texts are few within a
    block (a pair of books, a page); grams are never dropped, as that changes scores.
    """
    block = block or []
    sides = []
    for df, key, name in ((left, lkey, "l"), (right, rkey, "r")):
        norm = df.select(*block, key, tf.normalize_for_match(F.col("text")).alias("norm")).filter("length(norm) >= 2")
        grams = norm.select(*block, key, F.explode(tf.bigrams(F.col("norm"))).alias("gram"), (F.length("norm") - 1).alias(f"{name}_total"))
        sides.append(grams.groupBy(*block, key, "gram", f"{name}_total").agg(F.count("*").alias(f"{name}_n")))
    met = sides[0].join(sides[1], [*block, "gram"])
    out = met.groupBy(*block, lkey, rkey, "l_total", "r_total").agg(F.sum(F.least("l_n", "r_n")).alias("shared"))
    return out.select(*block, lkey, rkey, "shared", (2.0 * F.col("shared") / (F.col("l_total") + F.col("r_total"))).alias("similarity"))


def content_scores(candidates: DataFrame, left: DataFrame, right: DataFrame, lkey: str, rkey: str) -> DataFrame:
    """candidates (lkey, rkey) with their content score, weighted toward formulas where both texts have some.

    Each candidate meets both normalised texts and is scored by itself; a join on
    tokens would hold some hundred rows a text. The texts are never broadcast by
    the size of their files, which says little of them.
    """
    pairs = candidates
    for df, key, name in ((left, lkey, "l"), (right, rkey, "r")):
        texts = scoring.profiled(df.select(key, "text")).select(key, F.col("norm").alias(f"{name}_norm"), F.col("formulas").alias(f"{name}_formulas"))
        pairs = pairs.join(texts.hint("merge"), key)
    held = ", ".join(f"`{c}` {kind}" for c, kind in candidates.dtypes)
    pairs = pairs.select(*candidates.columns, *scoring.PAIR_TEXTS)
    return spread(pairs, lkey, rkey).mapInArrow(scoring.pair_scores, f"{held}, score double")


def rank_of(rung: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, RUNGS)), rung), F.lit(len(RUNGS) + 1))


def capped(rung: Column, ceiling: Column) -> Column:
    """The weaker of a rung and its ceiling; no ceiling changes nothing."""
    return F.when(ceiling.isNull() | (rank_of(ceiling) <= rank_of(rung)), rung).otherwise(ceiling)


def rung_for(confidence: Column, matched: Column) -> Column:
    return F.when(~matched, "REFUSED").when(confidence.isin("HIGH", "MEDIUM"), "AUTO_MATCH").when(confidence == "LOW", "REVIEW").otherwise("REFUSED")


def permitted(rung: Column, pair_status: Column, has_region: Column) -> Column:
    """What a pair's verdict leaves of a rung: nothing of a rejected pair, no automatic match of an unknown one."""
    unknown = F.when(rung == "AUTO_MATCH", "REVIEW").when(rung.isin("REVIEW", "LOCATED"), rung).otherwise("REFUSED")
    verified = F.when(rung.isin("AUTO_MATCH", "REVIEW", "LOCATED"), rung).otherwise("REFUSED")
    return F.when(pair_status == "REJECTED_PAIR", "BLOCKED").when(pair_status == "VERIFIED_PAIR", verified).otherwise(unknown)


def decided(scored: DataFrame) -> DataFrame:
    """The decision on each question from its candidates' scores.

    scored: one row a question and candidate (q, cand, seq, label_hit, score,
    exact_id, section_aligned, comparable, carries). Ties fall to the candidate
    first in book order. Returns (q, matched, confidence, cand, n_candidates).
    """
    hit = F.col("label_hit")
    agg = scored.groupBy("q").agg(
        F.count("*").alias("n"),
        F.count_if(hit).alias("hits"),
        F.max(F.when(hit, F.struct("score", (-F.col("seq")).alias("o"), "cand"))).alias("best_hit"),
        F.sort_array(F.collect_list(F.when(hit, F.col("score"))), False).alias("hit_scores"),
        F.max(F.struct("score", (-F.col("seq")).alias("o"), "cand")).alias("best"),
        F.sort_array(F.collect_list("score"), False).alias("scores"),
        F.first("exact_id").alias("exact_id"),
        F.first("section_aligned").alias("aligned"),
        F.first("comparable").alias("comparable"),
        F.first("carries").alias("carries"),
    )
    one, many, none = F.col("hits") == 1, F.col("hits") > 1, F.col("hits") == 0
    similar = F.col("comparable") & (F.col("best_hit.score") >= WEAK)
    second_hit = F.coalesce(F.try_element_at("hit_scores", F.lit(2)), F.lit(0.0))
    clear_hit = F.col("comparable") & (F.col("best_hit.score") >= STRONG) & (F.col("best_hit.score") - second_hit > MARGIN_SAME_LABEL)
    second = F.coalesce(F.try_element_at("scores", F.lit(2)), F.lit(0.0))
    by_content = none & F.col("comparable") & F.col("carries") & (F.col("best.score") >= STRONG)
    confidence = (
        F.when(one & F.col("exact_id"), "HIGH")
        .when(one & similar, F.when(F.col("aligned"), "HIGH").otherwise("MEDIUM"))
        .when(one, F.when(F.col("aligned"), "MEDIUM").otherwise("LOW"))
        .when(many & clear_hit, "MEDIUM")
        .when(by_content & (F.col("best.score") - second > MARGIN_CONTENT), "MEDIUM")
        .when(by_content, "LOW")
        .otherwise("NONE")
    )
    out = agg.withColumn("confidence", confidence).withColumn("matched", F.col("confidence") != "NONE")
    open_candidates = F.when(many, F.col("hits")).when(none & ~(F.col("comparable") & F.col("carries")), F.col("n")).otherwise(0)
    return out.select(
        "q",
        "matched",
        "confidence",
        F.when(F.col("matched"), F.when(F.col("hits") > 0, F.col("best_hit.cand")).otherwise(F.col("best.cand"))).alias("cand"),
        F.when(F.col("matched"), 0).otherwise(open_candidates).alias("n_candidates"),
    )


def with_rungs(decisions: DataFrame) -> DataFrame:
    """decisions (matched, confidence, n_candidates, ceiling, has_region, pair_status) with rung and capped_by."""
    base = capped(rung_for(F.col("confidence"), F.col("matched")), F.col("ceiling"))
    few = F.col("n_candidates").between(1, MOST_REVIEWED)
    open_rung = F.when(few, "REVIEW").when(F.col("has_region"), "LOCATED").otherwise("REFUSED")
    first = F.when(F.col("matched"), base).otherwise(open_rung)
    final = permitted(first, F.col("pair_status"), F.col("has_region"))
    reason = (
        F.when(F.col("pair_status") == "REJECTED_PAIR", "PAIR_IDENTITY_MISMATCH")
        .when(final != first, "PAIR_IDENTITY_UNKNOWN")
        .when(~F.col("matched") & few, "AMBIGUOUS_LABEL")
        .when(~F.col("matched") & F.col("has_region"), "NO_QUESTION_LEVEL_INDEX")
        .when(F.col("matched") & (base != rung_for(F.col("confidence"), F.col("matched"))), F.col("ceiling_reason"))
        .when(F.col("matched") & (F.col("confidence") == "LOW"), "LOW_CONFIDENCE")
    )
    return decisions.withColumns({"rung": final, "capped_by": reason})


def positional_support(matches: DataFrame, by: list[str], order: str) -> DataFrame:
    """A match of low confidence between two strong neighbours, as they stood before, becomes a medium one."""
    w = Window.partitionBy(*by).orderBy(order)
    strong = F.col("matched") & F.col("confidence").isin("HIGH", "MEDIUM")
    held = matches.withColumn("strong", strong)
    both = F.coalesce(F.lag("strong").over(w), F.lit(False)) & F.coalesce(F.lead("strong").over(w), F.lit(False))
    lifted = F.when((F.col("confidence") == "LOW") & F.col("matched") & both, "MEDIUM").otherwise(F.col("confidence"))
    return held.withColumn("supported", lifted).drop("strong")


def separated_by_position(candidates: DataFrame, key: list[str]) -> DataFrame:
    """(key, ordinal, alternatives): the only candidate inside its window, and how many others there are.

    candidates: (key, ordinal, from_place, to_place). Off by default: matching never calls it.
    """
    inside = F.col("ordinal").between(F.col("from_place"), F.col("to_place"))
    held = candidates.groupBy(*key).agg(F.count_if(inside).alias("inside"), F.max(F.when(inside, F.col("ordinal"))).alias("ordinal"), (F.count("*") - 1).alias("alternatives"))
    return held.filter("inside = 1").select(*key, "ordinal", "alternatives")


def identities(entries: DataFrame) -> DataFrame:
    """entries with entry_id, source:ordinal#label@page, and key; a missing part reads null."""
    label = F.when(F.col("label_id") != "", F.col("label_id")).otherwise(F.coalesce("label", F.lit("")))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("source", "ordinal", "page")]
    held = entries.withColumn("key", F.coalesce(F.nullif(ids.question_key(label, F.lit("")), F.lit("")), label))
    return held.withColumn("entry_id", F.concat(parts[0], F.lit(":"), parts[1], F.lit("#"), label, F.lit("@"), parts[2]))


def described_region(first: Column, last: Column, section: Column) -> Column:
    """Where to look in the answer book, in words."""
    where = F.when(first == last, F.concat(F.lit("答案册第 "), first, F.lit(" 页"))).otherwise(F.concat(F.lit("答案册第 "), first, F.lit("–"), last, F.lit(" 页")))
    return F.when(first.isNull(), F.lit(None)).when(F.coalesce(section, F.lit("")) == "", where).otherwise(F.concat(section, F.lit(" · "), where))


def positional_window(ordinal: Column, questions: Column, answers: Column, tolerance: float = 0.06, least: int = 4) -> Column:
    """STRUCT<from, to>: where in the answer index a question of this ordinal is expected; null without a scale."""
    expected = F.floor(ordinal * (answers - 1) / (questions - 1) + 0.5)
    half = F.greatest(F.lit(least), F.ceil(answers * tolerance))
    return F.when((ordinal >= 0) & (questions > 1) & (answers > 0), F.struct(F.greatest(F.lit(0), expected - half).alias("from"), F.least(answers - 1, expected + half).alias("to")))
