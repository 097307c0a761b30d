"""The whole linkage of books, many pairs at once: index, verify, match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import matching, outline, pairs, sequence, structure
from quillgraph.runtime import broadcast_if_small, checkpoint, large


def verified_pairs(lines: DataFrame, outline: DataFrame, entries: DataFrame, books: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """(q_doc, a_doc, status, reason) of each pair; entries as of matching.book_entries(), bound as of pairs.binding_states()."""
    # both read the same first lines; the lines are shuffled once for them
    texts = checkpoint(pairs.first_texts(lines, outline, max(pairs.YEAR_LINES, pairs.SUBJECT_LINES)))
    sources = entries.groupBy("doc_id").agg(F.bool_and(F.col("source") == "OUTLINE").alias("by_outline"))
    return pairs.verdicts(books, pairs.roles(entries), pairs.years(lines, outline, texts), pairs.subjects(lines, outline, texts), pairs.anchors(entries, books), sources, bound)


def gates(lines: DataFrame, docs: DataFrame, books: DataFrame) -> DataFrame:
    """(q_doc, a_doc, comparable, carries) of each pair; alphabets are compared only where both layers are opaque."""
    quality = checkpoint(structure.text_quality(lines, docs).select("doc_id", "quality").distinct())
    opaque = quality.filter("quality = 'OPAQUE'").select("doc_id")
    both = books.join(opaque.withColumnRenamed("doc_id", "q_doc"), "q_doc", "left_semi").join(opaque.withColumnRenamed("doc_id", "a_doc"), "a_doc", "left_semi")
    alike = structure.alphabet_overlap(lines.join(broadcast_if_small(opaque, 16), "doc_id", "left_semi"), both).select("q_doc", "a_doc", "comparable")
    return pairs.text_gates(quality, books.join(alike, ["q_doc", "a_doc"], "left").fillna(False, ["comparable"]))


def regions(held: DataFrame, open_pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(q_doc, a_doc, q, from, to, exact): where the answer of a question lies, by the outlines' ids, else by their aligned sections."""
    asked = open_pairs.join(held.select(F.col("doc_id").alias("q_doc"), F.col("n").alias("q"), "label_id", "page"), "q_doc")
    ends = docs.groupBy(F.col("doc_id").alias("a_doc")).agg(F.max(F.when(F.col("num_pages") > 0, F.col("num_pages"))).alias("pages"))
    answers = nodes.filter("page > 0").select(F.col("doc_id").alias("a_doc"), F.col("node_id").alias("a_node"), F.col("page").alias("a_page"), F.col("last").alias("a_last"), F.col("depth").alias("a_depth"))
    exact = outline.id_pairs(nodes, open_pairs).join(answers, ["a_doc", "a_node"]).join(ends, "a_doc", "left")
    last = F.coalesce("a_last", "a_page")
    exact = exact.select("q_doc", "a_doc", F.col("question_id").alias("label_id"), F.col("a_page").alias("e_from"), F.greatest("a_page", F.least(last, F.coalesce("pages", last))).alias("e_to"))
    sections = nodes.filter(F.col("kind").isin(*outline.SECTIONS))
    exact = large(exact)
    asking = sections.filter("page > 0").select(F.col("doc_id").alias("q_doc"), F.col("node_id").alias("q_node"), F.col("page").alias("q_page"), F.col("last").alias("q_last"), F.col("depth").alias("q_depth"))
    titles = large(sequence.aligned_titles(sections, open_pairs)).select("q_doc", "a_doc", "q_node", "a_node")
    found = outline.section_regions(titles.join(asking, ["q_doc", "q_node"]).join(answers, ["a_doc", "a_node"]), asked.filter("page is not null").select("q_doc", "page").distinct(), docs)
    found = large(found.drop("q_node"))
    out = asked.join(exact, ["q_doc", "a_doc", "label_id"], "left").join(found, ["q_doc", "a_doc", "page"], "left")
    is_exact = F.col("e_from").isNotNull()
    return out.select("q_doc", "a_doc", "q", F.coalesce("e_from", "from_page").alias("from"), F.when(is_exact, F.col("e_to")).otherwise(F.col("to_page")).alias("to"), is_exact.alias("exact"))


def linked(entries: DataFrame, verdicts: DataFrame, nodes: DataFrame, docs: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """One row a question and pair: the answer entry, the confidence and the rung that is left of it.

    A rejected pair is decided without touching texts. Questions with entries of
    their label are decided among those (among those in the question's region, if
    there are any); the rest of a pair is aligned in book order with the entries of
    its region, or of the whole book without one. nodes: as of outline.classified().
    gates: what the text layers of a pair are good for, as of pairs.text_gates();
    without them all texts are taken for usable.
    """
    held = large(entries.withColumn("n", F.monotonically_increasing_id()).filter("text <> ''"))
    left = held.select(F.col("doc_id").alias("q_doc"), F.col("n").alias("q"), F.struct("page", "ordinal", "id").alias("q_place"), "label_id", "text")
    right = held.select(F.col("doc_id").alias("a_doc"), F.col("n").alias("a"), F.struct("page", "ordinal", "id").alias("a_place"), "label_id", F.col("page").alias("a_page"), "structural", "text")
    key = ["q_doc", "a_doc", "q"]
    verdicts = checkpoint(verdicts.select("q_doc", "a_doc", "status"))
    open_pairs = checkpoint(verdicts.filter("status <> 'REJECTED_PAIR'").select("q_doc", "a_doc"))
    if gates is None:
        gates = open_pairs.withColumns({"comparable": F.lit(True), "carries": F.lit(True)})
    gates = checkpoint(gates.select("q_doc", "a_doc", "comparable", "carries"))
    where = large(regions(held, open_pairs, large(nodes), docs))
    open_asked = open_pairs.join(left, "q_doc")
    same = open_asked.filter("label_id <> ''").select(*key, "label_id").join(right.drop("text"), ["a_doc", "label_id"]).join(where, key)
    inside = F.col("a_page").between(F.col("from"), F.col("to"))
    w = Window.partitionBy(*key)
    same = same.withColumns({"hits": F.count("*").over(w), "any_inside": F.max(F.coalesce(inside, F.lit(False))).over(w)})
    same = large(same.filter(~F.col("any_inside") | inside | F.col("exact")))
    only = F.col("hits") == 1
    by_label = same.select(*key, "a", "a_place", F.lit(True).alias("label_hit"), (only & (F.col("exact") | F.coalesce("structural", F.lit(False)))).alias("exact_id"), F.col("any_inside").alias("section_aligned"))
    # the rest, aligned in book order within its region; pages of no region are -1
    rest = open_asked.join(same.select(*key).distinct(), key, "left_anti").join(where, key).withColumns({"lo": F.coalesce("from", F.lit(-1)), "hi": F.coalesce("to", F.lit(-1))})
    block = ["q_doc", "a_doc", "lo", "hi"]
    rest = large(rest.withColumn("q_seq", F.row_number().over(Window.partitionBy(*block).orderBy("q_place", "q"))))
    pool = rest.select(*block).distinct().join(right, "a_doc").filter("lo < 0 or a_page between lo and hi")
    pool = pool.withColumn("a_seq", F.row_number().over(Window.partitionBy(*block).orderBy("a_place", "a")))
    pool = large(pool)
    rest = rest.join(gates, ["q_doc", "a_doc"], "left")
    placed = sequence.aligned_entries(rest.select(*block, "q", "q_seq", "label_id", "text", "comparable"), pool.select(*block, "a", "a_seq", "label_id", "text"), block, whole=True)
    by_order = placed.filter("a is not null").join(right.select("a", "a_place"), "a").select(*key, "a", "a_place", F.lit(False).alias("label_hit"), F.lit(False).alias("exact_id"), (F.col("lo") >= 0).alias("section_aligned"))
    rows = large(by_label.unionByName(by_order))
    once = held.select("n", "text")
    scored = matching.content_scores(rows.select("q", "a").distinct(), once.withColumnRenamed("n", "q"), once.withColumnRenamed("n", "a"), "q", "a")
    no = F.lit(False)
    decided = matching.decided(
        rows.join(large(scored), ["q", "a"]).join(gates, ["q_doc", "a_doc"], "left").select(
            F.struct(*key).alias("q"), F.col("a").alias("cand"), F.col("a").alias("seq"), "label_hit", F.round("score", 9).alias("score"), "exact_id", "section_aligned", F.coalesce("comparable", no).alias("comparable"), F.coalesce("carries", no).alias("carries")
        )
    ).select("q.*", "matched", "confidence", "cand", "n_candidates")
    every = open_asked.select(*key).join(large(decided), key, "left").fillna({"matched": False, "confidence": "NONE", "n_candidates": 0})
    texts = every.filter("matched").join(once.select(F.col("n").alias("q"), F.col("text").alias("q_text")), "q").join(once.select(F.col("n").alias("cand"), F.col("text").alias("a_text")), "cand")
    ceilings = sequence.formula_ceilings(texts.select(F.struct(*key).alias("q"), "q_text", "a_text")).select("q.*", "ceiling", "ceiling_reason")
    out = every.join(large(ceilings), key, "left").join(verdicts.select("q_doc", "a_doc", F.col("status").alias("pair_status")), ["q_doc", "a_doc"])
    out = out.join(where.select(*key, F.col("from").isNotNull().alias("has_region")), key, "left").fillna({"has_region": False})
    names = held.select(F.col("n"), "label_id", "ordinal", "page")
    out = matching.with_rungs(out).join(names.select(F.col("n").alias("q"), F.col("label_id").alias("label"), F.col("page").alias("q_page")), "q")
    return out.join(names.select(F.col("n").alias("cand"), F.col("ordinal").alias("a_ordinal"), F.col("page").alias("a_page")), "cand", "left").select("q_doc", "a_doc", "label", "q_page", "confidence", "a_ordinal", "a_page", "rung", "capped_by")
