"""Outlines: spans of nodes, what each level of a tree holds, alignment regions."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import ids
from quillgraph.functions import textfeat as tf
from quillgraph.runtime import checkpoint

# Thresholds of the verdict on a level.
LONGEST_QUESTION, BARE_QUESTIONS, PAGE_MARKERS, MARKERS_AGREE = 8, 20, 10, 0.9


def outline_nodes(outline: DataFrame) -> DataFrame:
    """Nodes with a title; repeated rows once."""
    return outline.select("doc_id", "node_id", "depth", "title", "page", "end_page", "child_count").filter("doc_id is not null and title <> ''").distinct()


def spanned(outline: DataFrame, docs: DataFrame) -> DataFrame:
    """Nodes with `last` and `span`: a node without an end lasts to the page before the next later node of its level or above.

    The next node is found within the book by page and depth: of each depth the
    first later page, then the least over the depths at or above (a book has few
    depths), so no node is paired with all others.
    """
    nodes = outline_nodes(outline).withColumn("p", F.coalesce("page", F.lit(0)))
    pages = docs.select("doc_id", F.when(F.col("num_pages") > 0, F.col("num_pages")).alias("num_pages")).distinct()
    # every depth's pages in order, each with all nodes of that depth or deeper asking for the next one
    depths = nodes.select("doc_id", F.col("depth").alias("of")).distinct()
    asks = nodes.select("doc_id", "node_id", "p", "depth").join(depths, "doc_id").filter("of <= depth")
    marks = nodes.select("doc_id", F.col("depth").alias("of"), "p").distinct().withColumn("node_id", F.lit(None).cast("long"))
    both = asks.select("doc_id", "of", "p", "node_id").unionByName(marks)
    later = Window.partitionBy("doc_id", "of").orderBy("p").rangeBetween(1, Window.unboundedFollowing)
    found = both.withColumn("next", F.min(F.when(F.col("node_id").isNull(), F.col("p"))).over(later)).filter("node_id is not null")
    nearest = found.groupBy("doc_id", "node_id").agg(F.min("next").alias("next"))
    out = nodes.join(nearest, ["doc_id", "node_id"], "left").join(pages, "doc_id", "left")
    end = F.coalesce(F.col("next") - 1, F.col("num_pages"))
    last = F.when(F.col("end_page").isNotNull(), F.col("end_page")).when(end.isNotNull(), F.greatest(F.col("p"), end))
    span = F.when(F.col("end_page").isNotNull(), F.col("end_page") - F.col("page") + 1).when(end.isNull(), 1).otherwise(F.greatest(F.lit(1), end - F.col("p") + 1))
    return out.withColumns({"last": last, "span": span, "question_id": ids.title_id(F.col("title"))}).drop("next", "num_pages", "p", "end_page")


def level_verdicts(nodes: DataFrame) -> DataFrame:
    """(doc_id, depth, kind, n): what each level of a book's outline holds, from counts over the level."""
    title = F.col("title")
    flat = F.col("question_id").rlike("^[0-9]+$") & F.col("page").isNotNull()
    counted = nodes.groupBy("doc_id", "depth").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("child_count") > 0).alias("parents"),
        F.count_if(title.rlike(tf.SECTION_MARK)).alias("structural"),
        F.count_if(title.rlike(tf.TYPE_MARK)).alias("typed"),
        F.count_if(title.rlike(tf.QUESTION_MARK)).alias("marked"),
        F.count_if(F.col("question_id") != "").alias("with_id"),
        F.count_if(tf.descriptive_length(title) >= 2).alias("descriptive"),
        F.count_if(flat).alias("flat"),
        F.array_sort(F.collect_list(F.coalesce("span", F.lit(1)))).alias("spans"),
    )
    offsets = nodes.filter(flat).groupBy("doc_id", "depth", (F.col("page") - F.col("question_id").cast("int")).alias("o")).agg(F.count("*").alias("c"))
    agree = offsets.groupBy("doc_id", "depth").agg(F.max("c").alias("agree"))
    held = counted.join(agree, ["doc_id", "depth"], "left")
    n = F.col("n")
    median = F.element_at("spans", (F.floor(n / 2) + 1).cast("int"))
    paged = (F.col("flat") >= PAGE_MARKERS) & (2 * F.col("flat") >= F.col("with_id")) & (F.col("agree") >= MARKERS_AGREE * F.col("flat"))
    kind = (
        F.when(2 * F.col("parents") > n, "SECTION")
        .when(2 * F.col("structural") > n, "SECTION")
        .when(2 * F.col("typed") > n, "QUESTION_TYPE")
        .when(2 * F.col("marked") >= n, "QUESTION")
        .when(F.col("with_id") == 0, "SECTION")
        .when(paged, "PAGE_MARKER")
        .when(2 * F.col("descriptive") >= n, "SECTION")
        .when(median > LONGEST_QUESTION, "SECTION")
        .when(n >= BARE_QUESTIONS, "QUESTION")
        .otherwise("UNKNOWN")
    )
    levels = F.count("*").over(Window.partitionBy("doc_id"))
    return held.withColumn("kind", kind).withColumn("kind", F.when((F.col("depth") == 0) & (levels > 1) & (F.col("kind") == "SECTION"), "BOOK").otherwise(F.col("kind"))).select("doc_id", "depth", "kind", "n")


def classified(outline: DataFrame, docs: DataFrame) -> DataFrame:
    """Nodes with their kind: their level's, but a question with children is a section and one without id unknown."""
    nodes = spanned(outline, docs)
    out = nodes.join(level_verdicts(nodes).select("doc_id", "depth", "kind"), ["doc_id", "depth"])
    question = F.col("kind") == "QUESTION"
    kind = F.when(question & (F.col("child_count") > 0), "SECTION").when(question & (F.col("question_id") == ""), "UNKNOWN").otherwise(F.col("kind"))
    return out.withColumn("kind", kind)


SECTIONS = ("SECTION", "BOOK", "QUESTION_TYPE")


def id_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(q_doc, a_doc, question_id, q_node, a_node): questions of both books with the same id, unique on the answer side.

    Of an id's repeated questions the last one in book order counts.
    """
    questions = nodes.filter("kind = 'QUESTION'").select("doc_id", "question_id", "node_id", "page")
    left = questions.groupBy("doc_id", "question_id").agg(F.max_by("node_id", F.struct("page", "node_id")).alias("q_node"))
    right = questions.groupBy("doc_id", "question_id").agg(F.count("*").alias("n"), F.min("node_id").alias("a_node")).filter("n = 1")
    return (
        pairs.join(left.withColumnRenamed("doc_id", "q_doc"), "q_doc")
        .join(right.withColumnRenamed("doc_id", "a_doc").drop("n"), ["a_doc", "question_id"])
        .select("q_doc", "a_doc", "question_id", "q_node", "a_node")
    )


def next_sections(frame: pd.DataFrame) -> pd.DataFrame:
    """(q_doc, a_doc, seq, next_page): where in the answer book the next later section at or above a section's depth begins, behind it.

    Read from the end; of each depth those sections are kept that begin behind all kept before them.
    """
    frame = frame.sort_values("seq")
    kept: dict[int, tuple[list[int], list[int]]] = {}
    out = []
    for seq, page, depth in zip(frame["seq"].tolist()[::-1], frame["a_page"].tolist()[::-1], frame["a_depth"].tolist()[::-1]):
        # the lists run from the farthest section to the nearest, pages falling
        near = None
        for of, (seqs, pages) in kept.items():
            if of <= depth and (k := bisect_left(pages, -page)) > 0 and (near is None or seqs[k - 1] < near[0]):
                near = seqs[k - 1], -pages[k - 1]
        out.append((seq, near[1] if near else None))
        seqs, pages = kept.setdefault(depth, ([], []))
        while pages and -pages[-1] <= page:
            seqs.pop()
            pages.pop()
        seqs.append(seq)
        pages.append(-page)
    head = frame.iloc[0]
    return pd.DataFrame([(head["q_doc"], head["a_doc"], s, n) for s, n in out], columns=["q_doc", "a_doc", "seq", "next_page"]).astype({"next_page": "Int64"})


def section_regions(sections: DataFrame, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """The answer region of each asked page: of the aligned sections around it the deepest, then the latest.

    sections: (q_doc, a_doc, q_node, q_page, q_last, q_depth, a_page, a_last, a_depth), aligned pairs;
    pages: (q_doc, page). The join by page is bucketed, a section stands in each bucket that it touches.
    """
    width = 16
    seq = Window.partitionBy("q_doc", "a_doc").orderBy("q_page", "q_node")
    ordered = sections.filter("q_page > 0 and a_page > 0").withColumn("seq", F.row_number().over(seq))
    answers = docs.select(F.col("doc_id").alias("a_doc"), F.col("num_pages").alias("a_pages")).distinct()
    ordered = checkpoint(ordered)
    places = ordered.select("q_doc", "a_doc", "seq", F.col("a_page").cast("long").alias("a_page"), F.col("a_depth").cast("int").alias("a_depth"))
    bound = places.groupBy("q_doc", "a_doc").applyInPandas(next_sections, "q_doc long, a_doc long, seq long, next_page long")
    held = ordered.join(bound, ["q_doc", "a_doc", "seq"], "left").join(answers, "a_doc", "left")
    end = F.coalesce("a_last", F.col("next_page") - 1, F.when(F.col("a_pages") > 0, F.col("a_pages")), "a_page")
    held = held.withColumns({"from": F.col("a_page"), "to": F.greatest("a_page", end)})
    # no section goes on beyond the last page that is asked for
    asked_to = pages.groupBy("q_doc").agg(F.max("page").alias("asked_to"))
    held = held.join(asked_to, "q_doc").withColumn("until", F.least(F.coalesce("q_last", "asked_to"), "asked_to")).filter("until >= q_page")
    spread = held.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("q_page") / width), F.floor(F.col("until") / width))))
    asked = pages.withColumn("bucket", F.floor(F.col("page") / width))
    hit = asked.join(spread, ["q_doc", "bucket"]).filter((F.col("page") >= F.col("q_page")) & (F.col("q_last").isNull() | (F.col("page") <= F.col("q_last"))))
    best = hit.groupBy("q_doc", "a_doc", "page").agg(F.max_by(F.struct("q_node", "from", "to"), F.struct("q_depth", "seq")).alias("b"))
    return best.select("q_doc", "a_doc", "page", F.col("b.q_node").alias("q_node"), F.col("b.from").alias("from_page"), F.col("b.to").alias("to_page"))
