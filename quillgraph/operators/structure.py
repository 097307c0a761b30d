"""Structure of a book's lines: quality, running lines, question entries, contents pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import ids
from quillgraph.functions import textfeat as tf

# Character classes and thresholds of the verdict on a text layer.
CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{fffd}]"
# Blocks that follow each other, as Armenian and Hebrew, Arabic and Syriac, are written as one range.
ODD_SCRIPT = (
    r"[\x{530}-\x{5ff}\x{600}-\x{74f}\x{900}-\x{9ff}\x{a00}-\x{a7f}\x{b80}-\x{bff}\x{c00}-\x{c7f}\x{d00}-\x{d7f}\x{e00}-\x{e7f}\x{f00}-\x{fff}\x{10a0}-\x{10ff}\x{1200}-\x{137f}]"
)
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
STRUCTURED = r"[0-9A-Za-z+\-*/=^_(){}\[\]<>|∫∑∏√±×÷≤≥≠∞→]"
QUALITY = {"odd_corrupt": 0.03, "control_corrupt": 0.02, "odd_degraded": 0.01, "control_degraded": 0.005, "han_expected": 0.005, "structured_opaque": 0.25}
LEAST_CHARS, CHARS_PER_PAGE, PAGE_COVERAGE, LEAST_PAGES = 200, 20, 0.5, 8
ALPHABET_LEAST, ALPHABET_SHARE = 250, 0.9
# What makes a form a running line.
RUNNING = {"pages": 8, "page_share": 0.05, "edge_share": 0.5, "edge_depth": 2, "page_lines": 5, "length": 4}
#: Lines of a block, by number.
BLOCK = 4_096
QUESTION_PAGES, MARK_SHARE = 4, 0.2
TOC_LABELS, TOC_SHARE = 4, 0.6
OFFSET_SUPPORT, OFFSET_AGREEMENT = 20, 0.6


def book_lines(lines: DataFrame) -> DataFrame:
    """Lines with a place in their book; repeated rows once."""
    return lines.select("doc_id", "line_no", "page", "text", "top", "bottom").filter("doc_id is not null and line_no is not null").distinct()


def page_range(lines: DataFrame, first: int | Column, last: int | Column) -> DataFrame:
    """The range scan: the filter reaches the reader."""
    return lines.filter(F.col("page").between(first, last))


def sampled_pages(lines: DataFrame, docs: DataFrame, pages: int = 12, most_lines: int = 4_000) -> DataFrame:
    """Every n-th page of each book, up to and with the page that passes most_lines lines."""
    stride = F.greatest(F.lit(1), F.floor(F.col("num_pages") / pages))
    held = book_lines(lines).join(docs.select("doc_id", "num_pages").distinct(), "doc_id").filter((F.col("page") >= 1) & (F.col("page") <= F.col("num_pages")) & (F.pmod(F.col("page") - 1, stride) == 0))
    counts = held.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = counts.withColumn("before", before).filter(F.col("before") <= most_lines).select("doc_id", "page")
    return held.join(kept, ["doc_id", "page"], "left_semi").drop("num_pages")


def text_quality(lines: DataFrame, docs: DataFrame, expect_han: bool = False) -> DataFrame:
    """The verdict on each book's text layer, with the counts behind it; one aggregate over the lines."""
    text = F.coalesce("text", F.lit(""))
    counts = (
        book_lines(lines)
        .groupBy("doc_id")
        .agg(
            F.sum(F.length(text)).alias("chars"),
            *[F.sum(F.regexp_count(text, F.lit(p))).alias(n) for n, p in (("control", CONTROL), ("odd", ODD_SCRIPT), ("han", HAN), ("structured", STRUCTURED))],
            F.count_distinct(F.when(ids.trimmed(text) != "", F.col("page"))).alias("pages_with_text"),
        )
    )
    books = docs.select("doc_id", F.when(F.col("num_pages") > 0, F.col("num_pages")).alias("pages_read")).distinct()
    out = books.join(counts, "doc_id", "left")
    share = {n: F.col(n) / F.col("chars") for n in ("control", "odd", "han", "structured")}
    judged = F.col("chars") >= LEAST_CHARS
    opaque = F.when(share["structured"] >= QUALITY["structured_opaque"], "OPAQUE").otherwise("CORRUPT")
    sparse = (F.col("pages_read") >= LEAST_PAGES) & ((F.col("chars") / F.col("pages_read") < CHARS_PER_PAGE) | (F.col("pages_with_text") / F.col("pages_read") < PAGE_COVERAGE))
    quality = F.when(F.col("chars").isNull(), "SCANNED").when(F.col("chars") == 0, "BLANK").when(sparse, "SPARSE_LAYER")
    if expect_han:
        quality = quality.when(judged & (share["han"] < QUALITY["han_expected"]), opaque)
    quality = (
        quality.when(judged & (share["odd"] > QUALITY["odd_corrupt"]), opaque)
        .when(share["control"] > QUALITY["control_corrupt"], "CORRUPT")
        .when((share["odd"] > QUALITY["odd_degraded"]) | (share["control"] > QUALITY["control_degraded"]), "DEGRADED")
        .otherwise("USABLE")
    )
    return out.withColumn("quality", quality)


def alphabets(lines: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, ch): characters that a book uses at least so often, without white space.

    Each line counts its characters once before the shuffle.
    """
    chars = book_lines(lines).select("doc_id", F.explode(F.filter(F.split("text", ""), lambda c: (c != "") & ~c.rlike(ids.WS))).alias("ch"))
    return chars.groupBy("doc_id", "ch").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("doc_id", "ch")


def alphabet_overlap(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(q_doc, a_doc, shared, total, comparable) of each pair of books."""
    own = alphabets(lines)
    sizes = own.groupBy("doc_id").agg(F.count("*").alias("n"))
    shared = (
        pairs.join(own.withColumnsRenamed({"doc_id": "q_doc"}), "q_doc")
        .join(own.withColumnsRenamed({"doc_id": "a_doc"}), ["a_doc", "ch"])
        .groupBy("q_doc", "a_doc")
        .agg(F.count("*").alias("shared"))
    )
    out = pairs.join(shared, ["q_doc", "a_doc"], "left")
    for side in ("q", "a"):
        out = out.join(sizes.withColumnsRenamed({"doc_id": f"{side}_doc", "n": f"{side}_n"}), f"{side}_doc", "left")
    out = out.fillna(0, ["shared", "q_n", "a_n"]).withColumn("total", F.least("q_n", "a_n"))
    enough = (F.col("total") >= ALPHABET_LEAST) & (F.col("shared") >= ALPHABET_SHARE * F.col("total"))
    return out.select("q_doc", "a_doc", "shared", "total", enough.alias("comparable"))


def running_forms(lines: DataFrame) -> DataFrame:
    """(doc_id, form, pages, edge, total) of lines that run along a book's page edges."""
    held = book_lines(lines)
    page = Window.partitionBy("doc_id", "page")
    placed = held.withColumns(
        {"k": F.row_number().over(page.orderBy("line_no")), "of": F.count("*").over(page), "form": tf.boilerplate_form(F.col("text")), "labelled": tf.carries_label(F.col("text"))}
    )
    books = held.groupBy("doc_id").agg(F.count_distinct(F.coalesce("page", F.lit(-1))).alias("of_pages"))
    edge = (F.col("k") <= RUNNING["edge_depth"]) | (F.col("of") - F.col("k") < RUNNING["edge_depth"])
    forms = (
        placed.filter((F.col("of") >= RUNNING["page_lines"]) & ~F.col("labelled") & (F.length("form") >= RUNNING["length"]))
        .groupBy("doc_id", "form")
        .agg(F.count_distinct("page").alias("pages"), F.sum(edge.cast("int")).alias("edge"), F.count("*").alias("total"))
        .filter(F.col("pages") >= RUNNING["pages"])
    )
    kept = forms.join(books, "doc_id").filter((F.col("pages") >= RUNNING["page_share"] * F.col("of_pages")) & (F.col("edge") >= RUNNING["edge_share"] * F.col("total")))
    return kept.select("doc_id", "form", "pages", "edge", "total")


def without_running_lines(lines: DataFrame) -> DataFrame:
    """The lines of the books without running lines; a line with a question's number always stays."""
    held = book_lines(lines).withColumns({"form": tf.boilerplate_form(F.col("text")), "labelled": tf.carries_label(F.col("text"))})
    forms = running_forms(lines).select("doc_id", "form", F.lit(False).alias("labelled"))
    return held.join(forms, ["doc_id", "form", "labelled"], "left_anti").drop("form", "labelled")


def opening_lines(lines: DataFrame) -> DataFrame:
    """Lines with `opens`: does the line open a question, by its number and not as a repeated heading.

    A book that marks its questions by words opens none by a bare number before a heading.
    """
    held = book_lines(lines).withColumns({"labelled": ids.is_question_line(F.col("text")), "marked": F.coalesce("text", F.lit("")).rlike(tf.LINE_MARK)})
    form = ids.trimmed(F.regexp_replace(F.coalesce("text", F.lit("")), f"{ids.WS}+", " "))
    held = held.withColumn("form", F.when(F.col("labelled"), form))
    repeated = held.filter("labelled").groupBy("doc_id", "form").agg(F.count_distinct("page").alias("n")).filter(F.col("n") > QUESTION_PAGES).select("doc_id", "form", F.lit(True).alias("repeated"))
    books = held.filter("labelled").groupBy("doc_id").agg((F.sum(F.col("marked").cast("int")) >= MARK_SHARE * F.count("*")).alias("marks"))
    out = held.join(repeated, ["doc_id", "form"], "left").join(books, "doc_id", "left")
    heading = F.coalesce("marks", F.lit(False)) & ~F.col("marked") & (tf.descriptive_length(F.col("text")) >= 2)
    return out.withColumn("opens", F.col("labelled") & F.col("repeated").isNull() & ~heading).drop("form", "repeated", "marks", "labelled", "marked")


def segmented_entries(lines: DataFrame) -> DataFrame:
    """Entries of each book: a line that opens a question and all lines up to the next one.

    Running lines extend an entry's pages but add no text. Lines before the first
    question belong to none; entries without text are left out after numbering.
    """
    opened = opening_lines(lines).withColumns({"form": tf.boilerplate_form(F.col("text")), "labelled": tf.carries_label(F.col("text"))})
    running = running_forms(lines).select("doc_id", "form", F.lit(False).alias("labelled"), F.lit(True).alias("running"))
    # questions before a line: of the blocks before its own by their sums, then within the block, so no book is sorted as a whole
    opened = opened.withColumns({"opening": F.col("opens").cast("int"), "block": F.floor(F.col("line_no") / BLOCK)})
    blocks = opened.groupBy("doc_id", "block").agg(F.sum("opening").alias("opening"))
    before = F.coalesce(F.sum("opening").over(Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).drop("opening")
    within = F.sum("opening").over(Window.partitionBy("doc_id", "block").orderBy("line_no"))
    rows = opened.join(running, ["doc_id", "form", "labelled"], "left").join(blocks, ["doc_id", "block"])
    rows = rows.withColumn("ordinal", F.col("before") + within - 1).filter("ordinal >= 0").drop("opening", "block", "before")
    first = ids.question_line(F.col("text"))
    sub = ids.sub_question_line(F.col("text"))
    piece = F.when(F.col("opens"), first["body"]).when(F.col("running"), F.lit(None)).when(sub.isNotNull(), sub["body"]).otherwise(F.col("text"))
    rows = rows.withColumns({"label": F.when(F.col("opens"), first["id"]), "piece": F.nullif(piece, F.lit("")), "is_sub": ~F.col("opens") & F.col("running").isNull() & sub.isNotNull()})
    out = rows.groupBy("doc_id", "ordinal").agg(
        F.max("label").alias("label"),
        F.min_by("page", "line_no").alias("page"),
        F.max_by("page", "line_no").alias("end_page"),
        ids.trimmed(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("line_no", "piece")))), lambda x: x["piece"]), " ")).alias("text"),
        F.sum(F.col("is_sub").cast("int")).alias("subs"),
    )
    return out.filter("text <> ''")


def contents_pages(entries: DataFrame) -> DataFrame:
    """(doc_id, page, labels, n, leaders) of contents pages: several labels, mostly with leaders to a page number."""
    text = F.coalesce("text", F.lit(""))
    pages = entries.groupBy("doc_id", "page").agg(F.count_distinct("label").alias("labels"), F.count("*").alias("n"), F.sum(text.rlike(tf.TOC_ROW).cast("int")).alias("leaders"))
    return pages.filter((F.col("labels") >= TOC_LABELS) & (F.col("leaders") >= TOC_SHARE * F.col("n")))


def without_contents(entries: DataFrame) -> DataFrame:
    """entries with `suppressed`: does the entry stand on a contents page; what is suppressed stays visible."""
    pages = contents_pages(entries).select("doc_id", "page", F.lit(True).alias("suppressed"))
    return entries.join(pages, ["doc_id", "page"], "left").fillna(False, ["suppressed"])


def contents_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, label, printed_page) of lines of a table of contents."""
    held = book_lines(lines).filter(F.col("text").rlike(tf.TOC_ROW) & ids.is_question_line(F.col("text")))
    label = ids.question_line(F.col("text"))["id"]
    return held.select("doc_id", "line_no", label.alias("label"), F.regexp_extract("text", tf.TOC_ROW, 1).cast("int").alias("printed_page"))


def page_offsets(rows: DataFrame, entries: DataFrame, support: int = OFFSET_SUPPORT) -> DataFrame:
    """(doc_id, offset, votes, support): the shift from printed to counted pages on which most labels agree.

    rows: (doc_id, seq, label, printed_page); entries: (doc_id, seq, label, page). Of
    a label the first row of either side counts; ties fall to the smaller shift.
    """
    first = rows.groupBy("doc_id", "label").agg(F.min_by("printed_page", "seq").alias("printed_page"))
    body = entries.groupBy("doc_id", "label").agg(F.min_by("page", "seq").alias("page"))
    votes = first.join(body, ["doc_id", "label"]).filter("page is not null").groupBy("doc_id", (F.col("page") - F.col("printed_page")).alias("offset")).agg(F.count("*").alias("n"))
    best = votes.groupBy("doc_id").agg(F.sum("n").alias("support"), F.max(F.struct("n", (-F.col("offset")).alias("o"))).alias("b"))
    out = best.select("doc_id", (-F.col("b.o")).alias("offset"), F.col("b.n").alias("votes"), "support")
    return out.filter((F.col("support") >= support) & (F.col("votes") >= OFFSET_AGREEMENT * F.col("support")))


def contents_locations(rows: DataFrame, entries: DataFrame, docs: DataFrame, support: int = OFFSET_SUPPORT) -> DataFrame:
    """(doc_id, label, printed_page, predicted, state): what the body says of each label that the contents list.

    state is corroborated if the body has the label on the very page, conflicted if
    elsewhere or beyond the book, unseen if it has none; books without an agreed
    shift give no rows.
    """
    first = rows.groupBy("doc_id", "label").agg(F.min_by("printed_page", "seq").alias("printed_page"))
    body = entries.groupBy("doc_id", "label").agg(F.min_by("page", "seq").alias("body_page"))
    shifts = page_offsets(rows, entries, support).select("doc_id", "offset")
    books = docs.select("doc_id", F.when(F.col("num_pages") > 0, F.col("num_pages")).alias("num_pages")).distinct()
    held = first.join(shifts, "doc_id").join(books, "doc_id", "left").join(body, ["doc_id", "label"], "left").withColumn("predicted", F.col("printed_page") + F.col("offset"))
    beyond = (F.col("predicted") < 1) | F.coalesce(F.col("predicted") > F.col("num_pages"), F.lit(False))
    state = F.when(beyond, "conflicted").when(F.col("body_page").isNull(), "unseen").when(F.col("body_page") != F.col("predicted"), "conflicted").otherwise("corroborated")
    return held.select("doc_id", "label", "printed_page", "predicted", state.alias("state"))


def located_entries(entries: DataFrame, locations: DataFrame) -> DataFrame:
    """entries (doc_id, label, page, ...) with `confirmed`; where exactly one of a label's entries is confirmed, the others go."""
    found = locations.filter("state = 'corroborated'").select("doc_id", "label", F.col("predicted").alias("located"))
    held = entries.join(found, ["doc_id", "label"], "left").withColumn("confirmed", F.coalesce(F.col("located") == F.col("page"), F.lit(False)))
    label = Window.partitionBy("doc_id", "label")
    held = held.withColumns({"of": F.count("*").over(label), "sure": F.sum(F.col("confirmed").cast("int")).over(label)})
    return held.filter((F.col("of") < 2) | (F.col("sure") != 1) | F.col("confirmed")).drop("located", "of", "sure")
