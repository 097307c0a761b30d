"""The text that belongs to one entry: its page range, cut at its own heading and the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import ids
from quillgraph.operators.structure import book_lines


def entry_lines(lines: DataFrame, entries: DataFrame, width: int = 16) -> DataFrame:
    """(doc_id, entry, line_no, page, text, top, bottom, scoped) of the lines of each entry.

    entries: (doc_id, entry, label, page, end_page, next_label, next_page). A line
    belongs to the entry's pages, from the heading with its number, if there is one,
    up to the heading of the next entry; lines that hold a page number alone go.
    """
    held = book_lines(lines).withColumn("heading", ids.question_line(F.col("text"))["id"])
    last = F.coalesce("end_page", "page")
    upper = F.when(F.col("next_page").isNotNull(), F.greatest(last, F.col("next_page"))).otherwise(last)
    spread = entries.filter("page is not null").withColumns({"last": last, "upper": upper})
    spread = spread.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("page") / width), F.floor(F.col("upper") / width)))).withColumnRenamed("page", "first")
    window = held.withColumn("bucket", F.floor(F.col("page") / width)).join(spread, ["doc_id", "bucket"]).filter("page between first and upper")
    own = window.filter(F.col("heading") == F.col("label")).groupBy("doc_id", "entry").agg(F.min("line_no").alias("start"))
    window = window.join(own, ["doc_id", "entry"], "left")
    stop = window.filter((F.col("heading") == F.col("next_label")) & (F.col("line_no") > F.col("start"))).groupBy("doc_id", "entry").agg(F.min("line_no").alias("stop"))
    inside = window.join(stop, ["doc_id", "entry"], "left").filter((F.col("start").isNull() | (F.col("line_no") >= F.col("start"))) & (F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))))
    number = ids.trimmed(F.coalesce("text", F.lit("")))
    alone = number.rlike("^[0-9]{1,6}$") & number.cast("int").between(F.col("first"), F.col("last"))
    kept = inside.filter(~F.coalesce(alone, F.lit(False)))
    return kept.select("doc_id", "entry", "line_no", "page", "text", "top", "bottom", F.col("start").isNotNull().alias("scoped"))


def entry_texts(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, entry, text, scoped, spans): the joined text of each entry and the band it takes on each page."""
    held = entry_lines(lines, entries)
    bands = held.filter("top is not null and bottom is not null").groupBy("doc_id", "entry", "page").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    spans = bands.groupBy("doc_id", "entry").agg(F.array_sort(F.collect_list(F.struct("page", "top", "bottom"))).alias("spans"))
    texts = held.groupBy("doc_id", "entry").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("x"), F.max("scoped").alias("scoped"))
    joined = ids.trimmed(F.array_join(F.transform("x", lambda v: v["text"]), " "))
    return texts.select("doc_id", "entry", joined.alias("text"), "scoped").join(spans, ["doc_id", "entry"], "left")


def section_title_forms(sections: DataFrame) -> DataFrame:
    """(doc_id, form): titles of sections as printed, and without their number where two characters are left."""
    title = ids.trimmed(F.coalesce("title", F.lit("")))
    held = sections.select("doc_id", title.alias("title")).filter("title <> ''")
    bare = ids.trimmed(F.regexp_replace("title", rf"^{ids.WS}*[0-9]+(?:[.．][0-9]+)*{ids.WS}*", ""))
    both = F.array(F.col("title"), F.when(F.length(bare) >= 2, bare))
    return held.select("doc_id", F.explode(F.array_compact(both)).alias("form")).distinct()


def cleaning_patterns(titles: DataFrame, running: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, patterns): what is taken out of a book's texts, titles from the longest on, then running forms.

    titles: (doc_id, form), running: (doc_id, form) of structure.running_forms(). Blanks in a piece meet any number of blanks.
    """
    rows = titles.select("doc_id", "form", F.lit(0).alias("kind")).unionByName(running.filter(F.length("form") >= least).select("doc_id", "form", F.lit(1).alias("kind")))
    pattern = F.regexp_replace(F.regexp_replace("form", r"([.*+?^${}()|\[\]\\])", r"\\$1"), f"{ids.WS}+", r"\\s*")
    rows = rows.select("doc_id", F.struct("kind", (-F.length("form")).alias("o"), pattern.alias("pattern")).alias("x"))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["pattern"]).alias("patterns"))


def cleaned(text: Column, forms: Column) -> Column:
    """text without the given titles and running forms, each taken literally, longest first."""
    ordered = F.array_sort(forms, lambda a, b: F.length(b) - F.length(a))
    out = F.aggregate(ordered, text, lambda acc, f: F.replace(acc, f, F.lit(" ")))
    return ids.trimmed(F.regexp_replace(out, f"{ids.WS}+", " "))


def without_patterns(text: Column, patterns: Column) -> Column:
    """text without what the patterns of cleaning_patterns() meet, one after another."""
    out = F.aggregate(F.coalesce(patterns, F.array().cast("array<string>")), F.coalesce(text, F.lit("")), lambda acc, p: F.regexp_replace(acc, p, F.lit(" ")))
    return ids.trimmed(F.regexp_replace(out, f"{ids.WS}+", " "))


def within_region(entries: DataFrame, page: Column, top: Column, bottom: Column) -> DataFrame:
    """Entries whose spans meet a band of a page."""
    return entries.filter(F.exists("spans", lambda s: (s["page"] == page) & (s["bottom"] >= top) & (s["top"] <= bottom)))
