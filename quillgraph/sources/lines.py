"""Reading and writing of books: positioned text items, OCR text, validated caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.ids import WS
from quillgraph.operators.pairs import needs_recognizer
from quillgraph.operators.structure import book_lines, text_quality

# Tolerances, in points or shares of a height, of what stands on one line.
BASELINE, SMALL, NEAR, GAP, OVERLAP = 2.5, 0.8, 0.7, 0.4, 0.5
LEAST_MEDIAN, THIN = 40, 20
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"


def read_lines(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Lines of books from parquet; a page range reaches the reader as a pushed filter."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.filter(F.col("page") >= first)
    if last is not None:
        df = df.filter(F.col("page") <= last)
    return df


def grouped_items(items: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, top, bottom) from positioned items (doc_id, page, x, y, width, height, text).

    Items of a page share a line if their baselines are close; a small item beside
    a larger one, as an exponent, joins the line it touches. Null texts are left out.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x"])
        rows: list[list] = []
        small = []
        tallest = frame.height.max()
        for item in frame.itertuples():
            if item.height <= SMALL * tallest and item.height > 0:
                small.append(item)
                continue
            row = next((r for r in rows if abs(r[0].y - item.y) <= BASELINE), None)
            rows.append([item]) if row is None else row.append(item)
        for item in small:
            near = [
                r for r in rows
                for big in r
                if big.height > 0 and abs(big.y - item.y) <= NEAR * big.height and -OVERLAP * big.height <= item.x - (big.x + big.width) <= GAP * big.height
            ]
            row = near[0] if near else next((r for r in rows if abs(r[0].y - item.y) <= BASELINE), None)
            rows.append([item]) if row is None else row.append(item)
        rows.sort(key=lambda r: min(i.y for i in r))
        out = [(frame.doc_id.iloc[0], frame.page.iloc[0], k, "".join(i.text for i in sorted(r, key=lambda i: i.x)), min(i.y for i in r), max(i.y + i.height for i in r)) for k, r in enumerate(rows, 1)]
        return pd.DataFrame(out, columns=["doc_id", "page", "line", "text", "top", "bottom"])

    held = items.filter("text is not null and x is not null and y is not null").fillna(0.0, ["width", "height"])
    return held.groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, line long, text string, top double, bottom double")


def repaired_ocr(text: Column) -> Column:
    """OCR text with full-width digits and signs made plain, blanks between Chinese characters and repeated blanks removed."""
    plain = F.translate(text, "０１２３４５６７８９（）．：；＝＋－", "0123456789().:;=+-")
    joined = F.regexp_replace(plain, rf"(?<={HAN}){WS}+(?={HAN})", "")
    return F.regexp_replace(F.regexp_replace(joined, r"[ \t]+", " "), r"^ | $", "")


def recognised(pages: DataFrame, recognise, budget: int = 400) -> DataFrame:
    """(doc_id, page, line_no, text, failed) from pages (doc_id, page) by a recogniser, a function of both.

    An error or an empty result marks the page as failed; pages beyond the budget are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, page in zip(frame.doc_id, frame.page):
                try:
                    lines = [x.strip() for x in (recognise(doc, page) or "").splitlines() if x.strip()]
                except Exception:
                    lines = []
                rows += [(doc, page, k, x, False) for k, x in enumerate(lines, 1)] or [(doc, page, 0, None, True)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "line_no", "text", "failed"])

    return pages.filter(F.col("page").between(1, budget)).select("doc_id", "page").mapInPandas(run, "doc_id long, page int, line_no long, text string, failed boolean")


def recognition_verdicts(read: DataFrame, docs: DataFrame, budget: int = 400) -> DataFrame:
    """(doc_id, pages_asked, pages_read, pages_failed, quality, usable) of recognised books.

    read: as of recognised(). The text is judged anew over the pages that were
    asked for; a book is usable if a page was read and its text needs no further recogniser.
    """
    asked = docs.groupBy("doc_id").agg(F.least(F.greatest(F.coalesce(F.max("num_pages"), F.lit(0)), F.lit(0)), F.lit(budget)).alias("num_pages"))
    counts = read.groupBy("doc_id").agg(F.count_distinct(F.when(~F.col("failed"), F.col("page"))).alias("pages_read"), F.count_distinct(F.when(F.col("failed"), F.col("page"))).alias("pages_failed"))
    none = F.lit(None).cast("double")
    lines = read.filter("not failed").select("doc_id", (F.col("page").cast("long") * 1_000_000 + F.col("line_no")).alias("line_no"), "page", "text", none.alias("top"), none.alias("bottom"))
    quality = text_quality(lines, asked).select("doc_id", "quality")
    out = asked.join(counts, "doc_id", "left").fillna(0, ["pages_read", "pages_failed"]).join(quality, "doc_id", "left")
    usable = (F.col("pages_read") > 0) & ~needs_recognizer(F.col("quality"))
    return out.select("doc_id", F.col("num_pages").alias("pages_asked"), "pages_read", "pages_failed", "quality", usable.alias("usable"))


def layer_or_ocr(layer: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc_id, page, text, origin) of pages: the text layer where it has text, else OCR, else none."""
    def side(df: DataFrame, name: str) -> DataFrame:
        held = df.filter("text is not null").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("x"))
        return held.select("doc_id", "page", F.array_join(F.transform("x", lambda v: v["text"]), " ").alias(name))

    both = side(layer, "own").join(side(ocr, "read"), ["doc_id", "page"], "full_outer")
    has = F.trim(F.coalesce("own", F.lit(""))) != ""
    origin = F.when(has, "LAYER").when(F.col("read").isNotNull(), "OCR").otherwise("NONE")
    return both.select("doc_id", "page", F.when(has, F.col("own")).otherwise(F.col("read")).alias("text"), origin.alias("origin"))


def range_text(pages: DataFrame, ranges: DataFrame, width: int = 16) -> DataFrame:
    """ranges (key, doc_id, first, last) with their text and origin; one page by OCR marks the whole range so."""
    spread = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    hit = pages.withColumn("bucket", F.floor(F.col("page") / width)).join(spread, ["doc_id", "bucket"]).filter("page between first and last")
    rank = F.array_position(F.array(F.lit("NONE"), F.lit("LAYER"), F.lit("OCR")), F.col("origin"))
    out = hit.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("x"), F.max_by("origin", rank).alias("origin"))
    return out.select("key", F.array_join(F.transform("x", lambda v: v["text"]), " ").alias("text"), "origin")


def write_cache(lines: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """Write the lines of books as parquet by book, if all pass; else nothing is written and ValueError says which fail.

    A book passes with a median of at least 40 characters a page. Returns the figures by book.
    """
    pages = book_lines(lines).groupBy("doc_id", "page").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    figures = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.percentile("chars", 0.5).alias("median"), F.count_if(F.col("chars") == 0).alias("empty"), F.count_if(F.col("chars") < THIN).alias("thin"))
    figures = docs.select("doc_id").distinct().join(figures, "doc_id", "left")
    bad = figures.filter(F.coalesce("median", F.lit(0.0)) < LEAST_MEDIAN).select("doc_id").limit(5).collect()
    if bad:
        raise ValueError(f"books with too little text: {[r.doc_id for r in bad]}")
    book_lines(lines).repartitionByRange("doc_id", "line_no").write.mode("overwrite").parquet(path)
    return figures


def cache_figures(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, pages, lines, pages_with_text, coverage, median, thin, checksum, problems, complete) of each book to be cached.

    The median is the upper one over the pages that have lines; problems name what
    a complete cache must not have. The checksum is taken over blocks of lines, then
    over the blocks, so no book is one string.
    """
    books = docs.groupBy("doc_id").agg(F.greatest(F.coalesce(F.max("num_pages"), F.lit(0)), F.lit(0)).alias("pages"))
    held = book_lines(lines).withColumn("chars", F.length(F.coalesce("text", F.lit(""))))
    by_page = held.join(books, "doc_id").filter("page between 1 and pages").groupBy("doc_id", "page").agg(F.sum("chars").alias("chars"))
    sizes = by_page.groupBy("doc_id").agg(F.array_sort(F.collect_list("chars")).alias("x"), F.count_if(F.col("chars") > 0).alias("pages_with_text"), F.count_if((F.col("chars") > 0) & (F.col("chars") < THIN)).alias("thin"))
    counts = held.groupBy("doc_id").agg(F.count("*").alias("lines"))
    row = F.struct("line_no", F.coalesce("text", F.lit("")).alias("text"))
    blocks = held.groupBy("doc_id", F.floor(F.col("line_no") / 256).alias("block")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.concat(x["line_no"].cast("string"), F.lit("\t"), x["text"])), "\n"), 256).alias("h"))
    sums = blocks.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), ""), 256).alias("checksum"))
    out = books.join(sizes, "doc_id", "left").join(counts, "doc_id", "left").join(sums, "doc_id", "left").fillna(0, ["pages_with_text", "thin", "lines"])
    out = out.withColumn("median", F.coalesce(F.try_element_at("x", (F.floor(F.size("x") / 2) + 1).cast("int")), F.lit(0)))
    problems = F.array_compact(F.array(F.when(F.col("pages_with_text") < F.col("pages"), "EMPTY_PAGES"), F.when(F.col("lines") == 0, "NO_LINES"), F.when(F.col("median") < LEAST_MEDIAN, "LOW_MEDIAN")))
    coverage = F.when(F.col("pages") > 0, F.round(F.col("pages_with_text") / F.col("pages"), 4)).otherwise(0.0)
    return out.select("doc_id", "pages", "lines", "pages_with_text", coverage.alias("coverage"), "median", "thin", "checksum", F.array_join(problems, ",").alias("problems"), (F.size(problems) == 0).alias("complete"))


def write_checked_cache(lines: DataFrame, docs: DataFrame, path: str, allow_incomplete: bool = False) -> DataFrame:
    """Write the lines and the figures of books below path, if all books are complete; else nothing is written and ValueError says which are not.

    allow_incomplete: written all the same, with the figures that say so.
    """
    figures = cache_figures(lines, docs)
    bad = figures.filter("not complete").select("doc_id", "problems").orderBy("doc_id").limit(5).collect()
    if bad and not allow_incomplete:
        raise ValueError(f"incomplete books: {[(r.doc_id, r.problems) for r in bad]}")
    book_lines(lines).repartitionByRange("doc_id", "line_no").write.mode("overwrite").parquet(f"{path}/lines")
    figures.write.mode("overwrite").parquet(f"{path}/figures")
    return figures


def write_corpus(lines: DataFrame, path: str) -> None:
    """Lines of books as JSON lines."""
    book_lines(lines).write.mode("overwrite").json(path)


def shown(matches: DataFrame) -> DataFrame:
    """matches with what may be shown: no text of an opaque layer, escaped for HTML."""
    text = F.col("text")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return matches.withColumn("display_text", F.when(F.col("quality") != "OPAQUE", text))
