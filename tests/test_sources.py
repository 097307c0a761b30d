from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import entrytext, glyphs, structure
from quillgraph.sources import lines as S
from quillgraph.streaming import glyph_stream

LINES = "doc_id long, line_no long, page int, text string, top double, bottom double"


def test_items_become_lines(spark):
    items = [(1, 1, 0.0, 100.0, 10.0, 10.0, "x"), (1, 1, 10.5, 96.0, 4.0, 6.0, "2"), (1, 1, 20.0, 101.0, 10.0, 10.0, "+1"), (1, 1, 0.0, 130.0, 10.0, 10.0, "next"), (1, 1, None, 1.0, 1.0, 1.0, "lost"), (1, 1, 0.0, 1.0, 1.0, 1.0, None)]
    got = S.grouped_items(spark.createDataFrame(items, "doc_id long, page int, x double, y double, width double, height double, text string")).orderBy("line").collect()
    assert [r.text for r in got] == ["x2+1", "next"]


def test_recogniser_failures_are_counted(spark):
    def read(doc, page):
        if page == 2:
            raise RuntimeError("no")
        return None if page == 3 else " a \n\nb"

    got = S.recognised(spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 401)], "doc_id long, page int"), read).collect()
    assert sorted((r.page, r.line_no, r.text, r.failed) for r in got) == [(1, 1, "a", False), (1, 2, "b", False), (2, 0, None, True), (3, 0, None, True)]


def test_layer_goes_before_ocr_and_marks_ranges(spark):
    layer = spark.createDataFrame([(1, 1, 1, "own"), (1, 2, 2, " ")], "doc_id long, line_no long, page int, text string")
    ocr = spark.createDataFrame([(1, 1, 1, "read"), (1, 2, 2, "read")], "doc_id long, line_no long, page int, text string")
    pages = S.layer_or_ocr(layer, ocr)
    assert {(r.page, r.text, r.origin) for r in pages.collect()} == {(1, "own", "LAYER"), (2, "read", "OCR")}
    ranges = spark.createDataFrame([("a", 1, 1, 1), ("b", 1, 1, 2)], "key string, doc_id long, first int, last int")
    assert {(r.key, r.text, r.origin) for r in S.range_text(pages, ranges).collect()} == {("a", "own", "LAYER"), ("b", "own read", "OCR")}


def test_cache_refuses_thin_books(spark, tmp_path):
    rows = [(1, k, k, "x" * 50, None, None) for k in range(1, 4)] + [(2, 1, 1, "y", None, None)]
    df, docs = spark.createDataFrame(rows, LINES), spark.createDataFrame([(1,), (2,)], "doc_id long")
    with pytest.raises(ValueError):
        S.write_cache(df, docs, str(tmp_path / "a"))
    assert not (tmp_path / "a").exists()
    S.write_cache(df.filter("doc_id = 1"), docs.filter("doc_id = 1"), str(tmp_path / "a"))
    assert S.read_lines(spark, str(tmp_path / "a"), 2, 3).count() == 2


def test_ocr_text_and_cleaning(spark):
    df = spark.createDataFrame([("求 导 数 （１） x  + y", ["求导", "x"])], "t string, f array<string>")
    assert df.select(S.repaired_ocr(F.col("t"))).first()[0] == "求导数 (1) x + y"
    assert df.select(entrytext.cleaned(F.lit("a.b [x] c"), F.array(F.lit("[x]"), F.lit(".b")))).first()[0] == "a c"


def test_shown_text_is_escaped(spark):
    df = spark.createDataFrame([("<a&'\">", "USABLE"), ("x", "OPAQUE")], "text string, quality string")
    assert [r.display_text for r in S.shown(df).collect()] == ["&lt;a&amp;&#39;&quot;&gt;", None]


def test_running_lines(spark):
    rows, n = [], 0
    for p in range(1, 11):
        for t in ("Head of the book", f"1.{p} question", f"body {p} abc", f"text {chr(96 + p)} xyz", "middle words", f"more {chr(96 + p)}", "Foot line"):
            n += 1
            rows.append((1, n, p, t, None, None))
    df = spark.createDataFrame(rows + rows[:5], LINES)
    assert {r.form for r in structure.running_forms(df).collect()} == {"Headofthebook", "Footline"}
    assert structure.without_running_lines(df).count() == 50
    got = structure.segmented_entries(df).orderBy("ordinal").collect()
    assert [r.label for r in got] == [f"1.{p}" for p in range(1, 11)] and got[0].end_page == 2


def test_quality_verdicts(spark):
    rows = [(1, 1, 1, "plain text " * 30, None, None), (2, 1, 1, "ॐ" * 300, None, None), (3, 1, 1, "", None, None), (4, 1, 1, "few", None, None), (6, 1, 1, "\x01" * 50 + "a" * 200, None, None)]
    docs = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 400), (5, 3), (6, 1)], "doc_id long, num_pages int")
    got = {r.doc_id: r.quality for r in structure.text_quality(spark.createDataFrame(rows, LINES), docs).collect()}
    assert got == {1: "USABLE", 2: "CORRUPT", 3: "BLANK", 4: "SPARSE_LAYER", 5: "SCANNED", 6: "CORRUPT"}


def test_votes_of_a_stream_add_up(spark, tmp_path):
    text = "(已知 x+1=2, y=3*(z-1) 则 a<b 与 c>d 成立, f(x)=g(y)+h(z)."
    broken = "".join(chr(0x980 + ord(c) % 128) if "一" <= c <= "鿿" else c for c in text)
    for k in range(2):
        spark.createDataFrame([(broken, text)] * 2, "broken string, readable string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("broken string, readable string").parquet(str(tmp_path / "in"))
        glyph_stream.vote_stream(stream, str(tmp_path / "votes"), str(tmp_path / "state")).awaitTermination()
    whole = glyphs.votes(spark.createDataFrame([(broken, text)] * 4, "broken string, readable string"))
    key = lambda df: sorted((r.glyph, r.cand, r.n) for r in df.select("glyph", "cand", "n").collect())
    assert key(glyph_stream.read_votes(spark, str(tmp_path / "votes"))) == key(whole)


def test_checked_cache_is_closed_to_incomplete_books(spark, tmp_path):
    rows = [(1, k, k, "x" * 50, None, None) for k in range(1, 4)] + [(2, 1, 1, "x" * 50, None, None), (2, 2, 2, "y", None, None)]
    lines = spark.createDataFrame(rows + rows[:1], LINES)
    docs = spark.createDataFrame([(1, 3), (2, 4), (3, None)], "doc_id long, num_pages int")
    got = {r.doc_id: (r.pages_with_text, r.median, r.thin, r.problems, r.complete) for r in S.cache_figures(lines, docs).collect()}
    assert got == {1: (3, 50, 0, "", True), 2: (2, 50, 1, "EMPTY_PAGES", False), 3: (0, 0, 0, "NO_LINES,LOW_MEDIAN", False)}
    with pytest.raises(ValueError, match="EMPTY_PAGES"):
        S.write_checked_cache(lines, docs, str(tmp_path / "a"))
    assert not (tmp_path / "a").exists()
    S.write_checked_cache(lines, docs, str(tmp_path / "b"), allow_incomplete=True)
    again = S.cache_figures(spark.read.parquet(str(tmp_path / "b" / "lines")), docs).select("doc_id", "checksum").collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, spark.read.parquet(str(tmp_path / "b" / "figures")).select("doc_id", "checksum").collect()), key=repr)


def test_recognised_books_are_judged_anew(spark):
    pages = spark.createDataFrame([(d, p) for d in (1, 2) for p in range(1, 11)], "doc_id long, page int")

    def recognise(doc, page):
        if page == 3:
            raise RuntimeError("no")
        return "a line of forty characters, more or less" if doc == 1 else ""

    docs = spark.createDataFrame([(1, 10), (2, 10), (3, None)], "doc_id long, num_pages int")
    got = {r.doc_id: (r.pages_read, r.pages_failed, r.quality, r.usable) for r in S.recognition_verdicts(S.recognised(pages, recognise), docs).collect()}
    assert got == {1: (9, 1, "USABLE", True), 2: (0, 10, "SCANNED", False), 3: (0, 0, "SCANNED", False)}
