from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillgraph.operators import audit, entrytext, evaluate, glyphs, matching, outline, pairs, scoring, sequence, structure

ENTRY = "doc_id long, id string, label string, ordinal int, page int, end_page int, text string, scoped_text string, answer string, source string, structural boolean"


def dice(a, b):
    return sequence.bigram_dice(a, b)


def test_score_rows_equal_brute_force(spark):
    texts = ["", "a", "f(x)=3x+1 grows", "f(x)=3x+1 grows fast", "已知函数 f(x)=x^2-1 在区间 [0,1] 上连续", "no formula here", "aaaa aaaa", "f(x)=3x+1 grows"]
    df = scoring.profiled(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")).toPandas().sort_values("k")
    names: dict[str, int] = {}
    a, b = scoring.side_of(df, names), scoring.side_of(df, names)
    got = scoring.score_rows(a, b)
    once = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "x long, text string")
    pairs_ = once.select("x").crossJoin(once.select(F.col("x").alias("y")))
    want = matching.content_scores(pairs_, once, once.withColumnRenamed("x", "y"), "x", "y").collect()
    assert all(abs(got[r.x, r.y] - r.score) < 1e-6 for r in want) and len(want) == len(texts) ** 2
    small, scoring.MOST_TOKENS = scoring.MOST_TOKENS, 10
    assert np.allclose(scoring.score_rows(a, b), got)
    scoring.MOST_TOKENS = small


def test_alignment_scores_by_content(spark):
    q = spark.createDataFrame([(1, k, k, "", t, c) for k, (t, c) in enumerate([("f(x)=3x+1 grows", True), ("set theory of cardinals", True), ("set theory of cardinals", False)])], "b long, q long, q_seq long, label_id string, text string, comparable boolean")
    a = spark.createDataFrame([(1, 10, 0, "", "f(x)=3x+1 falls"), (1, 11, 1, "", "set theory of cardinals")], "b long, a long, a_seq long, label_id string, text string")
    got = {r.q: (r.a, r.timed_out, r.truncated) for r in sequence.aligned_entries(q, a, ["b"]).collect()}
    # what may not be compared takes no partner
    assert got == {0: (10, False, False), 1: (11, False, False), 2: (None, False, False)}
    many = spark.createDataFrame([(1, k, k, "", "other words") for k in range(sequence.MOST_CANDIDATES + 1)], "b long, a long, a_seq long, label_id string, text string")
    assert {r.truncated for r in sequence.aligned_entries(q, many, ["b"]).collect()} == {True}


def test_next_sections_equal_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(1, 12)
        rows = [(1, 2, k, rng.randrange(1, 9), rng.randrange(3)) for k in range(n)]
        got = dict(outline.next_sections(pd.DataFrame(rows, columns=["q_doc", "a_doc", "seq", "a_page", "a_depth"]))[["seq", "next_page"]].itertuples(index=False))
        for _, _, k, page, depth in rows:
            want = next((p for _, _, j, p, of in rows if j > k and of <= depth and p > page), None)
            assert (None if pd.isna(got[k]) else got[k]) == want


def test_sections_without_an_end_reach_all_asked_pages(spark):
    sections = spark.createDataFrame([(1, 2, 5, 1, None, 0, 3, 30, 0)], "q_doc long, a_doc long, q_node long, q_page int, q_last int, q_depth int, a_page int, a_last int, a_depth int")
    pages = spark.createDataFrame([(1, 2), (1, 50_000)], "q_doc long, page int")
    got = {r.page for r in outline.section_regions(sections, pages, spark.createDataFrame([(2, 90)], "doc_id long, num_pages int")).collect()}
    assert got == {2, 50_000}


def test_contents_pages_are_suppressed(spark):
    rows = [(1, str(k), f"1.{k}", k, 2, 2, f"limits ..... {k}", None, None, "BODY", False) for k in range(5)] + [(1, "9", "2.1", 9, 7, 7, "limits", None, None, "BODY", False)]
    got = {r.id: r.suppressed for r in structure.without_contents(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == {str(k): True for k in range(5)} | {"9": False}


def test_patterns_meet_the_printed_titles(spark):
    nodes = spark.createDataFrame([(1, " 1.1 极限与 连续 "), (1, "x"), (1, None)], "doc_id long, title string")
    titles = entrytext.section_title_forms(nodes)
    assert {r.form for r in titles.collect()} == {"1.1 极限与 连续", "极限与 连续", "x"}
    running = spark.createDataFrame([(1, "a+b(c)"), (1, "ab")], "doc_id long, form string")
    patterns = entrytext.cleaning_patterns(titles.filter("form <> 'x'"), running)
    df = spark.createDataFrame([(1, "see 1.1极限与连续 now 极限与  连续 a+b(c) ab"), (2, None)], "doc_id long, text string").join(patterns, "doc_id", "left")
    got = {r.doc_id: r.t for r in df.select("doc_id", entrytext.without_patterns(F.col("text"), F.col("patterns")).alias("t")).collect()}
    assert got == {1: "see now ab", 2: ""}


def test_gates_of_text_quality(spark):
    quality = spark.createDataFrame([(1, "USABLE"), (2, "DEGRADED"), (3, "CORRUPT"), (4, "OPAQUE"), (5, "OPAQUE")], "doc_id long, quality string")
    overlaps = spark.createDataFrame([(1, 2, False), (1, 1, False), (1, 3, True), (4, 5, True), (4, 1, False), (1, 9, True)], "q_doc long, a_doc long, comparable boolean")
    got = {(r.q_doc, r.a_doc): (r.comparable, r.carries) for r in pairs.text_gates(quality, overlaps).collect()}
    assert got == {(1, 2): (True, False), (1, 1): (True, True), (1, 3): (False, False), (4, 5): (True, False), (4, 1): (False, False), (1, 9): (False, False)}
    named = {r.quality: (r.a, r.b) for r in quality.select("quality", pairs.may_be_comparable(F.col("quality")).alias("a"), pairs.needs_recognizer(F.col("quality")).alias("b")).collect()}
    assert named == {"USABLE": (True, False), "DEGRADED": (True, False), "CORRUPT": (False, True), "OPAQUE": (True, False)}


def test_a_binding_verifies_what_cannot_be_checked(spark):
    books = spark.createDataFrame([(1, 2), (3, 4)], "q_doc long, a_doc long")
    role = spark.createDataFrame([(1, "EXERCISE"), (2, "ANSWER"), (3, "EXERCISE"), (4, "EXERCISE")], "doc_id long, role string")
    none = spark.createDataFrame([], "doc_id long, year string, subject string, by_outline boolean")
    anchor = spark.createDataFrame([], "q_doc long, a_doc long, sampled long, first long")
    states = spark.createDataFrame([(1, 2, "VALID"), (3, 4, "VALID")], "q_doc long, a_doc long, state string")
    got = {r.q_doc: (r.status, r.reason) for r in pairs.verdicts(books, role, none, none, anchor, none, states).collect()}
    assert got == {1: ("VERIFIED_PAIR", "PAIR_BOUND_MANUALLY"), 3: ("REJECTED_PAIR", "RIGHT_ROLE_INVALID")}


def test_glyph_learner_says_what_it_lacks(spark):
    counted = spark.createDataFrame([("a", "x", 5), ("a", "y", 1), ("b", "z", 1)], "glyph string, cand string, n long")
    table = glyphs.glyph_table(counted)
    assert [tuple(r) for r in glyphs.progress(counted, table).collect()] == [(2, 1, 1, 7)]
    assert {(r.glyph, r.cand, r.place) for r in glyphs.evidence(counted, 1).collect()} == {("a", "x", 1), ("b", "z", 1)}
    lines = spark.createDataFrame([("ঀঁঁং",), (None,)], "text string")
    held = glyphs.coverage(lines, spark.createDataFrame([("ঁ", "x")], "glyph string, cand string"))
    assert [tuple(r) for r in glyphs.coverage_share(held).collect()] == [(2, 4, 0.5, ["ঀ", "ং"])]


def test_inversions_of_many_ranks(spark):
    rng = random.Random(8)
    seq = [rng.randrange(50) for _ in range(80)]
    rows = [(1, t, r) for t, r in enumerate(seq)] + [(2, 0, 3)]
    got = {r.u: (r.breaks, r.inversions) for r in audit.order_audit(spark.createDataFrame(rows, "u int, t int, r int"), ["u"], ["t"], "r").collect()}
    assert got[1] == (sum(b < a for a, b in zip(seq, seq[1:])), sum(seq[j] < seq[i] for i in range(80) for j in range(i + 1, 80))) and got[2] == (0, 0)


def test_one_entry_inside_its_window(spark):
    rows = spark.createDataFrame([(1, 5, 3, 7), (1, 9, 3, 7), (2, 4, 3, 7), (2, 5, 3, 7), (3, 1, 3, 7)], "q long, ordinal int, from_place long, to_place long")
    assert [tuple(r) for r in matching.separated_by_position(rows, ["q"]).collect()] == [(1, 5, 1)]


def test_empty_measures(spark):
    none = spark.createDataFrame([], "b long, v int")
    assert evaluate.slow_share(none, ["b"], "v").count() == 0
    some = spark.createDataFrame([(1, k) for k in range(100)] + [(2, None)], "b long, v int")
    assert [tuple(r) for r in evaluate.slow_share(some, ["b"], "v").collect()] == [(1, 100, 95, 99)]


def test_top_similar_equals_the_join(spark, monkeypatch):
    rng = random.Random(9)
    words = "limit series matrix 函数 极限 kernel f(x)=3x+1".split()
    texts = spark.createDataFrame([(k, " ".join(rng.choices(words, k=rng.randrange(0, 6)))) for k in range(60)] + [(3, "x"), (70, None), (None, "limit")], "t long, text string").repartition(3)
    queries = spark.createDataFrame([(k, " ".join(rng.choices(words, k=3))) for k in range(7)] + [(9, ""), (8, None)], "q long, text string")
    met = matching.gram_similarity(queries, texts.filter("t is not null"), "q", "t")
    want: dict[int, list] = {}
    for r in met.collect():
        want.setdefault(r.q, []).append((-round(r.similarity, 9), r.t, r.shared))
    want = {q: sorted(x)[:4] for q, x in want.items()}
    for bytes_ in (scoring.MOST_QUERY_BYTES, 200):
        monkeypatch.setattr(scoring, "MOST_QUERY_BYTES", bytes_)
        got: dict[int, list] = {}
        for r in scoring.top_similar(queries, texts, 4).collect():
            got.setdefault(r.q, []).append((-round(r.similarity, 9), r.t, r.shared))
        assert {q: sorted(x) for q, x in got.items()} == want
