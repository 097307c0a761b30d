from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from quillgraph.llm import scan_repair as S

SCHEMA = "doc_id long, line_no long, page int, text string, top double, bottom double, fault string"
WORDS = "kernel trivial convergence uniform closed interval constant remainder operator power series rank drop taken large adjoint bounded measure estimate boundary region sharp exclude".split()


def body(seed):
    return " ".join(random.Random(seed).sample(WORDS, 7))


def book(doc=1, pages=12, tops=True):
    rows, n = [], 0
    for p in range(1, pages + 1):
        texts = [f"{p}   2024 power series classified" if p % 2 == 0 else "1 Numerical quadrature"] + [body(1000 * doc + 10 * p + k) for k in range(8)] + [f"- {p} -"]
        y = 58.0 if p == 1 else 40.0
        for k, t in enumerate(texts):
            n += 1
            top = y + 18 * k + (18 if k and p > 1 else 0)
            rows.append([doc, n, p, t, top if tops else None, None, "clash"])
    return rows


def found(spark, rows):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(3)
    return {(r.doc_id, r.line_no, r.fault) for r in S.scan_faults(df).collect()}


def test_titles_numbers_and_words(spark):
    for tops in (True, False):
        rows = book(1, tops=tops) + book(2, tops=tops) + book(3, tops=tops)
        rows[5][3] = "the kerncl is trivial and the rank taken"
        rows[14][3] = "convergence is uniform on the closed inter-"
        rows[15][3] = "val of the remainder"
        rows[24][3] = "the bounded self-"
        rows[25][3] = "adjoint operator"
        for k in (42, 43, 44, 45):
            rows[k][3] += " self-adjoint"
        rows[34][3] = "both the left-"
        rows[35][3] = "and the constant may be taken"
        rows.append(list(rows[5]))
        got = found(spark, rows)
        heads = {(1, r[1]) for r in rows if r[0] == 1 and (r[1] - 1) % 10 == 0 and r[1] > 1}
        assert {(d, n) for d, n, f in got if f == "header" and d == 1} == heads
        assert {(d, n) for d, n, f in got if f == "page_no" and d == 1} == {(1, n) for n in range(10, 121, 10)}
        assert {(n, f) for d, n, f in got if f in ("hyphen", "misread") and d == 1} == {(6, "misread"), (15, "hyphen"), (25, "hyphen")}


def test_paragraphs(spark):
    rows = book(1) + book(2)
    rows[5][3] = "the kerncl is trivial and the closed inter­"
    rows[6][3] = "val ends here."
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    text = "\n".join(r.text for r in S.paragraphs(df).filter("doc_id = 1 and page = 1").orderBy("para_no").collect())
    assert "kernel is trivial and the closed interval ends here." in text and "- 1 -" not in text


def test_odd_rows(spark):
    assert found(spark, []) == set()
    rows = [[None, 1, 1, "x", None, None, None], [1, None, 1, "x", None, None, None], [1, 1, None, "x" * 100_000, None, None, None], [1, 2, 1, None, None, None, None], [1, 3, 1, "", None, None, None]]
    assert found(spark, rows) == set()


def test_long_pages_come_in_pieces(spark):
    n = 2 * S.MOST_LINES + 5
    rows = [(1, k, 1, f"line {k}", None, None, None) for k in range(n)]
    lines = spark.createDataFrame(rows + rows[:10], SCHEMA)

    def run(batches):
        import pyarrow as pa

        for x in S.pieces(batches):
            yield pa.RecordBatch.from_pydict({"n": [len(x.numbers)], "k": [x.number], "first": [x.first], "last": [x.last]})

    got = S.by_page(S.placed_lines(lines, "top"), "text").mapInArrow(run, "n long, k long, first boolean, last boolean").collect()
    assert sorted((r.k, r.n, r.first, r.last) for r in got) == [(0, S.MOST_LINES, True, False), (1, n - S.MOST_LINES, False, True)]


def test_words_divided_between_pieces_blocks_and_pages(spark):
    known = [(9, k, 1, "the convergence of closed interval and remainder", None, None, None) for k in range(30)]
    long_page = [(1, k, 1, "plain words here", None, None, None) for k in range(2 * S.MOST_LINES + 5)]
    long_page[S.MOST_LINES - 1] = (1, S.MOST_LINES - 1, 1, "the conver-", None, None, None)
    long_page[S.MOST_LINES] = (1, S.MOST_LINES, 1, "gence of it", None, None, None)
    no_page = [(2, k, None, "plain words here", None, None, None) for k in range(130)]
    no_page[63] = (2, 63, None, "on the inter-", None, None, None)
    no_page[64] = (2, 64, None, "val", None, None, None)
    over = [(3, 1, 1, "the remain-", None, None, None), (3, 2, 2, " ", None, None, None), (3, 3, 3, "der of it", None, None, None), (3, 4, 4, "all", None, None, None)]
    spread = [(4, 1, 1, "the remain-", None, None, None), *((4, k, 1, "", None, None, None) for k in range(2, 12)), (4, 12, 1, "der of it", None, None, None)]
    got = found(spark, known + long_page + no_page + over + spread)
    assert {(d, n) for d, n, f in got if f == "hyphen"} == {(1, S.MOST_LINES - 1), (2, 63), (3, 1), (4, 1)}


def repaired(words, asked):
    out = {}
    for w in asked:
        fits = {c: x for c, n in words.items() if (x := S.repair_cost(w, words.get(w, 1), c, n)) is not None}
        out[w] = min(fits, key=lambda c: (fits[c], -words[c])) if fits else None
    return out


def test_weighted_repairs(spark):
    words = {"convergence": 900, "uniform": 800, "kernel": 900, "compared": 500, "limit": 900, "residual": 900}
    asked = {"c0nvergence": "convergence", "unlform": "uniform", "cornpared": "compared", "unixorm": "uniform", "unifrm": "uniform", "unifform": "uniform", "residuaal": "residual", "limxt": "limit", "kemcl": "kernel"}
    asked |= {"kernels": None, "zzzz": None, "48x": None, "limits": None, "uni": None}
    assert repaired(words, asked) == asked
    # the index brings together what the distance accepts
    df = [spark.createDataFrame(list(x.items()), "word string, n long") for x in ({w: 1 for w in asked} | words, words)]
    got = {r.word: r.printed for r in S.repairs(*df).collect()}
    assert got == {w: c for w, c in asked.items() if c}


def test_frequent_misreadings_are_repaired_at_every_size(spark):
    for times in (1, 30, 1_000):
        words = spark.createDataFrame([("that", 14_863 * times), ("tbat", 72 * times)], "word string, n long")
        found = S.repairs(words, words).collect()
        assert [(r.word, r.printed) for r in found] == [("tbat", "that")]
    held = S.Held({"tbat": [(0.3, "that")]}, {})
    assert [x[:2] for x in S.word_repairs("tbat tbat that", held, False, False)] == [(0, 4), (5, 9)]


def test_slices_give_the_same_repairs(spark):
    words = spark.createDataFrame([(f"w{k}", 1, "the", 99, 0.3) for k in range(50)], "word string, n long, printed string, printed_n long, cost double")
    triples = spark.createDataFrame([("甲乙丙", k, "丁") for k in range(3)], "word string, place int, printed string")
    parts = [b.value for b in S.slices(words, triples, most=10)]
    assert len(parts) == 6 and sorted(w for h in parts for w in h.words) == sorted(f"w{k}" for k in range(50))
    assert sum(len(h.triples) for h in parts) == 3


def test_context_picks_between_repairs(spark):
    known = ["the hand holds"] * 30 + ["a band plays"] * 30 + ["one land"] * 2
    rows = [(1, k, 1, t, None, None, None, None) for k, t in enumerate([*known, "a hancl plays", "the bancl"])]
    got = {(r.line_no, r.seen, r.printed) for r in S.scan_repairs(spark.createDataFrame(rows, SCHEMA.replace("double, fault", "double, clash string, fault"))).collect()}
    assert (62, "hancl", "hand") in got and (63, "bancl", "band") in got


def test_chinese_characters_by_their_triples(spark):
    right = "设函数在区间上连续，故函数有界。"
    rows = [(1, k, 1, right, None, None, None) for k in range(40)] + [(1, 100 + k, 1, right.replace("函数在", "函教在").replace("故函数有", "故函教有"), None, None, None) for k in range(3)]
    got = found(spark, [(*r,) for r in rows])
    assert {n for _, n, f in got if f == "misread"} == {100, 101, 102}


def test_method_over_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.scan_repairs(empty).count() == 0 and S.paragraphs(empty).count() == 0


def test_the_lexicon_counts_every_match_of_the_patterns(spark):
    texts = ["well-known x-ray a1-b2 -ab-cd- ab--cd ab-cd-ef 12ab3 123 İz Œuvre-d'art é-ü", "٣ab ²x cd­ef A_b\nMid-Line 7-8", "数学-分析 ab-cd 😀ab", "naïve—so self-self- (re-do)"]
    whole = rf"(?<![{S.LETTER}0-9-])[{S.LETTER}]{{2,}}(?:-[{S.LETTER}]{{2,}})+(?![{S.LETTER}0-9-])"
    want = Counter((S.WORD_ROW, w) for t in texts for w in S.WORD.findall(t.lower()) if len(w) > 1) + Counter((S.COMPOUND_ROW, w) for t in texts for w in re.findall(whole, t.lower()))
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, line_no long, text string")
    got = {(r.kind, r.word): r.n for r in S.lexicon(df).collect() if r.kind != S.TRIPLE_ROW}
    assert got == dict(want)


@pytest.mark.parametrize("values, kind", [(["a", None, "数"], pa.string()), ([1.5, None, float("inf")], pa.float64()), ([1, 2], pa.int64()), ([1, None], pa.int64()), ([[{"x": 1}], None], pa.list_(pa.struct([("x", pa.int64())]))), ([], pa.float64())])
def test_column_values_are_those_of_a_list(values, kind):
    column = pa.array(values, kind)
    assert S.column_values(column) == S.column_values(pa.chunked_array([column])) == column.to_pylist()


def test_a_page_is_one_row_with_its_edges_and_first_lines():
    x = S.Piece(1, 5, 0, True, True, [1, 2], ["first words", "second"], [[None, None]])
    (row,) = S.structure_rows(x)
    assert row[0] == S.PAGE_ROW and row[2] == 5 and [n["word"] for n in row[8]] == ["first", "second"]
    (block,) = S.structure_rows(x._replace(page=None, number=3))
    assert block[0] == S.FIRST_ROW and block[3] == 2


def test_only_the_first_lines_that_are_asked_for_are_gathered(spark):
    lines = [(1, p, 10 * p + k, body(10 * p + k), None) for p in (1, 2, 3, 5, 6, 7) for k in range(5)] + [(1, 4, 40, "  ", None)]
    lines += [(1, p, 10 * p + 5, body(10 * p + 5) + " theo\u00ad", None) for p in (2, 3, 6, 7)]
    lines += [(2, None, k, "plain words here" if k % 64 != 63 else "the theo\u00ad", None) for k in range(130)]
    df = spark.createDataFrame(lines, "doc_id long, page int, line_no long, text string, top double")
    got = {(r.doc_id, r.line_no) for r in S.scan_faults(df).collect() if r.fault == "hyphen"}
    assert got == {(1, 25), (1, 35), (1, 65), (2, 63), (2, 127)}
