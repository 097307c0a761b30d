from __future__ import annotations

from quillgraph.operators import matching, outline
from quillgraph.plans import linkage

TEXTS = ["limits of bounded sequences exist", "continuous functions on compact sets", "derivatives of inverse maps", "improper integrals converge"]


def entry(doc, label, k, page, text):
    return doc, label, label, k, page, page, text, "", "", "BODY", False


def test_the_rest_of_a_pair_is_aligned_and_located(spark):
    rows = [entry(1, f"1.{k + 1}", k, 1 + k, t) for k, t in enumerate(TEXTS)] + [entry(1, "9.1", 9, 11, "quaternions rotate xyzzy")]
    rows += [entry(2, "1.1", 0, 2, TEXTS[0]), entry(2, "7.2", 1, 3, TEXTS[1]), entry(2, "7.3", 2, 4, TEXTS[2]), entry(2, "1.4", 3, 15, TEXTS[3])]
    entries = matching.book_entries(spark.createDataFrame(rows, "doc_id long, id string, label string, ordinal int, page int, end_page int, text string, scoped_text string, answer string, source string, structural boolean"))
    nodes = [(d, k, 0, f"第{k}章 {t}", p, None, 1) for d, pages in ((1, (1, 11)), (2, (2, 12))) for k, t, p in zip((1, 2), ("极限与连续函数", "积分与级数"), pages)]
    docs = spark.createDataFrame([(1, 20), (2, 20)], "doc_id long, num_pages int")
    nodes = outline.classified(spark.createDataFrame(nodes, "doc_id long, node_id long, depth int, title string, page int, end_page int, child_count int"), docs)
    verdicts = spark.createDataFrame([(1, 2, "VERIFIED_PAIR", None)], "q_doc long, a_doc long, status string, reason string")
    got = {r.label: (r.confidence, r.a_ordinal, r.rung) for r in linkage.linked(entries, verdicts, nodes, docs).collect()}
    # in its section, by content alone in book order, outside its section, and located only
    assert got["1.1"] == ("HIGH", 0, "AUTO_MATCH")
    assert got["1.2"] == ("MEDIUM", 1, "AUTO_MATCH") and got["1.3"] == ("MEDIUM", 2, "AUTO_MATCH")
    assert got["1.4"] == ("MEDIUM", 3, "AUTO_MATCH")
    assert got["9.1"] == ("NONE", None, "LOCATED")


def test_alphabets_decide_on_opaque_pairs_alone(spark):
    odd = [chr(c) for c in (*range(0x905, 0x9FE), *range(0xC05, 0xC7E))]
    rows = [(d, k, 1 + k // 50, f"{c}{c} x+1=2", None, None) for d in (1, 2) for k, c in enumerate(odd)]
    rows += [(3, k, 1, f"{chr(0x1200 + k % 80)}{chr(0x1200 + k % 80)} x+1=2", None, None) for k in range(200)] + [(4, k, 1, "plain words of a usable layer", None, None) for k in range(40)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no long, page int, text string, top double, bottom double")
    docs = spark.createDataFrame([(d, 7) for d in (1, 2, 3, 4)], "doc_id long, num_pages int")
    books = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 4)], "q_doc long, a_doc long")
    got = {(r.q_doc, r.a_doc): (r.comparable, r.carries) for r in linkage.gates(lines, docs, books).collect()}
    assert got == {(1, 2): (True, False), (2, 3): (False, False), (3, 4): (False, False), (4, 4): (True, True)}


def test_tables_of_entries_are_not_broadcast(spark):
    rows = [entry(d, f"1.{k + 1}", k, 1 + k, t) for d in (1, 2) for k, t in enumerate(TEXTS)]
    entries = matching.book_entries(spark.createDataFrame(rows, "doc_id long, id string, label string, ordinal int, page int, end_page int, text string, scoped_text string, answer string, source string, structural boolean"))
    docs = spark.createDataFrame([(1, 20), (2, 20)], "doc_id long, num_pages int")
    nodes = outline.classified(spark.createDataFrame([(d, 1, 0, "第1章 极限", 1, None, 1) for d in (1, 2)], "doc_id long, node_id long, depth int, title string, page int, end_page int, child_count int"), docs)
    verdicts = spark.createDataFrame([(1, 2, "VERIFIED_PAIR", None)], "q_doc long, a_doc long, status string, reason string")
    out = linkage.linked(entries, verdicts, nodes, docs)
    # the verdicts of the pairs of books alone
    assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") <= 1
    assert {r.label: r.rung for r in out.collect()} == {f"1.{k + 1}": "AUTO_MATCH" for k in range(4)}
