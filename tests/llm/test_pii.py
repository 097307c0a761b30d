from __future__ import annotations

import pytest

from quillgraph.llm import pii as P

SCHEMA = "doc_id long, text string, kind string, line_no int"
FIRST = ["Osric", "Tilda", "Ione", "Bram", "Edda", "Nolan", "Petra", "Silas"]
LAST = ["Gellan", "Marrow", "Quarn", "Selver", "Wexen", "Harke", "Ollen", "Tarring"]


def corpus():
    rows = [(k, f"Thanks to Dr {LAST[k]} for spotting the slip.\nThe Merrin Lemma holds.") for k in range(8)]
    rows += [(10 + k, f"Thanks to {FIRST[k]} {LAST[k]} for spotting the slip.") for k in range(8)]
    rows += [(20 + k, f"Ring us: +44 7700 9002{k}1\nRing us: 555-01{k}2\nLine 7 holds 06133811{k}0 zeros.") for k in range(8)]
    rows += [(30, "write to a.b+c@mail.example or x.y [at] mail dot test"), (31, "f@g and (a@b)"), (32, "ID 945-40-3999, id 110105194912310026"), (33, "lives at No. 172 Dovefold Lane, Eastmere 00455"), (34, "家住青砚市听雨区渡月大道3号7单元393室"), (35, "54, rue des Tilleuls-Gris, 00470 Valmoire\nBirkholzweg 22, 00123 Ort"), (36, "ISBN 000-0-9464-274-7 and ticket #9965583196558"), (37, None), (38, ""), (39, "ｘ＠ｍａｉｌ．ｔｅｓｔ")]
    return [(i, t, "clash", 3) for i, t in rows]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame(corpus() + corpus()[:3], SCHEMA).repartition(3)
    return {(r.doc_id, r.line_no, r.kind) for r in P.personal_data(df).collect()}


def test_names_are_found_by_their_patterns(got):
    assert {(k, 1, "name") for k in (*range(8), *range(10, 18))} <= got
    assert not any((k, 2, "name") in got for k in range(8))


def test_numbers_are_found_by_their_patterns(got):
    for k in range(8):
        assert (20 + k, 1, "phone") in got and (20 + k, 2, "phone") in got
        assert not any(d == 20 + k and n == 3 for d, n, _ in got)


def test_forms(got):
    assert {(30, 1, "email"), (39, 1, "email"), (32, 1, "id_number"), (33, 1, "address"), (34, 1, "address"), (35, 1, "address"), (35, 2, "address")} <= got
    assert not any(d in (31, 36, 37, 38) for d, _, _ in got)


def test_redaction(spark):
    out = {r.doc_id: r.text for r in P.redacted(spark.createDataFrame(corpus(), SCHEMA)).collect()}
    assert out[30] == "write to [EMAIL] or [EMAIL]" and out[39] == "[EMAIL]"
    assert out[33] == "lives at [ADDRESS], Eastmere 00455" and out[37] is None and out[38] == ""
    assert out[0] == "Thanks to [NAME] for spotting the slip.\nThe Merrin Lemma holds."
    assert out[20].startswith("Ring us: [PHONE]\nRing us: [PHONE]\nLine 7")


def test_empty_table(spark):
    assert P.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0


def test_names_of_any_surname(spark):
    # the first are known by their honorific and bear out the words before them
    rows = [(k, f"联系人：{n}老师\n联系人：{n}") for k, n in enumerate(["王建国", "李晓红", "张伟", "陈思远"])]
    rows += [(10 + k, f"联系人：{n}") for k, n in enumerate(["林晓明", "刘洋", "马超", "何文", "的卢飞", "仰天"])]
    got = {(r.doc_id, r.line_no, r.kind) for r in P.personal_data(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)).collect()}
    assert {(10 + k, 1, "name") for k in range(6)} <= got
    spans = {text[a:b] for text in ("答疑：何老师", "感谢林晓明老师", "12 号的同学") for _, a, b, *_ in P.candidates(text)}
    assert {"何", "林晓明"} <= spans and "号的" not in spans
    assert not any(seed for *_, seed in P.candidates("任课老师和高中同学"))


def test_a_surname_of_no_list_beside_an_honorific(spark):
    assert "仝" not in P.SINGLE and "翀" not in P.SINGLE
    rows = [(k, f"如有疑问请联系{n}老师。", None, None) for k, n in enumerate(["王建国", "李晓红", "张伟", "陈思远", "仝晓明"])] + [(9, "请联系数学老师，任课老师和高中同学都在。", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.inst) for r in P.accepted_mentions(df).collect() if r.kind == "name"}
    assert {(0, "王建国"), (4, "仝晓明")} <= got
    assert {d for d, _ in got if d < 9} == {0, 1, 2, 3, 4}


def test_emails_pass_through_the_graph(spark):
    df = spark.createDataFrame([(1, "write to a.b@mail.example", None, None), (2, "a.b@mail.example again", None, None)], SCHEMA)
    assert {(r.doc_id, r.kind, r.l) for r in P.accepted_mentions(df).collect()} == {(1, "email", "write to"), (2, "email", "^")}


@pytest.mark.parametrize(
    "text, spans",
    [
        ("胡同5号, 雨花胡同12号 与青云路 3号", ["雨花胡同12号", "与青云路 3号"]),
        ("No. 172 Dovefold Lane; 4 dots, Flat 3, 8 Mill Road", ["No. 172 Dovefold Lane", "Flat 3, 8 Mill Road"]),
        ("x9 HIGH STREET or 12 OLD MILL LANE", ["12 OLD MILL LANE"]),
        ("(020) 7946 0018, +(44) 20 7946 0018", ["(020) 7946 0018", "+(44) 20 7946 0018"]),
        ("by Prof. Quarn", ["Prof. Quarn"]),
        ("联系人：仝晓明\n联系人: 万一", ["仝晓明", "万一"]),
    ],
)
def test_spans_of_patterns_that_begin_with_a_set(text, spans):
    found = {text[a:b] for kind, a, b, *_ in P.candidates(text) if kind in ("address", "phone") or kind == "name" and ("Prof" in text or "联系" in text)}
    assert set(spans) <= found
    assert not any(x.startswith(("胡同5", "9 HIGH")) for x in found)
