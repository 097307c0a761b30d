from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import canonical as C


@pytest.mark.parametrize(
    "a, b",
    [("Ｋｅｙ　１", "Key 1"), ("café", "café"), ("a​b", "ab"), ("a b", "a b"), ("ӓ", "ä"), ("ﬁn", "fin"), ("Τop", "Top"), ("，", ","), ("ёж", "ëж"), ("e​́", "é"), ("x\r\ny", "x\ny"), ("例", "例"), ("⼀", "一"), ("ｶﾞ", "ガ"), ("﻿a", "a")],
)
def test_look_alikes_agree(a, b):
    assert C.canonical(a, {}) == C.canonical(b, {})


@pytest.mark.parametrize("a, b", [("a", "A"), ("e", "é"), ("2", "²"), ("2", "②"), ("a b", "a  b"), ("O", "0"), ("l", "1"), ("x", "y"), ("½", "1/2"), ("℃", "°C")])
def test_others_stay_apart(a, b):
    assert C.canonical(a, {}) != C.canonical(b, {})


def whole(text):
    """The canonical form without isolating segments."""
    mapping = C.tables()[3]
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").translate(mapping))


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aé̈​ａ一\r\nᅡᄀᆨ가àｶﾞ")), max_size=12))
def test_segments_equal_the_whole(text):
    known: dict[str, str] = {}
    out = C.canonical(text, known)
    assert unicodedata.normalize("NFC", out) == whole(text)
    assert C.canonical(out, known) == out


def test_pairs(spark):
    rows = [(1, "Abc", None), (2, "Ａbc", "t"), (3, "Abc", "t​"), (4, "abc", ""), (5, None, "  "), (6, "​", "  "), (7, "", "t"), (1, "Abc", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, title string, field double")
    got = {tuple(r) for r in C.lookalikes(df, ["text", "title"]).distinct().collect()}
    assert got == {("text", 1, 2), ("text", 2, 3), ("title", 2, 3), ("title", 3, 7)}
    assert C.lookalikes(df.limit(0), ["text", "title"]).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, "Ａ" * 50_000, None)], "doc_id long, text string, title string")
    assert [tuple(r) for r in C.canonical_texts(df, "doc_id", ["text", "title"]).collect()] == [(1, "A" * 50_000, None)]


def test_classes_and_hot_forms(spark):
    rows = [(k, "Solution", None) for k in range(300)] + [(900, "Ｓolution", None), (901, "Solution​", None), (902, "other", "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, title string, form string")
    got = {tuple(r) for r in C.lookalikes(df, ["text", "title"]).collect()}
    assert got == {("text", k, j) for k in range(300) for j in (900, 901)} | {("text", 900, 901)}
    classes = C.lookalike_classes(df, ["text", "title"]).collect()
    assert {(r.field, r.doc_id, r.forms, r.members) for r in classes} == {("text", k, 3, 302) for k in (*range(300), 900, 901)}
    assert len({r.class_id for r in classes}) == 1 and len({r.form_id for r in classes}) == 3
    assert C.canonical("Ꭺ ⲟ Օ", {}) == "A o O"


def test_many_texts_at_once_agree_with_each():
    signs = [chr(c) for c in (*range(0x20, 0xD800), *range(0xF900, 0x11000), 0x1F600, 0x10FFFE, 0x10FFFF)]
    texts = signs + ["", "\r\n", "a\rb", "ｶﾞ", "e​́", "ﬁn", "Ｋｅｙ　１，中", "ёж" + "ᅟ" * 3, *("a".join(signs[k : k + 7]) for k in range(0, len(signs), 7))]
    assert C.canonical_each(texts, {}) == [C.canonical(t, {}) for t in texts]
    assert C.canonical_each([], {}) == []
    # only what depends on its neighbours, or becomes several signs, is read sign by sign
    assert not any(C.single_forms()[ord(c)] == C.HARD for c in "，：　Ａéё​") and all(C.single_forms()[ord(c)] == C.HARD for c in "ﬁ\r\u0301\uff9e")
