from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import ids
from quillgraph.functions import textfeat as tf


def one(spark, column, *values):
    names = [chr(97 + k) for k in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(column(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("1.200", "1.200"), ("01.010", "1.10"), (" 1．2 ", "1.2"), ("1.2.", ""), ("12345", ""), ("", ""), (None, ""), ("a", "")])
def test_normalize_id(spark, raw, want):
    assert one(spark, ids.normalize_id, raw) == want


@pytest.mark.parametrize(
    "line, want",
    [("例题 1.31 求导", ("1.31", "求导")), ("第 9 题. 证明", ("9", "证明")), ("1.31 求导", ("1.31", "求导")), ("　1.31、求", ("1.31", "求")), ("12. foo", ("12", "foo")), ("12 foo", None), ("12.5x", ("12.5", "x")), ("x 1.2", None), (None, None), ("", None)],
)
def test_question_line(spark, line, want):
    got = one(spark, ids.question_line, line)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("title, want", [("习题 2.3 极限", "2.3"), ("Example 4", "4"), ("第 7 题", "7"), ("1.1 函数", "1.1"), ("前言", ""), (None, "")])
def test_title_id(spark, title, want):
    assert one(spark, ids.title_id, title) == want


@pytest.mark.parametrize("text, want", [("答案：3。因为", "3"), ("解 x=1；余", "x=1"), ("求 x。答: 4  step", "4"), ("plain text", "plain text"), ("。x", "。x"), ("", ""), (None, "")])
def test_extract_answer(spark, text, want):
    assert one(spark, ids.extract_answer, text) == want


def test_normalize_keeps_grouping(spark):
    assert one(spark, tf.normalize_for_match, "1／（x＋1）".replace("／", "/").replace("＋", "+")) == "1/(x+1)"
    assert one(spark, tf.normalize_for_match, "A, b。 C–D") == "abc-d"
    assert one(spark, tf.normalize_for_match, None) == ""


def test_contexts_and_formulas(spark):
    assert one(spark, tf.symbol_contexts, "a+b") == ["··a+b··"]
    assert one(spark, tf.symbol_contexts, "") == []
    assert one(spark, tf.formula_fragments, "求(1) x^2+1 与 y") == ["x^2+1"] or one(spark, tf.formula_fragments, "求(1) x^2+1 与 y") == ["(1)x^2+1"]


def test_fnv(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % (1 << 32)
        return f"{h:08x}"

    for s in ("", "a", "foobar", "数学"):
        assert one(spark, tf.fnv1a, s) == fnv(s)


def test_descriptive_length(spark):
    assert one(spark, tf.descriptive_length, "例题 1.2") == 0
    assert one(spark, tf.descriptive_length, "1.1 极限与连续") == 5
