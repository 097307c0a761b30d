from __future__ import annotations

import os

import pytest

from quillgraph.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(T.TOKENIZERS, T.VOCABULARY)), reason="no vocabulary")
TEXTS = ["", None, "Hello  world\n\n it's 2024!", "<|endoftext|> is text", "　全角 空白 x", "naïve café 数学分析 👍🏽", "x" * 3_000, " \t\r\n ", "don't  ", "İß ﬁ ​", "a" * 70 + " " + "é" * 300]


def reference(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(T.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("most", [T.DICTIONARY_WORDS, 3])
def test_ids_equal_the_library(spark, most):
    df = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: list(r.ids) for r in T.token_ids(df, most=most).collect()}
    assert got == {k: reference(t) for k, t in enumerate(TEXTS)}


def test_decoding_gives_the_text_back(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in T.decoded(T.token_ids(df)).collect()}
    assert got == {k: t or "" for k, t in enumerate(TEXTS)}


def test_long_words_merge_alike():
    rank = T.ranks(T.TOKENIZERS, T.VOCABULARY)
    for word in (b"internationalisation" * 20, "数学".encode() * 100, b" " * 500):
        parts = [word[k : k + 1] for k in range(len(word))]
        assert T.merged_long(list(parts), rank).tolist() == reference(word.decode()) or b" " in word


def test_empty_table(spark):
    assert T.token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_distinct_word_is_folded(spark):
    texts = ["the theorem holds", "the  naïve estimate 数学", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rank = T.ranks(T.TOKENIZERS, T.VOCABULARY)
    got = {r.word: (r.n, list(r.ids)) for r in T.folded_words(df).collect()}
    assert got["the"][0] == 2 and " theorem" in got
    assert all(ids == list(T.merged(w.encode(), rank)) for w, (_, ids) in got.items())


def test_a_piece_is_reached_by_its_merges():
    rank = T.ranks(T.TOKENIZERS, T.VOCABULARY)
    assert all(list(T.merged(piece, rank)) == [r] for piece, r in rank.items())


def test_long_words_are_in_the_method(spark):
    texts = ["数学分析" * 16, "数学分析" * 17, "x" * 3_000 + " " + "x" * 3_000, "é" * 65]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.word: (r.n, list(r.ids)) for r in T.folded_words(df).collect()}
    assert {w: n for w, (n, _) in got.items()} == {"数学分析" * 16: 1, "数学分析" * 17: 1, "x" * 3_000: 1, " " + "x" * 3_000: 1, "é" * 65: 1}
    assert all(ids == reference(w) for w, (_, ids) in got.items())
