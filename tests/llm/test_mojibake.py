from __future__ import annotations

import numpy as np
import pytest

from quillgraph.llm import mojibake as M

PLAIN = ["例题 3.1 已知函数在闭区间上一致连续，从而极限存在且有限。", "Here the naïve estimate isn’t sharp → see “the” lemma.", "Daraus folgt, daß die Größe für jede natürliche Zahl gilt.", "L’énoncé précédent est vérifié, d’où la conclusion."] * 60


@pytest.fixture(scope="module")
def model(spark):
    garbled = [p.encode().decode("cp1252", "replace") for p in PLAIN[:4]]
    return M.model(spark.createDataFrame([(k, t) for k, t in enumerate(PLAIN + garbled)], "doc_id long, text string"))


def wrong(text, codec, right="utf-8"):
    return "".join(chr(b) if M.encoded(chr(b), codec) is None and b < 0xA0 else bytes([b]).decode(codec, "replace") for b in text.encode(right)) if codec in M.SINGLE else text.encode(right).decode(codec, "replace")


@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "cp437", "mac_roman", "cp1251"])
def test_one_byte_codecs_are_undone(model, codec):
    for text in PLAIN[:4]:
        bad = "".join({v: k for k, v in M.byte_map(codec).items()}.get(bytes([b]), b) if b > 0x7F and False else next(chr(c) for c, x in M.byte_map(codec).items() if x == bytes([b])) if b > 0x7F else chr(b) for b in text.encode())
        assert M.repaired([bad], model) == [text]


def test_double_encoding_and_places(model):
    twice = PLAIN[0].encode().decode("latin-1").encode().decode("latin-1")
    assert M.repaired([twice], model) == [PLAIN[0]]
    mixed = PLAIN[1] + " naÃ¯ve " + PLAIN[2]
    assert M.repaired([mixed], model)[0] == PLAIN[1] + " naïve " + PLAIN[2]
    assert M.repaired([PLAIN[0].encode("gb18030").decode("latin-1")], model)[0] == PLAIN[0]


def test_plain_texts_stay(model):
    others = ["NÃO, ÊTRE and Âge keep their capitals", "x≤1‖y‖₂, ∀ε>0 ∃δ>0: ℝ³→ℂ", "ﾊﾝｶｸ 1 ① ½ №", "", "plain ascii", "尉迟若岫"]
    for text in PLAIN[:4] + others:
        assert M.repaired([text], model)[0] is text or M.repaired([text], model)[0] == text


def test_table(spark):
    bad = PLAIN[1].encode().decode("latin-1")
    rows = [(k, t, False) for k, t in enumerate(PLAIN)] + [(900, bad, True), (901, None, None), (902, "", None), (903, "lost � byte", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, garbled boolean")
    got = {r.doc_id: r for r in M.repaired_texts(df).collect()}
    assert {i for i, r in got.items() if r.garbled} == {900, 903}
    assert got[900].text == PLAIN[1] and got[901].text is None and got[902].text == ""
    assert M.repaired_texts(df.limit(0)).count() == 0


def test_segments_are_maximal():
    assert M.segments(np.array([1.0, -0.5, 1.0, -3.0, 2.0])) == [(0, 3), (4, 5)]
    assert M.segments(np.array([-1.0, -2.0])) == []


def test_a_garbled_part_beside_sound_text(model):
    for sound, right in (("已知函数在闭区间上一致连续", "naïve"), ("从而极限存在且有限", "Größe"), ("例题", "énoncé")):
        word = right.encode().decode("latin-1")
        at = next(k for k, c in enumerate(word) if c > "\x7f")
        bad = word[at:]
        assert M.repaired([sound + bad + " ends"], model) == [sound + bad.encode("latin-1").decode() + " ends"]
    assert M.repaired(["从而极限存在" + "“the".encode().decode("cp1252") + " lemma"], model) == ["从而极限存在“the lemma"]


def test_accents_of_one_codec_read_as_another(model):
    bad = PLAIN[3].replace("’", "'").encode("cp1252").decode("mac_roman")
    assert bad != PLAIN[3] and M.repaired([bad], model) == [PLAIN[3].replace("’", "'")]
    assert M.repaired(["a lone Ç stays"], model) == ["a lone Ç stays"]


def test_segments_bound_the_runs(spark):
    bad = PLAIN[1].encode().decode("latin-1")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(PLAIN)] + [(900, "已知函数" + bad), (901, None)], "doc_id long, text string")
    rows = M.garbled_runs(df).collect()
    assert rows and {r.doc_id for r in rows} == {900}
    text = "已知函数" + bad
    assert all(text[r.start : r.end] == r.was and r.was.encode(r.codec).decode(r.right) == r.now for r in rows)
    assert M.odd_segments(np.array([3, 4, 6, 20, 21])) == [(3, 7), (20, 22)]


def test_information_is_exact_and_bounded(spark):
    import math
    from collections import Counter

    texts = ["éa éb éa ça", "éa", None, "", "ab"]
    got = {r.code: r for r in M.pair_information(M.counted(spark.createDataFrame([(t,) for t in texts], "text string"))).collect()}
    pairs = Counter(x + y for t in texts if t for x, y in zip(t, t[1:]) if x > "\x7f" or y > "\x7f")
    left, right = Counter(), Counter()
    for p, n in pairs.items():
        left[p[0]] += n
        right[p[1]] += n
    total = sum(pairs.values())
    want = {ord(p[0]) << 21 | ord(p[1]): max(0.0, n * math.log2(n * total / (left[p[0]] * right[p[1]]))) for p, n in pairs.items()}
    assert set(got) == set(want) and all(abs(got[c].bits - want[c]) < 1e-9 for c in want)
