from __future__ import annotations

import random
import unicodedata

from quillgraph.llm import leakage as L

SCHEMA = "doc_id long, text string, item_id string"


def plain(text):
    return "".join(c.lower() for c in text or "" if unicodedata.category(c)[0] in "LN")


def brute(docs, items):
    out = set()
    for d, t, *_ in docs:
        x = plain(t)
        grams = {x[k : k + 40] for k in range(len(x) - 39)}
        out |= {(d, i) for i, s in items if any(plain(s)[k : k + 40] in grams for k in range(len(plain(s)) - 39))}
    return out


def test_every_long_span_is_found(spark):
    rng = random.Random(4)
    abc = "abcdefgh漢字éß0"
    items = [(k, "".join(rng.choice(abc) for _ in range(rng.choice([10, 39, 40, 60, 200])))) for k in range(30)]
    docs = []
    for i in range(120):
        text = "".join(rng.choice(abc) for _ in range(rng.randrange(0, 80)))
        if rng.random() < 0.7:
            s = rng.choice(items)[1]
            n = rng.choice([38, 39, 40, 41, 55])
            a = rng.randrange(0, max(1, len(s) - n))
            piece = s[a : a + n]
            text += "".join(c.upper() + rng.choice(["", "", " ", ",\n"]) if c != "ß" else c for c in piece) + "".join(rng.choice(abc) for _ in range(20))
        docs.append((i, text, "clash"))
    docs += [(500, None, None), (501, "", None), (502, "short", None), (0, docs[0][1], "clash")]
    d, b = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    want = brute(docs, items)
    assert want
    for limit in (L.BROADCAST_ITEM_BYTES, 0):
        assert {(r.doc_id, r.item_id) for r in L.leaked(d, b, limit).collect()} == want


def test_empty_sides(spark):
    d, b = spark.createDataFrame([(1, "x" * 300_000, None)], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert L.leaked(d, b).count() == 0
    assert L.leaked(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "y" * 60)], "item_id long, text string")).count() == 0
