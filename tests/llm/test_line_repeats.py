from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from quillgraph.llm import line_repeats as L

SCHEMA = "doc_id long, source string, text string, key string, line_no int"


def brute(rows):
    docs = {r[0]: r for r in rows}
    total, seen = Counter(r[1] for r in docs.values() if r[1] is not None), defaultdict(set)
    key = lambda s: re.sub(r"[0-9\s]+", "", s).lower()
    for i, source, text, *_ in docs.values():
        for line in text.split("\n") if text is not None and source is not None else ():
            if key(line):
                seen[source, key(line)].add(i)
    good = {k for k, v in seen.items() if len(v) >= 5 and 10 * len(v) >= total[k[0]]}
    return {(i, n) for i, source, text, *_ in docs.values() if text is not None for n, line in enumerate(text.split("\n"), 1) if (source, key(line)) in good}


@pytest.mark.parametrize("counters", [L.COUNTERS, 3, 1])
def test_equals_brute_force(spark, counters):
    rng = random.Random(counters)
    words = [f"line {c}" for c in "abcdefghijklmnop"]
    rows = []
    for i in range(300):
        source = rng.choice(["big", "big", "big", "small", None])
        lines = [rng.choice(words[: 4 if rng.random() < 0.5 else 16]) + (f" {rng.randrange(99)}" if rng.random() < 0.5 else "") for _ in range(rng.randrange(0, 6))]
        rows.append((i, source, "\n".join(lines) if rng.random() > 0.05 else None, "clash", 7))
    rows += [(1000 + i, "tiny", "NOTICE　1\n\n 5 ", "clash", 7) for i in range(5)] + [(2000 + i, "four", "notice", None, None) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {(r.doc_id, r.line_no) for r in L.repeated_lines(df, counters).collect()} == brute(rows)


def test_texts_come_back_without_them(spark):
    rows = [(i, "s", f"keep {chr(97 + i) * 3}\r\nShare 12{i}", None, None) for i in range(6)] + [(9, None, "Share 1", None, None), (10, "s", None, None, None), (11, "s", "", None, None)]
    got = {r.doc_id: r.text for r in L.without_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == "keep aaa\r" and got[9] == "Share 1" and got[10] is None and got[11] == ""


def test_empty_table_and_long_text(spark):
    assert L.repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, "s", "x" * 200_000 + "\nsame", None, None) for i in range(5)]
    assert L.repeated_lines(spark.createDataFrame(rows, SCHEMA)).count() == 10
