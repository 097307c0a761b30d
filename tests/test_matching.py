from __future__ import annotations

import itertools
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillgraph.operators import audit, glyphs, matching, outline, sequence


def test_alignment_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        scores = {(i, j): rng.choice([0.0, 0.3, 0.5, 0.9]) for i in range(n) for j in range(m)}
        got = sequence.aligned(n, m, scores, -0.1, 0.2)

        def value(pairs):
            return sum(scores[p] for p in pairs) - 0.1 * (n + m - 2 * len(pairs))

        best = max(
            value(list(zip(a, b)))
            for k in range(min(n, m) + 1)
            for a in itertools.combinations(range(n), k)
            for b in itertools.combinations(range(m), k)
            if all(scores[p] >= 0.2 for p in zip(a, b))
        )
        assert abs(value(got) - best) < 1e-9
        assert got == sorted(got) and len({i for i, _ in got}) == len(got)


def test_chains_equal_the_alignment():
    rng = random.Random(4)
    for k in range(400):
        n, m = rng.randrange(0, 9), rng.randrange(0, 9)
        scores = {(i, j): rng.choice([0.25, 0.5, 0.75]) for i in range(n) for j in range(m) if rng.random() < 0.5}
        assert sequence.chained(n, m, scores, -0.125, 0.5) == sequence.aligned(n, m, scores, -0.125, 0.5)
        # at a band's edge ties may fall otherwise
        got, want = (sum(scores[p] + 0.25 for p in f(n, m, scores, -0.125, 0.5, 1 + k % 2)) for f in (sequence.chained, sequence.aligned))
        assert got == want


def test_large_books_are_aligned(spark, monkeypatch):
    monkeypatch.setattr(sequence, "MOST_CELLS", 4)
    titles = ["limits of sequences", "continuity and compactness", "derivatives", "improper integrals", "power series"]
    rows = [(d, k, 1, t, k + 1) for d, own in ((1, titles), (2, [titles[0], "a new part", *titles[1:]])) for k, t in enumerate(own)]
    sections = spark.createDataFrame(rows, "doc_id long, node_id long, depth int, title string, page int")
    got = sequence.aligned_titles(sections, spark.createDataFrame([(1, 2)], "q_doc long, a_doc long")).collect()
    assert sorted((r.q_node, r.a_node) for r in got) == [(0, 0), (1, 2), (2, 3), (3, 4), (4, 5)]
    n = 2_500
    assert sequence.chained(n, n, {(i, j): 1.0 if i == j else 0.5 for i in range(n) for j in range(max(0, i - 1), min(n, i + 2))}, -0.05, 0.45) == [(i, i) for i in range(n)]


def test_formulas_conflict_and_miss():
    sk = {"a+b=c": "+=", "a+b=d": "+=", "zzzzz=9": "=", "x^2": "^"}
    assert sequence.compared_formulas(["a+b=c"], ["a+b=c"], sk) == (1, 0, 0)
    assert sequence.compared_formulas(["x^2"], ["zzzzz=9"], sk) == (0, 0, 1)
    assert sequence.compared_formulas([], ["x^2"], sk) == (0, 0, 0)


def decide(spark, rows):
    schema = "q long, cand long, seq long, label_hit boolean, score double, exact_id boolean, section_aligned boolean, comparable boolean, carries boolean"
    return {r.q: (r.confidence, r.cand, r.n_candidates) for r in matching.decided(spark.createDataFrame(rows, schema)).collect()}


def test_decisions(spark):
    t, f = True, False
    got = decide(
        spark,
        [
            (1, 1, 1, t, 0.0, t, f, t, t), (2, 1, 1, t, 0.31, f, f, t, t), (3, 1, 1, t, 0.31, f, t, t, t), (4, 1, 1, t, 0.1, f, f, t, t), (5, 1, 1, t, 0.1, f, t, t, t),
            (6, 1, 1, t, 0.8, f, f, t, t), (6, 2, 2, t, 0.5, f, f, t, t), (7, 1, 1, t, 0.8, f, f, t, t), (7, 2, 2, t, 0.8, f, f, t, t),
            (8, 1, 1, f, 0.9, f, f, t, t), (8, 2, 2, f, 0.1, f, f, t, t), (9, 1, 1, f, 0.9, f, f, t, t), (9, 2, 2, f, 0.85, f, f, t, t), (10, 1, 1, f, 0.9, f, f, f, f), (11, 1, 1, f, 0.2, f, f, t, t),
        ],
    )
    assert got == {1: ("HIGH", 1, 0), 2: ("MEDIUM", 1, 0), 3: ("HIGH", 1, 0), 4: ("LOW", 1, 0), 5: ("MEDIUM", 1, 0), 6: ("MEDIUM", 1, 0), 7: ("NONE", None, 2), 8: ("MEDIUM", 1, 0), 9: ("LOW", 1, 0), 10: ("NONE", None, 1), 11: ("NONE", None, 0)}


def test_rungs_only_fall(spark):
    rungs = matching.RUNGS
    df = spark.createDataFrame([(a, b, s, r) for a in rungs for b in (*rungs, None) for s in ("VERIFIED_PAIR", "UNKNOWN_PAIR", "REJECTED_PAIR") for r in (True, False)], "a string, b string, s string, r boolean")
    rows = df.select("*", matching.capped(F.col("a"), F.col("b")).alias("c"), matching.permitted(F.col("a"), F.col("s"), F.col("r")).alias("p")).collect()
    for x in rows:
        assert rungs.index(x.c) >= rungs.index(x.a)
        assert rungs.index(x.p) >= rungs.index(x.a) or x.a == "BLOCKED"
        assert x.s == "VERIFIED_PAIR" or x.p != "AUTO_MATCH"
        assert x.s != "REJECTED_PAIR" or x.p == "BLOCKED"


def test_inversions_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(u, t, rng.randrange(4)) for u in range(3) for t in range(30)]
    got = {r.u: (r.breaks, r.inversions) for r in audit.order_audit(spark.createDataFrame(rows, "u int, t int, r int"), ["u"], ["t"], "r").collect()}
    for u in range(3):
        seq = [r for x, _, r in rows if x == u]
        assert got[u] == (sum(b < a for a, b in zip(seq, seq[1:])), sum(seq[j] < seq[i] for i in range(30) for j in range(i + 1, 30)))


def test_glyphs_are_learned(spark):
    # only what stands between two kept signs can be learned
    text = "(已知 x+1=2, y=3*(z-1) 则 a<b 与 c>d 成立, f(x)=g(y)+h(z)."
    broken = "".join(chr(0x980 + ord(c) % 128) if "一" <= c <= "鿿" else c for c in text)
    pages = spark.createDataFrame([(broken, text)] * 4 + [(None, text), ("", "")], "broken string, readable string")
    table = {r.glyph: r.cand for r in glyphs.glyph_table(glyphs.votes(pages)).collect()}
    assert all(table.get(b) == c for b, c in zip(broken, text) if b != c)


def test_page_buckets_equal_interval_join(spark):
    rng = random.Random(2)
    entries = [(1, str(k), k, p, p + rng.randrange(0, 40)) for k, p in enumerate(rng.randrange(1, 200) for _ in range(60))]
    e = spark.createDataFrame(entries, "doc_id long, id string, ordinal int, page int, end_page int")
    asked = [(1, p) for p in range(1, 260, 7)]
    got = Counter((r.page, r.id) for r in matching.questions_on_pages(e, spark.createDataFrame(asked, "doc_id long, page int")).collect())
    assert got == Counter((p, x[1]) for _, p in asked for x in entries if x[3] <= p <= x[4])


def test_levels_of_outlines(spark):
    rows = [(1, 0, 0, "第1章 极限", 1, None, 2)] + [(1, k, 1, f"例题 1.{k}", k, None, 0) for k in range(1, 6)]
    rows += [(2, k, 0, str(k), k + 3, None, 0) for k in range(1, 13)]
    o = spark.createDataFrame(rows, "doc_id long, node_id long, depth int, title string, page int, end_page int, child_count int")
    d = spark.createDataFrame([(1, 10), (2, 20)], "doc_id long, num_pages int")
    got = {(r.doc_id, r.depth): r.kind for r in outline.level_verdicts(outline.spanned(o, d)).collect()}
    assert got == {(1, 0): "BOOK", (1, 1): "QUESTION", (2, 0): "PAGE_MARKER"}


def test_texts_of_candidates_are_not_broadcast(spark, tmp_path):
    # letters beyond the basic plane count as one character each
    texts = ["𝑥𝑦+𝑧=ab 𝑥-1", "𝑥𝑦+𝑧=ac 𝑥-1", "𝑥𝑥𝑥 升 (𝑦)", "𝑥𝑥 降"]
    spark.createDataFrame(list(enumerate(texts)), "x long, text string").write.parquet(f"{tmp_path}/texts")
    once = spark.read.parquet(f"{tmp_path}/texts")
    both = once.select("x").join(once.select(F.col("x").alias("y")), F.lit(True))
    out = matching.content_scores(both, once, once.withColumnRenamed("x", "y"), "x", "y")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == plan.count("BroadcastNestedLoopJoin")
    got = {(r.x, r.y): r.score for r in out.collect()}

    def dice(a, b):
        return 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))

    def bigrams(t):
        return [t[k : k + 2] for k in range(len(t) - 1)]

    norms = [t.replace(" ", "") for t in texts]
    assert len(got) == 16 and all(got[k, k] == 1 for k in range(4))
    # no formula in one of them: bigrams alone
    assert abs(got[0, 3] - dice(bigrams(norms[0]), bigrams(norms[3]))) < 1e-9 and abs(got[2, 3] - dice(bigrams(norms[2]), bigrams(norms[3]))) < 1e-9
    contexts = [[f"···{t}···"[k : k + 7] for k, c in enumerate(t) if c in "+-=()"] for t in norms]
    fragments = ["".join(re.findall("[a-z0-9+=()-]{2,}", t)) for t in norms]
    math = 0.6 * dice(contexts[0], contexts[1]) + 0.4 * dice(bigrams(fragments[0]), bigrams(fragments[1]))
    assert abs(got[0, 1] - 0.75 * math - 0.25 * dice(bigrams(norms[0]), bigrams(norms[1]))) < 1e-9
