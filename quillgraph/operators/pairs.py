"""Is this answer book the partner of that exercise book: roles, year, subject, anchors, fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import ids
from quillgraph.functions import textfeat as tf
from quillgraph.operators import scoring
from quillgraph.operators.structure import book_lines
from quillgraph.runtime import checkpoint, large

# Language of worked solutions, subjects by their names and by their topics.
SOLUTION = rf"(答案|解答|解[：:]|证明|综上|因此|所以|故{ids.WS}|得证|证毕|由此可得)"
SUBJECTS = {
    "MATH_ANALYSIS": ("数学分析|微积分", "数学分析|微积分|极限|积分|导数|级数"),
    "ALGEBRA": ("高等代数|线性代数", "高等代数|线性代数|矩阵|多项式|行列式|特征值|二次型"),
    "PROBABILITY": ("概率论|数理统计", "概率|随机变量|随机事件|分布函数|数学期望|方差|样本|假设检验"),
    "ODE": ("常微分方程", "常微分方程|初值问题|通解|特解|奇解|常数变易|朗斯基|稳定性"),
    "PDE": ("数学物理方程|偏微分方程", "数学物理方程|偏微分|波动方程|热传导|拉普拉斯方程|边值问题|分离变量|格林函数"),
    "ABSTRACT_ALGEBRA": ("近世代数|抽象代数", "近世代数|抽象代数|子群|正规子群|商群|同态|同构|置换群|循环群|理想|整环"),
    "COMPLEX_ANALYSIS": ("复变函数", "复变函数|解析函数|留数|柯西积分|全纯|共形映射"),
    "REAL_ANALYSIS": ("实变函数|泛函分析", "实变函数|泛函分析|测度|勒贝格|可测函数|巴拿赫|希尔伯特空间"),
    "NUMERICAL_ANALYSIS": ("数值分析", "数值分析|插值|数值积分|迭代法|截断误差|舍入误差|数值解"),
    "ANALYTIC_GEOMETRY": ("解析几何", "解析几何|二次曲面|二次曲线|平面方程|直线方程|空间向量"),
}
LANGUAGE_SHARE, ANSWER_SHARE, LEAST_ENTRIES = 0.97, 0.97, 20
ANCHOR_TOP, ANCHORS, LEAST_SHARED = 0.4, 24, 8
YEAR_AGREES, LEAST_NAMES, LEAST_TOPICS, CLEAR = 0.6, 5, 3, 2
#: Answer entries that are scored in one task.
CHUNK = 2_048
YEAR_LINES, SUBJECT_LINES, DIGEST_LINES = 4_000, 3_000, 400


def roles(entries: DataFrame) -> DataFrame:
    """(doc_id, n, language, answers, role) from the entries of each book, which have text."""
    text = F.col("text")
    answer = ids.extract_answer(text)
    held = entries.filter("text <> ''")
    out = held.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.count_if(text.rlike(SOLUTION)).alias("language"),
        F.count_if((answer != "") & (answer != text)).alias("answers"),
        F.max((F.col("source") == "OUTLINE").cast("int")).alias("by_outline"),
    )
    solves = (F.col("language") >= LANGUAGE_SHARE * F.col("n")) & (F.col("answers") >= ANSWER_SHARE * F.col("n"))
    role = F.when(F.col("n") < LEAST_ENTRIES, "UNKNOWN").when(solves, "ANSWER").when(F.col("by_outline") == 1, "EXERCISE").otherwise("UNKNOWN")
    return out.select("doc_id", "n", "language", "answers", role.alias("role"))


def first_texts(lines: DataFrame, outline: DataFrame, most: int) -> DataFrame:
    """(doc_id, k, text): outline titles, with k 0, and the first lines of each book.

    The first lines are found by counts of pages and then lines, so that no book
    is sorted as a whole: pages up to the one that passes the number, and of that
    page the lines that still fit.
    """
    held = book_lines(lines).select("doc_id", "line_no", F.floor(F.col("line_no") / 256).alias("block"), "text")
    blocks = held.groupBy("doc_id", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).filter(F.col("before") < most).select("doc_id", "block", "before")
    placed = held.join(blocks, ["doc_id", "block"]).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("line_no")) + F.col("before"))
    titles = outline.select("doc_id", "node_id", "title").distinct().select("doc_id", F.lit(0).cast("long").alias("k"), F.col("title").alias("text"))
    return placed.filter(F.col("k") <= most).select("doc_id", F.col("k").cast("long").alias("k"), "text").unionByName(titles).filter("text is not null")


def years(lines: DataFrame, outline: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, year, votes, total): the year named most often, if most namings agree; ties fall to the earlier year.

    texts: the first texts, where they are at hand.
    """
    texts = first_texts(lines, outline, YEAR_LINES) if texts is None else texts.filter(F.col("k") <= YEAR_LINES)
    named = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(20[0-9]{2})"), 1)).alias("year"))
    counts = named.groupBy("doc_id", "year").agg(F.count("*").alias("n"))
    best = counts.groupBy("doc_id").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("year").cast("int")).alias("y"))).alias("b"))
    agrees = F.col("b.n") >= YEAR_AGREES * F.col("total")
    return best.select("doc_id", F.when(agrees, (-F.col("b.y")).cast("string")).alias("year"), F.col("b.n").alias("votes"), "total")


def subjects(lines: DataFrame, outline: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject): by names of subjects, else by topics, if the leader is clear; else MIXED.

    texts: the first texts, where they are at hand.
    """
    texts = first_texts(lines, outline, SUBJECT_LINES) if texts is None else texts.filter(F.col("k") <= SUBJECT_LINES)
    sums = [F.count_if(F.col("text").rlike(p)).alias(f"{kind}_{s}") for s, both in SUBJECTS.items() for kind, p in zip(("n", "t"), both)]
    held = texts.groupBy("doc_id").agg(*sums)

    def leader(kind: str, least: int) -> Column:
        ranked = F.sort_array(F.array(*[F.struct(F.col(f"{kind}_{s}").alias("n"), F.lit(s).alias("s")) for s in SUBJECTS]), False)
        top, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
        return F.when((top["n"] >= least) & (top["n"] >= CLEAR * second["n"]), top["s"])

    return held.select("doc_id", F.coalesce(leader("n", LEAST_NAMES), leader("t", LEAST_TOPICS), F.lit("MIXED")).alias("subject"))


def anchors(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(q_doc, a_doc, shared, sampled, first): how often the most similar answer entry bears the question's label.

    Sampled are at most 24 questions with a label of the answer book, at equal
    steps in book order; they are held against all entries of the answer book by
    their content score, in chunks of bounded size. Ties fall to the first in book order.
    """
    held = entries.filter("text <> ''").select("doc_id", "ordinal", "id", "label_id", "text").distinct()
    held = large(scoring.profiled(held.withColumn("e", F.xxhash64("doc_id", "ordinal", "id", "text"))))
    labels = held.filter("label_id <> ''").select(F.col("doc_id").alias("a_doc"), "label_id").distinct()
    shared = pairs.join(held.filter("label_id <> ''").withColumnRenamed("doc_id", "q_doc"), "q_doc").join(labels, ["a_doc", "label_id"], "left_semi")
    w = Window.partitionBy("q_doc", "a_doc")
    places = shared.select("q_doc", "a_doc", "ordinal", "id", "norm", "e").withColumns({"k": F.row_number().over(w.orderBy("ordinal", "id", "norm")) - 1, "shared": F.count("*").over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("shared") / ANCHORS))
    places = places.filter((F.col("shared") >= LEAST_SHARED) & (F.pmod("k", step) == 0) & (F.col("k") / step < ANCHORS))
    places = checkpoint(places.select("q_doc", "a_doc", "e", "shared", F.col("k").cast("long").alias("q")))
    sampled = checkpoint(places.join(held.withColumnRenamed("doc_id", "q_doc"), ["q_doc", "e"]).select("q_doc", "a_doc", "shared", "q", "label_id", *scoring.PROFILE))
    chunks = held.groupBy(F.col("doc_id").alias("a_doc")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    asked = sampled.join(chunks, "a_doc").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pool = sampled.select("q_doc", "a_doc").distinct().join(chunks, "a_doc").join(held.withColumnRenamed("doc_id", "a_doc"), "a_doc")
    pool = pool.withColumn("chunk", F.pmod("e", F.col("chunks")).cast("int"))
    block = ["q_doc", "a_doc", "chunk"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [*block[:2], "q", "score", "ordinal", "id", "a_label"]
        if left.empty or right.empty:
            return pd.DataFrame([], columns=columns)
        # nulls stand before all, as where the places were numbered
        right = right.sort_values(["ordinal", "id", "norm"], na_position="first", kind="stable")
        names: dict[str, int] = {}
        scores = np.round(scoring.score_rows(scoring.side_of(left, names), scoring.side_of(right, names)), 9)
        best = scores.argmax(axis=1)
        rows = [(*left.iloc[i][block[:2]], q, scores[i, j], right["ordinal"].iloc[j], right["id"].iloc[j], right["label_id"].iloc[j]) for i, (q, j) in enumerate(zip(left["q"], best))]
        return pd.DataFrame(rows, columns=columns).astype({"ordinal": "Int64"})

    columns = [*block, *scoring.PROFILE]
    # new names for the columns that both sides have from one table
    right = pool.select(*columns, F.col("ordinal").cast("long"), "id", "label_id").toDF(*columns, "ordinal", "id", "label_id")
    best = asked.select(*columns, "q").groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(run, "q_doc long, a_doc long, q long, score double, ordinal long, id string, a_label string")
    best = best.groupBy("q_doc", "a_doc", "q").agg(F.min_by("a_label", F.struct((-F.col("score")).alias("s"), "ordinal", "id")).alias("a_label"))
    out = sampled.select("q_doc", "a_doc", "shared", "q", "label_id").join(best, ["q_doc", "a_doc", "q"], "left")
    return out.groupBy("q_doc", "a_doc", "shared").agg(F.count("*").alias("sampled"), F.count_if(F.col("label_id") == F.col("a_label")).alias("first"))


def text_gates(quality: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(q_doc, a_doc, comparable, carries): what the books' text layers are good for.

    Similar texts are evidence where both layers are usable or degraded, or opaque
    in the same way; they carry a match alone where both are usable. overlaps: as
    of structure.alphabet_overlap().
    """
    out = overlaps.select("q_doc", "a_doc", F.col("comparable").alias("alike"))
    for side in ("q", "a"):
        own = quality.select(F.col("doc_id").alias(f"{side}_doc"), F.col("quality").alias(side)).distinct()
        out = out.join(own, f"{side}_doc", "left")

    def good(side: str) -> Column:
        return F.coalesce(F.col(side).isin("USABLE", "DEGRADED") | ((F.col(side) == "OPAQUE") & F.col("alike")), F.lit(False))

    carries = F.coalesce((F.col("q") == "USABLE") & (F.col("a") == "USABLE"), F.lit(False))
    return out.select("q_doc", "a_doc", (good("q") & good("a")).alias("comparable"), carries.alias("carries"))


def may_be_comparable(quality: Column) -> Column:
    """Is text of this quality attached to an index at all."""
    return quality.isin("USABLE", "DEGRADED", "OPAQUE")


def needs_recognizer(quality: Column) -> Column:
    """Can nothing be matched before the pages have been recognised."""
    return quality.isin("SCANNED", "SPARSE_LAYER", "BLANK", "CORRUPT")


def verdicts(pairs: DataFrame, role: DataFrame, year: DataFrame, subject: DataFrame, anchor: DataFrame, sources: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """(q_doc, a_doc, status, reason): roles reject first, then year and subject, then anchors; missing evidence leaves unknown.

    bound (q_doc, a_doc, state): stored bindings as of binding_states(). A valid one
    verifies a pair whose anchors are missing or weak, never one that was rejected.
    """
    out = pairs
    for side in ("q", "a"):
        for df, c in ((role, "role"), (year, "year"), (subject, "subject"), (sources, "by_outline")):
            out = out.join(df.select(F.col("doc_id").alias(f"{side}_doc"), F.col(c).alias(f"{side}_{c}")), f"{side}_doc", "left")
    out = out.join(anchor, ["q_doc", "a_doc"], "left")
    out = out.withColumn("state", F.lit(None).cast("string")) if bound is None else out.join(bound.select("q_doc", "a_doc", "state"), ["q_doc", "a_doc"], "left")
    a_role, q_role = F.coalesce("a_role", F.lit("UNKNOWN")), F.coalesce("q_role", F.lit("UNKNOWN"))
    other_year = F.coalesce(F.col("q_year") != F.col("a_year"), F.lit(False))
    other_subject = F.coalesce((F.col("q_subject") != "MIXED") & (F.col("a_subject") != "MIXED") & (F.col("q_subject") != F.col("a_subject")), F.lit(False))
    weak = F.coalesce(F.col("first") < ANCHOR_TOP * F.col("sampled"), F.lit(False))
    firm = F.coalesce(F.col("q_by_outline") & F.col("a_by_outline"), F.lit(False))
    reason = (
        F.when(a_role == "EXERCISE", "RIGHT_ROLE_INVALID")
        .when(q_role == "ANSWER", "LEFT_ROLE_INVALID")
        .when(a_role == "UNKNOWN", "PAIR_IDENTITY_UNKNOWN")
        .when(other_year | other_subject | (weak & firm), "PAIR_IDENTITY_MISMATCH")
        .when(weak | F.col("sampled").isNull(), F.when(F.coalesce(F.col("state") == "VALID", F.lit(False)), "PAIR_BOUND_MANUALLY").otherwise("PAIR_IDENTITY_UNKNOWN"))
    )
    status = F.when(reason.isNull() | (reason == "PAIR_BOUND_MANUALLY"), "VERIFIED_PAIR").when(reason == "PAIR_IDENTITY_UNKNOWN", "UNKNOWN_PAIR").otherwise("REJECTED_PAIR")
    return out.select("q_doc", "a_doc", status.alias("status"), reason.alias("reason"))


def fingerprints(lines: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, pages, outline_shape, labels, label_range, content_digest, id) of each book; id is the digest of the others.

    The digest is taken over at most 400 lines at equal steps; their places come
    from counts by blocks of lines, so no book is sorted as a whole.
    """
    held = book_lines(lines).select("doc_id", "line_no", F.floor(F.col("line_no") / 256).alias("block"), "text")
    blocks = held.groupBy("doc_id", "block").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id")
    before = F.coalesce(F.sum("n").over(w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumns({"before": before, "of": F.sum("n").over(w)})
    placed = held.join(blocks.select("doc_id", "block", "before", "of"), ["doc_id", "block"]).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("line_no")) - 1 + F.col("before"))
    step = F.greatest(F.lit(1), F.floor(F.col("of") / DIGEST_LINES))
    kept = placed.filter((F.pmod("k", step) == 0) & (F.col("k") / step < DIGEST_LINES)).select("doc_id", "k", F.regexp_replace(F.coalesce("text", F.lit("")), f"{ids.WS}+", "").alias("t"))
    digest = kept.groupBy("doc_id").agg(tf.fnv1a(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "")).alias("content_digest"))
    shape = nodes.groupBy("doc_id", "depth").agg(F.count("*").alias("n")).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "n"))), lambda x: F.concat_ws(":", x["depth"].cast("string"), x["n"].cast("string"))), ",").alias("outline_shape")
    )
    # the first and the last label in the outline's order
    named = nodes.filter("kind = 'QUESTION' and question_id <> ''").withColumn("place", F.struct("page", "node_id"))
    labels = named.groupBy("doc_id").agg(F.count("*").alias("labels"), F.concat_ws("..", F.min_by("question_id", "place"), F.max_by("question_id", "place")).alias("label_range"))
    out = docs.select("doc_id", F.coalesce("num_pages", F.lit(0)).alias("pages")).distinct().join(shape, "doc_id", "left").join(labels, "doc_id", "left").join(digest, "doc_id", "left")
    filled = {"outline_shape": F.lit(""), "labels": F.lit(0), "label_range": F.lit(""), "content_digest": F.lit("811c9dc5")}
    out = out.select("doc_id", "pages", *[F.coalesce(c, x).alias(c) for c, x in filled.items()])
    names = {"pages": "pages", "outline_shape": "outlineShape", "labels": "labels", "label_range": "labelRange", "content_digest": "contentDigest"}
    return out.withColumn("id", tf.fnv1a(F.to_json(F.struct(*[F.col(c).alias(n) for c, n in names.items()]))))


FINGERPRINT = ("pages", "outline_shape", "labels", "label_range", "content_digest", "id")


def bindings(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """A stored binding of each pair: the fingerprints of both books."""
    sides = [prints.select(F.col("doc_id").alias(f"{s}_doc"), F.struct(*FINGERPRINT).alias(s)) for s in ("q", "a")]
    return pairs.join(sides[0], "q_doc").join(sides[1], "a_doc").select("q_doc", "a_doc", F.col("q").alias("q_print"), F.col("a").alias("a_print"))


def binding_states(stored: DataFrame, prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """(q_doc, a_doc, state): VALID, BINDING_ABSENT, BINDING_MALFORMED (a side or field is missing) or BINDING_STALE."""
    now = bindings(prints, pairs).withColumnsRenamed({"q_print": "q_now", "a_print": "a_now"})
    out = now.join(stored, ["q_doc", "a_doc"], "left")
    broken = F.col("q_print").isNull() | F.col("a_print").isNull()
    for side in ("q", "a"):
        for f in FINGERPRINT:
            broken = broken | F.col(f"{side}_print.{f}").isNull()
    absent = F.col("q_print").isNull() & F.col("a_print").isNull()
    same = (F.col("q_print") == F.col("q_now")) & (F.col("a_print") == F.col("a_now"))
    return out.select("q_doc", "a_doc", F.when(absent, "BINDING_ABSENT").when(broken, "BINDING_MALFORMED").when(same, "VALID").otherwise("BINDING_STALE").alias("state"))
