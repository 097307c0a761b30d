"""Queries of the core library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph import sqltext as sx
from quillgraph.functions import ids
from quillgraph.functions import textfeat as tf
from quillgraph.operators import audit, entrytext, evaluate, glyphs, matching, outline, pairs, reconcile, scoring, sequence, shred, structure
from quillgraph.plans import linkage
from quillgraph.runtime import table
from quillgraph.sources import lines as lines_source
from quillgraph.streaming import glyph_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "p1_found",
    r"""
    WITH raw AS (
      SELECT 0 AS side, lower(trim(id)) AS id, bytes AS size, regexp_replace(trim(sha256), '(?i)^sha256[:-]\s*', '') AS b, NULL::TIMESTAMPTZ AS checked FROM manifest WHERE trim(id) <> ''
      UNION ALL SELECT 1, lower(trim(id)), size, regexp_replace(trim(digest), '(?i)^sha256[:-]\s*', ''), verified_at AS checked FROM upload_verification WHERE trim(id) <> ''),
    plain AS (
      SELECT side, id, size, checked, nullif(CASE WHEN regexp_full_match(b, '[A-Za-z0-9+/]{43}=')
        THEN lower(hex(from_base64(CASE WHEN regexp_full_match(b, '[A-Za-z0-9+/]{43}=') THEN b ELSE '' END))) WHEN regexp_full_match(b, '([0-9A-Fa-f]{2}:){31}[0-9A-Fa-f]{2}') THEN lower(replace(b, ':', '')) ELSE lower(b) END, '') AS sha FROM raw),
    last AS (SELECT side, id, size, sha FROM (SELECT *, row_number() OVER (PARTITION BY side, id ORDER BY checked DESC NULLS LAST) AS k FROM plain) WHERE k = 1),
    m AS (SELECT id, size AS bytes, sha FROM last WHERE side = 0),
    u AS (SELECT id, size, sha FROM last WHERE side = 1),
    j AS (SELECT coalesce(m.id, u.id) AS id, m.id AS mid, u.id AS uid, bytes, size, m.sha AS msha, u.sha AS usha FROM m FULL JOIN u ON m.id = u.id)
    SELECT id, 'only_manifest' AS diff FROM j WHERE uid IS NULL
    UNION ALL SELECT id, 'only_upload' FROM j WHERE mid IS NULL
    UNION ALL SELECT id, 'bytes' FROM j WHERE mid IS NOT NULL AND uid IS NOT NULL AND bytes IS DISTINCT FROM size
    UNION ALL SELECT id, 'sha256' FROM j WHERE mid IS NOT NULL AND uid IS NOT NULL AND msha IS DISTINCT FROM usha
    """,
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.archive_differences(table(spark, d, "manifest"), table(spark, d, "upload_verification"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.outline_nodes(table(spark, d, "outline_raw")).select("record_id", "node_path", "parent_path")


@query("p4_columns")
def p4_columns(spark: SparkSession, d: str) -> DataFrame:
    return shred.leaf_columns(table(spark, d, "outline_raw"))


@query("p4_nodes")
def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    return shred.outline_nodes(table(spark, d, "outline_raw")).withColumn("title", F.regexp_replace("title", r"(?U)^\s+|\s+$", ""))


# Identifiers and text.


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return structure.book_lines(table(spark, d, "doc_lines"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return matching.book_entries(table(spark, d, "entries"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each book with the next one: a window over the ids of books alone, the smallest table."""
    ids_ = table(spark, d, "docs").select("doc_id").distinct()
    return ids_.select(F.col("doc_id").alias("q_doc"), F.lead("doc_id").over(Window.orderBy("doc_id")).alias("a_doc")).filter("a_doc is not null")


LABEL_ID = f"{sx.normalize_id('''regexp_extract(coalesce(id, ''), '([0-9]{1,4}(?:[.．][0-9]{1,4})*)', 1)''')}"
ENTRY_IDS = f"{sx.ENTRIES}, ei AS (SELECT *, {LABEL_ID} AS label_id FROM e)"


@query("id_normalize", f"WITH e AS (SELECT DISTINCT doc_id, id FROM entries) SELECT doc_id, id, {sx.normalize_id('id')} AS canonical FROM e")
def id_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entries").select("doc_id", "id").distinct().withColumn("canonical", ids.normalize_id(F.col("id")))


@query(
    "id_book_order",
    f"""WITH e AS (SELECT DISTINCT doc_id, id, page FROM entries), c AS (SELECT *, {sx.normalize_id('id')} AS canonical FROM e)
    SELECT doc_id, id, page, canonical, dense_rank() OVER (PARTITION BY doc_id ORDER BY page NULLS FIRST, CASE WHEN canonical = '' THEN []::INTEGER[] ELSE list_transform(string_split(canonical, '.'), lambda s: CAST(s AS INTEGER)) END) AS place FROM c""",
)
def id_book_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entries").select("doc_id", "id", "page").distinct().withColumn("canonical", ids.normalize_id(F.col("id")))
    return rows.withColumn("place", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("page").asc_nulls_first(), ids.id_segments(F.col("id")))))


@query(
    "label_parse_lines",
    f"WITH {sx.LINES} SELECT doc_id, line_no, {sx.question_id('text')} AS label, {sx.question_body('text')} AS body, {sx.sub_id('text')} AS sub FROM lines WHERE {sx.is_question_line('text')} OR {sx.sub_id('text')} IS NOT NULL",
)
def label_parse_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select("doc_id", "line_no", ids.question_line(F.col("text")).alias("q"), ids.sub_question_line(F.col("text")).alias("s"))
    return rows.filter("q is not null or s is not null").select("doc_id", "line_no", F.col("q.id").alias("label"), F.col("q.body").alias("body"), F.col("s.sub").alias("sub"))


@query("title_ids", f"WITH o AS (SELECT DISTINCT doc_id, node_id, title FROM outline) SELECT doc_id, node_id, {sx.title_id('title')} AS question_id, {sx.descriptive_length('title')} AS descriptive FROM o")
def title_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "outline").select("doc_id", "node_id", "title").distinct()
    return rows.select("doc_id", "node_id", ids.title_id(F.col("title")).alias("question_id"), tf.descriptive_length(F.col("title")).alias("descriptive"))


@query("answer_extract", f"WITH e AS (SELECT DISTINCT doc_id, id, text FROM entries) SELECT doc_id, id, {sx.extract_answer('text')} AS answer FROM e")
def answer_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entries").select("doc_id", "id", "text").distinct().select("doc_id", "id", ids.extract_answer(F.col("text")).alias("answer"))


@query("normalize_text", f"WITH e AS (SELECT DISTINCT doc_id, id, text FROM entries) SELECT doc_id, id, {sx.normalize_for_match('text')} AS norm FROM e")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entries").select("doc_id", "id", "text").distinct().select("doc_id", "id", tf.normalize_for_match(F.col("text")).alias("norm"))


@query(
    "bigram_profile",
    f"WITH b AS (SELECT item_id, {sx.normalize_for_match('text')} AS norm FROM benchmark), g AS (SELECT item_id, unnest({sx.bigrams('norm')}) AS gram, length(norm) - 1 AS total FROM b) SELECT item_id, gram, CAST(total AS INTEGER) AS total, count(*) AS n FROM g GROUP BY ALL",
)
def bigram_profile(spark: SparkSession, d: str) -> DataFrame:
    return matching.gram_table(table(spark, d, "benchmark").select("item_id", "text").distinct(), "item_id").withColumn("total", F.col("total").cast("int"))


@query(
    "math_fragments",
    f"WITH e AS (SELECT DISTINCT doc_id, id, text FROM entries), n AS (SELECT doc_id, id, {sx.normalize_for_match('text')} AS norm FROM e) SELECT doc_id, id, len({sx.fragments('norm')}) AS fragments, array_to_string({sx.fragments('norm')}, ' ') AS math FROM n",
)
def math_fragments(spark: SparkSession, d: str) -> DataFrame:
    found = tf.math_fragments(tf.normalize_for_match(F.col("text")))
    return table(spark, d, "entries").select("doc_id", "id", "text").distinct().select("doc_id", "id", F.size(found).alias("fragments"), F.array_join(found, " ").alias("math"))


@query(
    "symbol_contexts",
    f"""WITH e AS (SELECT DISTINCT text FROM entries), n AS (SELECT {sx.normalize_for_match('text')} AS norm FROM e), p AS (SELECT norm, '···' || norm || '···' AS padded, unnest(range(1, length(norm) + 1)) AS k FROM n)
    SELECT substr(padded, k, 7) AS context, count(*) AS n FROM p WHERE {sx.matches('substr(norm, k, 1)', f'[{tf.SKELETON}()]')} GROUP BY 1""",
)
def symbol_contexts(spark: SparkSession, d: str) -> DataFrame:
    # normalised in an aggregate's input, so that the lambda over places sees a column and not the whole expression
    texts = table(spark, d, "entries").select("text").distinct().groupBy("text").agg(F.first(tf.normalize_for_match(F.col("text"))).alias("norm"))
    return texts.select(F.explode(tf.symbol_contexts(F.col("norm"))).alias("context")).groupBy("context").agg(F.count("*").alias("n"))


FORMULAS = f"list_filter(list_transform(list_filter({sx.fragments('norm')}, lambda f: length(f) >= 3), lambda f: regexp_replace(f, {sx.q(tf.PART_MARK)}, '\\1', 'g')), lambda f: length(f) >= 3 AND regexp_replace(f, {sx.q(f'[^{tf.SKELETON}]')}, '', 'g') <> '')"


@query(
    "formula_set",
    f"""WITH e AS (SELECT DISTINCT doc_id, id, text FROM entries), n AS (SELECT *, {sx.normalize_for_match('text')} AS norm FROM e)
    SELECT doc_id, id, len({FORMULAS}) AS expressions, array_to_string(list_transform({FORMULAS}, lambda f: regexp_replace(f, {sx.q(f'[^{tf.SKELETON}]')}, '', 'g')), ' ') AS skeletons,
    {sx.count("coalesce(text, '')", '[(' + chr(92) + '[{]')} = {sx.count("coalesce(text, '')", '[)' + chr(92) + ']}]')} AS complete FROM n""",
)
def formula_set(spark: SparkSession, d: str) -> DataFrame:
    found = tf.formula_fragments(F.col("text"))
    rows = table(spark, d, "entries").select("doc_id", "id", "text").distinct()
    return rows.select("doc_id", "id", F.size(found).alias("expressions"), F.array_join(F.transform(found, tf.skeleton), " ").alias("skeletons"), tf.brackets_balance(F.col("text")).alias("complete"))


# Structure of the books.


def _class(pattern: str) -> str:
    return f"sum({sx.count('''coalesce(text, '')''', pattern)})"


QUALITY_SQL = f"""
    WITH {sx.LINES}, c AS (SELECT doc_id, sum(length(coalesce(text, ''))) AS chars, {_class(structure.CONTROL)} AS control, {_class(structure.ODD_SCRIPT)} AS odd, {_class(structure.HAN)} AS han,
      {_class(structure.STRUCTURED)} AS structured, count(DISTINCT CASE WHEN {sx.trimmed("coalesce(text, '')")} <> '' THEN page END) AS pages_with_text FROM lines GROUP BY doc_id),
    b AS (SELECT DISTINCT doc_id, CASE WHEN num_pages > 0 THEN num_pages END AS pages_read FROM docs)
    SELECT b.doc_id, CAST(chars AS BIGINT) AS chars, CAST(control AS BIGINT) AS control, CAST(odd AS BIGINT) AS odd, CAST(han AS BIGINT) AS han, CAST(structured AS BIGINT) AS structured, pages_with_text, pages_read,
      CASE WHEN chars IS NULL THEN 'SCANNED' WHEN chars = 0 THEN 'BLANK'
        WHEN pages_read >= 8 AND (chars / pages_read < 20 OR pages_with_text / pages_read < 0.5) THEN 'SPARSE_LAYER'
        WHEN chars >= 200 AND odd / chars > 0.03 THEN CASE WHEN structured / chars >= 0.25 THEN 'OPAQUE' ELSE 'CORRUPT' END
        WHEN control / chars > 0.02 THEN 'CORRUPT' WHEN odd / chars > 0.01 OR control / chars > 0.005 THEN 'DEGRADED' ELSE 'USABLE' END AS quality
    FROM b LEFT JOIN c ON b.doc_id = c.doc_id"""


@query("text_quality", QUALITY_SQL)
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return structure.text_quality(table(spark, d, "doc_lines"), table(spark, d, "docs"))


@query(
    "alphabet_overlap",
    f"""WITH {sx.LINES}, {sx.PAIRS}, ch AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM lines),
    own AS (SELECT doc_id, ch FROM ch WHERE ch <> '' AND NOT {sx.matches('ch', ids.WS)} GROUP BY doc_id, ch HAVING count(*) >= 2), n AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id),
    s AS (SELECT q_doc, a_doc, count(*) AS shared FROM pairs JOIN own x ON x.doc_id = q_doc JOIN own y ON y.doc_id = a_doc AND x.ch = y.ch GROUP BY ALL)
    SELECT p.q_doc, p.a_doc, coalesce(shared, 0) AS shared, least(coalesce(x.n, 0), coalesce(y.n, 0)) AS total,
      least(coalesce(x.n, 0), coalesce(y.n, 0)) >= 250 AND coalesce(shared, 0) >= 0.9 * least(coalesce(x.n, 0), coalesce(y.n, 0)) AS comparable
    FROM pairs p LEFT JOIN s ON s.q_doc = p.q_doc AND s.a_doc = p.a_doc LEFT JOIN n x ON x.doc_id = p.q_doc LEFT JOIN n y ON y.doc_id = p.a_doc""",
)
def alphabet_overlap(spark: SparkSession, d: str) -> DataFrame:
    return structure.alphabet_overlap(table(spark, d, "doc_lines"), _pairs(spark, d))


@query(
    "text_gates",
    f"""WITH q AS ({SQL['text_quality']}), o AS ({SQL['alphabet_overlap']}), g AS (SELECT q_doc, a_doc, x.quality AS xq, y.quality AS yq, comparable AS alike FROM o LEFT JOIN (SELECT DISTINCT doc_id, quality FROM q) x ON x.doc_id = q_doc LEFT JOIN (SELECT DISTINCT doc_id, quality FROM q) y ON y.doc_id = a_doc)
    SELECT q_doc, a_doc, coalesce((xq IN ('USABLE', 'DEGRADED') OR xq = 'OPAQUE' AND alike) AND (yq IN ('USABLE', 'DEGRADED') OR yq = 'OPAQUE' AND alike), false) AS comparable, coalesce(xq = 'USABLE' AND yq = 'USABLE', false) AS carries FROM g""",
)
def text_gates(spark: SparkSession, d: str) -> DataFrame:
    return linkage.gates(table(spark, d, "doc_lines"), table(spark, d, "docs"), _pairs(spark, d))


RUNNING_SQL = f"""{sx.LINES}, placed AS (SELECT *, {sx.boilerplate_form('text')} AS form, {sx.carries_label('text')} AS labelled,
      row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS k, count(*) OVER (PARTITION BY doc_id, page) AS of_page FROM lines),
    books AS (SELECT doc_id, count(DISTINCT coalesce(page, -1)) AS of_pages FROM lines GROUP BY doc_id),
    forms AS (SELECT doc_id, form, count(DISTINCT page) AS pages, sum(CAST(k <= 2 OR of_page - k < 2 AS BIGINT)) AS edge, count(*) AS total FROM placed WHERE of_page >= 5 AND NOT labelled AND length(form) >= 4 GROUP BY doc_id, form HAVING count(DISTINCT page) >= 8),
    running AS (SELECT forms.* FROM forms JOIN books ON forms.doc_id = books.doc_id WHERE pages >= 0.05 * of_pages AND edge >= 0.5 * total)"""


@query("boilerplate_forms", f"WITH {RUNNING_SQL} SELECT doc_id, form, pages, CAST(edge AS BIGINT) AS edge, total FROM running")
def boilerplate_forms(spark: SparkSession, d: str) -> DataFrame:
    return structure.running_forms(table(spark, d, "doc_lines"))


@query("boilerplate_strip", f"WITH {RUNNING_SQL} SELECT p.doc_id, p.line_no, p.text FROM placed p LEFT JOIN running r ON p.doc_id = r.doc_id AND p.form = r.form AND NOT p.labelled WHERE r.form IS NULL")
def boilerplate_strip(spark: SparkSession, d: str) -> DataFrame:
    return structure.without_running_lines(table(spark, d, "doc_lines")).select("doc_id", "line_no", "text")


OPENS_SQL = f"""lab AS (SELECT *, {sx.is_question_line('text')} AS is_q, {sx.matches("coalesce(text, '')", tf.LINE_MARK)} AS marked,
      {sx.trimmed(f"regexp_replace(coalesce(text, ''), {sx.q(ids.WS + '+')}, ' ', 'g')")} AS heading FROM lines),
    rep AS (SELECT doc_id, heading FROM lab WHERE is_q GROUP BY doc_id, heading HAVING count(DISTINCT page) > 4),
    mk AS (SELECT doc_id, sum(CAST(marked AS BIGINT)) >= 0.2 * count(*) AS marks FROM lab WHERE is_q GROUP BY doc_id),
    opened AS (SELECT lab.*, is_q AND rep.heading IS NULL AND NOT (coalesce(marks, false) AND NOT marked AND {sx.descriptive_length('text')} >= 2) AS opens
      FROM lab LEFT JOIN rep ON is_q AND lab.doc_id = rep.doc_id AND lab.heading = rep.heading LEFT JOIN mk ON lab.doc_id = mk.doc_id)"""


@query("question_openers", f"WITH {sx.LINES}, {OPENS_SQL} SELECT doc_id, line_no, page FROM opened WHERE opens")
def question_openers(spark: SparkSession, d: str) -> DataFrame:
    return structure.opening_lines(table(spark, d, "doc_lines")).filter("opens").select("doc_id", "line_no", "page")


SEGMENT_SQL = f"""{RUNNING_SQL}, {OPENS_SQL},
    islands AS (SELECT o.*, r.form IS NOT NULL AS is_running, sum(CAST(opens AS BIGINT)) OVER (PARTITION BY o.doc_id ORDER BY line_no) - 1 AS ordinal
      FROM opened o LEFT JOIN running r ON o.doc_id = r.doc_id AND {sx.boilerplate_form('o.text')} = r.form AND NOT {sx.carries_label('o.text')}),
    pieces AS (SELECT *, nullif(CASE WHEN opens THEN {sx.question_body('text')} WHEN is_running THEN NULL
        WHEN {sx.sub_id('text')} IS NOT NULL THEN {sx.trimmed(f"regexp_replace(substr(text, length({sx.part('text', ids.SUB, 1)}) + 1), {sx.q(ids.MARK_BY_WORD)}, '')")} ELSE text END, '') AS piece FROM islands WHERE ordinal >= 0),
    segments AS (SELECT doc_id, ordinal, max(CASE WHEN opens THEN {sx.question_id('text')} END) AS label, arg_min(page, line_no) AS page, arg_max(page, line_no) AS end_page,
      {sx.trimmed("coalesce(string_agg(piece, ' ' ORDER BY line_no), '')")} AS text, sum(CAST(NOT opens AND NOT is_running AND {sx.sub_id('text')} IS NOT NULL AS BIGINT)) AS subs FROM pieces GROUP BY doc_id, ordinal)"""


@query("segment_entries", f"WITH {SEGMENT_SQL} SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, label, page, end_page, text, CAST(subs AS BIGINT) AS subs FROM segments WHERE text <> ''")
def segment_entries(spark: SparkSession, d: str) -> DataFrame:
    return structure.segmented_entries(table(spark, d, "doc_lines"))


@query(
    "toc_pages",
    f"WITH {sx.ENTRIES} SELECT doc_id, page, count(DISTINCT label) AS labels, sum(CAST({sx.matches('''coalesce(text, '')''', tf.TOC_ROW)} AS BIGINT)) AS leaders FROM e GROUP BY doc_id, page HAVING count(DISTINCT label) >= 4",
)
def toc_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = _entries(spark, d).groupBy("doc_id", "page").agg(F.count_distinct("label").alias("labels"), F.sum(F.coalesce("text", F.lit("")).rlike(tf.TOC_ROW).cast("int")).alias("leaders"))
    return pages.filter("labels >= 4")


@query(
    "page_offset_vote",
    f"""WITH {ENTRY_IDS}, r AS (SELECT doc_id, label_id, printed_page FROM (SELECT DISTINCT entries.doc_id, id, ordinal, printed_page FROM entries WHERE printed_page IS NOT NULL) x JOIN (SELECT DISTINCT doc_id AS dd, id AS ii, label_id FROM ei) y ON doc_id = dd AND id IS NOT DISTINCT FROM ii),
    f AS (SELECT doc_id, label_id, min(printed_page) AS printed FROM r WHERE label_id <> '' GROUP BY ALL), b AS (SELECT doc_id, label_id, min(page) AS page FROM ei WHERE label_id <> '' GROUP BY ALL),
    v AS (SELECT doc_id, page - printed AS shift, count(*) AS n FROM f JOIN b USING (doc_id, label_id) WHERE page IS NOT NULL GROUP BY ALL)
    SELECT doc_id, shift AS "offset", n AS votes, support FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS support, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, shift) AS k FROM v) WHERE k = 1 AND support >= 3 AND n >= 0.6 * support""",
)
def page_offset_vote(spark: SparkSession, d: str) -> DataFrame:
    printed = table(spark, d, "entries").filter("printed_page is not null").select("doc_id", "id", "ordinal", "printed_page").distinct()
    label = ids.normalize_id(F.regexp_extract(F.coalesce("id", F.lit("")), r"([0-9]{1,4}(?:[.．][0-9]{1,4})*)", 1))
    rows = printed.select("doc_id", label.alias("label"), "printed_page", F.col("printed_page").alias("seq")).filter("label <> ''")
    entries = _entries(spark, d).filter("label_id <> ''").select("doc_id", F.col("label_id").alias("label"), "page", F.coalesce("page", F.lit(1 << 30)).alias("seq"))
    return structure.page_offsets(rows, entries, support=3)


@query(
    "page_samples",
    f"""WITH {sx.LINES}, b AS (SELECT DISTINCT doc_id, num_pages FROM docs), h AS (SELECT l.*, num_pages FROM lines l JOIN b USING (doc_id) WHERE page BETWEEN 1 AND num_pages AND (page - 1) % greatest(1, num_pages // 12) = 0),
    c AS (SELECT doc_id, page, n, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, page, count(*) AS n FROM h GROUP BY ALL))
    SELECT doc_id, page, n FROM c WHERE before <= 4000""",
)
def page_samples(spark: SparkSession, d: str) -> DataFrame:
    return structure.sampled_pages(table(spark, d, "doc_lines"), table(spark, d, "docs")).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query("range_scan", f"WITH {sx.LINES} SELECT doc_id, line_no, page, text FROM lines WHERE page BETWEEN 2 AND 4")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return structure.book_lines(structure.page_range(table(spark, d, "doc_lines"), 2, 4)).select("doc_id", "line_no", "page", "text")


# Outlines.

SPAN_SQL = f"""o AS (SELECT DISTINCT doc_id, node_id, depth, title, page, end_page, child_count, coalesce(page, 0) AS p FROM outline WHERE doc_id IS NOT NULL AND title <> ''),
    nx AS (SELECT x.doc_id, x.node_id, min(y.p) AS nextp FROM o x LEFT JOIN o y ON x.doc_id = y.doc_id AND y.p > x.p AND y.depth <= x.depth GROUP BY x.doc_id, x.node_id),
    np AS (SELECT DISTINCT doc_id, CASE WHEN num_pages > 0 THEN num_pages END AS num_pages FROM docs),
    sp AS (SELECT o.*, coalesce(nextp - 1, num_pages) AS e FROM o JOIN nx USING (doc_id, node_id) LEFT JOIN np USING (doc_id)),
    nodes AS (SELECT doc_id, node_id, depth, title, page, child_count, CASE WHEN end_page IS NOT NULL THEN end_page WHEN e IS NOT NULL THEN greatest(p, e) END AS last,
      CASE WHEN end_page IS NOT NULL THEN end_page - page + 1 WHEN e IS NULL THEN 1 ELSE greatest(1, e - p + 1) END AS span, {sx.title_id('title')} AS question_id FROM sp)"""
LEVEL_SQL = f"""{SPAN_SQL},
    ag AS (SELECT doc_id, depth, max(c) AS agree FROM (SELECT doc_id, depth, page - CAST(question_id AS INTEGER) AS shift, count(*) AS c FROM nodes WHERE regexp_full_match(question_id, '[0-9]+') AND page IS NOT NULL GROUP BY ALL) GROUP BY ALL),
    cn AS (SELECT doc_id, depth, count(*) AS n, count(*) FILTER (child_count > 0) AS parents, count(*) FILTER ({sx.matches('title', tf.SECTION_MARK)}) AS structural, count(*) FILTER ({sx.matches('title', tf.TYPE_MARK)}) AS typed,
      count(*) FILTER ({sx.matches('title', tf.QUESTION_MARK)}) AS marked, count(*) FILTER (question_id <> '') AS with_id, count(*) FILTER ({sx.descriptive_length('title')} >= 2) AS descriptive,
      count(*) FILTER (regexp_full_match(question_id, '[0-9]+') AND page IS NOT NULL) AS flat, list_sort(list(coalesce(span, 1))) AS spans, count(*) OVER (PARTITION BY doc_id) AS levels FROM nodes GROUP BY doc_id, depth),
    lv AS (SELECT cn.doc_id, cn.depth, n, levels, CASE WHEN 2 * parents > n THEN 'SECTION' WHEN 2 * structural > n THEN 'SECTION' WHEN 2 * typed > n THEN 'QUESTION_TYPE' WHEN 2 * marked >= n THEN 'QUESTION' WHEN with_id = 0 THEN 'SECTION'
      WHEN flat >= 10 AND 2 * flat >= with_id AND agree >= 0.9 * flat THEN 'PAGE_MARKER' WHEN 2 * descriptive >= n THEN 'SECTION' WHEN spans[n // 2 + 1] > 8 THEN 'SECTION' WHEN n >= 20 THEN 'QUESTION' ELSE 'UNKNOWN' END AS kind0
      FROM cn LEFT JOIN ag ON cn.doc_id = ag.doc_id AND cn.depth = ag.depth),
    levels AS (SELECT doc_id, depth, n, CASE WHEN depth = 0 AND levels > 1 AND kind0 = 'SECTION' THEN 'BOOK' ELSE kind0 END AS kind FROM lv),
    kinds AS (SELECT nodes.*, CASE WHEN kind = 'QUESTION' AND child_count > 0 THEN 'SECTION' WHEN kind = 'QUESTION' AND question_id = '' THEN 'UNKNOWN' ELSE kind END AS kind FROM nodes JOIN levels USING (doc_id, depth))"""


@query("outline_spans", f"WITH {SPAN_SQL} SELECT doc_id, node_id, CAST(last AS INTEGER) AS last, CAST(span AS INTEGER) AS span FROM nodes")
def outline_spans(spark: SparkSession, d: str) -> DataFrame:
    return outline.spanned(table(spark, d, "outline"), table(spark, d, "docs")).select("doc_id", "node_id", F.col("last").cast("int").alias("last"), F.col("span").cast("int").alias("span"))


@query("outline_cohort", f"WITH {LEVEL_SQL} SELECT doc_id, depth, kind, n FROM levels")
def outline_cohort(spark: SparkSession, d: str) -> DataFrame:
    return outline.level_verdicts(outline.spanned(table(spark, d, "outline"), table(spark, d, "docs")))


@query("outline_kinds", f"WITH {LEVEL_SQL} SELECT doc_id, node_id, kind, question_id FROM kinds")
def outline_kinds(spark: SparkSession, d: str) -> DataFrame:
    return outline.classified(table(spark, d, "outline"), table(spark, d, "docs")).select("doc_id", "node_id", "kind", "question_id")


@query("range_spans", f"WITH {LEVEL_SQL} SELECT doc_id, kind, count(*) AS nodes, CAST(sum(span) AS BIGINT) AS pages FROM kinds GROUP BY ALL")
def range_spans(spark: SparkSession, d: str) -> DataFrame:
    return outline.classified(table(spark, d, "outline"), table(spark, d, "docs")).groupBy("doc_id", "kind").agg(F.count("*").alias("nodes"), F.sum("span").cast("long").alias("pages"))


@query(
    "id_pairs_unique",
    f"""WITH {LEVEL_SQL}, pairs AS (SELECT * FROM (SELECT doc_id AS q_doc, lead(doc_id) OVER (ORDER BY doc_id) AS a_doc FROM (SELECT DISTINCT doc_id FROM outline)) WHERE a_doc IS NOT NULL), qs AS (SELECT doc_id, question_id, node_id, page FROM kinds WHERE kind = 'QUESTION'),
    l AS (SELECT doc_id, question_id, node_id AS q_node FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, question_id ORDER BY page DESC NULLS LAST, node_id DESC) AS k FROM qs) WHERE k = 1),
    r AS (SELECT doc_id, question_id, min(node_id) AS a_node FROM qs GROUP BY ALL HAVING count(*) = 1)
    SELECT q_doc, a_doc, l.question_id, q_node, a_node FROM pairs JOIN l ON l.doc_id = q_doc JOIN r ON r.doc_id = a_doc AND r.question_id = l.question_id""",
)
def id_pairs_unique(spark: SparkSession, d: str) -> DataFrame:
    return outline.id_pairs(_classified(spark, d), _outline_pairs(spark, d))


# Matching.


@query(
    "label_lookup",
    f"""WITH {ENTRY_IDS}, {sx.PAIRS}, w AS (SELECT DISTINCT a_doc AS doc_id, label_id AS label FROM pairs JOIN ei ON ei.doc_id = q_doc),
    h AS (SELECT doc_id, label_id, count(*) AS hits, min(ordinal) AS ordinal FROM ei WHERE label_id <> '' GROUP BY ALL), b AS (SELECT DISTINCT doc_id FROM ei)
    SELECT w.doc_id, w.label, CASE WHEN b.doc_id IS NULL THEN 'NO_INDEX' WHEN w.label = '' OR hits IS NULL THEN 'NOT_FOUND' WHEN hits > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS status, coalesce(hits, 0) AS hits, CASE WHEN hits = 1 THEN ordinal END AS ordinal
    FROM w LEFT JOIN h ON w.doc_id = h.doc_id AND w.label = h.label_id LEFT JOIN b ON w.doc_id = b.doc_id""",
)
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    wanted = _pairs(spark, d).join(entries.select(F.col("doc_id").alias("q_doc"), F.col("label_id").alias("label")).distinct(), "q_doc").select(F.col("a_doc").alias("doc_id"), "label")
    return matching.label_lookup(entries, wanted)


@query(
    "page_interval_join",
    f"WITH {ENTRY_IDS}, p AS (SELECT DISTINCT doc_id, page AS asked FROM doc_lines WHERE page IS NOT NULL) SELECT p.doc_id, asked AS page, id, ordinal FROM p JOIN ei ON p.doc_id = ei.doc_id AND asked BETWEEN page AND coalesce(end_page, page)",
)
def page_interval_join(spark: SparkSession, d: str) -> DataFrame:
    return matching.questions_on_pages(_entries(spark, d), table(spark, d, "doc_lines").filter("page is not null").select("doc_id", "page"))


DICE_SQL = f"""
    l AS (SELECT DISTINCT item_id, {sx.normalize_for_match('text')} AS norm FROM benchmark), r AS (SELECT DISTINCT doc_id, {sx.normalize_for_match('text')} AS norm FROM documents WHERE text <> ''),
    lg AS (SELECT item_id, gram, length(norm) - 1 AS total, count(*) AS n FROM (SELECT item_id, norm, unnest({sx.bigrams('norm')}) AS gram FROM l) GROUP BY ALL), rg AS (SELECT doc_id, gram, length(norm) - 1 AS total, count(*) AS n FROM (SELECT doc_id, norm, unnest({sx.bigrams('norm')}) AS gram FROM r) GROUP BY ALL),
    sim AS (SELECT item_id, doc_id, CAST(sum(least(lg.n, rg.n)) AS BIGINT) AS shared, 2.0 * sum(least(lg.n, rg.n)) / (lg.total + rg.total) AS similarity FROM lg JOIN rg USING (gram) GROUP BY item_id, doc_id, lg.total, rg.total)"""


@query("dice_topk", f"WITH {DICE_SQL} SELECT item_id, doc_id, shared, round(similarity, 6) AS similarity, k FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 9) DESC, doc_id) AS k FROM sim) WHERE k <= 5")
def dice_topk(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("t"), "text")
    found = scoring.top_similar(items, texts, 5)
    return found.select(F.col("q").alias("item_id"), F.col("t").alias("doc_id"), "shared", F.round("similarity", 6).alias("similarity"), "k")


def _same_label(spark: SparkSession, d: str) -> DataFrame:
    """Each question with the entries of the next book that bear its label, one text a question and candidate."""
    entries = _entries(spark, d).filter("label_id <> '' and text <> ''")
    left = entries.select(F.col("doc_id").alias("q_doc"), "label_id", F.col("ordinal").alias("q_ordinal"), F.col("text").alias("q_text"))
    right = entries.select(F.col("doc_id").alias("a_doc"), "label_id", F.col("ordinal").alias("a_ordinal"), F.col("text").alias("a_text"))
    return _pairs(spark, d).join(left, "q_doc").join(right, ["a_doc", "label_id"])


def _dice_sql(a: str, b: str, grams_a: str, grams_b: str) -> str:
    shared = f"list_sum(list_transform(list_distinct({grams_a}), lambda g: least(len(list_filter({grams_a}, lambda x: x = g)), len(list_filter({grams_b}, lambda x: x = g)))))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0 ELSE 2.0 * {shared} / (len({grams_a}) + len({grams_b})) END"


def _context_list(norm: str) -> str:
    kept = f"list_filter(range(1, length({norm}) + 1), lambda k: {sx.matches(f'substr({norm}, k, 1)', f'[{tf.SKELETON}()]')})"
    return f"list_transform({kept}, lambda k: substr('···' || {norm} || '···', k, 7))"


CONTENT_SQL = f"""{ENTRY_IDS}, {sx.PAIRS}, t AS (SELECT q_doc, a_doc, x.label_id, x.ordinal AS q_ordinal, y.ordinal AS a_ordinal, x.text AS q_text, y.text AS a_text FROM pairs JOIN ei x ON x.doc_id = q_doc JOIN ei y ON y.doc_id = a_doc AND x.label_id = y.label_id WHERE x.label_id <> '' AND x.text <> '' AND y.text <> ''),
    n AS (SELECT *, {sx.normalize_for_match('q_text')} AS qn, {sx.normalize_for_match('a_text')} AS an FROM t),
    f AS (SELECT *, {sx.normalize_for_match(f"array_to_string({sx.fragments('qn')}, ' ')")} AS qm, {sx.normalize_for_match(f"array_to_string({sx.fragments('an')}, ' ')")} AS am, {_context_list('qn')} AS qc, {_context_list('an')} AS ac, {sx.bigrams('qn')} AS qg, {sx.bigrams('an')} AS ag FROM n),
    g AS (SELECT *, {sx.bigrams('qm')} AS qmg, {sx.bigrams('am')} AS amg FROM f),
    s AS (SELECT *, {_dice_sql('qn', 'an', 'qg', 'ag')} AS prose, {_dice_sql('qm', 'am', 'qmg', 'amg')} AS fragments,
      CASE WHEN len(qc) >= 2 AND len(ac) >= 2 THEN 2.0 * list_sum(list_transform(list_distinct(qc), lambda c: least(len(list_filter(qc, lambda x: x = c)), len(list_filter(ac, lambda x: x = c))))) / (len(qc) + len(ac)) END AS context FROM g),
    scored AS (SELECT q_doc, a_doc, label_id, q_ordinal, a_ordinal, CASE WHEN qm = '' OR am = '' THEN prose ELSE 0.75 * CASE WHEN context IS NULL THEN fragments ELSE 0.6 * context + 0.4 * fragments END + 0.25 * prose END AS score FROM s)"""


@query("content_similarity", f"WITH {CONTENT_SQL} SELECT q_doc, a_doc, label_id, q_ordinal, a_ordinal, round(score, 6) AS score FROM scored")
def content_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).withColumn("score", F.round("score", 6))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d).filter("label_id <> '' and text <> ''")
    texts = entries.select("doc_id", "ordinal", "label_id", "text", F.xxhash64("text").alias("t"))
    left = texts.select(F.col("doc_id").alias("q_doc"), "label_id", F.col("ordinal").alias("q_ordinal"), F.col("t").alias("lt"))
    right = texts.select(F.col("doc_id").alias("a_doc"), "label_id", F.col("ordinal").alias("a_ordinal"), F.col("t").alias("rt"))
    candidates = _pairs(spark, d).join(left, "q_doc").join(right.hint("merge"), ["a_doc", "label_id"])
    once = texts.select("t", "text").distinct()
    scored = matching.content_scores(candidates.select("lt", "rt").distinct(), once.withColumnRenamed("t", "lt"), once.withColumnRenamed("t", "rt"), "lt", "rt")
    return candidates.join(scored, ["lt", "rt"]).select("q_doc", "a_doc", "label_id", "q_ordinal", "a_ordinal", "score")


# Alignment and decisions.


def _outline_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each book with an outline and the next such book."""
    books = table(spark, d, "outline").select("doc_id").distinct()
    return books.select(F.col("doc_id").alias("q_doc"), F.lead("doc_id").over(Window.orderBy("doc_id")).alias("a_doc")).filter("a_doc is not null")


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return outline.classified(table(spark, d, "outline"), table(spark, d, "docs"))


@query("title_alignment")
def title_alignment(spark: SparkSession, d: str) -> DataFrame:
    sections = _classified(spark, d).filter(F.col("kind").isin(*outline.SECTIONS))
    return sequence.aligned_titles(sections, _outline_pairs(spark, d))


OUTLINE_PAIRS_SQL = "op AS (SELECT * FROM (SELECT doc_id AS q_doc, lead(doc_id) OVER (ORDER BY doc_id) AS a_doc FROM (SELECT DISTINCT doc_id FROM outline)) WHERE a_doc IS NOT NULL)"
#: Sections paired by their place among their depth, where both books have one: an alignment that SQL can state.
PLACED_SQL = f"""{LEVEL_SQL}, {OUTLINE_PAIRS_SQL}, sec AS (SELECT *, row_number() OVER (PARTITION BY doc_id, depth ORDER BY page, node_id) AS place FROM kinds WHERE kind IN ('SECTION', 'BOOK', 'QUESTION_TYPE') AND page > 0),
    al AS (SELECT q_doc, a_doc, x.node_id AS q_node, x.page AS q_page, x.last AS q_last, x.depth AS q_depth, y.page AS a_page, y.last AS a_last, y.depth AS a_depth FROM op JOIN sec x ON x.doc_id = q_doc JOIN sec y ON y.doc_id = a_doc AND x.depth = y.depth AND x.place = y.place),
    sq AS (SELECT *, row_number() OVER (PARTITION BY q_doc, a_doc ORDER BY q_page, q_node) AS seq FROM al),
    nb AS (SELECT x.q_doc, x.a_doc, x.seq, arg_min(y.a_page, y.seq) AS next_page FROM sq x JOIN sq y ON x.q_doc = y.q_doc AND x.a_doc = y.a_doc AND y.seq > x.seq AND y.a_page > x.a_page AND y.a_depth <= x.a_depth GROUP BY ALL),
    rg AS (SELECT sq.*, a_page AS from_page, greatest(a_page, coalesce(a_last, next_page - 1, num_pages, a_page)) AS to_page FROM sq LEFT JOIN nb USING (q_doc, a_doc, seq) LEFT JOIN np ON np.doc_id = a_doc),
    asked AS (SELECT DISTINCT doc_id, page AS asked FROM doc_lines WHERE page IS NOT NULL),
    hit AS (SELECT q_doc, a_doc, asked AS page, q_node, from_page, to_page, row_number() OVER (PARTITION BY q_doc, a_doc, asked ORDER BY q_depth DESC, seq DESC) AS k FROM asked JOIN rg ON doc_id = q_doc AND asked >= q_page AND (q_last IS NULL OR asked <= q_last))"""


@query("region_locate", f"WITH {PLACED_SQL} SELECT q_doc, a_doc, page, q_node, CAST(from_page AS INTEGER) AS from_page, CAST(to_page AS INTEGER) AS to_page FROM hit WHERE k = 1")
def region_locate(spark: SparkSession, d: str) -> DataFrame:
    sections = _classified(spark, d).filter(F.col("kind").isin(*outline.SECTIONS) & (F.col("page") > 0))
    sections = sections.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "depth").orderBy("page", "node_id")))
    left = sections.select(F.col("doc_id").alias("q_doc"), F.col("node_id").alias("q_node"), F.col("page").alias("q_page"), F.col("last").alias("q_last"), F.col("depth").alias("q_depth"), "depth", "place")
    right = sections.select(F.col("doc_id").alias("a_doc"), F.col("page").alias("a_page"), F.col("last").alias("a_last"), F.col("depth").alias("a_depth"), "depth", "place")
    aligned = _outline_pairs(spark, d).join(left, "q_doc").join(right, ["a_doc", "depth", "place"])
    pages = table(spark, d, "doc_lines").filter("page is not null").select(F.col("doc_id").alias("q_doc"), "page").distinct()
    out = outline.section_regions(aligned, pages, table(spark, d, "docs"))
    return out.withColumns({c: F.col(c).cast("int") for c in ("from_page", "to_page")})


@query("sequence_alignment")
def sequence_alignment(spark: SparkSession, d: str) -> DataFrame:
    held = _entries(spark, d).filter("text <> ''").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ordinal", "id")).cast("long"))
    left = held.select(F.col("doc_id").alias("q_doc"), F.col("n").alias("q"), F.col("n").alias("q_seq"), "label_id", "text")
    right = held.select(F.col("doc_id").alias("a_doc"), F.col("n").alias("a"), F.col("n").alias("a_seq"), "label_id", "text")
    books = _pairs(spark, d)
    return sequence.aligned_entries(books.join(left, "q_doc"), books.join(right, "a_doc"), ["q_doc", "a_doc"])


@query("formula_compare")
def formula_compare(spark: SparkSession, d: str) -> DataFrame:
    texts = _same_label(spark, d).select(F.struct("q_doc", "a_doc", "label_id", "q_ordinal", "a_ordinal").alias("q"), "q_text", "a_text")
    return sequence.formula_ceilings(texts).select("q.*", "total", "matched", "conflicts", "missing", "ceiling", "ceiling_reason")


DECISION_SQL = f"""{CONTENT_SQL}, c AS (SELECT q_doc, a_doc, q_ordinal, label_id, a_ordinal, round(score, 9) AS score FROM scored),
    r AS (SELECT *, count(*) OVER w AS hits, row_number() OVER (PARTITION BY q_doc, q_ordinal, label_id ORDER BY score DESC, a_ordinal) AS k, lead(score) OVER (PARTITION BY q_doc, q_ordinal, label_id ORDER BY score DESC, a_ordinal) AS second FROM c WINDOW w AS (PARTITION BY q_doc, q_ordinal, label_id)),
    decided AS (SELECT q_doc, q_ordinal, label_id, hits, CASE WHEN hits = 1 THEN CASE WHEN score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END WHEN score >= 0.55 AND score - coalesce(second, 0) > 0.15 THEN 'MEDIUM' ELSE 'NONE' END AS confidence, a_ordinal FROM r WHERE k = 1)"""


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    rows = scored.select(
        F.struct("q_doc", "q_ordinal", "label_id").alias("q"),
        F.col("a_ordinal").alias("cand"),
        F.col("a_ordinal").alias("seq"),
        F.lit(True).alias("label_hit"),
        F.round("score", 9).alias("score"),
        F.lit(False).alias("exact_id"),
        F.lit(False).alias("section_aligned"),
        F.lit(True).alias("comparable"),
        F.lit(True).alias("carries"),
    )
    return matching.decided(rows)


@query("match_confidence", f"WITH {DECISION_SQL} SELECT q_doc, q_ordinal, label_id, confidence, confidence <> 'NONE' AS matched, CASE WHEN confidence <> 'NONE' THEN a_ordinal END AS cand FROM decided")
def match_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _decisions(spark, d).select("q.*", "confidence", "matched", "cand")


@query(
    "assign_rungs",
    f"""WITH {DECISION_SQL}, st AS (SELECT *, CASE q_doc % 3 WHEN 0 THEN 'VERIFIED_PAIR' WHEN 1 THEN 'UNKNOWN_PAIR' ELSE 'REJECTED_PAIR' END AS status,
      CASE WHEN confidence = 'MEDIUM' THEN 'AUTO_MATCH' WHEN confidence = 'LOW' THEN 'REVIEW' WHEN hits BETWEEN 1 AND 5 THEN 'REVIEW' ELSE 'REFUSED' END AS first FROM decided)
    SELECT q_doc, q_ordinal, label_id, CASE WHEN status = 'REJECTED_PAIR' THEN 'BLOCKED' WHEN status = 'UNKNOWN_PAIR' AND first = 'AUTO_MATCH' THEN 'REVIEW' ELSE first END AS rung,
      CASE WHEN status = 'REJECTED_PAIR' THEN 'PAIR_IDENTITY_MISMATCH' WHEN status = 'UNKNOWN_PAIR' AND first = 'AUTO_MATCH' THEN 'PAIR_IDENTITY_UNKNOWN' WHEN confidence = 'NONE' AND hits BETWEEN 1 AND 5 THEN 'AMBIGUOUS_LABEL' WHEN confidence = 'LOW' THEN 'LOW_CONFIDENCE' END AS capped_by FROM st""",
)
def assign_rungs(spark: SparkSession, d: str) -> DataFrame:
    rest = F.pmod("q.q_doc", F.lit(3))
    status = F.when(rest == 0, "VERIFIED_PAIR").when(rest == 1, "UNKNOWN_PAIR").otherwise("REJECTED_PAIR")
    none = F.lit(None).cast("string")
    rows = _decisions(spark, d).withColumns({"ceiling": none, "ceiling_reason": none, "has_region": F.lit(False), "pair_status": status})
    return matching.with_rungs(rows).select("q.*", "rung", "capped_by")


@query("rung_histogram", f"WITH {DECISION_SQL} SELECT q_doc, CASE WHEN confidence = 'MEDIUM' THEN 'AUTO_MATCH' WHEN confidence = 'LOW' THEN 'REVIEW' ELSE 'REFUSED' END AS rung, count(*) AS n FROM decided GROUP BY ALL")
def rung_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = _decisions(spark, d).select("q.q_doc", matching.rung_for(F.col("confidence"), F.col("matched")).alias("rung"))
    return audit.rung_histogram(rows, ["q_doc"])


@query(
    "positional_support",
    f"""WITH {DECISION_SQL}, w AS (SELECT *, confidence = 'MEDIUM' AS strong FROM decided)
    SELECT q_doc, q_ordinal, label_id, CASE WHEN confidence = 'LOW' AND coalesce(lag(strong) OVER o, false) AND coalesce(lead(strong) OVER o, false) THEN 'MEDIUM' ELSE confidence END AS supported FROM w WINDOW o AS (PARTITION BY q_doc ORDER BY q_ordinal, label_id)""",
)
def positional_support(spark: SparkSession, d: str) -> DataFrame:
    rows = _decisions(spark, d).select("q.*", "matched", "confidence").withColumn("place", F.struct("q_ordinal", "label_id"))
    return matching.positional_support(rows, ["q_doc"], "place").select("q_doc", "q_ordinal", "label_id", "supported")


@query(
    "positional_window",
    f"""WITH {sx.ENTRIES}, {sx.PAIRS}, n AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, ordinal FROM e) GROUP BY ALL), x AS (SELECT DISTINCT q_doc, a_doc, ordinal, a.n AS qn, b.n AS an FROM pairs JOIN e ON e.doc_id = q_doc JOIN n a ON a.doc_id = q_doc JOIN n b ON b.doc_id = a_doc WHERE ordinal >= 0 AND a.n > 1),
    w AS (SELECT *, CAST(floor(ordinal * (an - 1) / (qn - 1) + 0.5) AS BIGINT) AS expected, greatest(4, CAST(ceil(an * 0.06) AS BIGINT)) AS half FROM x)
    SELECT q_doc, a_doc, ordinal, greatest(0, expected - half) AS from_place, least(an - 1, expected + half) AS to_place FROM w""",
)
def positional_window(spark: SparkSession, d: str) -> DataFrame:
    held = _entries(spark, d).select("doc_id", "ordinal").distinct()
    sizes = held.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = _pairs(spark, d).join(held.withColumnRenamed("doc_id", "q_doc"), "q_doc")
    rows = rows.join(sizes.withColumnsRenamed({"doc_id": "q_doc", "n": "qn"}), "q_doc").join(sizes.withColumnsRenamed({"doc_id": "a_doc", "n": "an"}), "a_doc")
    rows = rows.withColumn("w", matching.positional_window(F.col("ordinal"), F.col("qn"), F.col("an"))).filter("w is not null")
    return rows.select("q_doc", "a_doc", "ordinal", F.col("w.from").cast("long").alias("from_place"), F.col("w.to").cast("long").alias("to_place"))


# Pairs of books.

ROLE_SQL = f"""{sx.ENTRIES}, ra AS (SELECT doc_id, text, source, {sx.extract_answer('text')} AS found FROM e WHERE text <> ''),
    rc AS (SELECT doc_id, count(*) AS n, count(*) FILTER ({sx.matches('text', pairs.SOLUTION)}) AS language, count(*) FILTER (found <> '' AND found <> text) AS answers, bool_or(source = 'OUTLINE') AS by_outline FROM ra GROUP BY doc_id),
    roles AS (SELECT doc_id, n, language, answers, CASE WHEN n < 20 THEN 'UNKNOWN' WHEN language >= 0.97 * n AND answers >= 0.97 * n THEN 'ANSWER' WHEN by_outline THEN 'EXERCISE' ELSE 'UNKNOWN' END AS role FROM rc)"""
FIRST_SQL = f"""{sx.LINES}, ft AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM lines),
    tt AS (SELECT doc_id, title AS text FROM (SELECT DISTINCT doc_id, node_id, title FROM outline))"""


@query("role_classify", f"WITH {ROLE_SQL} SELECT doc_id, n, language, answers, role FROM roles")
def role_classify(spark: SparkSession, d: str) -> DataFrame:
    return pairs.roles(_entries(spark, d))


YEAR_SQL = f"""{FIRST_SQL}, ys AS (SELECT doc_id, unnest(regexp_extract_all(text, '20[0-9]{{2}}')) AS year FROM (SELECT doc_id, text FROM ft WHERE k <= 4000 UNION ALL SELECT * FROM tt)),
    yc AS (SELECT doc_id, year, count(*) AS n FROM ys GROUP BY ALL), yr AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, year) AS place FROM yc),
    years AS (SELECT doc_id, CASE WHEN n >= 0.6 * total THEN year END AS year, n AS votes, total FROM yr WHERE place = 1)"""


@query("doc_year", f"WITH {YEAR_SQL} SELECT * FROM years")
def doc_year(spark: SparkSession, d: str) -> DataFrame:
    return pairs.years(table(spark, d, "doc_lines"), table(spark, d, "outline"))


def _leader_sql(kind: str, least: int) -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, '{s}' AS s, {kind}_{s} AS n FROM sc" for s in pairs.SUBJECTS)
    return f"SELECT doc_id, s FROM (SELECT doc_id, s, n, lead(n) OVER (PARTITION BY doc_id ORDER BY n DESC, s DESC) AS second, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s DESC) AS k FROM ({rows})) WHERE k = 1 AND n >= {least} AND n >= 2 * second"


_SUBJECT_COUNTS = ", ".join(f"count(*) FILTER ({sx.matches('text', p)}) AS {kind}_{s}" for s, both in pairs.SUBJECTS.items() for kind, p in zip(("n", "t"), both))
SUBJECT_SQL = f"""sx AS (SELECT doc_id, text FROM ft WHERE k <= 3000 UNION ALL SELECT * FROM tt), sc AS (SELECT doc_id, {_SUBJECT_COUNTS} FROM sx WHERE text IS NOT NULL GROUP BY doc_id),
    ln AS ({_leader_sql('n', 5)}), lt AS ({_leader_sql('t', 3)}), subjects AS (SELECT sc.doc_id, coalesce(ln.s, lt.s, 'MIXED') AS subject FROM sc LEFT JOIN ln USING (doc_id) LEFT JOIN lt USING (doc_id))"""


@query("doc_subject", f"WITH {FIRST_SQL}, {SUBJECT_SQL} SELECT doc_id, subject FROM subjects")
def doc_subject(spark: SparkSession, d: str) -> DataFrame:
    return pairs.subjects(table(spark, d, "doc_lines"), table(spark, d, "outline"))


def _counted_dice(a: str, b: str, shared: str, na: str, nb: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0 ELSE 2.0 * {shared} / ({na} + {nb}) END"


#: Sampled questions against all entries of the answer book; shared tokens by joins.
ANCHOR_SQL = f"""{ENTRY_IDS}, {sx.PAIRS}, ae AS (SELECT DISTINCT doc_id, ordinal, id, label_id, text FROM ei WHERE text <> ''),
    an AS (SELECT *, {sx.normalize_for_match('text')} AS norm FROM ae), af AS (SELECT *, {sx.normalize_for_match(f"array_to_string({sx.fragments('norm')}, ' ')")} AS formulas FROM an),
    ak AS (SELECT *, row_number() OVER (ORDER BY doc_id, ordinal NULLS FIRST, id NULLS FIRST, norm NULLS FIRST) AS n FROM af),
    atk AS (SELECT n, 'prose' AS channel, unnest({sx.bigrams('norm')}) AS token FROM ak UNION ALL SELECT n, 'math', unnest({sx.bigrams('formulas')}) FROM ak UNION ALL SELECT n, 'context', unnest({_context_list('norm')}) FROM ak WHERE formulas <> ''),
    ac AS (SELECT n, channel, token, count(*) AS c FROM atk GROUP BY ALL), az AS (SELECT n, count(*) FILTER (channel = 'prose') AS prose, count(*) FILTER (channel = 'math') AS math, count(*) FILTER (channel = 'context') AS context FROM atk GROUP BY n),
    ash AS (SELECT q_doc, a_doc, n, label_id, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY q_doc, a_doc) AS shared FROM pairs JOIN ak ON doc_id = q_doc WHERE label_id <> '' AND EXISTS (SELECT 1 FROM ak y WHERE y.doc_id = a_doc AND y.label_id = ak.label_id) WINDOW w AS (PARTITION BY q_doc, a_doc ORDER BY n)),
    asm AS (SELECT *, greatest(1, shared // 24) AS step FROM ash WHERE shared >= 8), asd AS (SELECT * FROM asm WHERE k % step = 0 AND k // step < 24),
    acand AS (SELECT q_doc, a_doc, asd.n AS qn, asd.label_id, shared, y.n AS an, y.label_id AS a_label FROM asd JOIN ak y ON y.doc_id = a_doc),
    amet AS (SELECT qn, an, sum(least(x.c, y.c)) FILTER (x.channel = 'prose') AS prose, sum(least(x.c, y.c)) FILTER (x.channel = 'math') AS math, sum(least(x.c, y.c)) FILTER (x.channel = 'context') AS context FROM (SELECT DISTINCT qn, an FROM acand) JOIN ac x ON x.n = qn JOIN ac y ON y.n = an AND y.channel = x.channel AND y.token = x.token GROUP BY ALL),
    avals AS (SELECT d.*, x.norm AS xn, y.norm AS yn, x.formulas AS xf, y.formulas AS yf, coalesce(m.prose, 0) AS sp, coalesce(m.math, 0) AS sm, coalesce(m.context, 0) AS sc, coalesce(u.prose, 0) AS up, coalesce(u.math, 0) AS um, coalesce(u.context, 0) AS uc, coalesce(v.prose, 0) AS vp, coalesce(v.math, 0) AS vm, coalesce(v.context, 0) AS vc
      FROM acand d JOIN ak x ON x.n = qn JOIN ak y ON y.n = d.an LEFT JOIN amet m ON m.qn = d.qn AND m.an = d.an LEFT JOIN az u ON u.n = d.qn LEFT JOIN az v ON v.n = d.an),
    adice AS (SELECT *, {_counted_dice('xn', 'yn', 'sp', 'up', 'vp')} AS prose, {_counted_dice('xf', 'yf', 'sm', 'um', 'vm')} AS fragments, CASE WHEN uc >= 2 AND vc >= 2 THEN 2.0 * sc / (uc + vc) END AS context FROM avals),
    ascore AS (SELECT *, round(CASE WHEN xf = '' OR yf = '' THEN prose ELSE 0.75 * CASE WHEN context IS NULL THEN fragments ELSE 0.6 * context + 0.4 * fragments END + 0.25 * prose END, 9) AS score FROM adice),
    abest AS (SELECT *, row_number() OVER (PARTITION BY q_doc, a_doc, qn ORDER BY score DESC, an) AS place FROM ascore),
    anchors AS (SELECT q_doc, a_doc, shared, count(*) AS sampled, count(*) FILTER (label_id = a_label) AS first FROM abest WHERE place = 1 GROUP BY ALL)"""


@query("anchor_agreement", f"WITH {ANCHOR_SQL} SELECT q_doc, a_doc, shared, sampled, first FROM anchors")
def anchor_agreement(spark: SparkSession, d: str) -> DataFrame:
    return pairs.anchors(_entries(spark, d), _pairs(spark, d))


#: Roles first, then years and subjects, then anchors.
VERDICT_SQL = f"""{ANCHOR_SQL}, {ROLE_SQL.removeprefix(sx.ENTRIES + ', ')}, {YEAR_SQL}, {SUBJECT_SQL}, src AS (SELECT doc_id, bool_and(source = 'OUTLINE') AS by_outline FROM e GROUP BY doc_id),
    facts AS (SELECT p.q_doc, p.a_doc, coalesce(qr.role, 'UNKNOWN') AS q_role, coalesce(ar.role, 'UNKNOWN') AS a_role, coalesce(qy.year <> ay.year, false) AS other_year, coalesce(qs.subject <> 'MIXED' AND asu.subject <> 'MIXED' AND qs.subject <> asu.subject, false) AS other_subject,
      coalesce(first < 0.4 * sampled, false) AS weak, coalesce(qo.by_outline AND ao.by_outline, false) AS firm, sampled FROM pairs p LEFT JOIN roles qr ON qr.doc_id = p.q_doc LEFT JOIN roles ar ON ar.doc_id = p.a_doc LEFT JOIN years qy ON qy.doc_id = p.q_doc LEFT JOIN years ay ON ay.doc_id = p.a_doc
      LEFT JOIN subjects qs ON qs.doc_id = p.q_doc LEFT JOIN subjects asu ON asu.doc_id = p.a_doc LEFT JOIN src qo ON qo.doc_id = p.q_doc LEFT JOIN src ao ON ao.doc_id = p.a_doc LEFT JOIN anchors x ON x.q_doc = p.q_doc AND x.a_doc = p.a_doc),
    reasons AS (SELECT q_doc, a_doc, CASE WHEN a_role = 'EXERCISE' THEN 'RIGHT_ROLE_INVALID' WHEN q_role = 'ANSWER' THEN 'LEFT_ROLE_INVALID' WHEN a_role = 'UNKNOWN' THEN 'PAIR_IDENTITY_UNKNOWN' WHEN other_year OR other_subject OR (weak AND firm) THEN 'PAIR_IDENTITY_MISMATCH' WHEN weak OR sampled IS NULL THEN 'PAIR_IDENTITY_UNKNOWN' END AS reason FROM facts),
    verdicts AS (SELECT q_doc, a_doc, CASE WHEN reason IS NULL THEN 'VERIFIED_PAIR' WHEN reason = 'PAIR_IDENTITY_UNKNOWN' THEN 'UNKNOWN_PAIR' ELSE 'REJECTED_PAIR' END AS status, reason FROM reasons)"""


@query("pair_verdict", f"WITH {VERDICT_SQL} SELECT q_doc, a_doc, status, reason FROM verdicts")
def pair_verdict(spark: SparkSession, d: str) -> DataFrame:
    return linkage.verified_pairs(table(spark, d, "doc_lines"), table(spark, d, "outline"), _entries(spark, d), _pairs(spark, d))


@query("pair_matrix", f"WITH {VERDICT_SQL} SELECT status, reason, count(*) AS n FROM verdicts GROUP BY ALL")
def pair_matrix(spark: SparkSession, d: str) -> DataFrame:
    return pair_verdict(spark, d).groupBy("status", "reason").agg(F.count("*").alias("n"))


#: Over the 32-bit digest of a text's characters.
FNV_SQL = "lpad(lower(to_hex(CAST(list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(list_filter(string_split({0}, ''), lambda x: x <> ''), lambda x: CAST(ord(x) AS HUGEINT))), lambda h, x: (CAST(xor(CAST(h AS BIGINT), CAST(x AS BIGINT)) AS HUGEINT) * 16777619) % 4294967296) AS BIGINT))), 8, '0')"
PRINT_SQL = f"""{sx.LINES}, {LEVEL_SQL}, fl AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {sx.q(ids.WS + '+')}, '', 'g') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS of FROM lines),
    fd AS (SELECT doc_id, string_agg(t, '' ORDER BY k) AS t FROM fl WHERE k % greatest(1, of // 400) = 0 AND k // greatest(1, of // 400) < 400 GROUP BY doc_id),
    fs AS (SELECT doc_id, string_agg(depth || ':' || n, ',' ORDER BY depth) AS shape FROM (SELECT doc_id, depth, count(*) AS n FROM kinds GROUP BY ALL) GROUP BY doc_id),
    fq AS (SELECT doc_id, count(*) AS labels, first(question_id ORDER BY page NULLS FIRST, node_id) || '..' || last(question_id ORDER BY page NULLS FIRST, node_id) AS label_range FROM kinds WHERE kind = 'QUESTION' AND question_id <> '' GROUP BY doc_id),
    fp AS (SELECT d.doc_id, coalesce(num_pages, 0) AS pages, coalesce(shape, '') AS outline_shape, coalesce(labels, 0) AS labels, coalesce(label_range, '') AS label_range, {FNV_SQL.format("coalesce(fd.t, '')")} AS content_digest FROM (SELECT DISTINCT doc_id, num_pages FROM docs) d LEFT JOIN fs USING (doc_id) LEFT JOIN fq USING (doc_id) LEFT JOIN fd USING (doc_id)),
    prints AS (SELECT *, {FNV_SQL.format("""'{"pages":' || pages || ',"outlineShape":"' || outline_shape || '","labels":' || labels || ',"labelRange":"' || label_range || '","contentDigest":"' || content_digest || '"}'""")} AS id FROM fp)"""


@query("fingerprint", f"WITH {PRINT_SQL} SELECT doc_id, pages, outline_shape, labels, label_range, content_digest, id FROM prints")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return pairs.fingerprints(table(spark, d, "doc_lines"), _classified(spark, d), table(spark, d, "docs"))


@query(
    "fnv_digest",
    f"""WITH t AS (SELECT DISTINCT doc_id, title FROM outline WHERE title <> ''), c AS (SELECT doc_id, title, list_transform(string_split(title, ''), lambda x: CAST(ord(x) AS HUGEINT)) AS codes FROM t)
    SELECT doc_id, title, lpad(lower(to_hex(CAST(list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), codes), lambda h, x: (CAST(xor(CAST(h AS BIGINT), CAST(x AS BIGINT)) AS HUGEINT) * 16777619) % 4294967296) AS BIGINT))), 8, '0') AS digest FROM c""",
)
def fnv_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "outline").filter("title <> ''").select("doc_id", "title").distinct().withColumn("digest", tf.fnv1a(F.col("title")))


BINDING_SQL = "SELECT q_doc, a_doc, CASE q_doc % 4 WHEN 0 THEN 'BINDING_ABSENT' WHEN 1 THEN 'BINDING_STALE' WHEN 2 THEN 'BINDING_MALFORMED' ELSE 'VALID' END AS state FROM (SELECT * FROM (SELECT doc_id AS q_doc, lead(doc_id) OVER (ORDER BY doc_id) AS a_doc FROM docs) WHERE a_doc IS NOT NULL)"


@query("binding_states", BINDING_SQL)
def binding_states(spark: SparkSession, d: str) -> DataFrame:
    prints = fingerprint(spark, d)
    books = _pairs(spark, d)
    return pairs.binding_states(_stored_bindings(prints, books), prints, books)


def _stored_bindings(prints: DataFrame, books: DataFrame) -> DataFrame:
    """Bindings as a user may hold them: none of every fourth book, one of other contents, one without a digest, the others as they are."""
    rest = F.pmod("q_doc", F.lit(4))
    stored = pairs.bindings(prints, books).filter(rest != 0)
    changed = F.when(rest == 1, F.col("a_print").withField("content_digest", F.lit("00000000"))).when(rest == 2, F.col("a_print").withField("id", F.lit(None).cast("string")))
    return stored.withColumn("a_print", F.coalesce(changed, "a_print"))


@query(
    "bound_verdicts",
    f"""WITH {VERDICT_SQL}, bs AS ({BINDING_SQL}), r2 AS (SELECT f.q_doc, f.a_doc, CASE WHEN a_role = 'EXERCISE' THEN 'RIGHT_ROLE_INVALID' WHEN q_role = 'ANSWER' THEN 'LEFT_ROLE_INVALID' WHEN a_role = 'UNKNOWN' THEN 'PAIR_IDENTITY_UNKNOWN' WHEN other_year OR other_subject OR (weak AND firm) THEN 'PAIR_IDENTITY_MISMATCH' WHEN weak OR sampled IS NULL THEN CASE WHEN state = 'VALID' THEN 'PAIR_BOUND_MANUALLY' ELSE 'PAIR_IDENTITY_UNKNOWN' END END AS reason
      FROM facts f LEFT JOIN bs ON bs.q_doc = f.q_doc AND bs.a_doc = f.a_doc)
    SELECT q_doc, a_doc, CASE WHEN reason IS NULL OR reason = 'PAIR_BOUND_MANUALLY' THEN 'VERIFIED_PAIR' WHEN reason = 'PAIR_IDENTITY_UNKNOWN' THEN 'UNKNOWN_PAIR' ELSE 'REJECTED_PAIR' END AS status, reason FROM r2""",
)
def bound_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return linkage.verified_pairs(table(spark, d, "doc_lines"), table(spark, d, "outline"), _entries(spark, d), _pairs(spark, d), binding_states(spark, d))


# Glyphs and audits.


def _ciphered(spark: SparkSession, d: str) -> DataFrame:
    """Pages of Chinese books with each Chinese character replaced by a fixed other sign: a broken text layer with its readable twin."""
    held = _lines(spark, d).filter("text is not null and page is not null")
    pages = held.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("readable"))
    code = F.transform(F.split("readable", ""), lambda c: F.when(c.rlike(structure.HAN), F.decode(F.unhex(F.lpad(F.hex(F.pmod(F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int"), F.lit(4096)) + 0x1000), 4, "0")), "UTF-16BE")).otherwise(c))
    return pages.filter(F.col("readable").rlike(structure.HAN)).withColumn("broken", F.array_join(code, ""))


@query("glyph_votes")
def glyph_votes(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.votes(_ciphered(spark, d))


@query("glyph_table")
def glyph_table(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.glyph_table(glyphs.votes(_ciphered(spark, d)))


@query(
    "order_audit",
    """WITH e AS (SELECT user_id, ts, event_id, event_type FROM events), r AS (SELECT *, dense_rank() OVER (ORDER BY event_type) AS rk, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e),
    b AS (SELECT user_id, count(*) AS n, count(*) FILTER (rk < last) AS breaks FROM (SELECT *, lag(rk) OVER (PARTITION BY user_id ORDER BY k) AS last FROM r) GROUP BY user_id),
    i AS (SELECT x.user_id, count(*) AS inversions FROM r x JOIN r y ON x.user_id = y.user_id AND y.k > x.k AND y.rk < x.rk GROUP BY ALL)
    SELECT b.user_id, n, breaks, coalesce(inversions, 0) AS inversions FROM b LEFT JOIN i USING (user_id)""",
)
def order_audit(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    kinds = events.select("event_type").distinct().select("event_type", F.dense_rank().over(Window.orderBy("event_type")).alias("rk"))
    return audit.order_audit(events.join(F.broadcast(kinds), "event_type"), ["user_id"], ["ts", "event_id"], "rk")


@query(
    "start_alignment",
    f"""WITH {sx.LINES}, {ENTRY_IDS}, h AS (SELECT DISTINCT doc_id, {sx.question_id('text')} AS label, page FROM lines WHERE {sx.is_question_line('text')}),
    ev AS (SELECT ei.doc_id, ei.label_id AS label, ei.page, h.label IS NOT NULL AS printed FROM ei LEFT JOIN h ON ei.doc_id = h.doc_id AND ei.label_id = h.label AND ei.page = h.page WHERE label_id <> '')
    SELECT doc_id, count(*) FILTER (printed) AS starts, count(*) FILTER (NOT printed) AS continuations, count(DISTINCT label) AS labels, count(DISTINCT CASE WHEN printed THEN label END) AS start_labels FROM ev GROUP BY doc_id""",
)
def start_alignment(spark: SparkSession, d: str) -> DataFrame:
    headings = _lines(spark, d).filter(ids.is_question_line(F.col("text"))).select("doc_id", ids.question_line(F.col("text"))["id"].alias("label"), "page")
    return audit.start_alignment(_entries(spark, d).filter("label_id <> ''").select("doc_id", F.col("label_id").alias("label"), "page"), headings)


@query(
    "strict_metrics",
    f"""WITH {ENTRY_IDS}, {sx.PAIRS}, tr AS (SELECT doc_id, label_id, min(page) AS from_page, max(coalesce(end_page, page)) AS to_page FROM ei WHERE label_id <> '' GROUP BY ALL HAVING count(*) = 1),
    m AS (SELECT a_doc, label_id, page FROM pairs JOIN ei ON ei.doc_id = q_doc WHERE label_id <> '')
    SELECT a_doc AS doc_id, count(*) AS accepted, count(*) FILTER (page BETWEEN from_page AND to_page) AS confirmed, count(*) FILTER (NOT (page BETWEEN from_page AND to_page)) AS wrong_page, count(*) FILTER (from_page IS NULL) AS unidentifiable
    FROM m LEFT JOIN tr ON tr.doc_id = a_doc AND tr.label_id = m.label_id GROUP BY ALL""",
)
def strict_metrics(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d).filter("label_id <> ''")
    truth = entries.groupBy("doc_id", F.col("label_id").alias("label")).agg(F.min("page").alias("from_page"), F.max(F.coalesce("end_page", "page")).alias("to_page"), F.count("*").alias("n")).filter("n = 1").drop("n")
    matches = _pairs(spark, d).join(entries.select(F.col("doc_id").alias("q_doc"), F.col("label_id").alias("label"), "page"), "q_doc").select(F.col("a_doc").alias("doc_id"), "label", "page")
    return audit.strict_metrics(matches, truth, ["doc_id"])


# Contents, texts of entries, sources, the whole linkage.


def _printed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Printed pages by label, and the body's entries; of a label the smaller page counts first."""
    printed = table(spark, d, "entries").filter("printed_page is not null").select("doc_id", "id", "printed_page").distinct()
    label = ids.normalize_id(F.regexp_extract(F.coalesce("id", F.lit("")), r"([0-9]{1,4}(?:[.．][0-9]{1,4})*)", 1))
    rows = printed.select("doc_id", label.alias("label"), "printed_page", F.col("printed_page").alias("seq")).filter("label <> ''")
    body = _entries(spark, d).filter("label_id <> ''").select("doc_id", F.col("label_id").alias("label"), "id", "ordinal", "page", F.coalesce("page", F.lit(1 << 30)).alias("seq"))
    return rows, body


LOCATIONS_SQL = f"""{ENTRY_IDS}, pr AS (SELECT DISTINCT doc_id, {LABEL_ID} AS label, printed_page FROM entries WHERE printed_page IS NOT NULL AND doc_id IS NOT NULL), fp AS (SELECT doc_id, label, min(printed_page) AS printed_page FROM pr WHERE label <> '' GROUP BY ALL),
    bp AS (SELECT doc_id, label_id AS label, min(page) AS body_page FROM ei WHERE label_id <> '' GROUP BY ALL),
    vt AS (SELECT doc_id, body_page - printed_page AS shift, count(*) AS n FROM fp JOIN bp USING (doc_id, label) WHERE body_page IS NOT NULL GROUP BY ALL),
    sh AS (SELECT doc_id, shift FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS support, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, shift) AS k FROM vt) WHERE k = 1 AND support >= 3 AND n >= 0.6 * support),
    loc AS (SELECT fp.doc_id, fp.label, printed_page, printed_page + shift AS predicted, CASE WHEN printed_page + shift < 1 OR coalesce(printed_page + shift > CASE WHEN num_pages > 0 THEN num_pages END, false) THEN 'conflicted' WHEN body_page IS NULL THEN 'unseen' WHEN body_page <> printed_page + shift THEN 'conflicted' ELSE 'corroborated' END AS state
      FROM fp JOIN sh USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id, num_pages FROM docs) USING (doc_id) LEFT JOIN bp USING (doc_id, label))"""


@query("contents_locations", f"WITH {LOCATIONS_SQL} SELECT doc_id, label, printed_page, predicted, state FROM loc")
def contents_locations(spark: SparkSession, d: str) -> DataFrame:
    rows, body = _printed(spark, d)
    return structure.contents_locations(rows, body, table(spark, d, "docs"), support=3)


@query(
    "located_entries",
    f"""WITH {LOCATIONS_SQL}, b AS (SELECT doc_id, label_id AS label, id, ordinal, page FROM ei WHERE label_id <> ''), c AS (SELECT b.*, coalesce(predicted = page, false) AS confirmed FROM b LEFT JOIN loc ON loc.doc_id = b.doc_id AND loc.label = b.label AND state = 'corroborated'),
    w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, label) AS n, sum(CAST(confirmed AS BIGINT)) OVER (PARTITION BY doc_id, label) AS sure FROM c)
    SELECT doc_id, label, id, ordinal, page, confirmed FROM w WHERE n < 2 OR sure <> 1 OR confirmed""",
)
def located_entries(spark: SparkSession, d: str) -> DataFrame:
    rows, body = _printed(spark, d)
    return structure.located_entries(body.drop("seq"), structure.contents_locations(rows, body, table(spark, d, "docs"), support=3))


def _bounded_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries by label with the one that follows in book order."""
    held = _entries(spark, d).filter("label_id <> '' and page is not null").groupBy("doc_id", F.col("label_id").alias("label")).agg(F.min("page").alias("page"), F.max(F.coalesce("end_page", "page")).alias("end_page"))
    order = Window.partitionBy("doc_id").orderBy("page", ids.id_segments(F.col("label")))
    return held.withColumns({"entry": F.col("label"), "next_label": F.lead("label").over(order), "next_page": F.lead("page").over(order)})


BOUNDED_SQL = f"""{sx.LINES}, {ENTRY_IDS}, be AS (SELECT doc_id, label_id AS label, min(page) AS page, max(coalesce(end_page, page)) AS end_page FROM ei WHERE label_id <> '' AND page IS NOT NULL GROUP BY ALL),
    bn AS (SELECT *, lead(label) OVER o AS next_label, lead(page) OVER o AS next_page FROM be WINDOW o AS (PARTITION BY doc_id ORDER BY page, list_transform(string_split(label, '.'), lambda s: CAST(s AS INTEGER)))),
    hl AS (SELECT *, {sx.question_id('text')} AS heading FROM lines),
    wd AS (SELECT bn.doc_id, label, next_label, bn.page AS first_page, end_page, line_no, hl.page, text, top, bottom, heading FROM bn JOIN hl ON hl.doc_id = bn.doc_id AND hl.page BETWEEN bn.page AND CASE WHEN next_page IS NOT NULL THEN greatest(end_page, next_page) ELSE end_page END),
    st AS (SELECT *, min(line_no) FILTER (heading = label) OVER (PARTITION BY doc_id, label) AS start FROM wd),
    sp2 AS (SELECT *, min(line_no) FILTER (heading = next_label AND line_no > start) OVER (PARTITION BY doc_id, label) AS stop FROM st),
    own AS (SELECT * FROM sp2 WHERE (start IS NULL OR line_no >= start) AND (stop IS NULL OR line_no < stop)
      AND NOT coalesce(regexp_full_match({sx.trimmed("coalesce(text, '')")}, '[0-9]{{1,6}}') AND TRY_CAST({sx.trimmed("coalesce(text, '')")} AS INTEGER) BETWEEN first_page AND end_page, false))"""


@query("entry_text", f"WITH {BOUNDED_SQL} SELECT doc_id, label AS entry, {sx.trimmed("coalesce(string_agg(text, ' ' ORDER BY line_no), '')")} AS text, bool_or(start IS NOT NULL) AS scoped FROM own GROUP BY doc_id, label")
def entry_text(spark: SparkSession, d: str) -> DataFrame:
    return entrytext.entry_texts(table(spark, d, "doc_lines"), _bounded_entries(spark, d)).select("doc_id", "entry", "text", "scoped")


@query(
    "entry_spans",
    f"WITH {BOUNDED_SQL} SELECT doc_id, label AS entry, page, min(top) AS top, max(bottom) AS bottom FROM own WHERE top IS NOT NULL AND bottom IS NOT NULL GROUP BY ALL",
)
def entry_spans(spark: SparkSession, d: str) -> DataFrame:
    held = entrytext.entry_texts(table(spark, d, "doc_lines"), _bounded_entries(spark, d)).filter("spans is not null")
    return held.select("doc_id", "entry", F.explode("spans").alias("s")).select("doc_id", "entry", "s.*")


@query(
    "region_select",
    "WITH e AS (SELECT DISTINCT doc_id, id, ordinal, spans FROM entries WHERE doc_id IS NOT NULL) SELECT doc_id, id, ordinal FROM e WHERE len(list_filter(spans, lambda s: s.page = 2 AND s.bottom >= 100 AND s.top <= 300)) > 0",
)
def region_select(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "entries").filter("doc_id is not null").select("doc_id", "id", "ordinal", "spans").distinct()
    return entrytext.within_region(held, F.lit(2), F.lit(100.0), F.lit(300.0)).select("doc_id", "id", "ordinal")


@query(
    "page_text",
    f"WITH {sx.LINES} SELECT doc_id, page, string_agg(text, ' ' ORDER BY line_no) AS text, CASE WHEN trim(string_agg(text, ' ' ORDER BY line_no)) <> '' THEN 'LAYER' ELSE 'NONE' END AS origin FROM lines WHERE text IS NOT NULL AND page IS NOT NULL GROUP BY ALL",
)
def page_text(spark: SparkSession, d: str) -> DataFrame:
    held = _lines(spark, d).filter("page is not null")
    out = lines_source.layer_or_ocr(held, held.filter(F.lit(False)))
    return out.withColumn("text", F.coalesce("text", F.lit("")))


@query(
    "ocr_repair",
    f"""WITH {sx.LINES}, a AS (SELECT doc_id, line_no, translate(text, '０１２３４５６７８９（）．：；＝＋－', '0123456789().:;=+-') AS t FROM lines WHERE text IS NOT NULL),
    b AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(t, {sx.q(f'({structure.HAN}){ids.WS}+({structure.HAN})')}, '\\1\\2', 'g'), {sx.q(f'({structure.HAN}){ids.WS}+({structure.HAN})')}, '\\1\\2', 'g') AS t FROM a)
    SELECT doc_id, line_no, regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM b""",
)
def ocr_repair(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).filter("text is not null").select("doc_id", "line_no", lines_source.repaired_ocr(F.col("text")).alias("text"))


@query("glyph_coverage")
def glyph_coverage(spark: SparkSession, d: str) -> DataFrame:
    pages = _ciphered(spark, d)
    learned = glyphs.glyph_table(glyphs.votes(pages))
    return glyphs.coverage(pages.select(F.col("broken").alias("text")), learned)


@query("glyph_repair")
def glyph_repair(spark: SparkSession, d: str) -> DataFrame:
    pages = _ciphered(spark, d)
    learned = glyphs.glyph_table(glyphs.votes(pages))
    return glyphs.repaired(pages.select("doc_id", "page", F.col("broken").alias("text")), learned)


@query("linked_questions")
def linked_questions(spark: SparkSession, d: str) -> DataFrame:
    return linkage.linked(_entries(spark, d), pair_verdict(spark, d), _classified(spark, d), table(spark, d, "docs"), text_gates(spark, d))


# What is taken out of indexes and texts, identities, places.


@query(
    "contents_suppressed",
    f"""WITH {ENTRY_IDS}, tp AS (SELECT doc_id, page FROM e GROUP BY ALL HAVING count(DISTINCT label) >= 4 AND sum(CAST({sx.matches("coalesce(text, '')", tf.TOC_ROW)} AS BIGINT)) >= 0.6 * count(*))
    SELECT ei.doc_id, id, ordinal, ei.page, tp.page IS NOT NULL AS suppressed FROM ei LEFT JOIN tp ON tp.doc_id = ei.doc_id AND tp.page = ei.page""",
)
def contents_suppressed(spark: SparkSession, d: str) -> DataFrame:
    return structure.without_contents(_entries(spark, d)).select("doc_id", "id", "ordinal", "page", "suppressed")


TITLES_SQL = f"""{LEVEL_SQL}, st AS (SELECT doc_id, {sx.trimmed("coalesce(title, '')")} AS title FROM kinds WHERE kind IN ('SECTION', 'BOOK', 'QUESTION_TYPE')),
    sb AS (SELECT doc_id, title, {sx.trimmed(f"regexp_replace(title, {sx.q(f'^{ids.WS}*[0-9]+([.．][0-9]+)*{ids.WS}*')}, '')")} AS bare FROM st WHERE title <> ''),
    tf AS (SELECT DISTINCT doc_id, unnest(CASE WHEN length(bare) >= 2 THEN [title, bare] ELSE [title] END) AS form FROM sb)"""


def _title_forms(spark: SparkSession, d: str) -> DataFrame:
    return entrytext.section_title_forms(_classified(spark, d).filter(F.col("kind").isin(*outline.SECTIONS)))


@query("section_title_forms", f"WITH {TITLES_SQL} SELECT doc_id, form FROM tf")
def section_title_forms(spark: SparkSession, d: str) -> DataFrame:
    return _title_forms(spark, d)


@query(
    "cleaned_entries",
    f"""WITH {RUNNING_SQL}, {TITLES_SQL}, {ENTRY_IDS}, cp AS (SELECT doc_id, form, 0 AS kind FROM tf UNION ALL SELECT doc_id, form, 1 FROM running WHERE length(form) >= 4),
    pt AS (SELECT doc_id, list(regexp_replace(regexp_replace(form, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), {sx.q(ids.WS + '+')}, '\\\\s*', 'g') ORDER BY kind, length(form) DESC, regexp_replace(regexp_replace(form, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), {sx.q(ids.WS + '+')}, '\\\\s*', 'g')) AS patterns FROM cp GROUP BY doc_id)
    SELECT ei.doc_id, id, ordinal, {sx.trimmed(f"regexp_replace(list_reduce(list_prepend(coalesce(text, ''), coalesce(patterns, [])), lambda a, p: regexp_replace(a, p, ' ', 'g')), {sx.q(ids.WS + '+')}, ' ', 'g')")} AS text FROM ei LEFT JOIN pt ON pt.doc_id = ei.doc_id""",
)
def cleaned_entries(spark: SparkSession, d: str) -> DataFrame:
    patterns = entrytext.cleaning_patterns(_title_forms(spark, d), structure.running_forms(table(spark, d, "doc_lines")))
    rows = _entries(spark, d).join(patterns, "doc_id", "left")
    return rows.select("doc_id", "id", "ordinal", entrytext.without_patterns(F.col("text"), F.col("patterns")).alias("text"))


@query(
    "entry_identities",
    f"""WITH {ENTRY_IDS}, x AS (SELECT *, CASE WHEN label_id <> '' THEN label_id ELSE coalesce(label, '') END AS name FROM ei)
    SELECT doc_id, coalesce(source, 'null') || ':' || coalesce(CAST(ordinal AS VARCHAR), 'null') || '#' || name || '@' || coalesce(CAST(page AS VARCHAR), 'null') AS entry_id, CASE WHEN {sx.normalize_id('name')} <> '' THEN {sx.normalize_id('name')} ELSE name END AS key FROM x""",
)
def entry_identities(spark: SparkSession, d: str) -> DataFrame:
    return matching.identities(_entries(spark, d)).select("doc_id", "entry_id", "key")


@query(
    "separated_by_position",
    f"""WITH {ENTRY_IDS}, w AS ({SQL['positional_window']}), c AS (SELECT w.q_doc, w.a_doc, q.ordinal AS q_ordinal, q.label_id, a.ordinal, from_place, to_place FROM w JOIN (SELECT DISTINCT doc_id, ordinal, label_id FROM ei WHERE label_id <> '') q ON q.doc_id = w.q_doc AND q.ordinal = w.ordinal JOIN ei a ON a.doc_id = w.a_doc AND a.label_id = q.label_id)
    SELECT q_doc, a_doc, q_ordinal, label_id, max(ordinal) FILTER (ordinal BETWEEN from_place AND to_place) AS ordinal, count(*) - 1 AS alternatives FROM c GROUP BY ALL HAVING count(*) FILTER (ordinal BETWEEN from_place AND to_place) = 1""",
)
def separated_by_position(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d).filter("label_id <> ''")
    asked = entries.select(F.col("doc_id").alias("q_doc"), F.col("ordinal").alias("q_ordinal"), "label_id").distinct()
    windows = positional_window(spark, d).withColumnRenamed("ordinal", "q_ordinal")
    rows = windows.join(asked, ["q_doc", "q_ordinal"]).join(entries.select(F.col("doc_id").alias("a_doc"), "label_id", "ordinal"), ["a_doc", "label_id"])
    return matching.separated_by_position(rows, ["q_doc", "a_doc", "q_ordinal", "label_id"])


@query(
    "region_texts",
    f"""WITH {PLACED_SQL} SELECT q_doc, a_doc, page, {sx.trimmed("coalesce(title, '')")} AS section, CASE WHEN {sx.trimmed("coalesce(title, '')")} = '' THEN '' ELSE {sx.trimmed("coalesce(title, '')")} || ' · ' END || CASE WHEN from_page = to_page THEN '答案册第 ' || from_page || ' 页' ELSE '答案册第 ' || from_page || '–' || to_page || ' 页' END AS words
    FROM hit JOIN (SELECT doc_id, node_id, title FROM kinds) t ON t.doc_id = q_doc AND t.node_id = q_node WHERE k = 1""",
)
def region_texts(spark: SparkSession, d: str) -> DataFrame:
    titles = _classified(spark, d).select(F.col("doc_id").alias("q_doc"), F.col("node_id").alias("q_node"), ids.trimmed(F.coalesce("title", F.lit(""))).alias("section"))
    return region_locate(spark, d).join(titles, ["q_doc", "q_node"]).select("q_doc", "a_doc", "page", "section", matching.described_region(F.col("from_page"), F.col("to_page"), F.col("section")).alias("words"))


# Measures.

#: Where a label stands in both books of a pair, if it stands once in either.
TRUTH_SQL = f"""{ENTRY_IDS}, {sx.PAIRS}, one AS (SELECT doc_id, label_id, min(page) AS f, max(coalesce(end_page, page)) AS t FROM ei WHERE label_id <> '' GROUP BY ALL HAVING count(*) = 1),
    tr AS (SELECT q_doc, a_doc, x.label_id AS label, x.f AS q_from, x.t AS q_to, y.f AS a_from, y.t AS a_to FROM pairs JOIN one x ON x.doc_id = q_doc JOIN one y ON y.doc_id = a_doc AND y.label_id = x.label_id)"""


def _truth(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d).filter("label_id <> ''")
    once = entries.groupBy("doc_id", F.col("label_id").alias("label")).agg(F.min("page").alias("f"), F.max(F.coalesce("end_page", "page")).alias("t"), F.count("*").alias("n")).filter("n = 1")
    left, right = (once.select(F.col("doc_id").alias(f"{s}_doc"), "label", F.col("f").alias(f"{s}_from"), F.col("t").alias(f"{s}_to")) for s in ("q", "a"))
    return _pairs(spark, d).join(left, "q_doc").join(right, ["a_doc", "label"])


MATCHED_SQL = "mt AS (SELECT q_doc, a_doc, x.label_id AS label, x.page AS q_page, y.page AS a_page FROM pairs JOIN ei x ON x.doc_id = q_doc JOIN ei y ON y.doc_id = a_doc AND y.label_id = x.label_id WHERE x.label_id <> '')"


def _label_matches(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d).filter("label_id <> ''")
    left, right = (entries.select(F.col("doc_id").alias(f"{s}_doc"), F.col("label_id").alias("label"), F.col("page").alias(f"{s}_page")) for s in ("q", "a"))
    return _pairs(spark, d).join(left, "q_doc").join(right, ["a_doc", "label"])


@query(
    "regime_metrics",
    f"""WITH {TRUTH_SQL}, {MATCHED_SQL}, j AS (SELECT mt.*, coalesce(q_page BETWEEN q_from AND q_to, false) AS known, coalesce(a_page BETWEEN a_from AND a_to, false) AS there FROM mt LEFT JOIN tr USING (q_doc, a_doc, label)),
    c AS (SELECT q_doc, a_doc, count(*) AS accepted, count(*) FILTER (known AND there) AS confirmed, count(*) FILTER (known AND NOT there) AS wrong_page, count(*) FILTER (NOT known) AS unidentifiable, count(DISTINCT CASE WHEN known AND there THEN label END) AS "distinct" FROM j GROUP BY ALL),
    g AS (SELECT q_doc, a_doc, count(DISTINCT label) AS gold FROM tr GROUP BY ALL), f AS (SELECT coalesce(c.q_doc, g.q_doc) AS q_doc, coalesce(c.a_doc, g.a_doc) AS a_doc, coalesce(accepted, 0) AS accepted, coalesce(confirmed, 0) AS confirmed, coalesce(wrong_page, 0) AS wrong_page, coalesce(unidentifiable, 0) AS unidentifiable, coalesce("distinct", 0) AS "distinct", coalesce(gold, 0) AS gold FROM c FULL JOIN g ON c.q_doc = g.q_doc AND c.a_doc = g.a_doc)
    SELECT *, round(CASE WHEN accepted > 0 THEN confirmed / accepted END, 6) AS strict, round(CASE WHEN gold > 0 THEN "distinct" / gold END, 6) AS recall FROM f""",
)
def regime_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.regime_metrics(_label_matches(spark, d), _truth(spark, d), ["q_doc", "a_doc"])
    return out.withColumns({c: F.round(c, 6) for c in ("strict", "recall")})


@query(
    "slow_share",
    """WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
    SELECT user_id, n, max(CASE WHEN k = CAST(floor(n * 0.95) AS BIGINT) THEN value END) AS p95, max(value) AS most FROM v GROUP BY user_id, n""",
)
def slow_share(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.slow_share(table(spark, d, "events"), ["user_id"], "value")


@query(
    "located_metrics",
    f"""WITH {TRUTH_SQL}, {MATCHED_SQL}, hits AS (SELECT q_doc, a_doc, label, q_page, list(a_page) AS a_pages, count(*) AS n FROM mt GROUP BY ALL),
    qs AS (SELECT DISTINCT q_doc, a_doc, label_id AS label, page AS q_page FROM pairs JOIN ei ON doc_id = q_doc WHERE label_id <> ''),
    rs AS (SELECT qs.*, coalesce(a_pages, []) AS a_pages, CASE WHEN n = 1 THEN 'AUTO_MATCH' WHEN n <= 5 THEN 'REVIEW' WHEN qs.q_page % 2 = 0 THEN 'LOCATED' ELSE 'REFUSED' END AS rung, qs.q_page - 1 AS from_page, qs.q_page + 1 AS to_page FROM qs LEFT JOIN hits ON hits.q_doc = qs.q_doc AND hits.a_doc = qs.a_doc AND hits.label = qs.label AND hits.q_page IS NOT DISTINCT FROM qs.q_page),
    rc AS (SELECT DISTINCT q_doc, a_doc, tr.label, true AS reachable FROM tr JOIN ei ON doc_id = a_doc AND page <= a_to AND coalesce(end_page, page) >= a_from),
    j AS (SELECT rs.*, a_from, coalesce(q_page BETWEEN q_from AND q_to, false) AS known, len(list_filter(a_pages, lambda p: p BETWEEN a_from AND a_to)) > 0 AS hit, coalesce(a_from BETWEEN from_page AND to_page, false) AS there, coalesce(reachable, false) AS reachable FROM rs LEFT JOIN tr USING (q_doc, a_doc, label) LEFT JOIN rc USING (q_doc, a_doc, label))
    SELECT q_doc, a_doc, count(*) FILTER (known AND rung = 'AUTO_MATCH') AS auto, count(*) FILTER (known AND rung = 'AUTO_MATCH' AND hit) AS auto_correct, count(*) FILTER (known AND rung = 'REVIEW') AS review, count(*) FILTER (known AND rung = 'REVIEW' AND hit) AS review_hit, count(*) FILTER (known AND rung = 'LOCATED') AS located, count(*) FILTER (known AND rung = 'LOCATED' AND there) AS located_correct,
      count(*) FILTER (known AND rung = 'REFUSED') AS refused, count(*) FILTER (known AND rung = 'REFUSED' AND reachable) AS recoverable, count(*) FILTER (known AND rung = 'REFUSED' AND NOT reachable) AS irreducible, count(*) FILTER (NOT known) AS unidentifiable FROM j GROUP BY ALL""",
)
def located_metrics(spark: SparkSession, d: str) -> DataFrame:
    key = ["q_doc", "a_doc", "label", "q_page"]
    entries = _entries(spark, d)
    asked = _pairs(spark, d).join(entries.filter("label_id <> ''").select(F.col("doc_id").alias("q_doc"), F.col("label_id").alias("label"), F.col("page").alias("q_page")), "q_doc").select(*key).distinct()
    hits = _label_matches(spark, d).groupBy(*key).agg(F.collect_list("a_page").alias("a_pages"), F.count("*").alias("n")).withColumnsRenamed({c: f"h_{c}" for c in key})
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"h_{c}"))
    rung = F.when(F.col("n") == 1, "AUTO_MATCH").when(F.col("n") <= 5, "REVIEW").when(F.col("q_page") % 2 == 0, "LOCATED").otherwise("REFUSED")
    rows = asked.join(hits, same, "left").select(*key, F.coalesce("a_pages", F.array().cast("array<int>")).alias("a_pages"), rung.alias("rung"), (F.col("q_page") - 1).alias("from_page"), (F.col("q_page") + 1).alias("to_page"))
    answers = _pairs(spark, d).join(entries.select(F.col("doc_id").alias("a_doc"), "page", "end_page"), "a_doc")
    return evaluate.located_metrics(rows, _truth(spark, d), answers, ["q_doc", "a_doc"])


@query("outline_truncated", "SELECT doc_id, node_id, depth, CASE WHEN depth = 1 THEN 0 ELSE child_count END AS child_count FROM (SELECT DISTINCT doc_id, node_id, depth, title, page, end_page, child_count FROM outline) WHERE depth < 2")
def outline_truncated(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.truncated(table(spark, d, "outline").select("doc_id", "node_id", "depth", "title", "page", "end_page", "child_count").distinct()).select("doc_id", "node_id", "depth", "child_count")


@query(
    "page_only",
    f"""WITH {PLACED_SQL}, {TRUTH_SQL.replace(sx.PAIRS + ', ', '').replace('FROM pairs', 'FROM op')}, qp AS (SELECT DISTINCT q_doc, a_doc, label_id AS label, page FROM op JOIN ei ON doc_id = q_doc WHERE label_id <> '' AND page IS NOT NULL),
    rg1 AS (SELECT q_doc, a_doc, page, from_page, to_page FROM hit WHERE k = 1), p AS (SELECT q_doc, a_doc, count(*) AS pages, count(from_page) AS with_region FROM (SELECT DISTINCT q_doc, a_doc, page FROM qp) LEFT JOIN rg1 USING (q_doc, a_doc, page) GROUP BY ALL),
    c AS (SELECT q_doc, a_doc, count(*) AS covered, count(*) FILTER (a_from BETWEEN from_page AND to_page) AS correct, count(DISTINCT CASE WHEN a_from BETWEEN from_page AND to_page THEN label END) AS "distinct" FROM qp JOIN rg1 USING (q_doc, a_doc, page) JOIN tr USING (q_doc, a_doc, label) GROUP BY ALL)
    SELECT p.q_doc, p.a_doc, pages, with_region, coalesce(covered, 0) AS covered, coalesce(correct, 0) AS correct, coalesce("distinct", 0) AS "distinct" FROM p LEFT JOIN c ON c.q_doc = p.q_doc AND c.a_doc = p.a_doc""",
)
def page_only(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d).filter("label_id <> ''")
    books = _outline_pairs(spark, d)
    asked = books.join(entries.filter("page is not null").select(F.col("doc_id").alias("q_doc"), F.col("label_id").alias("label"), "page"), "q_doc").distinct()
    once = entries.groupBy("doc_id", F.col("label_id").alias("label")).agg(F.min("page").alias("f"), F.count("*").alias("n")).filter("n = 1")
    both = books.join(once.select(F.col("doc_id").alias("q_doc"), "label"), "q_doc").join(once.select(F.col("doc_id").alias("a_doc"), "label", F.col("f").alias("a_from")), ["a_doc", "label"])
    return evaluate.page_only(region_locate(spark, d).select("q_doc", "a_doc", "page", "from_page", "to_page"), asked, both, ["q_doc", "a_doc"])


@query(
    "corpus_summary",
    f"""WITH {sx.LINES}, o AS (SELECT DISTINCT doc_id, node_id, title, page FROM outline), r AS (SELECT doc_id, count(*) AS lines, sum(length(coalesce(text, ''))) AS chars, sum({sx.count("coalesce(text, '')", evaluate.HAN)}) AS han FROM (SELECT DISTINCT doc_id, line_no, text FROM lines) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS outline, count(*) FILTER ({sx.matches("coalesce(title, '')", evaluate.EXAMPLE_TITLE)}) AS examples, count(*) FILTER (page IS NULL) AS unresolved FROM o GROUP BY doc_id), b AS (SELECT doc_id, max(num_pages) AS pages FROM docs GROUP BY doc_id)
    SELECT b.doc_id, pages, coalesce(lines, 0) AS lines, CAST(coalesce(chars, 0) AS BIGINT) AS chars, CASE WHEN coalesce(chars, 0) > 0 THEN round(100 * han / chars, 2) ELSE 0.0 END AS han_percent, coalesce(outline, 0) AS outline, coalesce(examples, 0) AS examples, coalesce(unresolved, 0) AS unresolved FROM b LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.corpus_summary(table(spark, d, "doc_lines"), table(spark, d, "outline"), table(spark, d, "docs"))


@query(
    "break_examples",
    """WITH r AS (SELECT user_id, event_type, dense_rank() OVER (ORDER BY event_type) AS rk, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    b AS (SELECT user_id, k, lag(rk) OVER (PARTITION BY user_id ORDER BY k) AS last, rk AS rank FROM r)
    SELECT user_id, k, last, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS place FROM b WHERE rank < last) WHERE place <= 5""",
)
def break_examples(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    kinds = events.select("event_type").distinct().withColumn("rk", F.dense_rank().over(Window.orderBy("event_type")))
    return audit.break_examples(events.join(kinds, "event_type"), ["user_id"], ["ts", "event_id"], "rk").select("user_id", "k", "last", "rank")


@query("glyph_evidence")
def glyph_evidence(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.evidence(glyphs.votes(_ciphered(spark, d)))


@query("glyph_progress")
def glyph_progress(spark: SparkSession, d: str) -> DataFrame:
    counted = glyphs.votes(_ciphered(spark, d))
    return glyphs.progress(counted, glyphs.glyph_table(counted))


@query("glyph_share")
def glyph_share(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.coverage_share(glyph_coverage(spark, d))


# Streams, each drained over what is there and held against the same rows read at once.


@query(
    "stream_labels",
    f"""SELECT doc_id, CAST(floor(epoch(read_at) / 600) * 600 AS BIGINT) AS start, count(*) AS n FROM (SELECT DISTINCT doc_id, line_no, text, read_at FROM doc_lines WHERE read_at IS NOT NULL) WHERE {sx.is_question_line('text')} GROUP BY ALL""",
)
def stream_labels(spark: SparkSession, d: str) -> DataFrame:
    lines = glyph_stream.lines_stream(spark, f"{d}/doc_lines.parquet").filter("doc_id is not null and line_no is not null and read_at is not null")
    rows = glyph_stream.drained(glyph_stream.labelled_lines(lines))
    return rows.groupBy("doc_id", F.window("read_at", "10 minutes").alias("w")).agg(F.count("*").alias("n")).select("doc_id", F.unix_timestamp("w.start").alias("start"), "n")


# Layers and caches.


@query(
    "layer_or_ocr",
    f"""WITH {sx.LINES}, l AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY line_no) AS own FROM lines WHERE text IS NOT NULL AND page % 3 <> 0 GROUP BY ALL), o AS (SELECT doc_id, page, string_agg('# ' || text, ' ' ORDER BY line_no) AS read FROM lines WHERE text IS NOT NULL AND page % 2 = 0 GROUP BY ALL),
    b AS (SELECT coalesce(l.doc_id, o.doc_id) AS doc_id, coalesce(l.page, o.page) AS page, own, read, trim(coalesce(own, '')) <> '' AS has FROM l FULL JOIN o ON l.doc_id = o.doc_id AND l.page = o.page)
    SELECT doc_id, page, CASE WHEN has THEN own ELSE read END AS text, CASE WHEN has THEN 'LAYER' WHEN read IS NOT NULL THEN 'OCR' ELSE 'NONE' END AS origin FROM b""",
)
def layer_or_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Pages of which two thirds have a text layer and the even ones OCR, marked by a sign."""
    held = _lines(spark, d).filter("page is not null")
    return lines_source.layer_or_ocr(held.filter("page % 3 <> 0"), held.filter("page % 2 = 0").withColumn("text", F.concat(F.lit("# "), "text")))


@query(
    "cache_figures",
    f"""WITH {sx.LINES}, b AS (SELECT doc_id, greatest(coalesce(max(num_pages), 0), 0) AS pages FROM docs GROUP BY doc_id), h AS (SELECT *, length(coalesce(text, '')) AS chars FROM lines),
    p AS (SELECT h.doc_id, page, CAST(sum(chars) AS BIGINT) AS chars FROM h JOIN b ON b.doc_id = h.doc_id WHERE page BETWEEN 1 AND pages GROUP BY ALL),
    s AS (SELECT doc_id, list_sort(list(chars)) AS x, count(*) FILTER (chars > 0) AS pages_with_text, count(*) FILTER (chars > 0 AND chars < 20) AS thin FROM p GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS lines FROM h GROUP BY doc_id),
    k AS (SELECT doc_id, line_no // 256 AS block, sha256(string_agg(line_no || chr(9) || coalesce(text, ''), chr(10) ORDER BY line_no, coalesce(text, ''))) AS d FROM h GROUP BY ALL), d AS (SELECT doc_id, sha256(string_agg(d, '' ORDER BY block)) AS checksum FROM k GROUP BY doc_id),
    f AS (SELECT b.doc_id, pages, coalesce(lines, 0) AS lines, coalesce(pages_with_text, 0) AS pages_with_text, CASE WHEN pages > 0 THEN round(coalesce(pages_with_text, 0) / pages, 4) ELSE 0.0 END AS coverage, coalesce(x[len(x) // 2 + 1], 0) AS median, coalesce(thin, 0) AS thin, checksum FROM b LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)),
    g AS (SELECT *, list_filter([CASE WHEN pages_with_text < pages THEN 'EMPTY_PAGES' END, CASE WHEN lines = 0 THEN 'NO_LINES' END, CASE WHEN median < 40 THEN 'LOW_MEDIAN' END], lambda p: p IS NOT NULL) AS found FROM f)
    SELECT doc_id, pages, lines, pages_with_text, coverage, median, thin, checksum, array_to_string(found, ',') AS problems, len(found) = 0 AS complete FROM g""",
)
def cache_figures(spark: SparkSession, d: str) -> DataFrame:
    return lines_source.cache_figures(table(spark, d, "doc_lines"), table(spark, d, "docs"))
