"""Queries of the text operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import canonical, leakage, line_repeats, mojibake, pii, scan_repair, tokens
from quillgraph.runtime import table

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


REPEATED = r"""
    WITH l AS (
      SELECT doc_id, source, CAST(k AS INTEGER) AS line_no, parts[k] AS line,
             lower(regexp_replace(parts[k], '[0-9\s\v\x1c-\x1f\x{85}\p{Z}]+', '', 'g')) AS key
      FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
    t AS (SELECT source, count(*) AS docs FROM documents WHERE source IS NOT NULL GROUP BY source),
    c AS (SELECT l.source, key FROM l JOIN t ON l.source = t.source WHERE key <> '' GROUP BY l.source, key, docs
          HAVING count(DISTINCT doc_id) >= 5 AND 10 * count(DISTINCT doc_id) >= docs)
"""


@query("p2_found", REPEATED + "SELECT l.doc_id, l.line_no FROM l JOIN c ON l.source = c.source AND l.key = c.key")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return line_repeats.repeated_lines(table(spark, d, "documents")).select("doc_id", "line_no")


@query(
    "p2_clean",
    REPEATED
    + """, kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM l LEFT JOIN c ON l.source = c.source AND l.key = c.key WHERE c.key IS NULL GROUP BY l.doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
)
def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return line_repeats.without_repeated_lines(table(spark, d, "documents"))


@query(
    "p8_found",
    r"""
    WITH i AS (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS t FROM benchmark),
    g AS (SELECT DISTINCT item_id, substr(t, k, 40) AS gram FROM (SELECT item_id, t, unnest(range(1, len(t) - 38)) AS k FROM i)),
    d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS t FROM documents),
    h AS (SELECT doc_id, substr(t, k, 40) AS gram FROM (SELECT doc_id, t, unnest(range(1, len(t) - 38)) AS k FROM d))
    SELECT DISTINCT doc_id, item_id FROM h JOIN g ON h.gram = g.gram
    """,
)
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.lookalikes(table(spark, d, "documents"), ["text", "title"])


@query("p6_classes")
def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.lookalike_classes(table(spark, d, "documents"), ["text", "title"])


@query("p6_canonical")
def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_texts(table(spark, d, "documents"), "doc_id", ["text", "title"])


@query("p7_method")
def p7_method(spark: SparkSession, d: str) -> DataFrame:
    return tokens.folded_words(table(spark, d, "documents"))


@query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


@query("p7_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decoded(tokens.token_ids(table(spark, d, "documents")))


@query("p5_method")
def p5_method(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_runs(table(spark, d, "documents"))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired_texts(table(spark, d, "documents")).filter("garbled").select("doc_id").distinct()


@query("p5_restored")
def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired_texts(table(spark, d, "documents")).select("doc_id", "text")


@query("p9_method")
def p9_method(spark: SparkSession, d: str) -> DataFrame:
    return pii.accepted_mentions(table(spark, d, "documents"))


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(table(spark, d, "documents"))


@query("p9_redacted")
def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"))


@query("p3_method")
def p3_method(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.scan_repairs(table(spark, d, "doc_lines"))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.scan_faults(table(spark, d, "doc_lines"))


@query("p3_paragraphs")
def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.paragraphs(table(spark, d, "doc_lines"))
