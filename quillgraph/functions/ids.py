"""Identifiers of questions: parsing, canonical form, order.

All functions take and give columns. The patterns use no look-around, so that the
same text serves in any RE2 engine too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every kind, as a character class of both engines.
WS = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
ID = r"[0-9]{1,4}(?:[.．][0-9]{1,4})*"
DEEP_ID = r"[0-9]{1,4}(?:[.．][0-9]{1,4})+"

# The forms in which a question's number opens a line, tried in this order.
NUMBERED = rf"^({WS}*第{WS}*({ID}){WS}*题){WS}*[.．、:：]?{WS}*"
EXAMPLE = rf"^({WS}*例{WS}*题{WS}*({ID})){WS}*[.．、:：]?{WS}*"
DEEP = rf"^({WS}*({DEEP_ID}))(?:[^0-9]|$)"
FLAT = rf"^({WS}*([0-9]{{1,4}})){WS}*[.．、)）:：]"
FLAT_IS_DEEP = rf"^{WS}*[0-9]{{1,4}}[.．][0-9]"
MARK_BY_WORD = rf"^{WS}*[.．、:：]?{WS}*"
MARK_BY_NUMBER = rf"^{WS}*[.．、)）:：]?{WS}*"
SUB = rf"^({WS}*[(（]{WS}*([0-9]{{1,3}}){WS}*[)）]){WS}*[.．、:：]?{WS}*"
# Words of a title that mark its number as a question's.
MARKED_TITLE = rf"(?i)(?:例{WS}*题|习{WS}*题|练习题|例|Example|Exercise|Problem){WS}*({ID})(?:[^0-9]|$)"
NUMBERED_TITLE = rf"第{WS}*({ID}){WS}*题"
LEADING_TITLE = rf"^{WS}*({ID})(?:[^0-9]|$)"
# What introduces an answer.
ANSWER_FIRST = rf"(?i)^{WS}*(?:答案{WS}*[:：.．、]?{WS}*|(?:答|解|Answer|Ans)(?:{WS}*[:：.．、]{WS}*|{WS}+))"
ANSWER_INSIDE = rf"(?i)(?:答案|答|解|Answer|Ans){WS}*[:：]{WS}*"
ANSWER_ENDS = rf"[。；;]|{WS}{{2,}}"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def normalize_id(raw: Column) -> Column:
    """Canonical form: each segment without leading zeros; '' if raw is no identifier or null."""
    text = trimmed(F.coalesce(raw, F.lit("")))
    plain = F.array_join(F.transform(F.split(text, "[.．]"), lambda s: s.cast("int").cast("string")), ".")
    return F.when(text.rlike(r"^[0-9]{1,4}(?:[.．][0-9]{1,4})*$"), plain).otherwise("")


def id_segments(raw: Column) -> Column:
    """The segments as numbers, whose array order is the book's order; empty if raw is no identifier."""
    plain = normalize_id(raw)
    none = F.array().cast("array<int>")
    return F.when(plain == "", none).otherwise(F.transform(F.split(plain, r"\."), lambda s: s.cast("int")))


def same_question(a: Column, b: Column) -> Column:
    return (normalize_id(a) == normalize_id(b)) & (normalize_id(a) != "")


def question_key(raw: Column, sub: Column) -> Column:
    plain = normalize_id(raw)
    number = F.regexp_extract(F.coalesce(sub, F.lit("")), rf"^{WS}*([0-9]+)", 1)
    return F.when(plain == "", "").when(number == "", plain).otherwise(F.concat(plain, F.lit("("), number.cast("int").cast("string"), F.lit(")")))


def question_line(line: Column) -> Column:
    """STRUCT<id, body> of a line that opens a question, else null."""
    text = F.coalesce(line, F.lit(""))

    def parsed(pattern: str, mark: str) -> Column:
        head = F.regexp_extract(text, pattern, 1)
        rest = F.substring(text, F.length(head) + 1, F.length(text))
        return F.struct(normalize_id(F.regexp_extract(text, pattern, 2)).alias("id"), trimmed(F.regexp_replace(rest, mark, "")).alias("body"))

    return (
        F.when(text.rlike(NUMBERED), parsed(NUMBERED, MARK_BY_WORD))
        .when(text.rlike(EXAMPLE), parsed(EXAMPLE, MARK_BY_WORD))
        .when(text.rlike(DEEP), parsed(DEEP, MARK_BY_NUMBER))
        .when(text.rlike(FLAT) & ~text.rlike(FLAT_IS_DEEP), parsed(FLAT, MARK_BY_NUMBER))
    )


def is_question_line(line: Column) -> Column:
    text = F.coalesce(line, F.lit(""))
    return text.rlike(NUMBERED) | text.rlike(EXAMPLE) | text.rlike(DEEP) | (text.rlike(FLAT) & ~text.rlike(FLAT_IS_DEEP))


def sub_question_line(line: Column) -> Column:
    """STRUCT<sub, body> of a line that opens a part of a question, else null."""
    text = F.coalesce(line, F.lit(""))
    head = F.regexp_extract(text, SUB, 1)
    body = trimmed(F.regexp_replace(F.substring(text, F.length(head) + 1, F.length(text)), MARK_BY_WORD, ""))
    return F.when(text.rlike(SUB), F.struct(F.regexp_extract(text, SUB, 2).cast("int").cast("string").alias("sub"), body.alias("body")))


def title_id(title: Column) -> Column:
    """The identifier of an outline title: after a question word anywhere, else leading; '' if there is none."""
    text = trimmed(F.coalesce(title, F.lit("")))
    return F.coalesce(
        *[F.when(text.rlike(p), normalize_id(F.regexp_extract(text, p, 1))) for p in (MARKED_TITLE, NUMBERED_TITLE, LEADING_TITLE)], F.lit("")
    )


def extract_answer(text: Column) -> Column:
    """The answer that a text states: after its introduction, up to the end of the sentence."""
    raw = trimmed(F.coalesce(text, F.lit("")))
    inside = F.regexp_extract(raw, rf"(?s)^.*?{ANSWER_INSIDE.removeprefix('(?i)')}(.*)$".replace("(?s)", "(?is)"), 1)
    body = F.when(raw.rlike(ANSWER_FIRST), F.regexp_replace(raw, ANSWER_FIRST, "")).when(raw.rlike(ANSWER_INSIDE), inside).otherwise(raw)
    body = trimmed(body)
    first = F.regexp_extract(body, rf"(?s)^(.+?)(?:{ANSWER_ENDS})", 1)
    return trimmed(F.when(body.rlike(rf"^(?:{ANSWER_ENDS})") | ~body.rlike(ANSWER_ENDS), body).otherwise(first))
