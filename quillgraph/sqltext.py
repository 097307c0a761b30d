"""SQL spellings of the column functions, for the queries' reference SQL."""

from __future__ import annotations

from quillgraph.functions import ids, textfeat


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{ids.WS}+|{ids.WS}+$')}, '', 'g')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def part(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def normalize_id(x: str) -> str:
    t = trimmed(f"coalesce({x}, '')")
    return (
        f"CASE WHEN regexp_full_match({t}, '[0-9]{{1,4}}([.．][0-9]{{1,4}})*') "
        f"THEN array_to_string(list_transform(string_split_regex({t}, '[.．]'), lambda s: CAST(TRY_CAST(s AS INTEGER) AS VARCHAR)), '.') ELSE '' END"
    )


def is_question_line(x: str) -> str:
    t = f"coalesce({x}, '')"
    deep = f"({matches(t, ids.FLAT)} AND NOT {matches(t, ids.FLAT_IS_DEEP)})"
    return f"({matches(t, ids.NUMBERED)} OR {matches(t, ids.EXAMPLE)} OR {matches(t, ids.DEEP)} OR {deep})"


def _which(x: str, pick) -> str:
    t = f"coalesce({x}, '')"
    return (
        f"CASE WHEN {matches(t, ids.NUMBERED)} THEN {pick(t, ids.NUMBERED, ids.MARK_BY_WORD)} "
        f"WHEN {matches(t, ids.EXAMPLE)} THEN {pick(t, ids.EXAMPLE, ids.MARK_BY_WORD)} "
        f"WHEN {matches(t, ids.DEEP)} THEN {pick(t, ids.DEEP, ids.MARK_BY_NUMBER)} "
        f"WHEN {matches(t, ids.FLAT)} AND NOT {matches(t, ids.FLAT_IS_DEEP)} THEN {pick(t, ids.FLAT, ids.MARK_BY_NUMBER)} END"
    )


def question_id(x: str) -> str:
    return _which(x, lambda t, p, _: normalize_id(part(t, p, 2)))


def question_body(x: str) -> str:
    return _which(x, lambda t, p, mark: trimmed(f"regexp_replace(substr({t}, length({part(t, p, 1)}) + 1), {q(mark)}, '')"))


def sub_id(x: str) -> str:
    t = f"coalesce({x}, '')"
    return f"CASE WHEN {matches(t, ids.SUB)} THEN CAST(TRY_CAST({part(t, ids.SUB, 2)} AS INTEGER) AS VARCHAR) END"


def title_id(x: str) -> str:
    t = trimmed(f"coalesce({x}, '')")
    whens = " ".join(f"WHEN {matches(t, p)} THEN {normalize_id(part(t, p, 1))}" for p in (ids.MARKED_TITLE, ids.NUMBERED_TITLE, ids.LEADING_TITLE))
    return f"CASE {whens} ELSE '' END"


def normalize_for_match(x: str) -> str:
    low = f"regexp_replace(lower(coalesce({x}, '')), {q(textfeat.SPACING)}, '', 'g')"
    low = f"translate({low}, '（）［【］】｛｝－−–—＝', '()[[]]{{}}----=')"
    return f"regexp_replace({low}, {q(f'{textfeat.SENTENCE}|{ids.WS}+')}, '', 'g')"


def fragments(norm: str) -> str:
    return f"regexp_extract_all({norm}, {q(f'({textfeat.MATH}{{2,}})')}, 1)"


def bigrams(norm: str) -> str:
    return f"list_transform(range(1, greatest(length({norm}), 1)), lambda k: substr({norm}, k, 2))"


def boilerplate_form(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {q(f'[0-9]+|{ids.WS}+')}, '', 'g')"


def carries_label(x: str) -> str:
    return f"({is_question_line(x)} OR {matches(f'''coalesce({x}, '')''', ids.SUB)})"


def _without_first(x: str, pattern: str) -> str:
    flags = "(?is)" if pattern.startswith("(?i)") else "(?s)"
    return f"regexp_replace({x}, {q(flags + chr(92) + 'A(.*?)(?:' + pattern.removeprefix('(?i)') + ')')}, '\\1 ')"


def descriptive_length(x: str) -> str:
    t = f"coalesce({x}, '')"
    for pattern in (textfeat.QUESTION_MARK, textfeat.TYPE_MARK, textfeat.SECTION_MARK):
        t = _without_first(t, pattern)
    t = f"regexp_replace({t}, '[0-9]{{1,4}}([.．][0-9]{{1,4}})*', ' ', 'g')"
    return count(t, r"[\p{Han}\p{L}]")


def extract_answer(x: str) -> str:
    raw = trimmed(f"coalesce({x}, '')")
    inside = part(raw, "(?is)^.*?" + ids.ANSWER_INSIDE.removeprefix("(?i)") + "(.*)$", 1)
    first = f"regexp_replace({raw}, {q(ids.ANSWER_FIRST)}, '')"
    body = trimmed(f"CASE WHEN {matches(raw, ids.ANSWER_FIRST)} THEN {first} WHEN {matches(raw, ids.ANSWER_INSIDE)} THEN {inside} ELSE {raw} END")
    cut = f"regexp_extract(b, {q(f'(?s)^(.+?)(?:{ids.ANSWER_ENDS})')}, 1)"
    stop = f"CASE WHEN {matches('b', f'^(?:{ids.ANSWER_ENDS})')} OR NOT {matches('b', ids.ANSWER_ENDS)} THEN b ELSE {cut} END"
    return f"(SELECT {trimmed(stop)} FROM (SELECT {body} AS b))"


#: Lines of the books, repeated rows once.
LINES = "lines AS (SELECT DISTINCT doc_id, line_no, page, text, top, bottom FROM doc_lines WHERE doc_id IS NOT NULL AND line_no IS NOT NULL)"
ENTRIES = "e AS (SELECT DISTINCT doc_id, id, label, ordinal, page, end_page, text, scoped_text, answer, source, structural FROM entries WHERE doc_id IS NOT NULL)"
#: Each book with the next one, as exercise and answer.
PAIRS = "pairs AS (SELECT * FROM (SELECT doc_id AS q_doc, lead(doc_id) OVER (ORDER BY doc_id) AS a_doc FROM docs) WHERE a_doc IS NOT NULL)"
