"""Normalised text and the features that are compared: bigrams, formulas, operator contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.ids import WS, is_question_line, sub_question_line, trimmed

# Character classes of mathematical text.
MATH = r"[0-9a-zA-Z+\-*/=^_(){}\[\]<>|.,\\∫∑∏√±×÷≤≥≠∞πθαβγλμσ]"
SKELETON = r"+\-*/=^_<>|∫∑∏√±×÷≤≥≠"
RADIUS = 3
PAD = "·"
# Spellings that count as one.
SPACING = r"\\(left|right|,|;|:|!|quad|qquad)"
SENTENCE = r"""[，,。.、；;：:？?！!"'“”‘’]"""
# Words of titles.
QUESTION_MARK = rf"(?i)(例题|习题|练习题|例{WS}*[0-9]|第{WS}*[0-9]{{1,4}}{WS}*题|Example|Exercise|Problem)"
LINE_MARK = rf"(?i)(例{WS}*题|习{WS}*题|练习题|第{WS}*[0-9]{{1,4}}{WS}*题|Example|Exercise|Problem)"
SECTION_MARK = rf"(?i)(^第{WS}*[0-9一二三四五六七八九十百]+{WS}*[章节部编篇]|^Chapter|^Part|^Section|索引|目{WS}*录|Contents|Index)"
TYPE_MARK = r"(计算题|证明题|填空题|选择题|解答题|应用题|综合题)"
#: The mark of a question's part, where no letter or digit stands before it.
PART_MARK = rf"(^|[^0-9A-Za-z一-鿿])[(（]{WS}*[0-9]{{1,2}}{WS}*[)）]"
# Rows and headings of a table of contents.
TOC_ROW = rf"[.．·・‧∙•](?:{WS}*[.．·・‧∙•]){{2,}}{WS}*([0-9]{{1,4}}){WS}*$"
TOC_HEADING = rf"^{WS}*(目{WS}*录|索{WS}*引|题号索引|Contents|Index){WS}*$"


def normalize_for_match(text: Column) -> Column:
    """Lower case, one spelling of brackets, dashes and equals signs, without sentence punctuation and white space."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACING, "")
    low = F.translate(low, "（）［【］】｛｝－−–—＝", "()[[]]{}----=")
    return F.regexp_replace(low, rf"{SENTENCE}|{WS}+", "")


def bigrams(norm: Column) -> Column:
    """All pairs of neighbouring characters, repeated ones as often as they stand."""
    return F.regexp_extract_all(norm, F.lit("(?s)(?=(..))"), 1)


def math_fragments(norm: Column) -> Column:
    """Runs of at least two mathematical characters of a normalised text."""
    return F.regexp_extract_all(norm, F.lit(f"({MATH}{{2,}})"), 1)


def symbol_contexts(norm: Column, radius: int = RADIUS) -> Column:
    """Each operator with radius characters on either side, padded where the text ends."""
    padded = F.concat(F.lit(PAD * radius), norm, F.lit(PAD * radius))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{radius}}}[{SKELETON}()].{{{radius}}}))"), 1)


def skeleton(fragment: Column) -> Column:
    """The operators of a fragment alone."""
    return F.regexp_replace(fragment, f"[^{SKELETON}]", "")


def operands(fragment: Column) -> Column:
    return F.filter(F.transform(F.split(fragment, f"[{SKELETON}]"), trimmed), lambda s: s != "")


def formula_fragments(text: Column) -> Column:
    """Fragments of at least three characters with an operator, without the marks of question parts."""
    found = F.filter(math_fragments(normalize_for_match(text)), lambda f: F.length(f) >= 3)
    bare = F.transform(found, lambda f: F.regexp_replace(f, PART_MARK, "$1"))
    return F.filter(bare, lambda f: (F.length(f) >= 3) & (skeleton(f) != ""))


def brackets_balance(text: Column) -> Column:
    raw = F.coalesce(text, F.lit(""))
    return F.regexp_count(raw, F.lit(r"[(\[{]")) == F.regexp_count(raw, F.lit(r"[)\]}]"))


def without_first(text: Column, pattern: str) -> Column:
    """text with the first match of pattern as a blank."""
    flags = "(?is)" if pattern.startswith("(?i)") else "(?s)"
    return F.regexp_replace(text, f"{flags}\\A(.*?)(?:{pattern.removeprefix('(?i)')})", "$1 ")


def descriptive_length(title: Column) -> Column:
    """Letters and Chinese characters of a title beside its marks and numbers."""
    text = F.coalesce(title, F.lit(""))
    for pattern in (QUESTION_MARK, TYPE_MARK, SECTION_MARK):
        text = without_first(text, pattern)
    text = F.regexp_replace(text, r"[0-9]{1,4}(?:[.．][0-9]{1,4})*", " ")
    return F.regexp_count(text, F.lit(r"[\p{IsHan}\p{L}]"))


def boilerplate_form(text: Column) -> Column:
    """A line without digits and white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[0-9]+|{WS}+", "")


def carries_label(text: Column) -> Column:
    return is_question_line(text) | sub_question_line(text).isNotNull()


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a digest of the characters, as 8 hex digits."""
    codes = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(4294967296)))
    return F.lpad(F.lower(F.hex(step)), 8, "0")


# Similarity.


#: How formulas weigh against prose, and operator contexts against fragments.
MATH_WEIGHT = 0.75
SYMBOL_SHARE = 0.6
LEAST_CONTEXTS = 2
