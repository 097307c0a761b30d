"""One consistent form of visually identical text.

Method: each character has a quick-check property; it is stable if the canonical
form of every text keeps it as it stands. A scan finds the unstable segments, each
with the one character before it as boundary context (a mark may compose with it);
only those are normalised, and the results are spliced into the unchanged rest.

The canonical form: full-width and other width forms become ordinary ones, blanks
of every kind one plain blank each, line ends one line feed, characters without a
visible mark go, letters of other scripts that look like Latin ones become those,
presentation forms (ligatures, radicals, compatibility ideographs) become the plain
characters, base and mark become one composed character. Letter case, accents,
raised and circled characters stay.

Defined cases: null stays null, the empty text stays empty; a value without a
visible character has no look-alikes; repeated rows are documents of their own
only if their doc_id differs; other columns are never read.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.textio import code_points, mapped
from quillgraph.runtime import broadcast_if_small, checkpoint

# Letters of other scripts and the Latin ones they look like.
LOOKALIKES = {
    "Cyrillic capitals": ("АВЕЅІЈКМНОРСТХѴҮԌԚԜ", "ABESIJKMHOPCTXVYGQW"),
    "Cyrillic small": ("аеѕіјорсухѵүһԁԛԝ", "aesijopcyxvyhdqw"),
    "Greek capitals": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    "Greek small": ("ονϲϳ", "ovcj"),
    "Armenian": ("ՍՕօոսհց", "UOonuhg"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    "Coptic capitals": ("ⲎⲔⲘⲚⲞⲢⲤⲦⲬ", "HKMNOPCTX"),
    "Coptic small": ("ⲟⲣⲥⲭ", "opcx"),
    "Latin": ("ɑɡ", "ag"),
    "signs": ("µ‐‑", "μ--"),
}
MAPPED = {ord(a): b for left, right in LOOKALIKES.values() for a, b in zip(left, right, strict=True)}
LINE_ENDS = "\x0b\x0c\x85  "
#: Beside format and control characters.
UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x2800, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Ranges whose compatibility form looks the same.
SAME_LOOK = [(0x2160, 0x2180), (0x2E80, 0x2FE0), (0xF900, 0xFB07), (0xFE30, 0xFE70), (0xFF01, 0xFFEF)]


def base(c: int) -> str:
    """What a single character becomes before composition."""
    char = chr(c)
    if c == 0x0A:
        return char
    if char in LINE_ENDS or c == 0x0D:
        return "\n"
    if c == 0x09 or unicodedata.category(char) == "Zs":
        return " "
    if c in UNSEEN or unicodedata.category(char) in ("Cc", "Cf"):
        return ""
    if any(a <= c < b for a, b in SAME_LOOK):
        return "".join(MAPPED.get(ord(x), x) for x in unicodedata.normalize("NFKD", char))
    return "".join(MAPPED.get(ord(x), x) for x in unicodedata.normalize("NFD", char))


def composes_back(c: int) -> bool:
    """May it join with a character before it."""
    return unicodedata.combining(chr(c)) > 0 or 0x1161 <= c <= 0x1175 or 0x11A8 <= c <= 0x11C2 or not unicodedata.is_normalized("NFC", chr(c))


@functools.cache
def tables() -> tuple[re.Pattern[str], re.Pattern[str], re.Pattern[str], dict[int, str]]:
    """Patterns of a composing character, of unstable segments without and with the character before them; the map of single characters that change."""
    mapping: dict[int, str] = {}
    unstable: list[list[int]] = []
    back: list[list[int]] = []
    for c in [*range(0x323B0), *range(0xE0000, 0xE0200)]:
        if c == 0x0D or 0xD800 <= c < 0xE000 or 0x4E00 <= c < 0xA000 or 0x20 <= c < 0x7F or 0xAC00 <= c < 0xD7A4 or 0x20000 <= c < 0x2F800:
            continue
        new = base(c)
        if new != chr(c):
            mapping[c] = new
        for ranges, holds in ((unstable, unicodedata.normalize("NFC", new) != chr(c) or composes_back(c)), (back, composes_back(c))):
            if holds and ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            elif holds:
                ranges.append([c, c])
    one, two = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) for ranges in (back, unstable))
    mapping[0x0D] = "\n"  # beside a line feed the two are one line end
    return re.compile(f"[{one}]"), re.compile(f"\r\n?|[{two}]+"), re.compile(f"\r\n?|[^{two}\r]?[{two}]+"), mapping


def canonical(text: str, known: dict[str, str]) -> str:
    """The canonical form; known keeps segments already normalised."""
    composing, alone, with_context, mapping = tables()
    composes = False

    def fixed(m: re.Match[str]) -> str:
        nonlocal composes
        segment = m[0]
        if (out := known.get(segment)) is None:
            if not composes and composing.search(segment):
                composes = True
                return segment
            out = unicodedata.normalize("NFC", segment.replace("\r\n", "\n").translate(mapping))
            if len(known) < 200_000 and len(segment) < 64 and not composes:
                known[segment] = out
        return out

    out = alone.sub(fixed, text)
    if composes:
        # a mark may change the character before it: read again with that context
        out = with_context.sub(fixed, text)
    return out


#: What stands for a character that goes, and for one whose form depends on its neighbours or is longer.
GONE, HARD = 0x10FFFF, 0x10FFFE


@functools.cache
def single_forms() -> np.ndarray:
    """The canonical form of every character that has one by itself, of at most one character."""
    composing, _, _, mapping = tables()
    # what may join with the character before it
    second = {d.split()[1] for c in range(0x30000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    out = np.arange(0x110000, dtype=np.uint32)
    for c, new in mapping.items():
        form, first = unicodedata.normalize("NFC", new), unicodedata.normalize("NFD", new)[:1]
        joins = first and (unicodedata.combining(first) or f"{ord(first):04X}" in second or 0x1161 <= ord(first) <= 0x1175 or 0x11A8 <= ord(first) <= 0x11C2)
        out[c] = HARD if joins or len(form) > 1 else ord(form) if form else GONE
    out[[ord(m[0]) for m in composing.finditer("".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))]] = HARD
    out[[0x0D, GONE]] = HARD
    return out


def canonical_each(texts: list[str], known: dict[str, str]) -> list[str]:
    """canonical() of every text; at once for those whose characters all have a form by themselves."""
    points, starts = code_points(texts)
    new = single_forms()[points]
    whole = new.tobytes().decode("utf-32-le", "surrogatepass")
    at = starts.tolist()
    out = [whole[a:b].replace(chr(GONE), "") for a, b in zip(at, at[1:])]
    for k in np.unique(np.searchsorted(starts, np.flatnonzero(new == HARD), "right") - 1).tolist():
        out[k] = canonical(texts[k], known)
    return out


def canonical_texts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and the columns in canonical form."""
    known: dict[str, str] = {}

    def run(held: pa.Table) -> pa.Table:
        out = {key: held[key]}
        for c in columns:
            out[c] = pa.array([None if t is None else canonical(t, known) for t in held[c].to_pylist()], pa.string())
        return pa.table(out)

    schema = f"{key} {dict(df.dtypes)[key]}, " + ", ".join(f"{c} string" for c in columns)
    return mapped(df.select(key, *columns), run, schema)


def digest(c: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), c)


def field_forms(documents: DataFrame, fields: list[str]) -> DataFrame:
    """(field, doc_id, c1, c2, raw): 128-bit digests of the canonical form of each value and 64-bit ones of the stored form."""
    known: dict[str, str] = {}

    def run(held: pa.Table) -> pa.Table:
        fields_out: list[str] = []
        ids: list[int] = []
        forms: list[str] = []
        raws: list[str] = []
        doc_ids = held["doc_id"].to_pylist()
        for f in fields:
            for i, t in zip(doc_ids, held[f].to_pylist()):
                if t is not None and (form := canonical(t, known)) and not form.isspace():
                    fields_out.append(f)
                    ids.append(i)
                    forms.append(form)
                    raws.append(t)
        return pa.table({"field": fields_out, "doc_id": pa.array(ids, pa.int64()), "form": forms, "raw": raws})

    docs = documents.select("doc_id", *fields).filter("doc_id is not null")
    values = mapped(docs, run, "field string, doc_id long, form string, raw string", 1_000)
    return values.select("field", "doc_id", digest(F.col("form"), 1).alias("c1"), digest(F.col("form"), 2).alias("c2"), F.xxhash64("raw").alias("raw"))


def lookalike_classes(documents: DataFrame, fields: list[str]) -> DataFrame:
    """(field, doc_id, class_id, form_id, forms, members): each value that has look-alikes, its class and its own form.

    forms and members count the class; this grows with the documents, however large a class is.
    """
    values = checkpoint(field_forms(documents, fields))
    key = ["field", "c1", "c2"]
    # counted by form first, so a hot class comes as few rows
    forms = values.groupBy(*key, "raw").agg(F.count_distinct("doc_id").alias("n"))
    classes = forms.groupBy(*key).agg(F.count("*").alias("forms"), F.sum("n").alias("members")).filter("forms > 1")
    held = values.distinct().join(broadcast_if_small(checkpoint(classes), 64), key)
    return held.select("field", "doc_id", F.col("c1").alias("class_id"), F.col("raw").alias("form_id"), "forms", "members")


def lookalikes(documents: DataFrame, fields: list[str]) -> DataFrame:
    """(field, doc_id_a, doc_id_b): fields that look the same and are not the same string.

    The stored forms of a class are paired, and only then expanded into their
    documents, so equal strings never meet.
    """
    values = checkpoint(field_forms(documents, fields))
    key = ["field", "c1", "c2"]
    forms = values.select(*key, "raw").distinct()
    mixed = forms.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    members = checkpoint(values.join(broadcast_if_small(checkpoint(mixed), 48), key, "left_semi").distinct())
    own = members.select(*key, "raw").distinct()
    pairs = own.withColumnRenamed("raw", "x").join(own.withColumnRenamed("raw", "y"), key).filter("x < y")
    # few pairs of forms meet their documents where those lie; many are joined by shuffles, whose skewed parts are split
    left = members.withColumnsRenamed({"raw": "x", "doc_id": "i"}).join(broadcast_if_small(checkpoint(pairs), 56), [*key, "x"])
    out = left.join(members.withColumnsRenamed({"raw": "y", "doc_id": "j"}), [*key, "y"]).filter("i <> j")
    return out.select("field", F.least("i", "j").alias("doc_id_a"), F.greatest("i", "j").alias("doc_id_b")).distinct()
