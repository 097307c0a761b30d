"""Noise in text from scanned pages.

Method: a frequency lexicon of the corpus (words, hyphenated compounds, Chinese
character triples) is counted over all lines and stays a table. A symmetric-delete
index over it gives correction candidates: a word of any length and a word far
more frequent are joined where they share a form with one character deleted, or
where one or two confusion pairs of the scan turn one into the other. A weighted
edit distance, in which confusion pairs are cheap, decides whether a candidate is a
repair; between several, the counts of the word pairs with the word before pick.
Among Chinese characters the triples around a place take that role. All evidence is
a ratio of counts, so it is the same at every size of the corpus.

Repairs are found for distinct words, not for places; what a task holds in memory
are the misread words and triples alone, in slices of a fixed size, and each slice
is held against all pages.

Running titles and page numbers are found by repetition at the pages' edges;
divided words by joining the parts and looking the whole up in the tables.

Pages are the unit of work (a book may hold any share of the lines); lines of a
page are sorted and streamed, a long page in pieces that hand on to each other.

Defined cases: a null text is a line without content; lines without page are body
text; missing coordinates only take evidence away; repeated rows give no further
rows (in the lexicon's counts they weigh as stored); an empty table gives no rows;
very long lines are read whole. The next page of a book is the one with the next
number, or the one after it where that holds no body text.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from operator import sub
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.textio import mapped
from quillgraph.runtime import broadcast_if_small, checkpoint

#: Lines of one piece of a page, and the least that the last piece is left with.
MOST_LINES, LEAST_LINES = 4_096, 16
#: Lines at each edge of a page that may be a running title or a page number.
EDGE = 2
#: Misread words or triples that are held in memory at once; more are taken in slices.
MOST_HELD = 400_000
MOST_COUNTED = 500_000
#: A repair must be so many times as frequent as what it replaces; with an edit that is no confusion of the scan even more.
RARER, RARER_EDIT = 20, 60
#: The same for a Chinese character between its neighbours; one character may be misread often.
RARER_CHAR = 4
LEAST_COUNT = 3
#: Costs of a confusion pair and of another edit, and the most that a repair may cost.
CONFUSED, EDITED, MOST_COST = 0.3, 1.0, 1.0
#: What a known pair with the word before takes off a candidate's cost.
CONTEXT = 0.25

# What a scan reads for what is printed.
CONFUSIONS = (
    "c:e e:c l:i i:l 1:l 1:i l:t t:l 0:o 5:s 8:b 6:b 9:g b:ß 2:z rn:m m:rn ii:u ii:ü ri:n ni:m cl:d li:h h:b b:h f:t t:f q:g g:q o:c c:o u:v v:u nn:m vv:w "
    "ln:in a:o o:a n:ri u:ii d:cl a:ä o:ö u:ü e:é e:è e:ê i:î a:à u:ù o:ô c:ç"
)
SEEN: dict[str, list[str]] = defaultdict(list)
for _pair in CONFUSIONS.split():
    SEEN[_pair.split(":")[0]].append(_pair.split(":")[1])

LETTER = "A-Za-zÀ-ÖØ-öø-ÿŒœŠšŽž"
HAN = "㐀-䶿一-鿿"
WORD = re.compile(rf"[0-9]*[{LETTER}][{LETTER}0-9]*")
#: Of a run of letters, digits and hyphens as a whole.
COMPOUND = re.compile(rf"[{LETTER}]{{2,}}(?:-[{LETTER}]{{2,}})+")
MARKS = "-‐‑­¬"
LINE_ENDS_DIVIDED = re.compile(rf"[{MARKS}]\s*$", re.MULTILINE)
DIVIDED = re.compile(rf"([{LETTER}][{LETTER}0-9]*)([{MARKS}])\s*$")
STARTS = re.compile(rf"\s*([{LETTER}0-9]+)")
HAN_CHAR = re.compile(rf"[{HAN}]")
#: A page number with its ornament; a scan may have misread a digit.
NUMBER = r"(?:[0-9OSlIo]{1,5}|[ivxlcdm]{1,9}|[IVXLCDM]{1,9})"
PAGE_NUMBER = rf"^\s*((?:第|Page|Seite|page|p\.|S\.|PAGE|SEITE)?[^\p{{L}}\p{{N}}]*)({NUMBER})([^\p{{L}}\p{{N}}]*(?:页)?)\s*$"
CHAPTER = r"(?i)^(第\s*[0-9一二三四五六七八九十百]+\s*[章节编]|(chapter|chapitre|kapitel|teil|part)\b|[0-9lo]{1,2}[.\s]\s*\p{L})"

#: Kinds of counted entries.
WORD_ROW, COMPOUND_ROW, TRIPLE_ROW = range(3)
#: Sides of a page.
TOP_ROW, BOTTOM_ROW = 0, 1
NEWLINE, OTHER = 0x0A, 0x23


# The lexicon.


@functools.cache
def kept_signs(hyphens: bool) -> np.ndarray:
    """Letters and digits, with hyphens those too, as they are, and a blank for every other unit of UTF-16."""
    out = np.full(0x10000, 0x20, dtype=np.uint16)
    held = [ord(c) for c in map(chr, range(0x250)) if re.match(f"[{LETTER}0-9]", c)]
    out[held] = held
    if hyphens:
        out[ord("-")] = ord("-")
    return out


def runs(text: str, hyphens: bool = False) -> list[str]:
    """The runs of letters and digits, with hyphens of those too; one with a letter is a match of WORD."""
    return kept_signs(hyphens)[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)].tobytes().decode("utf-16-le").split()


def triple_codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the character triples of lines around a Chinese one; another character is #."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    han = ((c >= 0x3400) & (c <= 0x4DBF)) | ((c >= 0x4E00) & (c <= 0x9FFF))
    c = np.where(han | (c == NEWLINE), c, OTHER)
    inside = han[1:-1] & (c[:-2] != NEWLINE) & (c[2:] != NEWLINE)
    codes = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inside]
    return np.unique(codes, return_counts=True)


def column_values(column: pa.Array | pa.ChunkedArray) -> list[Any]:
    """As to_pylist(), by numpy where a column holds texts or numbers."""
    kind = column.type
    if not (pa.types.is_string(kind) or pa.types.is_floating(kind) or pa.types.is_integer(kind) and not column.null_count):
        return column.to_pylist()
    out = np.asarray(column).tolist()
    if pa.types.is_floating(kind) and column.null_count:
        for k in np.flatnonzero(np.asarray(column.is_null())).tolist():
            out[k] = None
    return out


def lexicon(lines: DataFrame) -> DataFrame:
    """(kind, word, n): counts of words, compounds and character triples over all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        grams: Counter[int] = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for w, n in found.items():
                for part in w.split("-"):
                    words[part] += n
            rows = [(WORD_ROW, w, n) for w, n in words.items() if len(w) > 1 and not w.isdigit()]
            rows += [(COMPOUND_ROW, w, n) for w, n in found.items() if "-" in w and COMPOUND.fullmatch(w)]
            rows += [(TRIPLE_ROW, "".join(chr(g >> k & 0x1FFFFF) for k in (42, 21, 0)), n) for g, n in grams.items()]
            kind, word, n = zip(*rows) if rows else ((), (), ())
            for held in (found, grams):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["kind", "word", "n"])

        for batch in batches:
            text = "\n".join(column_values(batch.column("text")))
            found.update(runs(text.lower(), True))
            if not text.isascii():
                for g, n in zip(*(x.tolist() for x in triple_codes(text))):
                    grams[g] += n
            if len(found) + len(grams) > MOST_COUNTED:
                yield flush()
        yield flush()

    rows = lines.filter("doc_id is not null and line_no is not null and text <> ''").select("text")
    return rows.mapInArrow(run, "kind int, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def entries(counts: DataFrame, kind: int) -> DataFrame:
    return counts.filter(F.col("kind") == kind).select("word", "n")


def deletes(word: str) -> set[str]:
    return {word[:k] + word[k + 1 :] for k in range(len(word))}


def confusions(word: str) -> set[str]:
    """What the word may be a misreading of, by one confusion pair."""
    return {word[:k] + right + word[k + size :] for k in range(len(word)) for size in (1, 2) if k + size <= len(word) for right in SEEN.get(word[k : k + size], ())}


def may_be_misread(word: str) -> bool:
    """At least three signs with two letters, and no more than two digits."""
    letters = sum(c.isalpha() for c in word)
    return len(word) > 2 and letters > 1 and letters >= len(word) - 2


@functools.cache
def bare(letter: str) -> str:
    """The letter without its accent."""
    return unicodedata.normalize("NFD", letter)[0]


def distance(word: str, printed: str) -> float:
    """The weighted edit distance from a word to what may have been printed.

    An edit that is no confusion pair lies inside the word: at its ends it makes another form of it.
    """
    far = 1 << 20
    best = [[float(far)] * (len(printed) + 1) for _ in range(len(word) + 1)]
    best[0][0] = 0.0
    for i in range(len(word) + 1):
        for j in range(len(printed) + 1):
            at = best[i][j]
            if at > MOST_COST:
                continue
            inside = 0 < i and 0 < j and i < len(word) and j < len(printed)
            if i < len(word) and j < len(printed):
                same = word[i] == printed[j]
                # a letter with another accent makes another word
                if same or (inside and i < len(word) - 1 and j < len(printed) - 1 and bare(word[i]) != bare(printed[j])):
                    best[i + 1][j + 1] = min(best[i + 1][j + 1], at + (0.0 if same else EDITED))
            for size in (1, 2):
                for right in SEEN.get(word[i : i + size], ()) if i + size <= len(word) else ():
                    if printed.startswith(right, j):
                        best[i + size][j + len(right)] = min(best[i + size][j + len(right)], at + CONFUSED)
            if inside:
                best[i + 1][j] = min(best[i + 1][j], at + EDITED)
                best[i][j + 1] = min(best[i][j + 1], at + EDITED)
    return best[-1][-1]


def repair_cost(word: str, n: int, printed: str, printed_n: int) -> float | None:
    """The cost of a repair, null if it is none: too far, or not so much more frequent."""
    cost = distance(word, printed)
    edited = cost >= EDITED
    if not 0 < cost <= MOST_COST or (cost > CONFUSED and len(word) < 5) or printed_n < (RARER_EDIT if edited else RARER) * max(1, n):
        return None
    return cost


FORMS = "form string, word string, n long"


def index_forms(words: DataFrame, printed: bool) -> DataFrame:
    """(form, word, n): the symmetric-delete index; printed are the words that repairs are taken from.

    A form after - is the word or what is left of it with one character deleted, one after = a whole word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for at in range(0, held.num_rows, 2_000):
                forms, words, counts = [], [], []
                for word, n in zip(*(held.column(c).slice(at, 2_000).to_pylist() for c in ("word", "n"))):
                    if not (word.isalpha() if printed else may_be_misread(word)):
                        continue
                    own = {"-" + x for x in (*deletes(word), word)} if len(word) > 4 or printed else set()
                    if printed:
                        own.add("=" + word)
                    else:
                        near = confusions(word)
                        if len(word) > 4:
                            near = near.union(*map(confusions, near))
                        own |= {"=" + x for x in near if x != word and x.isalpha()}
                    forms += own
                    words += [word] * len(own)
                    counts += [n] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["form", "word", "n"])

    return words.mapInArrow(run, FORMS)


def repairs(words: DataFrame, printed: DataFrame) -> DataFrame:
    """(word, n, printed, printed_n, cost): what the words (word, n) were printed as, out of the words printed (word, n).

    No form is hot: the words that share one are as many as its places and the letters allow.
    """
    frequent = printed.filter(F.col("n") >= RARER)
    right = index_forms(frequent, True).select("form", F.col("word").alias("printed"), F.col("n").alias("printed_n"))
    pairs = index_forms(words, False).join(right, "form").filter(F.col("printed_n") >= RARER * F.greatest("n", F.lit(1))).filter("word <> printed")

    def run(table: pa.Table) -> pa.Table:
        costs = [repair_cost(*row) for row in zip(*(table[c].to_pylist() for c in ("word", "n", "printed", "printed_n")))]
        return table.append_column("cost", pa.array(costs, pa.float64()))

    scored = mapped(pairs.select("word", "n", "printed", "printed_n").distinct(), run, "word string, n long, printed string, printed_n long, cost double")
    return scored.filter("cost is not null")


def misread_triples(triples: DataFrame) -> DataFrame:
    """(word, place, printed): triples whose character at the place was misread for printed."""
    grams = triples.select("word", "n", *[F.substring("word", k, 1).alias(f"c{k}") for k in (1, 2, 3)])
    often = grams.filter("n >= 2")
    # deleting the middle brings together what stands between the same neighbours
    tops = often.groupBy("c1", "c3").agg(F.max_by("c2", F.struct("n", "c2")).alias("top"), F.max("n").alias("top_n"))
    middles = often.join(tops, ["c1", "c3"]).groupBy(F.col("c2").alias("seen"), "top").agg(F.count_if(F.col("n") * RARER_CHAR <= F.col("top_n")).alias("votes"), F.count("*").alias("places"))
    all_places = middles.groupBy("seen").agg(F.sum("places").alias("of"))
    # a character stands for another if that explains a large part of the places where it is found
    held = middles.join(all_places, "seen").filter("votes >= 2 and votes >= 0.3 * of and seen <> top")
    chars = held.groupBy("seen").agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", "top")), asc=False), 1, 4).alias("tops"))
    chars = checkpoint(chars.select("seen", F.explode("tops.top").alias("printed")))
    chars = broadcast_if_small(chars, 32)
    own = grams.select("word", "n", F.posexplode(F.array("c1", "c2", "c3")).alias("place", "seen")).join(chars, "seen")
    new = F.concat(F.expr("substring(word, 1, place)"), "printed", F.expr("substring(word, place + 2, 3)"))
    own = own.select("word", "n", "place", "printed", new.alias("new"))
    right = triples.select(F.col("word").alias("new"), F.col("n").alias("new_n"))
    return own.join(right, "new").filter(F.col("new_n") >= F.greatest(F.lit(LEAST_COUNT), RARER_CHAR * F.col("n"))).select("word", "place", "printed")


class Held(NamedTuple):
    """A slice of the misread words, with their repairs from the cheapest on, and of the misread triples, by the misread character."""

    words: dict[str, list[tuple[float, str]]]
    triples: dict[str, dict[str, frozenset[tuple[int, str]]]]

    def suspect(self) -> re.Pattern[str] | None:
        return suspects(frozenset(self.triples)) if self.triples else None


@functools.lru_cache(4)
def suspects(chars: frozenset[str]) -> re.Pattern[str]:
    return re.compile("[" + re.escape("".join(sorted(chars))) + "]")


def held_of(words: pa.Table, triples: pa.Table) -> Held:
    out: dict[str, list[tuple[float, str]]] = defaultdict(list)
    for word, printed, n, cost in sorted(zip(*(words[c].to_pylist() for c in ("word", "printed", "printed_n", "cost"))), key=lambda r: (r[0], r[3], -r[2], r[1])):
        out[word].append((cost, printed))
    known: dict[str, dict[str, set[tuple[int, str]]]] = defaultdict(lambda: defaultdict(set))
    for word, place, printed in zip(*(triples[c].to_pylist() for c in ("word", "place", "printed"))):
        known[word[place]][word].add((place, printed))
    return Held(dict(out), {c: {w: frozenset(x) for w, x in held.items()} for c, held in known.items()})


def slices(words: DataFrame, triples: DataFrame, most: int = MOST_HELD) -> Iterator[Any]:
    """Broadcasts of misread words and triples, each of at most about `most` rows; one if they are few.

    A character's triples stay together, as a place is judged by all that cover it.
    """
    spark = words.sparkSession
    count = max(1, -(-(words.count() + triples.count()) // most))
    for k in range(count):
        own = [t.filter(F.pmod(F.xxhash64(key), F.lit(count)) == k) if count > 1 else t for t, key in ((words, F.col("word")), (triples, F.expr("substring(word, place + 1, 1)")))]
        yield spark.sparkContext.broadcast(held_of(own[0].toArrow(), own[1].toArrow()))


def misread_chars(text: str, held: Held) -> list[tuple[int, str]]:
    """Places of misread Chinese characters, with what was printed there: every triple that covers the place says so."""
    out: list[tuple[int, str]] = []
    suspect = held.suspect()
    if suspect is None:
        return out
    for m in suspect.finditer(text):
        k, known = m.start(), held.triples[m[0]]
        around = [c if HAN_CHAR.match(c) else "#" for c in text[max(0, k - 2) : k + 3]]
        at = min(2, k)
        # a triple around a foreign sign, or beyond the next one, was never counted
        windows = [known.get("".join(around[s : s + 3]), frozenset()) for s in range(len(around) - 2) if s <= at <= s + 2 and around[s + 1] != "#"]
        places = [at - s for s in range(len(around) - 2) if s <= at <= s + 2 and around[s + 1] != "#"]
        if not windows:
            continue
        said = frozenset.intersection(*(frozenset(p for at_, p in w if at_ == place) for w, place in zip(windows, places)))
        if said:
            out.append((k, min(said)))
    return out


def word_repairs(text: str, held: Held, skip_first: bool, skip_last: bool) -> list[tuple[int, int, str, list[tuple[float, str]]]]:
    """(start, end, word before, repairs) of the misread words of a line."""
    out = []
    low = text.lower()
    found = list(WORD.finditer(low))
    for k, m in enumerate(found):
        options = held.words.get(m[0])
        if options is None or (k == 0 and skip_first) or (k == len(found) - 1 and skip_last):
            continue
        # parts of formulas are no words
        if low[m.start() - 1 : m.start()] in ("^", "_", "\\", "{") or low[m.end() : m.end() + 1] in ("^", "_", "("):
            continue
        out.append((m.start(), m.end(), found[k - 1][0] if k else "", options))
    return out


def edge_lines(numbers: list[int], texts: list[str | None], tops: list[float | None]) -> list[list[dict[str, Any]]]:
    """The first and the last lines with text of a page, from the edge inwards, each with its distance to the next one in line pitches."""
    known = [x for x in tops if x is not None]
    steps = sorted(map(sub, known[1:], known))
    pitch = steps[len(steps) // 2] if len(steps) > 2 else 0.0
    sides = []
    for order, step in ((range(len(texts)), 1), (range(len(texts) - 1, -1, -1), -1)):
        side: list[dict[str, Any]] = []
        for k in order:
            if (t := texts[k]) and not t.isspace():
                near, gap = k + step, None
                if pitch > 0 and 0 <= near < len(tops) and tops[k] is not None and tops[near] is not None:
                    gap = abs(tops[near] - tops[k]) / pitch
                side.append({"line_no": numbers[k], "text": t, "gap": gap})
                if len(side) == EDGE:
                    break
        sides.append(side)
    return sides


# Pages.

EDGE_LINES = "array<struct<line_no:long,text:string,gap:double>>"
NEXT_LINES = "array<struct<line_no:long,word:string>>"
READ = f"kind int, doc_id long, page int, piece long, line_no long, word string, mark string, before string, next {NEXT_LINES}, tops {EDGE_LINES}, bottoms {EDGE_LINES}"
EDGE_TYPE = pa.list_(pa.struct([("line_no", pa.int64()), ("text", pa.string()), ("gap", pa.float64())]))
NEXT_TYPE = pa.list_(pa.struct([("line_no", pa.int64()), ("word", pa.string())]))
READ_TYPES = {
    "kind": pa.int32(), "doc_id": pa.int64(), "page": pa.int32(), "piece": pa.int64(), "line_no": pa.int64(), "word": pa.string(), "mark": pa.string(), "before": pa.string(), "next": NEXT_TYPE, "tops": EDGE_TYPE, "bottoms": EDGE_TYPE,
}
#: Kinds of rows: misread lines, divided words, first lines of a piece that is no page's first, edges of a page (with the first lines, where it begins).
MISREAD_ROW, DIVIDED_ROW, FIRST_ROW, PAGE_ROW = range(4)
#: Lines with text that are looked at for the rest of a divided word: one more than marks can stand at an edge.
FOLLOWING = EDGE + 1
#: The piece number that stands for a page's last piece.
LAST_PIECE = -1
NO_PAGE = -(1 << 31)
LINES_OF_A_BLOCK = 64


class Piece(NamedTuple):
    """Lines of one page in order; a page of few lines is one piece, lines without page come in blocks."""

    doc: int
    page: int | None
    number: int
    first: bool
    last: bool
    numbers: list[int]
    texts: list[str | None]
    rest: list[list[Any]]


def placed_lines(lines: DataFrame, *columns: str | Column) -> DataFrame:
    return lines.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), F.col("line_no").cast("long"), "text", *columns).filter("doc_id is not null and line_no is not null")


def by_page(rows: DataFrame, *order: str) -> DataFrame:
    """The lines brought together by page, in order."""
    block = F.when(F.col("page").isNull(), F.floor(F.col("line_no") / LINES_OF_A_BLOCK)).otherwise(F.lit(0))
    return rows.repartition(F.col("doc_id"), F.col("page"), block).sortWithinPartitions("doc_id", "page", "line_no", *order)


def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    """The pieces of lines sorted by by_page(), with the columns behind the text; a repeated line counts once."""
    rest: pa.Table | None = None
    going: tuple[int, int, int] | None = None
    number = 0

    def key_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, line = table["doc_id"].to_numpy(), table["line_no"].to_numpy()
        page = pc.fill_null(table["page"], NO_PAGE).to_numpy()
        return doc, page, np.where(page == NO_PAGE, line // LINES_OF_A_BLOCK, 0)

    for batch in with_end(batches):
        if batch is not None:
            part = pa.Table.from_batches([batch])
            rest = part if rest is None else pa.concat_tables([rest, part])
        if rest is None or not rest.num_rows:
            continue
        held = rest.combine_chunks()
        doc, page, block = key_of(held)
        line = held["line_no"].to_numpy()
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (page[1:] != page[:-1]) | (block[1:] != block[:-1])])
        again = np.concatenate([[False], ~new[1:] & (line[1:] == line[:-1])])
        if again.any():
            held = held.filter(pa.array(~again)).combine_chunks()
            doc, page, block, new = doc[~again], page[~again], block[~again], new[~again]
        n = held.num_rows
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        columns = [column_values(held[c]) for c in held.column_names[2:]]
        done = 0
        for s, e in zip(starts.tolist(), ends.tolist()):
            whole = batch is None or e < n
            here = (int(doc[s]), int(page[s]), int(block[s]))
            at = s
            while whole and at < e or e - at >= MOST_LINES + LEAST_LINES:
                to = at + MOST_LINES if e - at >= MOST_LINES + LEAST_LINES else e
                number = number + 1 if here == going else int(block[s])
                first, last = here != going, whole and to == e
                going = here
                yield Piece(here[0], None if here[1] == NO_PAGE else here[1], number, first, last, columns[0][at:to], columns[1][at:to], [c[at:to] for c in columns[2:]])
                at = done = to
        rest = held.slice(done)


# Running titles and page numbers.


def title_key(text: Column) -> Column:
    """A running title without the page number set beside it, blanks and letter case."""
    apart = text.contains("   ") | text.contains("\t")
    bare = F.when(apart, F.regexp_replace(text, rf"^\s*{NUMBER}(?:\s{{3,}}|\t)|(?:\s{{3,}}|\t){NUMBER}\s*$", "")).otherwise(text)
    return F.lower(F.regexp_replace(bare, r"[\s\x{a0}\x{2000}-\x{200b}\x{202f}\x{3000}]+", ""))


def opens_chapter(text: Column) -> Column:
    """Does the line read like a chapter's title, without the page number set before it."""
    return F.when(text.contains("   "), F.regexp_replace(text, rf"^\s*{NUMBER}\s{{3,}}", "")).otherwise(text).rlike(CHAPTER)


def number_value(text: Column) -> Column:
    """The value of an arabic or roman page number; null if a misread digit spoils it."""
    low = F.lower(text)
    signs = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    values = F.create_map(*[x for k, v in signs.items() for x in (F.lit(k), F.lit(v))])
    each = F.transform(F.filter(F.split(low, ""), lambda c: c != ""), lambda c: F.element_at(values, c))
    roman = F.aggregate(
        F.reverse(each),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda s, v: F.struct(F.when(v < s["last"], s["sum"] - v).otherwise(s["sum"] + v).alias("sum"), F.greatest(v, s["last"]).alias("last")),
        lambda s: s["sum"],
    )
    return F.when(text.rlike("^[0-9]+$"), text.cast("long")).when(low.rlike("^[ivxlcdm]+$"), roman.cast("long"))


def edge_faults(found: DataFrame) -> DataFrame:
    """(doc_id, line_no, fault) of page numbers and running titles."""
    pages = found.filter(f"kind = {PAGE_ROW} and page is not null").select("doc_id", "page", "piece", "tops", "bottoms")
    book = checkpoint(pages.groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("pages")))
    sides = F.array(F.struct(F.lit(TOP_ROW).alias("kind"), F.col("tops").alias("x")), F.struct(F.lit(BOTTOM_ROW).alias("kind"), F.col("bottoms").alias("x")))
    sided = pages.select("doc_id", "page", F.explode(sides).alias("s")).select("doc_id", "page", "s.kind", "s.x")

    def form(text: Column) -> Column:
        """The ornament of a page number, null if the line holds something else."""
        parts = [F.regexp_replace(F.regexp_extract(text, PAGE_NUMBER, k), r"\s+", " ") for k in (1, 3)]
        return F.when(text.rlike(PAGE_NUMBER), F.concat(parts[0], F.lit("#"), parts[1]))

    sided = checkpoint(sided.withColumn("own", F.transform("x", lambda x: form(x["text"]))))
    lines = sided.filter(F.exists("own", lambda f: f.isNotNull())).select("doc_id", "page", "kind", F.explode(F.arrays_zip("x", "own")).alias("z"))
    numbered = lines.filter("z.own is not null").select("doc_id", "page", "kind", F.col("z.own").alias("form"), F.regexp_extract("z.x.text", PAGE_NUMBER, 2).alias("number"))
    numbered = numbered.withColumn("value", number_value(F.col("number")))
    # pages whose numbers run with the page, by form and edge
    steps = numbered.groupBy("doc_id", "kind", "form", (F.col("value") - F.col("page")).alias("step")).agg(F.count_distinct("page").alias("n"))
    forms = steps.filter("step is not null").groupBy("doc_id", "kind", "form").agg(F.sum(F.when((F.col("n") >= 2) | (F.col("step") == 0), F.col("n"))).alias("running"))
    forms = forms.join(book, "doc_id").filter("running >= greatest(1, 0.4 * pages)").groupBy("doc_id", "kind").agg(F.collect_set("form").alias("forms"))
    forms = broadcast_if_small(checkpoint(forms), 96)
    page_no = sided.select("doc_id", "kind", "own", F.col("x.line_no").alias("line_no")).join(forms, ["doc_id", "kind"]).select("doc_id", "forms", F.explode(F.arrays_zip("own", "line_no")).alias("z"))
    page_no = page_no.filter(F.array_contains("forms", F.col("z.own"))).select("doc_id", "z.line_no")
    sided = sided.join(forms, ["doc_id", "kind"], "left").withColumn("forms", F.coalesce("forms", F.array().cast("array<string>")))
    is_number = F.transform("own", lambda f: F.coalesce(F.array_contains("forms", f), F.lit(False)))
    sided = sided.withColumn("numbers", is_number)
    # the outermost line that is no page number may be a running title
    outer = F.try_element_at(F.filter("x", lambda x, k: ~F.element_at("numbers", k + 1)), F.lit(1))
    sided = sided.select("doc_id", "page", "kind", outer.alias("outer"))
    outer = sided.filter("outer is not null").select("doc_id", "page", "kind", "outer.*")
    outer = outer.withColumns({"key": title_key(F.col("text")), "chapter": opens_chapter(F.col("text"))}).filter("key <> ''")
    outer = checkpoint(outer.select("doc_id", "kind", "line_no", "gap", "key", "chapter"))
    keys = outer.groupBy("doc_id", "kind", "key").agg(F.count("*").alias("n"))
    # a title that was misread belongs to the more frequent one that shares its beginning or end
    near = keys.select("doc_id", "kind", "key", "n", F.explode(F.array(F.concat(F.lit("a"), F.substring("key", 1, 6)), F.concat(F.lit("z"), F.expr("right(key, 6)")))).alias("b"))
    # of each beginning or end the most frequent title stands for its block, so no block is paired with itself
    heads = near.groupBy("doc_id", "kind", "b").agg(F.max(F.struct("n", "key")).alias("h")).select("doc_id", "kind", "b", F.col("h.key").alias("head"), F.col("h.n").alias("head_n"))
    close = near.join(heads, ["doc_id", "kind", "b"]).filter("key <> head and head_n >= n and levenshtein(key, head) <= greatest(1, least(3, 0.2 * length(head)))")
    family = close.groupBy("doc_id", "kind", "key").agg(F.max(F.struct("head_n", "head")).alias("f")).select("doc_id", "kind", "key", F.col("f.head").alias("family"))
    outer = outer.join(broadcast_if_small(checkpoint(family), 256), ["doc_id", "kind", "key"], "left").withColumn("family", F.coalesce("family", "key"))
    # means over a title's lines; of a chapter's title the first line opens the chapter
    stats = outer.groupBy("doc_id", "kind", "family").agg(
        F.count("*").alias("n"), F.count_if(F.col("gap") >= 1.5).alias("apart"), F.count_if(F.col("gap") < 1.5).alias("close"), F.min("line_no").alias("first"), F.max("chapter").alias("opens")
    )
    stats = stats.join(book, "doc_id")
    top, bottom = F.col("kind") == TOP_ROW, F.col("kind") == BOTTOM_ROW
    titles = stats.filter(
        (top & ((F.col("apart") > F.col("close")) | F.col("opens") & (F.col("n") >= 2) | (F.col("n") >= F.greatest(F.lit(2), F.col("pages") * 0.15))))
        | (top & F.col("opens") & (F.col("apart") >= 1))
        | (bottom & (F.col("n") >= F.greatest(F.lit(2), F.col("pages") * 0.25)))
    )
    titles = checkpoint(titles.select("doc_id", "kind", "family", "first", "opens"))
    held = outer.join(broadcast_if_small(titles, 256), ["doc_id", "kind", "family"])
    # a running title stands apart from the text, the line that opens a chapter does not
    opening = F.col("opens") & F.when(F.col("gap").isNotNull(), F.col("gap") < 1.5).otherwise(F.col("line_no") == F.col("first"))
    header = held.filter(~(top & opening))
    return header.select("doc_id", "line_no", F.lit("header").alias("fault")).unionByName(page_no.select("doc_id", "line_no", F.lit("page_no").alias("fault"))).distinct()


# Divided and misread words.


def misread_words(text: str, held: Held, skip_first: bool, skip_last: bool, early: bool) -> bool:
    """Does the line hold a misread word; early in a page its first word may be the rest of a divided one, so only a confusion pair counts there."""
    found = word_repairs(text, held, skip_first, skip_last)
    first = STARTS.match(text)
    return any(not early or first is None or a > first.start(1) or options[0][0] < EDITED for a, _, _, options in found)


def structure_rows(x: Piece) -> list[tuple]:
    """The edges and the first lines of a piece, as rows of READ."""
    rows: list[tuple] = []
    first = []
    for n, t in zip(x.numbers, x.texts):
        if t and not t.isspace():
            first.append({"line_no": n, "word": s[1] if (s := STARTS.match(t)) else None})
            if len(first) == FOLLOWING:
                break
    begins = x.page is not None and x.first
    if x.page is not None and (x.first or x.last):
        top, bottom = edge_lines(x.numbers, x.texts, x.rest[0])
        rows.append((PAGE_ROW, x.doc, x.page, 0 if x.first else 1, None, None, None, None, first if begins else None, top if x.first else [], bottom if x.last else []))
    if not begins:
        # under the piece that it goes on from
        rows.append((FIRST_ROW, x.doc, x.page, x.number - 1, 0, None, None, None, first, None, None))
    return rows


def read_piece(x: Piece, held: Held, structure: bool) -> list[tuple]:
    """Misread lines, and with structure divided words, edges and first lines, as rows of READ."""
    rows = structure_rows(x) if structure else []
    full = "\n".join(t for t in x.texts if t)
    doubts = held.words.keys() & runs(full.lower())
    divided = LINE_ENDS_DIVIDED.search(full) is not None
    odd = (s := held.suspect()) is not None and not full.isascii() and s.search(full) is not None
    if not doubts and not (structure and divided) and not odd:
        return rows
    cut, early = True, FOLLOWING
    for k, t in enumerate(x.texts):
        if not t or t.isspace():
            continue
        early -= 1
        m = DIVIDED.search(t) if divided and t.rstrip()[-1:] in MARKS else None
        # divided words are judged whole, later: their parts are left out here
        if m and structure:
            following = []
            for j in range(k + 1, len(x.texts)):
                if (u := x.texts[j]) and not u.isspace():
                    following.append({"line_no": x.numbers[j], "word": s[1] if (s := STARTS.match(u)) else None})
                    if len(following) == FOLLOWING:
                        break
            start = s.end() if cut and (s := STARTS.match(t)) else 0
            before = WORD.findall(t[start : m.start()].lower())
            key = None if len(following) == FOLLOWING else x.number if x.page is None or not x.last else LAST_PIECE
            rows.append((DIVIDED_ROW, x.doc, x.page, key, x.numbers[k], m[1], m[2], before[-1] if before else "", following, None, None))
        low = t.lower() if doubts else ""
        if any(w in low for w in doubts) and misread_words(t, held, cut, m is not None, early >= 0) or odd and not t.isascii() and misread_chars(t, held):
            rows.append((MISREAD_ROW, x.doc, x.page, None, x.numbers[k], None, None, None, None, None, None))
        cut = m is not None
    return rows


def read_pages(lines: DataFrame, shared: Any, structure: bool) -> DataFrame:
    """Misread lines, divided words with the lines that may go on with them, first lines and edges of the pages."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(READ_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, READ_TYPES.values())], names=list(READ_TYPES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for x in pieces(batches):
            rows += read_piece(x, shared.value, structure)
            if len(rows) >= 5_000:
                yield made(rows)
                rows = []
        yield made(rows)

    return by_page(placed_lines(lines, F.col("top").cast("double").alias("top")), "text", "top").mapInArrow(run, READ)


def divided_words(read: DataFrame, marks: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, line_no, to, a, b, keep, fixed): lines whose last word, a, goes on with b at the start of the line `to`.

    keep says that the mark is the word's own; fixed is what a misread word was printed as.
    """
    unit = F.coalesce("page", F.lit(NO_PAGE)).cast("long")
    parts = read.filter(f"kind = {DIVIDED_ROW}").select("doc_id", unit.alias("unit"), "piece", "line_no", "word", "mark", "before", "next")
    parts = checkpoint(parts.join(marks.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti"))
    over = read.filter(f"kind = {FIRST_ROW}").select("doc_id", unit.alias("unit"), "piece", F.col("line_no").alias("k"), "next")
    # a page goes on from the page before it, or from the one before that
    pages = read.filter(f"kind = {PAGE_ROW} and piece = 0").select("doc_id", "page", F.explode(F.array(*(F.lit(k).cast("long") for k in (0, 1)))).alias("k"), "next")
    over = over.unionByName(pages.select("doc_id", (F.col("page").cast("long") - 1 - F.col("k")).alias("unit"), F.lit(LAST_PIECE).cast("long").alias("piece"), "k", "next"))
    # only the first lines that are asked for are gathered
    looks = parts.filter("piece is not null").select("doc_id", "unit", "piece").distinct()
    over = over.join(looks, ["doc_id", "unit", "piece"], "left_semi").groupBy("doc_id", "unit", "piece").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "next"))), lambda x: x["next"])).alias("over"))
    # most divided words have their followers in the page; only the others look over its end
    inside, beyond = parts.filter("piece is null").withColumn("over", F.lit(None).cast(NEXT_LINES)), parts.filter("piece is not null").join(over, ["doc_id", "unit", "piece"], "left")
    columns = ["doc_id", "line_no", "word", "mark", "before", "next", "over"]
    parts = inside.select(columns).unionByName(beyond.select(columns))
    steps = parts.select("doc_id", "line_no", "word", "mark", "before", F.posexplode(F.concat("next", F.coalesce("over", F.array().cast(NEXT_LINES)))).alias("k", "x"))
    steps = steps.select("doc_id", "line_no", "word", "mark", "before", "k", F.col("x.line_no").alias("to"), F.col("x.word").alias("rest"))
    steps = steps.join(marks.select("doc_id", F.col("line_no").alias("to")), ["doc_id", "to"], "left_anti")
    pairs = steps.groupBy("doc_id", "line_no").agg(F.min_by(F.struct("word", "mark", "before", "to", "rest"), "k").alias("x")).select("doc_id", "line_no", "x.*")
    pairs = pairs.filter("rest is not null").withColumns({"a": F.lower("word"), "b": F.lower("rest")})
    pairs = checkpoint(pairs.select("doc_id", "line_no", "mark", "to", "a", "b", F.concat("a", "b").alias("whole")))
    # the tables are asked for distinct pairs
    asked = pairs.select("a", "b", "whole").distinct()
    words = entries(counts, WORD_ROW)
    own = words.filter("n >= 2").withColumnRenamed("n", "own")
    for part in ("a", "b"):
        asked = asked.join(own.select(F.col("word").alias(part), F.lit(True).alias(f"known_{part}")), part, "left")
    asked = asked.join(own.select(F.col("word").alias("whole"), "own"), "whole", "left")
    compounds = entries(counts, COMPOUND_ROW).select(F.col("word").alias("compound"), F.col("n").alias("compound_n"))
    asked = checkpoint(asked.withColumn("compound", F.concat_ws("-", "a", "b")).join(compounds, "compound", "left"))
    unknown = asked.filter("own is null and not (known_a is true and known_b is true)").select(F.col("whole").alias("word"), F.lit(0).cast("long").alias("n")).distinct()
    fixed = repairs(unknown, words).groupBy(F.col("word").alias("whole")).agg(F.min_by("printed", F.struct("cost", -F.col("printed_n"), "printed")).alias("fixed"))
    asked = asked.join(fixed, "whole", "left")
    # a repair of a word that stands by itself is no repair of two words
    said = checkpoint(asked.select("a", "b", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("compound_n", F.lit(0)).alias("compound_n"), F.when(F.col("own").isNull() & ~(F.coalesce("known_a", F.lit(False)) & F.coalesce("known_b", F.lit(False))), F.col("fixed")).alias("fixed")))
    held = pairs.join(broadcast_if_small(said, 128), ["a", "b"])
    hyphen = F.col("mark") == "-"
    goes_on = ~F.col("b").isin(*SUSPENDED)
    divided = ~hyphen | (goes_on & ((F.col("own") >= LEAST_COUNT) | F.col("fixed").isNotNull() | (F.col("compound_n") >= LEAST_COUNT)))
    keep = hyphen & (F.col("own") < LEAST_COUNT) & (F.col("compound_n") >= LEAST_COUNT)
    return held.filter(divided).select("doc_id", "line_no", "to", "a", "b", keep.alias("keep"), F.when(F.length("fixed") >= F.length("a"), F.col("fixed")).alias("fixed"))


def joined_words(divided: DataFrame) -> DataFrame:
    """(doc_id, line_no, fault) of divided words, and of words misread that were divided."""
    at = F.when(~F.col("fixed").startswith(F.col("a")), F.col("line_no")).otherwise(F.col("to"))
    misread = divided.filter("fixed is not null").select("doc_id", at.alias("line_no"), F.lit("misread").alias("fault"))
    return divided.select("doc_id", "line_no", F.lit("hyphen").alias("fault")).unionByName(misread)


# Words before which a part of a compound ends in a hyphen of its own.
SUSPENDED = tuple("and or und oder et ou bzw sowie wie bis to nor as".split())


def misread_entries(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The misread words with their repairs, and the misread triples, of a lexicon."""
    words = entries(counts, WORD_ROW)
    return checkpoint(repairs(words, words)), checkpoint(misread_triples(entries(counts, TRIPLE_ROW)))


def scan_faults(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, fault): header, page_no, hyphen and misread lines of all books."""
    counts = checkpoint(lexicon(lines))
    shared = list(slices(*misread_entries(counts)))
    read = checkpoint(read_pages(lines, shared[0], True))
    misread = read.filter(f"kind = {MISREAD_ROW}")
    for further in shared[1:]:
        misread = misread.unionByName(read_pages(lines, further, False))
    marks = checkpoint(edge_faults(read))
    words = misread.select("doc_id", "line_no", F.lit("misread").alias("fault")).unionByName(joined_words(checkpoint(divided_words(read, marks, counts)))).join(marks.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti")
    # the marks are distinct, and of other faults
    return marks.unionByName(words.distinct())


# Repaired text.


def contexts(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(before, word, n): how often a printed word of several repairs stands behind another word."""
    several = words.groupBy("word").agg(F.collect_set("printed").alias("p")).filter("size(p) > 1").select(F.explode("p").alias("word")).distinct()
    text = F.lower("text")
    found = lines.filter("text is not null").select(F.regexp_extract_all(text, F.lit(rf"([0-9]*[{LETTER}][{LETTER}0-9]*)")).alias("w"))
    pairs = found.select(F.explode(F.arrays_zip(F.expr("slice(w, 1, greatest(size(w) - 1, 0))").alias("before"), F.expr("slice(w, 2, size(w))").alias("word"))).alias("x")).select("x.before", "x.word")
    return pairs.join(broadcast_if_small(checkpoint(several), 64), "word", "left_semi").groupBy("before", "word").agg(F.count("*").alias("n"))


def places(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, start, end, seen, printed, cost): every misread word or character and its repair.

    A word with several repairs takes the one whose pair with the word before is known, then the cheaper one.
    """
    words, triples = misread_entries(counts)
    rows = lines.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), F.col("line_no").cast("long"), "text").filter("doc_id is not null and line_no is not null and text <> ''")
    schema = "doc_id long, page int, line_no long, start int, end int, seen string, before string, options array<struct<cost:double,printed:string>>"
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.struct([("cost", pa.float64()), ("printed", pa.string())]))]

    def finder(shared: Any) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            held, out = shared.value, []
            for doc, page, line, text in zip(*(table[c].to_pylist() for c in ("doc_id", "page", "line_no", "text"))):
                for a, b, before, options in word_repairs(text, held, False, DIVIDED.search(text) is not None):
                    out.append((doc, page, line, a, b, text[a:b], before, [{"cost": c, "printed": w} for c, w in options]))
                if not text.isascii():
                    out += [(doc, page, line, k, k + 1, text[k], "", [{"cost": CONFUSED, "printed": w}]) for k, w in misread_chars(text, held)]
            return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)], names=[x.split()[0] for x in schema.split(", ", 7)])

        return run

    found: DataFrame | None = None
    for shared in slices(words, triples):
        part = mapped(rows, finder(shared), schema)
        found = part if found is None else found.unionByName(part)
    found = checkpoint(found.distinct())
    one = found.filter("size(options) = 1").select("doc_id", "page", "line_no", "start", "end", "seen", F.col("options")[0].alias("o"))
    many = found.filter("size(options) > 1").select("doc_id", "page", "line_no", "start", "end", "seen", "before", F.explode("options").alias("o")).withColumn("word", F.col("o.printed"))
    many = many.join(broadcast_if_small(checkpoint(contexts(lines, words)), 96), ["before", "word"], "left")
    rank = F.struct((F.col("o.cost") - F.when(F.col("n") > 0, CONTEXT).otherwise(0.0)).alias("cost"), (-F.coalesce("n", F.lit(0))).alias("n"), F.col("o.printed").alias("p"))
    best = many.groupBy("doc_id", "page", "line_no", "start", "end", "seen").agg(F.min_by("o", rank).alias("o"))
    return one.unionByName(best).select("doc_id", "page", "line_no", "start", "end", "seen", F.col("o.printed").alias("printed"), F.col("o.cost").alias("cost"))


def scan_repairs(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, start, end, seen, printed, cost) over all lines."""
    return places(lines, checkpoint(lexicon(lines)))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, page, para_no, text): each page as continuous paragraphs, without running titles and page numbers.

    Divided words are joined (a divided word at the end of a page goes whole to
    that page's paragraph only if the page holds its end), misread words repaired.
    Paragraphs of a page are numbered in order, in a long page or without page with gaps.
    """
    counts = checkpoint(lexicon(lines))
    read = checkpoint(read_pages(lines, lines.sparkSession.sparkContext.broadcast(Held({}, {})), True))
    marks = checkpoint(edge_faults(read))
    drop = marks.groupBy("doc_id", "line_no").agg(F.lit(True).alias("drop"))
    divided = divided_words(read, marks, counts).groupBy("doc_id", "line_no").agg(F.max(F.struct("keep", "fixed")).alias("divided"))
    mended = places(lines, counts).groupBy("doc_id", "line_no").agg(F.collect_set(F.struct("start", "end", "printed")).alias("mended"))
    rows = placed_lines(lines).filter("text is not null").join(drop, ["doc_id", "line_no"], "left").filter("drop is null")
    rows = rows.join(mended, ["doc_id", "line_no"], "left").join(divided, ["doc_id", "line_no"], "left").select("doc_id", "page", "line_no", "text", "mended", "divided")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches):
            size = LINES_OF_A_BLOCK if x.page is None else MOST_LINES
            texts = flowing([(repaired_line(t, m or []), d) for t, m, d in zip(x.texts, *x.rest)])
            number = [x.number * size + k for k in range(len(texts))]
            columns = ([x.doc] * len(texts), [x.page] * len(texts), number, texts)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "page", "para_no", "text"])

    return by_page(rows, "text").mapInArrow(run, "doc_id long, page int, para_no long, text string")


def repaired_line(text: str, mended: list[dict[str, Any]]) -> str:
    """The line with its misread words and characters replaced, in the case they had."""
    for x in sorted(mended, key=lambda x: -x["start"]):
        old, new = text[x["start"] : x["end"]], x["printed"]
        text = text[: x["start"]] + (new.upper() if len(old) > 1 and old.isupper() else new.capitalize() if old[:1].isupper() else new) + text[x["end"] :]
    return text


def flowing(lines: list[tuple[str, dict[str, Any] | None]]) -> list[str]:
    """Lines, each with what is known of a word divided at its end, as paragraphs."""
    out: list[str] = []
    widest = max((len(t) for t, _ in lines), default=0)
    open_line, before = False, None
    for text, divided in lines:
        s = STARTS.match(text)
        m = DIVIDED.search(out[-1]) if out and open_line and before else None
        if m and s and before:
            if before["fixed"] and not before["keep"]:
                word = before["fixed"]
                out[-1] = out[-1][: m.start(1)] + (word.capitalize() if m[1][:1].isupper() else word) + text[s.end(1) :]
            else:
                out[-1] = out[-1][: m.start(2)] + ("-" if before["keep"] else "") + text.lstrip()
        elif out and open_line:
            glue = "" if re.search(rf"[{HAN}，。、；：）]$", out[-1]) or re.match(rf"[{HAN}，。、；：）]", text) else " "
            out[-1] = out[-1].rstrip() + glue + text.lstrip()
        else:
            out.append(text)
        before = divided
        # a line that is clearly shorter and ends a sentence ends its paragraph
        open_line = not (len(text) < 0.75 * widest and text.rstrip()[-1:] in ".。!?！？:：")
    return out
