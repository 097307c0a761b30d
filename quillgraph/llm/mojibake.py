"""Text garbled by decoding with the wrong character encoding.

Method: adjacent character pairs (those with a non-ASCII character) are scored by
their contribution to the corpus' mutual information, n(xy) log(n(xy) n / (n(x)
n(y))), over all documents. Pairs that contribute less than a fixed share of the
sum are improbable. Maximum-scoring segments over these scores isolate improbable
runs, and inverse mappings (encode with a wrongly used codec, decode with the
right one) are tested inside those runs only: on the characters of the segment,
carried on over neighbours that the codec in question can have produced. A
mapping is taken if it decodes and its result fits the corpus better.

Three kinds of mappings: bytes read one by one, over the runs of characters that
one-byte codecs know; bytes read in pairs, over the valid sequences among the
bytes of a segment's stretch; and, where only single accents are odd, one codec of
one byte for another, decided once a text over all its segments together.

What is broadcast has a proven bound: at most 1 / SHARE pairs can be probable, and
at most 1 / FLOOR pairs reach the share FLOOR of all pairs from which a pair counts
for the fit; counts enter as multiples of that floor, so all decisions depend on
shares alone and are the same at every size of the corpus.

Defined cases: null and empty texts are no cases; plain ASCII is never a case;
bytes that the wrong decoding lost stand as U+FFFD, which is improbable beside
anything, makes its text a case and stays; texts of any length are read whole;
repeated rows count once.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.textio import code_points, mapped
from quillgraph.runtime import broadcast_if_small, checkpoint

CHARS = 0x110000
#: A pair that adds less than this share to the corpus' mutual information is improbable.
SHARE = 5e-5
#: The same in a text of which a wrong mapping is known already.
SHARE_KNOWN = 2e-3
#: Pairs and characters below this share of all count as never seen where the fit is measured.
FLOOR = 1e-6
GAIN, LOSS = 1.0, 0.6
#: How much better, in bits of the mean share, a restored run must fit; a valid UTF-8 sequence hardly comes by chance.
BETTER, VALID = 1.0, 2.0
#: Accents that are decided together over a text: so many segments at least, each so much better.
TOGETHER, MUCH_BETTER = 3, 3.0
#: Distinct pairs that a task counts before it hands them on, and runs whose outcome a process keeps.
MOST_COUNTED, MOST_KEPT = 500_000, 200_000
#: Codecs with which bytes are wrongly read: those of one byte a character and the others.
SINGLE = ("latin-1", "cp1252", "cp437", "mac_roman", "cp1251", "koi8-r", "cp850", "iso8859-15", "cp1250", "iso8859-2")
DOUBLE = ("gb18030", "cp932", "cp950", "cp949", "euc_jp")
RIGHT = ("utf-8", "gb18030", "cp950", "cp932")
#: One-byte codecs of European text.
EUROPEAN = ("cp1252", "mac_roman", "cp850", "cp437")
#: What a two-byte codec cannot encode: lost bytes and controls that stand for a byte.
LOST = re.compile("([\ufffd\x80-\x9f])")
FOREIGN = re.compile(r"[^\x00-\x7f]+")
#: At least two characters of several bytes, in UTF-8.
SEQUENCES = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){2,}")


class Model:
    """Shares of characters and of pairs with a non-ASCII character, and which pairs are probable."""

    def __init__(self, chars: np.ndarray, codes: np.ndarray, shares: np.ndarray, information: np.ndarray):
        #: Bits above the floor of each character; codes of the probable pairs, sorted, by the share they must reach.
        self.chars = chars
        self.probable = {least: np.sort(codes[information >= least]) for least in (SHARE, SHARE_KNOWN)}
        self.pairs = dict(zip(codes.tolist(), np.log2(1.0 + shares / FLOOR).tolist()))
        #: Runs that no codec turns into anything, kept while a process lives.
        self.closed: set[str] = set()

    def close(self, run: str) -> None:
        if len(self.closed) < MOST_KEPT:
            self.closed.add(run)

    def improbable(self, left: np.ndarray, right: np.ndarray, share: float = SHARE) -> np.ndarray:
        probable = self.probable[share]
        if not len(probable):
            return np.ones(len(left), dtype=bool)
        codes = left.astype(np.int64) << 21 | right
        at = np.minimum(np.searchsorted(probable, codes), len(probable) - 1)
        # a lost byte is improbable beside anything
        return (probable[at] != codes) | (left == 0xFFFD) | (right == 0xFFFD)

    def fit(self, text: str) -> float:
        """Mean bits of the shares of a text's characters and pairs."""
        if not text:
            return 0.0
        points = [0 if c == "\ufffd" else ord(c) for c in text]
        one = sum(self.chars[c] for c in points) / len(points)
        found = [self.pairs.get(a << 21 | b, 0.0) for a, b in zip(points, points[1:]) if a > 0x7F or b > 0x7F or not a or not b]
        return (one + (sum(found) / len(found) if found else one)) / 2

    def usual(self, text: str) -> bool:
        """No pair of the text with a non-ASCII character is improbable."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        both = (c[:-1] > 0x7F) | (c[1:] > 0x7F)
        return not self.improbable(c[:-1][both], c[1:][both]).any()


def foreign_pairs(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the pairs with a non-ASCII character; a pair lies within one text."""
    near = (points[:-1] > 0x7F) | (points[1:] > 0x7F)
    ends = starts[1:-1]
    near[ends[(ends > 0) & (ends < len(points))] - 1] = False
    return np.flatnonzero(near)


def counted(documents: DataFrame) -> DataFrame:
    """(kind, code, n): counts of characters (kind 0) and of pairs (kind 1) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, pairs = np.zeros(CHARS, dtype=np.int64), [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)]

        def rows(kind: int, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, dtype=np.int32)), pa.array(code), pa.array(n)], names=["kind", "code", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                points, starts = code_points(batch.column("text").slice(at, 2_000).to_pylist())
                if not len(points):
                    continue
                high = int(points.max()) + 1
                chars[:high] += np.bincount(points, minlength=high)
                place = foreign_pairs(points, starts)
                code, n = np.unique(points[place].astype(np.int64) << 21 | points[place + 1], return_counts=True)
                both = np.concatenate([pairs[0], code])
                code, back = np.unique(both, return_inverse=True)
                pairs = [code, np.bincount(back, weights=np.concatenate([pairs[1], n]), minlength=len(code)).astype(np.int64)]
                if len(code) > MOST_COUNTED:
                    yield rows(1, *pairs)
                    pairs = [code[:0], code[:0]]
        yield rows(1, *pairs)
        seen = np.flatnonzero(chars)
        yield rows(0, seen, chars[seen])

    docs = documents.select("text").filter("text <> ''")
    return docs.mapInArrow(run, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def pair_information(counts: DataFrame) -> DataFrame:
    """(code, n, bits, sure): each pair's contribution to the mutual information of neighbouring characters.

    sure is the contribution with the lower bound of the count, n - 2 sqrt(n): few occurrences say nothing yet.
    """
    pairs = counts.filter("kind = 1").select("code", "n", F.shiftright("code", 21).alias("x"), F.col("code").bitwiseAND(0x1FFFFF).alias("y"))
    # as many sums as there are characters at most
    left, right = (pairs.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in ("x", "y"))
    total = pairs.agg(F.sum("n").cast("double").alias("total"))
    held = pairs.join(broadcast_if_small(left, 16), "x").join(broadcast_if_small(right, 16), "y").join(F.broadcast(total))
    point = F.greatest(F.lit(0.0), F.log2(F.col("n") * F.col("total") / (F.col("n_x") * F.col("n_y").cast("double"))))
    return held.select("code", "n", (F.col("n") * point).alias("bits"), (F.greatest(F.lit(0.0), F.col("n") - 2 * F.sqrt("n")) * point).alias("sure"))


def model(documents: DataFrame) -> Model:
    """Shares of characters, and of the pairs above the floor; at most 1 / FLOOR pairs reach it."""
    counts = checkpoint(counted(documents))
    rows = counts.filter("kind = 0").toArrow()
    chars = np.zeros(CHARS, dtype=np.int64)
    chars[rows["code"].to_numpy()] = rows["n"].to_numpy()
    pairs = checkpoint(pair_information(counts))
    sums = pairs.agg(F.sum("n").alias("n"), F.sum("bits").alias("bits")).first()
    n, bits = float(sums["n"] or 1), float(sums["bits"] or 0)
    held = pairs.filter((F.col("n") >= FLOOR * n) | (F.col("sure") >= SHARE * bits)).toArrow()
    code, share = held["code"].to_numpy(), held["n"].to_numpy() / n
    return Model(np.log2(1.0 + chars / (FLOOR * max(1, chars.sum()))), code, share, held["sure"].to_numpy() / max(bits, 1e-9))


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal maximum-scoring segments [a, b) of a sequence, in linear time."""
    found: list[tuple[int, int, float, float]] = []
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = (k, k + 1, before, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
    return [(a, b) for a, b, _, _ in found]


def odd_segments(odd: np.ndarray) -> list[tuple[int, int]]:
    """Segments [a, b) of pairs, from the sorted places of a text's improbable pairs.

    Neighbouring improbable pairs count as one score, and so do the pairs between.
    """
    cut = np.flatnonzero(np.diff(odd) > 1)
    first, last = odd[np.concatenate([[0], cut + 1])], odd[np.append(cut, len(odd) - 1)] + 1
    if len(first) == 1:
        return [(int(first[0]), int(last[0]))]
    scores = np.empty(2 * len(first) - 1)
    scores[::2] = GAIN * (last - first)
    scores[1::2] = -LOSS * (first[1:] - last[:-1])
    return [(int(first[a // 2]), int(last[(b - 1) // 2])) for a, b in segments(scores.tolist())]


@functools.cache
def byte_map(codec: str) -> dict[int, bytes]:
    """Characters of a one-byte codec; bytes without a character stand as the control of their number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            char = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            char = chr(b)
        out.setdefault(ord(char), bytes([b]))
    return out


def encoded(run: str, codec: str) -> bytes | None:
    """The bytes that the codec read as run; U+FFFD stands for a lost byte, 0xFF."""
    if codec in SINGLE:
        table, out = byte_map(codec), bytearray()
        for char in run:
            if char < "\x80":
                out += char.encode()
            elif char == "�":
                out += b"\xff"
            elif (b := table.get(ord(char))) is not None:
                out += b
            else:
                return None
        return bytes(out)
    if not LOST.search(run):
        try:
            return run.encode(codec)
        except UnicodeEncodeError:
            return None
    out = bytearray()
    for part in LOST.split(run):
        if part == "�":
            out += b"\xff"
        elif len(part) == 1 and "\x80" <= part <= "\x9f":
            out.append(ord(part))
        elif part:
            try:
                out += part.encode(codec)
            except UnicodeEncodeError:
                return None
    return bytes(out)


Mapping = tuple[str, str]


def inverse(run: str, codec: str, right: str, sure: bool) -> str | None:
    """run encoded with codec and decoded with right, if that is possible; sure: the mapping is known to hold."""
    raw = encoded(run, codec)
    return None if raw is None else decoded(run, raw, right, sure)


def decoded(run: str, raw: bytes, right: str, sure: bool) -> str | None:
    try:
        out = raw.decode(right)
    except UnicodeDecodeError:
        # bytes were lost, or the run begins or ends within a character
        out = raw.decode(right, "replace")
        bad = out.count("�")
        if "�" in run:
            good = sum(len(c.encode()) for c in out if c > "\x7f" and c != "�")
            if right != "utf-8" or not good or good < 0.4 * sum(b > 0x7F for b in raw):
                return None
        elif right != "utf-8" or bad > (0.5 if sure else 0.12) * sum(c > "\x7f" for c in out):
            return None
    if out == run or any(c < " " and c not in "\t\n\r" for c in out) or (right != "utf-8" and any("\x80" <= c < "\xa0" for c in out)):
        return None
    return out


@functools.cache
def known_characters(codec: str) -> frozenset[str]:
    return frozenset(map(chr, byte_map(codec))) | {"\ufffd"} | frozenset(map(chr, range(0x80)))


@functools.cache
def byte_like() -> dict[str, int]:
    """The non-ASCII characters of one-byte codecs, each with the set of its codecs as bits."""
    out: dict[str, int] = defaultdict(int)
    for k, codec in enumerate(SINGLE):
        for point in byte_map(codec):
            out[chr(point)] |= 1 << k
    out["\ufffd"] = (1 << len(SINGLE)) - 1
    return dict(out)


class Found(NamedTuple):
    """A span of a text, what it was read from, and the mapping that says so."""

    start: int
    end: int
    text: str
    way: Mapping


def byte_runs(text: str, a: int, b: int) -> list[tuple[int, int, int]]:
    """(start, end, codecs) of the characters of one-byte codecs in [a, b), carried on to both sides."""
    known, out, k = byte_like(), [], a
    while k < b:
        codecs = known.get(text[k])
        if codecs is None:
            k += 1
            continue
        start, end = k, k + 1
        while start and (more := known.get(text[start - 1])) is not None:
            start, codecs = start - 1, codecs & more
        while end < len(text) and (more := known.get(text[end])) is not None:
            end, codecs = end + 1, codecs & more
        out.append((start, end, codecs))
        k = end
    return out


def around(text: str, a: int, b: int, new: str) -> str:
    """new between the neighbours of [a, b), without what was lost."""
    return text[max(0, a - 1) : a] + new.replace("\ufffd", "") + text[b : b + 1]


def read_by_bytes(text: str, a: int, b: int, codecs: int, m: Model, held: list[Mapping], depth: int = 0) -> Found | None:
    """The best inverse of a run of characters of one-byte codecs; held are the only mappings tried, where there are some."""
    run, best = text[a:b], None
    for codec, right in held:
        if codec in SINGLE and codecs >> SINGLE.index(codec) & 1 and (new := inverse(run, codec, right, True)) is not None and m.fit(around(text, a, b, new)) + 1.5 > m.fit(around(text, a, b, run)):
            return read_again(Found(a, b, new, (codec, right)), text, m, depth)
    if held or run in m.closed:
        return None
    least = -1.0
    for k, codec in enumerate(SINGLE):
        if not codecs >> k & 1 or (raw := encoded(run, codec)) is None:
            continue
        for right in RIGHT if len(run) >= 4 and "\ufffd" not in run else RIGHT[:1]:
            if (new := decoded(run, raw, right, False)) is None:
                continue
            if least < 0:
                least = m.fit(around(text, a, b, run)) + BETTER
            x = Found(a, b, new, (codec, right))
            fits = m.fit(around(text, a, b, new)) + VALID * (right == "utf-8")
            if right == "utf-8" and FOREIGN.search(new):
                # what was encoded twice may fit only when it is read back twice
                x = read_again(x, text, m, depth)
                fits = max(fits, m.fit(around(text, a, b, x.text)) + VALID)
            if fits > least:
                best, least = x, fits
    if least < 0:
        m.close(run)
    return best


def read_by_pairs(text: str, a: int, b: int, m: Model, held: list[Mapping]) -> Found | None:
    """The best inverse of the two-byte codecs: the whole stretch, or the valid sequences among its bytes."""
    run, best, fit = text[a:b], None, -1.0
    known = {codec for codec, _ in held}
    # with the sign behind, which may be taken in, and marked apart from the runs of single bytes
    mark = text[a : b + 1] + "\0"
    if not held and mark in m.closed:
        return None
    open_run = False
    for codec in DOUBLE:
        if (held and codec not in known) or (raw := encoded(run, codec)) is None:
            continue
        valid = [x.span() for x in SEQUENCES.finditer(raw)]
        whole = codec in known or b - a < 4 or 2 * sum(e - s for s, e in valid) >= len(raw)
        if not whole and not valid:
            continue
        if fit < 0:
            fit = m.fit(around(text, a, b, run))
        least = fit + BETTER if best is None else best[0]
        for end in ((b, b + 1) if b < len(text) else (b,)) if whole else ():
            # a two-byte codec may have taken a plain character in
            if (new := inverse(text[a:end], codec, "utf-8", codec in known)) is None:
                continue
            open_run = True
            if sum(c > "\x7f" for c in new) < 2 and codec not in known and not m.usual(around(text, a, end, new)):
                continue
            fits = m.fit(around(text, a, end, new)) + VALID
            if fits > least:
                best, least = (fits, Found(a, end, new, (codec, "utf-8"))), fits
            break
        if best is not None:
            continue
        for x, y in valid:
            # the characters that lie wholly in the sequence
            before, inside = raw[:x].decode(codec, "ignore"), raw[x:y].decode(codec, "ignore")
            open_run = True
            s, e = a + len(before), min(b, a + len(before) + len(inside))
            if e - s < 3 or (new := inverse(text[s:e], codec, "utf-8", False)) is None or "\ufffd" in new:
                continue
            if m.fit(around(text, s, e, new)) > m.fit(around(text, s, e, text[s:e])) + BETTER:
                return Found(s, e, new, (codec, "utf-8"))
    if not held and not open_run:
        m.close(mark)
    return best and best[1]


def read_again(x: Found, text: str, m: Model, depth: int) -> Found:
    """What was encoded twice is mapped twice."""
    if depth < 2 and FOREIGN.search(x.text):
        whole = text[max(0, x.start - 1) : x.start], x.text, text[x.end : x.end + 1]
        a, joined = len(whole[0]), "".join(whole)
        spans = [r for r in byte_runs(joined, a, a + len(x.text)) if r[2]]
        new = [y for s, e, codecs in spans if (y := read_by_bytes(joined, s, e, codecs, m, [], depth + 1)) is not None]
        if not new and (y := read_by_pairs(joined, a, a + len(x.text), m, [])) is not None and y.end <= a + len(x.text):
            new = [y]
        if new := [y for y in new if y.start >= a and y.end <= a + len(x.text)]:
            return read_again(Found(x.start, x.end, spliced(joined, new)[a : len(joined) - len(whole[2]) + sum(len(y.text) - (y.end - y.start) for y in new)], x.way), text, m, depth + 1)
    return x


def spliced(text: str, found: list[Found]) -> str:
    out, at = [], 0
    for x in sorted(found):
        out += [text[at : x.start], x.text]
        at = x.end
    return "".join([*out, text[at:]])


def undone(text: str, a: int, b: int, m: Model, held: list[Mapping], tried: set[tuple[int, int]]) -> list[Found]:
    """The spans of an improbable segment [a, b) that an inverse mapping fits better; tried are the stretches looked at."""
    out: list[Found] = []
    for s, e, codecs in byte_runs(text, a, b):
        if codecs and (x := read_by_bytes(text, s, e, codecs, m, held)) is not None:
            out.append(x)
    if not out:
        for x in FOREIGN.finditer(text, a, b):
            # the stretch goes on over what stands beside the segment
            s, e = x.start(), x.end()
            while s and text[s - 1] > "\x7f":
                s -= 1
            while e < len(text) and text[e] > "\x7f":
                e += 1
            if (s, e) in tried:
                continue
            tried.add((s, e))
            if (y := read_by_pairs(text, s, e, m, held)) is not None:
                out.append(read_again(y, text, m, 0))
    return out


def accents(text: str, spans: list[tuple[int, int]], m: Model) -> list[Found]:
    """One European codec read as another: single accents say little, so all odd ones of the text decide together."""
    runs = {(s, e): c for a, b in spans for s, e, c in byte_runs(text, a, b)}
    if len(runs) < TOGETHER:
        return []
    best: tuple[float, list[Found]] = (MUCH_BETTER * len(runs), [])
    for codec in EUROPEAN:
        if not all(c >> SINGLE.index(codec) & 1 for c in runs.values()):
            continue
        for right in EUROPEAN:
            new = [] if right == codec else [Found(s, e, y, (codec, right)) for s, e in runs if (y := inverse(text[s:e], codec, right, True)) is not None and y.isalpha()]
            if len(new) < len(runs):
                continue
            gain = sum(m.fit(around(text, x.start, x.end, x.text)) - m.fit(around(text, x.start, x.end, text[x.start : x.end])) for x in new)
            if gain > best[0]:
                best = gain, new
    return best[1]


def garbled_spans(texts: list[str], m: Model, plain: set[str]) -> list[list[Found]]:
    """Of each text the spans that an inverse mapping restores.

    plain keeps the segments found to be no garbled ones, between calls.
    """
    points, starts = code_points(texts)
    if len(points) < 2:
        return [[] for _ in texts]
    place = foreign_pairs(points, starts)
    odd = place[m.improbable(points[place], points[place + 1])]
    bounds, near = np.searchsorted(odd, starts), np.searchsorted(place, starts)
    out: list[list[Found]] = []
    for k, text in enumerate(texts):
        own = odd[bounds[k] : bounds[k + 1]] - starts[k]
        found: list[Found] = []
        # a pair's number is that of its left character
        spans = [(a, b + 1) for a, b in odd_segments(own)] if len(own) else []
        held: list[Mapping] = []
        for again in range(2):
            if again:
                # once a mapping is known, short runs and frequent garbled pairs are looked at too
                if not held:
                    break
                pairs = place[near[k] : near[k + 1]]
                own = pairs[m.improbable(points[pairs], points[pairs + 1], SHARE_KNOWN)] - starts[k]
                spans = [(a, b + 1) for a, b in odd_segments(own)]
            tried: set[tuple[int, int]] = set()
            for a, b in spans:
                mark = text[max(0, a - 2) : b + 2]
                if not again and mark in plain:
                    continue
                new = [x for x in undone(text, a, b, m, held if again else [], tried) if not any(x.start < y.end and y.start < x.end for y in found)]
                held += [x.way for x in new if x.way not in held]
                found += new
                if not new and not again and len(plain) < MOST_KEPT:
                    plain.add(mark)
        found = found or accents(text, spans, m)
        out.append(sorted(x for x in found if x.text != text[x.start : x.end]))
    return out


def repaired(texts: list[str], m: Model, plain: set[str] | None = None) -> list[str]:
    """Each text with its garbled runs restored; a text without one comes back as the same object."""
    return [spliced(text, found) if found else text for text, found in zip(texts, garbled_spans(texts, m, set() if plain is None else plain))]


def shared_model(docs: DataFrame) -> Any:
    return docs.sparkSession.sparkContext.broadcast(model(docs))


def repaired_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text, garbled): the restored texts of all documents."""
    docs = documents.select("doc_id", "text").filter("doc_id is not null")
    shared, plain = shared_model(docs), set()

    def run(held: pa.Table) -> pa.Table:
        texts = held["text"].to_pylist()
        full = [t or "" for t in texts]
        new = repaired(full, shared.value, plain)
        # a lost byte makes its segment a garbled one, though nothing can restore it
        garbled = [a is not b or "\ufffd" in a for a, b in zip(full, new)]
        return pa.table({"doc_id": held["doc_id"], "text": [None if t is None else n for t, n in zip(texts, new)], "garbled": garbled})

    return mapped(docs, run, "doc_id long, text string, garbled boolean")


def garbled_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, start, end, was, now, codec, right): every restored run, its place in code points, and its mapping."""
    docs = documents.select("doc_id", "text").filter("doc_id is not null and text <> ''")
    shared, plain = shared_model(docs), set()

    def run(held: pa.Table) -> pa.Table:
        texts = held["text"].to_pylist()
        rows = [
            (doc, x.start, x.end, text[x.start : x.end], x.text, *x.way)
            for doc, text, found in zip(held["doc_id"].to_pylist(), texts, garbled_spans(texts, shared.value, plain))
            for x in found
        ]
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names=["doc_id", "start", "end", "was", "now", "codec", "right"])

    return mapped(docs, run, "doc_id long, start int, end int, was string, now string, codec string, right string")
