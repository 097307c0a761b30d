"""The whole corpus as token ids of a public byte-level BPE tokenizer.

Method: the texts are cut into words by the tokenizer's pattern and only distinct
words are encoded. A word is an array of byte pieces; a fold with Spark's
higher-order functions merges, step by step, the leftmost pair of least rank,
looking ranks up in a literal map, until no pair has a rank. The literal is an
array of small maps by hash, as a single map would be searched entry by entry.
Words and their ids come back to the texts through a dictionary of the most
frequent words, whose size is bounded; the rest of the words (none in a corpus
with fewer distinct words than the bound) are merged in place by the same rule.
Decoding concatenates the tokens' binary pieces.

Defined cases: empty and null texts give the empty list; strings that read like
special tokens are ordinary text; a text is taken as stored, of any length.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.textio import mapped
from quillgraph.runtime import checkpoint, spread

#: Where the public vocabularies lie; a parameter of every function here.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's published cutting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words, by frequency, whose ids are held in memory, and characters of the longest of them: the fold is
#: quadratic in a word's length, beyond it the same merges are made with a heap.
DICTIONARY_WORDS = 500_000
LONGEST_WORD = 64
#: Distinct words that a task counts before it hands them on.
MOST_COUNTED = 400_000
MAPS = 16_384
NO_RANK = 1 << 30


@functools.cache
def ranks(directory: str, vocabulary: str) -> dict[bytes, int]:
    with open(os.path.join(directory, vocabulary), "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def merged(word: bytes, rank: dict[bytes, int]) -> array:
    """Ids of a word: the leftmost pair of least rank is merged until none has a rank."""
    parts = [word[k : k + 1] for k in range(len(word))]
    if len(parts) > 256:
        return merged_long(parts, rank)
    while len(parts) > 1:
        best, at = min((rank.get(parts[k] + parts[k + 1], NO_RANK), k) for k in range(len(parts) - 1))
        if best == NO_RANK:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return array("i", [rank[p] for p in parts])


def merged_long(parts: list[bytes], rank: dict[bytes, int]) -> array:
    """As merged(), with a heap over linked pieces, for words of any length."""
    import heapq

    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, k, parts[k], parts[k + 1]) for k in range(len(parts) - 1) if (r := rank.get(parts[k] + parts[k + 1])) is not None]
    heapq.heapify(heap)
    alive = [True] * len(parts)
    while heap:
        _, k, left, right = heapq.heappop(heap)
        n = after[k]
        if not alive[k] or n >= len(parts) or parts[k] != left or parts[n] != right:
            continue
        parts[k], alive[n], after[k] = left + right, False, after[n]
        if after[n] < len(parts):
            before[after[n]] = k
        for a in (before[k], k):
            if a >= 0 and after[a] < len(parts) and (r := rank.get(parts[a] + parts[after[a]])) is not None:
                heapq.heappush(heap, (r, a, parts[a], parts[after[a]]))
    return array("i", [rank[p] for p, x in zip(parts, alive) if x])


def rank_of(piece: Column, literal: Column) -> Column:
    held = F.element_at(literal, (F.pmod(F.crc32(piece.cast("binary")), F.lit(MAPS)) + 1).cast("int"))
    return F.coalesce(F.try_element_at(held, piece), F.lit(NO_RANK))


def rank_literal(rank: dict[bytes, int]) -> Column:
    """The ranks as a literal: array of maps by hash of the piece; a byte is the character of its number."""
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for piece, r in rank.items():
        text = piece.decode("latin-1")
        maps[zlib.crc32(text.encode()) % MAPS][text] = r
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def folded_ids(word: Column, rank: dict[bytes, int]) -> Column:
    """Ids of a word by a fold of ranked merges over its byte pieces."""
    literal = rank_literal(rank)
    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    pieces = F.split(latin, "")
    pieces = F.filter(pieces, lambda p: p != "")
    none = F.array().cast("array<int>")

    def pair_ranks(parts: Column) -> Column:
        pairs = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts) - 1), lambda a, b: F.concat(a, b))
        return F.when(F.size(parts) > 1, F.transform(pairs, lambda p: rank_of(p, literal))).otherwise(none)

    def step(state: Column, _: Column) -> Column:
        parts, held = state["parts"], state["ranks"]
        least = F.array_min(held)
        at = F.array_position(held, least).cast("int")
        joined = F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))
        left = F.slice(parts, 1, at - 1)
        right = F.slice(parts, at + 2, F.size(parts))
        near = F.concat(
            F.when(at > 1, F.array(F.concat(F.element_at(parts, F.greatest(at - 1, F.lit(1))), joined))).otherwise(F.array().cast("array<string>")),
            F.transform(F.slice(right, 1, 1), lambda p: F.concat(joined, p)),
        )
        fresh = F.concat(F.slice(held, 1, F.greatest(at - 2, F.lit(0))), F.transform(near, lambda p: rank_of(p, literal)), F.slice(held, at + 2, F.size(held)))
        new = F.struct(F.concat(left, F.array(joined), right).alias("parts"), fresh.alias("ranks"))
        return F.when((F.size(held) > 0) & (least < NO_RANK), new).otherwise(state)

    start = F.struct(pieces.alias("parts"), pair_ranks(pieces).alias("ranks"))
    steps = F.when(F.size(pieces) > 1, F.sequence(F.lit(2), F.size(pieces))).otherwise(none)
    folded = F.aggregate(steps, start, step, lambda s: F.transform(s["parts"], lambda p: rank_of(p, literal)))
    # a word that is a piece itself is that piece, as the merges that made it would say
    whole = rank_of(latin, literal)
    return F.when(whole < NO_RANK, F.array(whole)).otherwise(folded)


def word_counts(documents: DataFrame, longest: int | None = None) -> DataFrame:
    """(word, n): every distinct word; with longest, those of at most so many characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(PATTERN)
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(cut.findall(text))
            if len(counts) > MOST_COUNTED:
                yield flush()
                counts.clear()
        yield flush()

    words = documents.select("text").filter("text <> ''").mapInArrow(run, "word string, n long")
    if longest is not None:
        words = words.filter(F.length("word") <= longest)
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def folded_words(documents: DataFrame, directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, n, ids): every distinct word, however rare or long, with its ids; by the fold up to LONGEST_WORD characters, beyond by the same merges with a heap."""
    counts = checkpoint(word_counts(documents))
    rank = ranks(directory, vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast(rank)

    def run(held: pa.Table) -> pa.Table:
        ids = [merged(word.encode(), shared.value) for word in held["word"].to_pylist()]
        return held.append_column("ids", pa.array(ids, pa.list_(pa.int32())))

    short = spread(counts.filter(F.length("word") <= LONGEST_WORD), "word").select("word", "n", folded_ids(F.col("word"), rank).alias("ids"))
    long = mapped(spread(counts.filter(F.length("word") > LONGEST_WORD), "word"), run, "word string, n long, ids array<int>", 500)
    return short.unionByName(long)


def dictionary(documents: DataFrame, directory: str = TOKENIZERS, vocabulary: str = VOCABULARY, most: int = DICTIONARY_WORDS) -> DataFrame:
    """(word, ids) of the most frequent distinct words, at most `most` of them."""
    counts = checkpoint(word_counts(documents, LONGEST_WORD))
    if counts.count() > most:
        counts = counts.orderBy(F.desc("n"), "word").limit(most)
    return checkpoint(counts.select("word", folded_ids(F.col("word"), ranks(directory, vocabulary)).alias("ids")))


class Words(dict[str, bytes]):
    """Ids of known words as bytes; another word is merged when it is asked for."""

    def __init__(self, known: dict[str, bytes], rank: dict[bytes, int]):
        super().__init__(known)
        self.rank = rank

    def __missing__(self, word: str) -> bytes:
        return merged(word.encode(), self.rank).tobytes()


def token_ids(documents: DataFrame, directory: str = TOKENIZERS, vocabulary: str = VOCABULARY, most: int = DICTIONARY_WORDS) -> DataFrame:
    """(doc_id, ids) of every document."""
    docs = documents.select("doc_id", "text")
    known = {r.word: np.asarray(r.ids, dtype=np.int32).tobytes() for r in dictionary(docs, directory, vocabulary, most).toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast((known, ranks(directory, vocabulary)))
    tools: list[tuple[Callable[[str], list[str]], Callable[[str], bytes]]] = []

    def run(held: pa.Table) -> pa.Table:
        if not tools:
            tools.append((regex.compile(PATTERN).findall, Words(*shared.value).__getitem__))
        cut, ids_of = tools[0]
        flat = [b"".join(map(ids_of, cut(text))) if text else b"" for text in held["text"].to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in flat])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), dtype=np.int32)))
        return pa.table({"doc_id": held["doc_id"], "ids": ids})

    return mapped(docs, run, "doc_id long, ids array<int>", 500)


def decoded(tokens: DataFrame, directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): the texts of ids, by concatenating the tokens' binary pieces."""
    rank = ranks(directory, vocabulary)
    pieces: list[str | None] = [None] * (max(rank.values()) + 1)
    for piece, r in rank.items():
        pieces[r] = piece.decode("latin-1")
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    joined = F.array_join(F.transform("ids", lambda i: F.element_at(literal, i + 1)), "")
    return tokens.select("doc_id", F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8").alias("text"))
