"""Evaluation texts that leak into training text.

Method: winnowing. Of a text's letters and digits, in lower case, every K-gram is
hashed and the least hash of each window of W grams is kept. Two texts that share
a run of K + W - 1 = 40 characters share a whole window and so its least hash;
no shared run of that length is missed. Fingerprints of documents are joined with
those of the items, and each hit is extended to both sides; only runs of at least
40 characters count.

The items' fingerprints are broadcast while they fit a checked bound; beyond it
documents' fingerprints are joined with them by a shuffle.

Defined cases: null, empty and short texts share nothing; repeated rows count
once; other columns are never read.
"""

from __future__ import annotations

import functools
import unicodedata
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.textio import code_points, mapped
from quillgraph.runtime import broadcast_if_small, checkpoint

SHARED = 40
K = 20
W = SHARED - K + 1
#: Bytes of item texts whose fingerprints are broadcast.
BROADCAST_ITEM_BYTES = 8 * 1024 * 1024
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def letters() -> np.ndarray:
    """Code point to its lower-case code point if it is a letter or digit (Unicode L or N), else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in [*range(0x32400), *range(0xE0000, 0xE0200)]:
        char = chr(c)
        if unicodedata.category(char)[0] in "LN":
            low = char.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def alphanumeric(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of all texts, and the start of each text among them."""
    points, starts = code_points(texts)
    kept = letters()[points]
    mask = kept != 0
    before = np.concatenate([[0], np.cumsum(mask)])
    return kept[mask], before[starts]


def grams(codes: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each run of k codes, by doubling."""
    power, size, done = {1: codes.astype(np.uint64) * MULTIPLIER ^ (codes.astype(np.uint64) >> np.uint64(3))}, 1, 0
    with np.errstate(over="ignore"):
        while 2 * size <= k:
            h = power[size]
            power[2 * size] = h[:-size] * np.uint64(0xD6E8FEB86659FD93 + 2 * size) + h[size:] if len(h) > size else h[:0]
            size *= 2
        out = None
        for size in sorted(power, reverse=True):
            if done + size <= k:
                h = power[size]
                out = h if out is None else out[: max(0, len(h) - done)] * np.uint64(0xC2B2AE3D27D4EB4F) + h[done:][: len(out)]
                done += size
        if out is None:
            return np.zeros(0, dtype=np.uint64)
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def window_minima(h: np.ndarray, w: int = W) -> np.ndarray:
    low, size = h, 1
    while 2 * size <= w:
        low = np.minimum(low[:-size], low[size:]) if len(low) > size else low[:0]
        size *= 2
    rest = w - size
    return np.minimum(low[:-rest], low[rest:]) if rest and len(low) > rest else low[:0] if rest else low


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and starts as of alphanumeric(); hash, text and place of each fingerprint."""
    codes, starts = alphanumeric(texts)
    h = grams(codes)
    if not len(h):
        none = np.zeros(0, dtype=np.int64)
        return codes, starts, none.astype(np.uint64), none, none
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    whole = owner[: len(h)] == owner[K - 1 :][: len(h)]
    # grams over two texts never win a window within one text
    low = window_minima(np.where(whole, h, np.uint64(0xFFFFFFFFFFFFFFFF)))
    inside = owner[: len(low)] == owner[SHARED - 1 :][: len(low)]
    low = low[inside[: len(low)]] if len(inside) >= len(low) else low[:0]
    at = np.flatnonzero(whole & np.isin(h, np.unique(low)))
    return codes, starts, h[at], owner[at], at


class Items:
    """The item side: fingerprints in order of hash, with the item and place of each."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        self.codes, self.starts, h, owner, at = fingerprints(texts)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.at = h[order], owner[order], at[order]


def shared_run(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """Length of the equal run through a[i] and b[j]."""
    n = min(len(a) - i, len(b) - j)
    differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
    ahead = int(differ[0]) if len(differ) else n
    n = min(i, j)
    differ = np.flatnonzero(a[i - n : i][::-1] != b[j - n : j][::-1])
    return ahead + (int(differ[0]) if len(differ) else n)


def leaks(ids: list[int], texts: list[str], items: Items) -> list[tuple[int, int]]:
    codes, starts, h, owner, at = fingerprints(texts)
    left, right = np.searchsorted(items.hash, h, "left"), np.searchsorted(items.hash, h, "right")
    out: set[tuple[int, int]] = set()
    for k in np.flatnonzero(right > left):
        doc = int(owner[k])
        own = codes[starts[doc] : starts[doc + 1]]
        for hit in range(left[k], right[k]):
            item = int(items.owner[hit])
            pair = (ids[doc], items.ids[item])
            if pair not in out:
                other = items.codes[items.starts[item] : items.starts[item + 1]]
                if shared_run(own, int(at[k] - starts[doc]), other, int(items.at[hit] - items.starts[item])) >= SHARED:
                    out.add(pair)
    return list(out)


def leaked(documents: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id): a document and an item that share a run of at least 40 letters or digits."""
    docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > broadcast_bytes:
        return joined_leaks(docs, items)
    rows = items.orderBy("item_id").collect()
    shared = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))
    built: dict[str, Items] = {}

    def run(held: pa.Table) -> pa.Table:
        if "items" not in built:
            built["items"] = Items(*shared.value)
        pairs = leaks(held["doc_id"].to_pylist(), held["text"].to_pylist(), built["items"])
        return pa.table({"doc_id": pa.array([d for d, _ in pairs], pa.int64()), "item_id": pa.array([i for _, i in pairs], pa.int64())})

    return mapped(docs, run, "doc_id long, item_id long").distinct()


def fingerprint_table(df: DataFrame, key: str) -> DataFrame:
    """(h, key, place) of every fingerprint."""

    def run(held: pa.Table) -> pa.Table:
        ids = np.asarray(held[key].to_pylist(), dtype=np.int64)
        _, starts, h, owner, at = fingerprints(held["text"].to_pylist())
        return pa.table({"h": pa.array(h.astype(np.int64)), key: pa.array(ids[owner]), "place": pa.array(at - starts[owner])})

    return mapped(df, run, f"h long, {key} long, place long")


def joined_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As leaked(), with the fingerprints of both sides joined by a shuffle."""
    hits = fingerprint_table(docs, "doc_id").join(fingerprint_table(items, "item_id").withColumnRenamed("place", "item_place"), "h")
    pairs = checkpoint(hits.groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("place", "item_place")).alias("places")))
    texts = pairs.join(docs, "doc_id").join(broadcast_if_small(items.withColumnRenamed("text", "item_text"), 4096), "item_id")

    def run(held: pa.Table) -> pa.Table:
        rows: list[dict[str, Any]] = held.to_pylist()
        kept = []
        for r in rows:
            (a, _), (b, _) = alphanumeric([r["text"]]), alphanumeric([r["item_text"]])
            if any(shared_run(a, p["place"], b, p["item_place"]) >= SHARED for p in r["places"]):
                kept.append(r)
        return pa.table({"doc_id": pa.array([r["doc_id"] for r in kept], pa.int64()), "item_id": pa.array([r["item_id"] for r in kept], pa.int64())})

    return mapped(texts, run, "doc_id long, item_id long").distinct()
