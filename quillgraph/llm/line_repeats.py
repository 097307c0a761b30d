"""Lines repeated across one source's documents.

Method: each partition keeps a mergeable heavy-hitter summary of the line keys of
every source it meets (counters with subtractive pruning, so a count is low by at
most the error kept beside it). Summaries add up by source and key. Every key
whose count plus its source's error could reach the threshold is a candidate; a
second pass counts the candidates exactly, by their text, and the confirmed lines
are taken out of the documents. A source whose error alone reaches the threshold
has all its lines counted, so no line is ever missed.

Defined cases: a null text has no lines but counts as a document of its source; a
null source has no cases and keeps its texts; a line of which nothing remains
without digits and white space is never a case; an empty table gives no rows; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import broadcast_if_small, checkpoint

MIN_DOCS = 5
MIN_SHARE_PERCENT = 10
#: Counters that a partition keeps for a source, and in all before it hands its summaries on.
COUNTERS = 2_048
MOST_COUNTERS = 400_000


def line_key(line: Column) -> Column:
    """A line without the digits 0-9, white space and letter case."""
    return F.lower(F.regexp_replace(line, r"(?U)[0-9\s\x1c-\x1f]+", ""))


def summaries(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(s, k, n): counters of keys (s, keys); a row with k null holds the error of source s."""

    def pruned(held: dict[int, int]) -> int:
        if len(held) <= 2 * counters:
            return 0
        cut = sorted(held.values(), reverse=True)[counters]
        for k in [k for k, n in held.items() if n <= cut]:
            del held[k]
        for k in held:
            held[k] -= cut
        return cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, int]] = {}
        error: dict[int, int] = {}

        def flush() -> pa.RecordBatch:
            rows = [(s, k, n) for s, own in held.items() for k, n in own.items()] + [(s, None, e) for s, e in error.items() if e]
            s, k, n = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["s", "k", "n"])

        for batch in batches:
            lists = batch.column("keys")
            parents = batch.column("s").take(pc.list_parent_indices(lists))
            found = pa.table({"s": parents, "k": lists.flatten()}).group_by(["s", "k"]).aggregate([([], "count_all")])
            for s, k, n in zip(*(found.column(c).to_pylist() for c in ("s", "k", "count_all"))):
                own = held.setdefault(s, {})
                own[k] = own.get(k, 0) + n
            for s, own in held.items():
                if cut := pruned(own):
                    error[s] = error.get(s, 0) + cut
            if sum(map(len, held.values())) > MOST_COUNTERS:
                yield flush()
                held, error = {}, {}
        yield flush()

    return keys.mapInArrow(run, "s long, k long, n long")


def keyed(documents: DataFrame) -> DataFrame:
    return documents.filter("source is not null").select(
        "doc_id", "source", F.xxhash64("source").alias("s"), F.split("text", "\n", -1).alias("lines")
    )


def repeated_lines(documents: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(source, doc_id, line_no, key) of every occurrence of a repeated line."""
    docs = keyed(documents.select("doc_id", "source", "text"))
    keys = docs.filter("lines is not null").select(
        "s",
        F.array_distinct(F.transform(F.filter(F.transform("lines", line_key), lambda k: k != ""), lambda k: F.xxhash64(k))).alias("keys"),
    )
    totals = docs.groupBy("s", "source").agg(F.count("*").alias("docs"))
    enough = F.greatest(F.lit(MIN_DOCS), F.ceil(F.col("docs") * MIN_SHARE_PERCENT / 100)).alias("enough")
    totals = checkpoint(totals.select("s", "source", enough))
    merged = checkpoint(summaries(keys, counters).groupBy("s", "k").agg(F.sum("n").alias("n")))
    errors = merged.filter("k is null").select("s", F.col("n").alias("error"))
    bounds = checkpoint(totals.select("s", "enough").join(errors, "s", "left").fillna(0, ["error"]))
    merged = merged.join(broadcast_if_small(bounds, 32), "s").filter("k is null or n + error >= enough")
    candidates = merged.filter("k is not null").select("s", F.xxhash64(F.lit(0), "s", "k").alias("c"))
    open_sources = merged.filter("k is null and n >= enough").select("s")
    lines = docs.select("s", "source", "doc_id", F.posexplode("lines").alias("pos", "line")).select(
        "s", "source", "doc_id", (F.col("pos") + 1).alias("line_no"), line_key(F.col("line")).alias("key")
    )
    lines = lines.filter("key <> ''").withColumn("c", F.xxhash64(F.lit(0), "s", F.xxhash64("key")))
    wanted = broadcast_if_small(checkpoint(candidates.select("c").distinct()), 16)
    known = lines.join(wanted, "c", "left_semi")
    if not open_sources.isEmpty():
        rest = lines.join(broadcast_if_small(open_sources, 16), "s", "left_semi")
        known = known.join(broadcast_if_small(open_sources, 16), "s", "left_anti").unionByName(rest)
    known = checkpoint(known.select("source", "doc_id", "line_no", "key"))
    exact = known.groupBy("source", "key", "doc_id").agg(F.lit(1).alias("one")).groupBy("source", "key").agg(F.count("*").alias("n"))
    confirmed = exact.join(broadcast_if_small(totals.select("source", "enough"), 64), "source").filter("n >= enough").select("source", "key")
    confirmed = checkpoint(confirmed)
    return known.join(broadcast_if_small(confirmed, 256), ["source", "key"], "left_semi")


def without_repeated_lines(documents: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, text): each text without the repeated lines of its source; null texts stay null."""
    drop = repeated_lines(documents, counters).groupBy("doc_id").agg(F.collect_set("line_no").alias("drop"))
    docs = documents.select("doc_id", "text")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("drop", i + 1)), "\n")
    return docs.join(drop, "doc_id", "left").select("doc_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text"))
