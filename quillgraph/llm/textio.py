"""Arrow helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mapped(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str, batch: int = 2_000) -> DataFrame:
    """Apply f to Arrow tables of about batch rows; a row is never split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for at in range(0, held.num_rows, batch):
                out = f(pa.Table.from_batches([held.slice(at, batch)]))
                yield from out.combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and the start of each text (one more than texts)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def distinct_documents(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns of documents with an id; doc_id is unique, so no shuffle is spent on it."""
    return df.select("doc_id", *columns).filter(F.col("doc_id").isNotNull())
