"""Incremental forms: glyph votes that grow with each batch of pages, entries of a stream of lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.functions import ids
from quillgraph.operators.glyphs import votes
from quillgraph.runtime import delete_at_end, shared_folder


def vote_stream(pages: DataFrame, path: str, checkpoint_dir: str) -> StreamingQuery:
    """Append each batch's votes below path; read_votes() adds them up.

    Votes are counts, so batches only add; a batch that is written again after a
    failure replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        votes(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def read_votes(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).groupBy("glyph", "cand").agg(F.sum("n").alias("n"))


def labelled_lines(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Labelled lines of a stream of lines (with read_at), each once within the watermark."""
    held = lines.withWatermark("read_at", late).dropDuplicatesWithinWatermark(["doc_id", "line_no"])
    parsed = held.withColumn("q", ids.question_line(F.col("text"))).filter("q is not null")
    return parsed.select("doc_id", "line_no", "page", F.col("q.id").alias("label"), F.col("q.body").alias("body"), "read_at")


def labels_per_window(lines: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """(window, doc_id, n): labelled lines by the time they were read."""
    return labelled_lines(lines, late).groupBy(F.window("read_at", window), "doc_id").agg(F.count("*").alias("n"))


def drained(stream: DataFrame) -> DataFrame:
    """What an appending stream gives for all that is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/quillgraph-stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    for folder in (path, f"{path}-state"):
        delete_at_end(spark, folder)
    return spark.read.schema(stream.schema).parquet(path)


def lines_stream(spark: SparkSession, path: str) -> DataFrame:
    """The lines at path, a folder of files or one file, as a stream with the schema they have."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files.getFileStatus(held).isDirectory():
        return reader.parquet(path)
    # a stream's source is a folder
    return reader.option("pathGlobFilter", held.getName()).parquet(held.getParent().toString())
