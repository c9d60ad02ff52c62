"""Streams of text. The text functions are stateless column expressions, so they run on a stream as
they do on a table; counts of a stream are kept as partial counts, one table per batch, that can be summed at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import analyzed_words
from ..operators.counting import add_counts, token_counts


def count_stream(stream: DataFrame, text: str, path: str, checkpoint: str) -> StreamingQuery:
    """Write the word counts of each batch of new documents; stops when all present input is done.

    A batch is written under its number and replaces what an interrupted try has left there, so each document counts
    exactly once. Words are summed before they are written: a batch takes one row per distinct word.
    """

    def write(batch: DataFrame, number: int) -> None:
        counts = token_counts(batch.select(analyzed_words(F.col(text)).alias("words")), [], "words")
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def corpus_counts(spark: SparkSession, path: str) -> DataFrame:
    """The corpus counter as of now."""
    return add_counts(spark.read.schema("token string, cnt long, batch long").parquet(path), [])
