"""The corpus pipeline: toxic documents go, repeated lines go, near copies go, leaked benchmarks go, the rest is packed.

Each stage is written as Parquet and read again as the documents of the next.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent)
if _ROOT not in sys.path:
    sys.path.insert(0, _ROOT)

from lexispark.llm import decontaminate, line_dedup, ngram_join, packing, toxicity  # noqa: E402
from lexispark.llm.common import table, written  # noqa: E402
from lexispark.plans.catalog import ship_package  # noqa: E402


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labels that are not held out, does not call toxic."""
    ship_package(spark)
    return toxicity.without_toxic(docs, toxicity.fit_from_tables(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those of which nothing is left go."""
    ship_package(spark)
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    ship_package(spark)
    return ngram_join.one_of_each(docs, ngram_join.Similar(words=5, percent=80))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words (or a whole shorter item) of the benchmark."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents placed in sequences of 1024 tokens."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack_tokens),
]

#: Fuzzy lines, trained scores and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
