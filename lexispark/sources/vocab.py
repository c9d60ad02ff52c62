"""Vocabulary tables: (tokenizer, piece_id, piece, score, type)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of pieces that are not ordinary text.
UNKNOWN = "<unk>"
CONTROL = ("<s>", "</s>")


def piece_type(piece: Column) -> Column:
    return (
        F.when(piece == UNKNOWN, F.lit("UNKNOWN")).when(piece.isin(*CONTROL), F.lit("CONTROL")).otherwise(F.lit("NORMAL"))
    )


def _tsv_rows(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Rows split at the last tab. The order is that of the file: see `sources.text`."""
    from .text import raw_lines

    rows = raw_lines(spark, paths)
    pattern = r"^([\s\S]*)\t([^\t]*)$"
    return rows.select(
        "src",
        F.col("line_no").cast("int").alias("piece_id"),
        F.regexp_extract("line", pattern, 1).alias("piece"),
        F.regexp_extract("line", pattern, 2).cast("double").alias("score"),
    )


def read_vocab(spark: SparkSession, path: str, with_scores: bool = True) -> DataFrame:
    """One vocabulary file: `piece <tab> score` per line; pieces may hold tabs themselves."""
    rows = _tsv_rows(spark, path).drop("src")
    rows = rows.withColumn("type", piece_type(F.col("piece")))
    return rows if with_scores else rows.drop("score")


def read_vocabs(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Many vocabularies keyed by tokenizer name, and the names whose path does not exist."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        p = hadoop.Path(path)
        return p.getFileSystem(conf).exists(p)

    found = {name: path for name, path in paths.items() if exists(path)}
    missing = [name for name in paths if name not in found]
    if not found:
        raise FileNotFoundError("none of the vocabularies exists")
    parts = [read_vocab(spark, path).withColumn("tokenizer", F.lit(name)) for name, path in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, missing


def listing(vocab: DataFrame) -> DataFrame:
    """Pieces in id order."""
    return vocab.orderBy("tokenizer", "piece_id")


def vocab_from_pairs(pairs: DataFrame, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """A vocabulary from (piece, score) pairs whose place is given by an integer column."""
    return pairs.select(
        *keys, F.col(order).cast("int").alias("piece_id"), "piece", F.col("score").cast("double").alias("score"),
        piece_type(F.col("piece")).alias("type"),
    )


def with_specials(vocab: DataFrame, specials: Sequence[str]) -> DataFrame:
    """Put special pieces first, per tokenizer, and shift the other ids."""
    names = F.array(*[F.lit(s) for s in specials])
    first = (
        vocab.select("tokenizer").distinct()
        .select("tokenizer", F.posexplode(names).alias("piece_id", "piece"))
        .withColumn("score", F.lit(0.0))
    )
    shifted = vocab.select("tokenizer", (F.col("piece_id") + len(specials)).cast("int").alias("piece_id"), "piece", "score")
    both = first.unionByName(shifted)
    special = F.when(F.col("piece") == UNKNOWN, F.lit("UNKNOWN")).when(F.col("piece").isin(*specials), F.lit("CONTROL"))
    return both.withColumn("type", F.coalesce(special, F.lit("NORMAL")))
