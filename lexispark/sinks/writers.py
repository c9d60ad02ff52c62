"""Writers. Every result is written by many tasks; nothing is gathered first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_clusters(docs: DataFrame, path: str, cluster: str = "cluster") -> None:
    """One directory per cluster with its documents as lines, each followed by a blank line."""
    body = F.concat(F.array_join("lines", "\n"), F.when(F.size("lines") > 0, "\n").otherwise(""))
    docs.select(F.col(cluster).alias("cluster"), body.alias("value")).write.partitionBy("cluster").text(path)


def document_place(src: Column, start_line: Column) -> Column:
    return F.concat_ws(":", src, start_line)


def write_document_labels(docs: DataFrame, path: str, label: str) -> None:
    """`src:line <tab> label` per document."""
    rows = docs.select(document_place(F.col("src"), F.col("start_line")).alias("place"), F.col(label))
    rows.write.option("sep", "\t").csv(path)


def write_json_record(row: DataFrame, path: str) -> None:
    """A one-row frame of metrics as one JSON record."""
    row.coalesce(1).write.json(path)


def write_table(df: DataFrame, path: str) -> None:
    """Weights, embeddings and fitted tables (terms, components)."""
    df.write.parquet(path)


def _ordered_by_id(vocab: DataFrame) -> DataFrame:
    """Each vocabulary in one task, in id order: vocabularies are small, their file is ordered."""
    return vocab.repartition("tokenizer").sortWithinPartitions("tokenizer", "piece_id")


def write_vocabs_tsv(vocab: DataFrame, path: str) -> None:
    """`piece <tab> score` lines in id order, one directory per tokenizer."""
    line = F.concat("piece", F.lit("\t"), F.col("score").cast("string"))
    _ordered_by_id(vocab).select("tokenizer", line.alias("value")).write.partitionBy("tokenizer").text(path)


def write_vocabs_json(vocab: DataFrame, path: str) -> None:
    """One {piece, id} record per line in id order, one directory per tokenizer."""
    record = F.to_json(F.struct("piece", F.col("piece_id").alias("id")))
    _ordered_by_id(vocab).select("tokenizer", record.alias("value")).write.partitionBy("tokenizer").text(path)


def write_label_lines(df: DataFrame, path: str, labels: str, order: Sequence[str]) -> None:
    """One line of space-joined labels per sequence, in order."""
    df.orderBy(*order).select(F.array_join(labels, " ").alias("value")).write.text(path)


def write_predictions_tsv(df: DataFrame, path: str, index: str, prediction: str) -> None:
    rows = df.orderBy(index).select(F.col(index).alias("index"), F.col(prediction).alias("prediction"))
    rows.write.option("sep", "\t").option("header", True).csv(path)


def metric_records(scores: DataFrame, lang: str, metrics: Sequence[str]) -> DataFrame:
    """metric, lang, eval: one row per metric and language."""
    return scores.unpivot([lang], list(metrics), "metric", "value").withColumnRenamed(lang, "lang")


def write_metric_records(scores: DataFrame, path: str, lang: str, metrics: Sequence[str]) -> None:
    """One {"eval_<metric>": value} record per metric and language."""
    rows = metric_records(scores, lang, metrics)
    record = F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("eval_"), "metric")), F.array("value")))
    rows.select("metric", "lang", record.alias("value")).write.partitionBy("metric", "lang").text(path)


def write_results(results: DataFrame, path: str, metric: str) -> None:
    """One directory per grid cell: model_seed<seed>, source language, target language."""
    cell = F.concat(F.col("model"), F.lit("_seed"), F.col("seed").cast("string"))
    rows = results.select(cell.alias("run"), "lang_src", "lang_tgt", F.col("value").alias(f"eval_{metric}"))
    rows.repartition("run").write.partitionBy("run", "lang_src", "lang_tgt").json(path)
