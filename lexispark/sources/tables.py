"""Labelled tables and experiment results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve_columns(columns: Sequence[str], task: str, text: str | None = None, label: str | None = None) -> tuple[str, str]:
    """Text and label columns: by explicit name, else by the usual name, else by position."""
    text = text or ("tokens" if "tokens" in columns else columns[0])
    usual = f"{task}_tags"
    label = label or (usual if usual in columns else columns[1])
    return text, label


def read_labelled(spark: SparkSession, path: str, schema: T.StructType | str, file_format: str | None = None) -> DataFrame:
    """A CSV or JSON dataset with an explicit schema."""
    kind = file_format or path.rsplit(".", 1)[-1]
    if kind == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    if kind == "json":
        return spark.read.schema(schema).json(path)
    raise ValueError(f"expected a csv or json file, not {kind}")


def labelled_corpus(spark: SparkSession, root: str, task: str, lang: str, split: str) -> DataFrame:
    """One configuration of a corpus stored by (task, lang, split): read by partition pruning."""
    rows = spark.read.parquet(root)
    return rows.where((F.col("task") == task) & (F.col("lang") == lang) & (F.col("split") == split))


# A directory may be plain or of the form name=value.
RESULT_PATH = r"/(?:[^/=]+=)?([^/]+)_seed([0-9]+)/(?:[^/=]+=)?([^/]+)/(?:[^/=]+=)?([^/]+)/[^/]+$"


def read_results(spark: SparkSession, root: str, metric: str) -> DataFrame:
    """model, seed, lang_src, lang_tgt, value from one JSON file per cell; the keys are in the path."""
    rows = spark.read.schema(f"`eval_{metric}` double").json(f"{root}/*/*/*/*.json")
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    keys = {"model": 1, "seed": 2, "lang_src": 3, "lang_tgt": 4}
    cols = [F.regexp_extract(path, RESULT_PATH, i).alias(k) for k, i in keys.items()]
    out = rows.select(*cols, F.col(f"eval_{metric}").alias("value"))
    return out.withColumn("seed", F.col("seed").cast("int"))


def experiment_grid(dims: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every combination of the distinct values of some columns.

    The values of a grid dimension are few by nature; they are gathered into one row of arrays
    and exploded one after the other.
    """
    grid = dims.select(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns])
    for c in columns:
        grid = grid.withColumn(c, F.explode(c))
    return grid


def missing_cells(grid: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of the grid that have no result: the work that is left."""
    return grid.join(present.select(*keys).distinct(), list(keys), "left_anti")
