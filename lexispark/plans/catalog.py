"""All queries, gathered."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from . import io_queries, label_queries, model_queries, result_queries, stats_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "ship_package"]

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lexispark-")) / "lexispark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in package.rglob("*.py"):
            z.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
