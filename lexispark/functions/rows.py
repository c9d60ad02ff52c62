"""Rows from arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(
    df: DataFrame, keys: Sequence[str | Column], array: Column | str, name: str, pos: str | None = None
) -> DataFrame:
    """keys and one row per element (with its place, if `pos` is given). Elements are never null.

    A plain explode makes the optimizer add a test for empty arrays next to the scan, which computes
    the array again, regular expressions included. The outer form with a test on the element does not.
    """
    generated = F.posexplode_outer(array).alias(pos, name) if pos else F.explode_outer(array).alias(name)
    return df.select(*keys, generated).where(F.col(name).isNotNull())
