"""Array columns: model inputs, masks, argmax. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_right(ids: Column, length: Column | int, value: int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0))))


def round_up(size: Column, multiple: int) -> Column:
    """The next multiple of `multiple`."""
    return (F.ceil(size / multiple) * multiple).cast("int")


def argmax(scores: Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def unit_length(v: Column) -> Column:
    """Divide by the Euclidean norm; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x.cast("double")
    )


def pair_features(a: Column, b: Column) -> Column:
    """Both vectors and their elementwise product, one after the other."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: x * y))
