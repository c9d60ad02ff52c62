"""Reproducible randomness: every draw is an md5 of stable keys, never of row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(*parts: Column | str | int) -> Column:
    """32 hex digits that act as one uniform draw per distinct combination of parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary"))


def hex_threshold(share: float) -> str:
    """The 8-digit hex bound below which a draw falls with probability `share`."""
    return format(min(int(share * 2**32), 2**32 - 1), "08x")


def draw_below(key: Column, share: float) -> Column:
    """True with probability `share`; a plain string comparison."""
    if share >= 1:
        return F.lit(True)
    return F.substring(key, 1, 8) < F.lit(hex_threshold(share))


def draw_int(key: Column, n: int, offset: int = 0) -> Column:
    """An integer in 0..n-1 from six hex digits of a draw, starting at digit `offset`."""
    return F.conv(F.substring(key, offset + 1, 6), 16, 10).cast("int") % F.lit(n)
