"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def _scrambled(x: Column) -> Column:
    """A bijection of 64-bit numbers by shifts, so that the order of nodes is as good as random."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp for every node of `links`; comp is the smallest node that can be reached.

    Nodes get scrambled names. Each round every node is hooked to its smallest neighbour, if that is smaller; hooks are
    followed four steps up; links are renamed to where their ends lead, and those inside one place fall away. In a random
    order chains of hooks are short, so the links shrink by a factor each round. Neighbours of a node meet as partial
    minima, never in one task, and the tables of a round are in the shared folder.
    """
    ends = links.select(_scrambled(F.col(a)).alias("x"), _scrambled(F.col(b)).alias("y"), F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    ends = written(ends, "links")
    nodes = ends.select(F.col("a").alias("node"), F.col("x").alias("at")).unionByName(ends.select(F.col("b").alias("node"), F.col("y").alias("at"))).distinct()
    open_links = _oriented(ends.select("x", "y"))
    steps = []
    while open_links.limit(1).count():
        hooks = written(open_links.groupBy(F.col("high").alias("at")).agg(F.min("low").alias("up")), "hooks")
        for _ in range(2):
            above = hooks.select(F.col("at").alias("up"), F.col("up").alias("top"))
            hooks = written(hooks.join(above, "up", "left").select("at", F.coalesce("top", "up").alias("up")), "hooks")
        steps.append(hooks)
        x = hooks.select(F.col("at").alias("low"), F.col("up").alias("x"))
        y = hooks.select(F.col("at").alias("high"), F.col("up").alias("y"))
        renamed = open_links.join(x, "low", "left").join(y, "high", "left")
        open_links = _oriented(renamed.select(F.coalesce("x", "low").alias("x"), F.coalesce("y", "high").alias("y")))
    labels = nodes
    for hooks in steps:
        labels = labels.join(hooks, "at", "left").select("node", F.coalesce("up", "at").alias("at"))
    labels = written(labels, "labels")
    least = labels.groupBy("at").agg(F.min("node").alias("comp"))
    return labels.join(least, "at").select("node", "comp")


def _oriented(links: DataFrame) -> DataFrame:
    """Distinct links (low, high) between different ends."""
    pairs = links.where("x <> y").select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"))
    return written(pairs.distinct(), "links")
