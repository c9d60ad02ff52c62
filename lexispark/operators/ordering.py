"""Limits, shuffles, samples and running totals that need no single sorted task.

Order-dependent results are computed in two levels: a small table of totals per bucket, where a
bucket is a range of the order, and a window inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw_below, draw_key
from ..session import stored

# 65,536 ranges of a uniform md5 key; a bucket table of this size is always safe to broadcast.
DRAW_BUCKET_DIGITS = 4


def running_total(
    df: DataFrame,
    value: Column | str,
    order: Sequence[str],
    bucket: Column,
    keys: Sequence[str] = (),
    name: str = "before",
) -> DataFrame:
    """Add `name`: the sum of `value` over the rows before this one, per `keys`, in `order`.

    `bucket` must grow with the order. Windows run inside one bucket, so a key that holds most
    rows is still spread over many tasks; only the bucket table is scanned in key order.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    part = [*keys, "_bucket"]
    sums = rows.groupBy(*part).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*part, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return (
        rows.join(starts, part)
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_bucket", "_value", "_start", "_inside")
    )


def dense_index(
    df: DataFrame, order: Sequence[str], bucket: Column, keys: Sequence[str] = (), name: str = "row_no"
) -> DataFrame:
    """Add consecutive 0-based numbers in `order`, per `keys`."""
    return running_total(df, F.lit(1).cast("long"), order, bucket, keys, name)


def seeded_shuffle(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """All rows in a random but repeatable order: a range-partitioned sort by md5."""
    return df.withColumn("draw", draw_key(key, seed)).orderBy("draw")


def shuffle_rank(df: DataFrame, key: Column, seed: int, name: str = "shuffled_pos") -> DataFrame:
    """The position every row gets in `seeded_shuffle`, without a global sort."""
    drawn = df.withColumn("draw", draw_key(key, seed))
    bucket = F.substring("draw", 1, DRAW_BUCKET_DIGITS)
    return dense_index(drawn, ["draw"], bucket, name=name)


def first_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in the given order (0 or None: all)."""
    if not n:
        return df
    return df.orderBy(*order).limit(n)


def exact_sample(
    df: DataFrame, n: int, key: Column, seed: int, by: Sequence[str] = ()
) -> DataFrame:
    """Exactly n rows (per `by`, all of them if there are fewer), drawn without replacement.

    The bucket counts tell in which bucket the n-th smallest draw lies. Without `by` that is one number, so rows of other
    buckets are kept or dropped next to the scan and only those of the cut bucket are shuffled and ranked.
    """
    drawn = df.withColumn("draw", draw_key(key, seed)).withColumn(
        "_bucket", F.substring("draw", 1, DRAW_BUCKET_DIGITS)
    )
    part = [*by, "_bucket"]
    counts = drawn.groupBy(*part).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_upto") - F.col("_n")
    cut = counts.withColumn("_upto", F.sum("_n").over(upto)).where(before < n)
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("draw"))
    if not by:
        # The last bucket that is reached, if the rows before it do not fill the sample with it: one row.
        last = cut.where(F.col("_upto") > n).select(F.struct("_bucket", (n - before).alias("_need")).alias("last")).scalar()
        whole = drawn.where(F.coalesce(F.col("_bucket") < last["_bucket"], F.lit(True)))
        # Buckets past a cut that is filled exactly are dropped as well.
        filled = cut.agg(F.max("_bucket")).scalar()
        whole = whole.where(F.col("_bucket") <= filled)
        partial = drawn.where(F.col("_bucket") == last["_bucket"]).withColumn("_rank", rank).where(F.col("_rank") <= last["_need"])
        return whole.drop("draw", "_bucket").unionByName(partial.drop("draw", "_bucket", "_rank"))
    kept = drawn.join(cut.withColumn("_need", F.lit(n) - before), part)
    whole = kept.where(F.col("_n") <= F.col("_need"))
    partial = (
        kept.where(F.col("_n") > F.col("_need"))
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= F.col("_need"))
        .drop("_rank")
    )
    return whole.unionByName(partial).drop("draw", "_bucket", "_n", "_upto", "_need")


def percent_split(df: DataFrame, key: Column, percent: float, seed: int, name: str = "split") -> DataFrame:
    """Label `percent` of the rows 'validation' and the rest 'train'."""
    chosen = draw_below(draw_key(key, seed), percent / 100)
    return df.withColumn(name, F.when(chosen, F.lit("validation")).otherwise(F.lit("train")))


def top_n(df: DataFrame, n: int, value: str, tie: str) -> DataFrame:
    """The n rows with the largest integer `value`, ties by `tie` ascending, for large n.

    Works on the table of distinct values: values that fit whole are kept whole and only the
    rows of the one value at the cut are sorted.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    upto = Window.orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .where(F.col("_upto") - F.col("_n") < n)
        .withColumn("_need", F.lit(n) - (F.col("_upto") - F.col("_n")))
    )
    kept = df.join(cut, value)
    whole = kept.where(F.col("_n") <= F.col("_need"))
    rank = F.row_number().over(Window.partitionBy(value).orderBy(tie))
    partial = kept.where(F.col("_n") > F.col("_need")).withColumn("_rank", rank)
    partial = partial.where(F.col("_rank") <= F.col("_need")).drop("_rank")
    return whole.unionByName(partial).drop("_n", "_upto", "_need")


def largest_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows in `order`, which should end with a key, for large n.

    Rows are sorted into ranges once; the sizes of the ranges tell which one is cut, and only that one is sorted and limited.
    `df` is read twice, as ranges are drawn from a sample: hand in one that is cheap to read.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    whole, left = -1, n
    for at in sorted(sizes):
        if sizes[at] > left:
            part = ranged.where(F.col("_range") == at).orderBy(*order).limit(left)
            return ranged.where(F.col("_range") <= whole).unionByName(part).drop("_range")
        whole, left = at, left - sizes[at]
    return ranged.drop("_range")


def start_lines(docs: DataFrame, bucket_width: int = 100_000) -> DataFrame:
    """1-based line where each document begins: every document takes its lines and a blank one."""
    placed = running_total(
        docs,
        (F.size("lines") + 1).cast("long"),
        ["doc_ord"],
        F.floor(F.col("doc_ord") / bucket_width),
        ["src"],
        "_lines_before",
    )
    return placed.withColumn("start_line", F.col("_lines_before") + 1).drop("_lines_before")
