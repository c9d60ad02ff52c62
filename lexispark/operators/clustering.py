"""k-means over dense vectors, and measures of a clustering."""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import squared_distance
from ..functions.rows import explode_rows
from ..session import checkpointed
from .ordering import exact_sample


def kmeans(df: DataFrame, vector: str, k: int, starts: int = 20, seed: int = 0, max_iter: int = 100) -> tuple[DataFrame, KMeansModel]:
    """Label every row by the best of several k-means runs, and the model."""
    rows = df.withColumn("_features", array_to_vector(F.col(vector))).persist()
    best = None
    try:
        for start in range(starts):
            model = KMeans(k=k, seed=seed + start, maxIter=max_iter, featuresCol="_features", predictionCol="cluster").fit(rows)
            cost = model.summary.trainingCost
            if best is None or cost < best[0]:
                best = (cost, model)
    finally:
        rows.unpersist()
    model = best[1]
    labelled = model.transform(df.withColumn("_features", array_to_vector(F.col(vector)))).drop("_features")
    return labelled, model


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """label, centroid: the mean vector of each label."""
    rows = explode_rows(df, [label], vector, "_x", "_i")
    means = rows.groupBy(label, "_i").agg(F.avg("_x").alias("_m"))
    packed = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return packed.select(label, F.col("_v._m").alias("centroid"))


def assign_nearest(df: DataFrame, vector: str, centers: DataFrame, label: str) -> DataFrame:
    """One assignment step: the label of the nearest centroid, the smallest label on ties.

    The k centroids travel as one array value; the distance is a native expression.
    """
    table = centers.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c")))))
    rows = df.withColumn("_centers", table.scalar())
    scored = F.transform(
        "_centers", lambda c: F.struct(squared_distance(F.col(vector), c["c"]).alias("d"), c["l"].alias("l"))
    )
    best = F.array_min(scored)
    return rows.withColumn("_best", best).select(
        *df.columns, F.col("_best.l").alias("cluster"), F.sqrt(F.col("_best.d")).alias("distance")
    )


def contingency(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("c"), F.col(cluster).alias("k")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Homogeneity, completeness, V-measure and adjusted Rand index, as one row."""
    table = contingency(df, truth, cluster)
    by_c = table.groupBy("c").agg(F.sum("n").alias("nc"))
    by_k = table.groupBy("k").agg(F.sum("n").alias("nk"))
    cells = table.join(by_c, "c").join(by_k, "k")

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    def plogp(n: Column, total: Column) -> Column:
        return -F.sum(n / total * F.ln(n / total))

    both = cells.withColumn("total", table.agg(F.sum("n")).scalar()).agg(
        (-F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") / F.col("nk")))).alias("h_c_k"),
        (-F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") / F.col("nc")))).alias("h_k_c"),
        F.sum(pairs(F.col("n"))).alias("a"),
        F.max("total").alias("total"),
    )
    total = F.col("total")
    rows_c = by_c.withColumn("total", by_c.agg(F.sum("nc")).scalar())
    rows_k = by_k.withColumn("total", by_k.agg(F.sum("nk")).scalar())
    row = (
        both.withColumn("h_c", rows_c.agg(plogp(F.col("nc"), total)).scalar())
        .withColumn("h_k", rows_k.agg(plogp(F.col("nk"), total)).scalar())
        .withColumn("b", by_c.agg(F.sum(pairs(F.col("nc")))).scalar())
        .withColumn("c", by_k.agg(F.sum(pairs(F.col("nk")))).scalar())
    )
    homogeneity = F.when(F.col("h_c") == 0, 1.0).otherwise(1 - F.col("h_c_k") / F.col("h_c"))
    completeness = F.when(F.col("h_k") == 0, 1.0).otherwise(1 - F.col("h_k_c") / F.col("h_k"))
    expected = F.col("b") * F.col("c") / pairs(total.cast("double"))
    gap = (F.col("b") + F.col("c")) / 2 - expected
    rand = F.when(gap == 0, 1.0).otherwise((F.col("a") - expected) / gap)
    row = row.select(homogeneity.alias("homogeneity"), completeness.alias("completeness"), rand.alias("adjusted_rand"))
    h, c = F.col("homogeneity"), F.col("completeness")
    return row.withColumn("v_measure", F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c)))


BLOCK_ROWS = 512


def _dense(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _sparse_distances(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Distances of sparse rows, through a term index of the right side."""
    ids = np.concatenate([np.asarray(v, dtype=np.int64) for v in right["ids"]])
    rows = np.repeat(np.arange(len(right)), [len(v) for v in right["ids"]])
    vals = np.concatenate([np.asarray(v, dtype=np.float64) for v in right["weights"]])
    order = np.argsort(ids, kind="stable")
    ids, rows, vals = ids[order], rows[order], vals[order]
    norm_r = np.bincount(rows, weights=vals * vals, minlength=len(right))
    out = np.empty((len(left), len(right)))
    for i, (li, lw) in enumerate(zip(left["ids"], left["weights"])):
        li, lw = np.asarray(li, dtype=np.int64), np.asarray(lw, dtype=np.float64)
        lo, hi = np.searchsorted(ids, li, "left"), np.searchsorted(ids, li, "right")
        sizes = hi - lo
        at = np.repeat(hi - sizes.cumsum(), sizes) + np.arange(sizes.sum())
        dots = np.bincount(rows[at], weights=np.repeat(lw, sizes) * vals[at], minlength=len(right))
        out[i] = np.sqrt(np.maximum(norm_r + (lw * lw).sum() - 2 * dots, 0.0))
    return out


def silhouette(df: DataFrame, key: str, cluster: str, sample_size: int, seed: int, vector: str | None = None) -> DataFrame:
    """Mean silhouette (Euclidean) over a sample, as one row.

    Vectors are dense (`vector`) or sparse (columns ids, weights). The sample is cut into blocks;
    every task compares one block with one other and returns sums per cluster, so no task or
    driver holds the sample and no row pairs are emitted. A lone member of a cluster scores 0.
    """
    columns = [vector] if vector else ["ids", "weights"]
    rows = df.select(F.col(key).alias("_key"), F.col(cluster).alias("_cluster"), *columns)
    sample = checkpointed(exact_sample(rows, sample_size, F.col("_key"), seed))
    n_blocks = max(1, math.ceil(sample.count() / BLOCK_ROWS))
    block = F.pmod(F.xxhash64("_key"), F.lit(n_blocks))
    others = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>"))
    left = sample.select("*", block.alias("_a"), others.alias("_b"))
    # Renamed copies: both sides come from the same table.
    right = sample.select(*[F.col(c).alias(c) for c in sample.columns], block.alias("_b"), others.alias("_a"))
    schema = f"_key {dict(rows.dtypes)['_key']}, _own {dict(rows.dtypes)['_cluster']}, _other {dict(rows.dtypes)['_cluster']}, _sum double, _n long"

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"_key": [], "_own": [], "_other": [], "_sum": [], "_n": []})
        dist = distances(_dense(a[vector]), _dense(b[vector])) if vector else _sparse_distances(a, b)
        groups, place = np.unique(b["_cluster"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(a), len(groups)))
        for g in range(len(groups)):
            sums[:, g] = dist[:, place == g].sum(axis=1)
        sizes = np.bincount(place, minlength=len(groups))
        return pd.DataFrame(
            {
                "_key": np.repeat(a["_key"].to_numpy(), len(groups)),
                "_own": np.repeat(a["_cluster"].to_numpy(), len(groups)),
                "_other": np.tile(groups, len(a)),
                "_sum": sums.ravel(),
                "_n": np.tile(sizes, len(a)),
            }
        )

    sums = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(compare, schema)
    sums = sums.groupBy("_key", "_own", "_other").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    own = F.col("_own") == F.col("_other")
    per_row = sums.groupBy("_key").agg(
        F.max(F.when(own, F.col("_n"))).alias("_size"),
        F.max(F.when(own & (F.col("_n") > 1), F.col("_sum") / (F.col("_n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("_sum") / F.col("_n"))).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    score = F.when((F.col("_size") == 1) | (F.greatest(a, b) == 0), 0.0).otherwise((b - a) / F.greatest(a, b))
    return per_row.agg(F.avg(score).alias("silhouette"))
