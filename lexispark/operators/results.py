"""Analytics over experiment results (model, seed, lang_src, lang_tgt, value)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import draw_key
from ..functions.rows import explode_rows
from ..session import checkpointed
from .ordering import running_total

# Bootstrap replicates per regime, and the model families of the focused views.
REPLICATES = {"in": 100, "en_all": 300, "en_other": 300, "cross": 30}
FAMILIES = ("Chung", "beta", "k_")


def with_regimes(results: DataFrame, pivot: Column, regimes: Sequence[str] = tuple(REPLICATES)) -> DataFrame:
    """One row per result and regime it belongs to; `pivot` is the language transfer starts from.

    Every regime is then computed in the same pass, grouped by `regime`. Within a regime the pair
    (lang_src, lang_tgt) says as much as the one language that varies, so pairs serve as cells throughout.
    """
    src, tgt, start = F.col("lang_src"), F.col("lang_tgt"), F.col("_start")
    tests = {
        "in": src == tgt,
        "en_all": src == start,
        "en_other": (src == start) & (tgt != start),
        "cross": src != tgt,
    }
    tags = F.array_compact(F.array(*[F.when(tests[r], F.lit(r)) for r in regimes]))
    rows = explode_rows(results.withColumn("_start", pivot), ["*"], tags, "regime")
    return rows.drop("_start")


def model_means(results: DataFrame, keys: Sequence[str] = ("regime",)) -> DataFrame:
    return results.groupBy(*keys, "model").agg(F.avg("value").alias("mean_value"))


def bootstrap(results: DataFrame, replicates: dict[str, int] = REPLICATES) -> DataFrame:
    """regime, model, replicate, mean_value: each replicate draws one seed per cell and averages the cells."""
    last = F.lit(0)
    for regime, n in replicates.items():
        last = F.when(F.col("regime") == regime, n - 1).otherwise(last)
    rows = results.withColumn("replicate", F.explode(F.sequence(F.lit(0), last)))
    draw = draw_key(*[F.col(c) for c in ("model", "lang_src", "lang_tgt", "replicate", "seed")])
    picks = rows.groupBy("regime", "model", "lang_src", "lang_tgt", "replicate").agg(F.min_by("value", draw).alias("value"))
    return picks.groupBy("regime", "model", "replicate").agg(F.avg("value").alias("mean_value"))


def replicate_spread(replicates: DataFrame) -> DataFrame:
    return replicates.groupBy("regime", "model").agg(
        F.avg("mean_value").alias("boot_mean"), F.stddev_samp("mean_value").alias("boot_sd")
    )


def display_range(means: DataFrame) -> DataFrame:
    """The span of the means, extended by its own width on both sides."""
    low, high = F.min("mean_value"), F.max("mean_value")
    return means.groupBy("regime").agg((low - (high - low)).alias("y_min"), (high + (high - low)).alias("y_max"))


def with_language_stats(results: DataFrame, stats: DataFrame) -> DataFrame:
    """Left join of tokenizer statistics on (model, lang_tgt); equal names get a suffix on each side."""
    clash = [c for c in stats.columns if c in results.columns and c != "model"]
    left = results.withColumnsRenamed({c: f"{c}_results" for c in clash})
    right = stats.withColumnsRenamed({c: f"{c}_tok" for c in clash} | {"lang": "lang_tgt"})
    return left.join(right, ["model", "lang_tgt"], "left")


def with_pair_stats(results: DataFrame, stats: DataFrame) -> DataFrame:
    return results.join(stats, ["model", "lang_src", "lang_tgt"], "left")


def delta_over_baseline(results: DataFrame, baseline: str, by: Sequence[str], value: str = "value") -> DataFrame:
    """Add the baseline mean per `by`, and the difference to it. The baseline side has one row per `by`."""
    base = results.where(F.col("model") == baseline).groupBy(*by).agg(F.avg(value).alias(f"{value}_baseline"))
    joined = results.join(base, list(by), "left")
    return joined.withColumn(f"{value}_delta", F.col(value) - F.col(f"{value}_baseline"))


def family_views(deltas: DataFrame, families: Sequence[str] = FAMILIES, always: str = "unigram", more_than: int = 6) -> DataFrame:
    """Rows of each model family, plus the models that belong to every view, tagged `family`.

    There is nothing to focus on, hence no rows, unless there are more than `more_than` models.
    """
    names = F.array(*[F.lit(f) for f in families])
    enough = deltas.select(F.count_distinct("model") > more_than).scalar()
    member = F.filter(names, lambda f: F.col("model").contains(f) | F.col("model").contains(always))
    return deltas.where(enough).withColumn("family", F.explode(member))


def language_adjusted(results: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Add <column>_delta: the difference to the mean over all rows of the same languages."""
    means = results.groupBy(*by).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    joined = results.join(means, list(by))
    for c in columns:
        joined = joined.withColumn(f"{c}_delta", F.col(c) - F.col(f"_mean_{c}"))
    return joined.drop(*[f"_mean_{c}" for c in columns])


def average_ranks(df: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, value, `name`: the rank of each distinct value; equal values share their mean rank.

    Ranks come from the table of distinct values, added up over 1,024 ranges of the value.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_m"))
    ends = counts.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    place = (F.col(value) - F.col("_e.low")) / F.nullif(F.col("_e.high") - F.col("_e.low"), F.lit(0.0))
    ranked = running_total(
        counts.withColumn("_e", ends), "_m", [value], F.coalesce(F.floor(place * 1023), F.lit(0)), keys, "_smaller"
    )
    return ranked.select(*keys, value, (F.col("_smaller") + (F.col("_m") + 1) / 2).alias(name))


def correlations(df: DataFrame, x: str, y: str, keys: Sequence[str] = ("regime",)) -> DataFrame:
    """n, pearson, spearman per `keys` over rows where both sides are known."""
    # Read seven times below, so it is computed once and written to the shared folder.
    rows = checkpointed(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y))
    rank_x, rank_y = average_ranks(rows, x, "_rx", keys), average_ranks(rows, y, "_ry", keys)
    ranked = rows.join(rank_x, [*keys, x]).join(rank_y, [*keys, y])
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman")
    )


def _tail(r: float, n: int) -> float:
    """Two-sided p-value of a correlation: the t tail as a continued fraction of the beta integral."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if abs(r) >= 1 and n > 2 else math.nan
    half = (n - 2) / 2
    x = 1 - r * r  # equals df / (df + t^2)
    a, b = half, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
        h = d
        for m in range(1, 500):
            for top in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1 + top * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + top / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) if 0 < x < 1 else 0.0
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def with_p_values(correlation_row: DataFrame) -> DataFrame:
    """Add p-values to the rows of `correlations`: one row per group, so plain Python is enough."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in ("pearson", "spearman"):
                batch[f"{c}_p"] = [_tail(r, n) for r, n in zip(batch[c], batch["n"])]
            yield batch

    added = T.StructType([T.StructField(f"{c}_p", T.DoubleType()) for c in ("pearson", "spearman")])
    return correlation_row.mapInPandas(add, T.StructType(correlation_row.schema.fields + added.fields))


def series(df: DataFrame, value: str = "value", keys: Sequence[str] = ("regime",)) -> DataFrame:
    """Mean per (lang_tgt, model): the points of the line charts."""
    return df.groupBy(*keys, "lang_tgt", "model").agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))


def _poisson_bounds() -> list[str]:
    """Cumulative probabilities of a Poisson count with mean 1, as 32-bit hex bounds."""
    bounds, term, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += term
        bounds.append(format(min(int(total * 2**32), 2**32 - 1), "08x"))
        term /= k + 1
    return bounds


POISSON_BOUNDS = _poisson_bounds()


def resampling_weight(draw: Column) -> Column:
    """How often a row occurs in one resample: a Poisson(1) count read off a hex draw."""
    key = F.substring(draw, 1, 8)
    weight = F.lit(len(POISSON_BOUNDS))
    for k in reversed(range(len(POISSON_BOUNDS))):
        weight = F.when(key < POISSON_BOUNDS[k], k).otherwise(weight)
    return weight


def series_band(df: DataFrame, replicates: int, value: str = "value") -> DataFrame:
    """A 95 % band for each point: percentiles of the means of resampled rows.

    Rows are resampled independently (Poisson bootstrap), so a replicate is a weighted mean with
    partial aggregation and needs no row numbers.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draw = draw_key(*[F.col(c) for c in ("model", "lang_src", "lang_tgt", "seed", "replicate")])
    rows = rows.withColumn("_w", resampling_weight(draw))
    means = rows.groupBy("lang_tgt", "model", "replicate").agg(
        (F.sum(F.col(value) * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_mean")
    )
    return means.groupBy("lang_tgt", "model").agg(
        F.percentile("_mean", 0.025).alias("low"), F.percentile("_mean", 0.975).alias("high")
    )
