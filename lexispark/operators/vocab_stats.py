"""Statistics of token frequencies, per group, from count tables.

Rank statistics work on the count-of-counts table: one row per distinct count. It is tiny compared
with the vocabulary, so nothing here sorts tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .counting import with_probability


def count_of_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, cnt, m (tokens with that count), rank_before, seen_before, total."""
    table = counts.where(F.col("cnt") > 0).groupBy(*keys, "cnt").agg(F.count("*").alias("m"))
    earlier = (
        Window.partitionBy(*keys).orderBy(F.col("cnt").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*keys)
    mass = F.col("m") * F.col("cnt")
    return (
        table.withColumn("rank_before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
        .withColumn("seen_before", F.coalesce(F.sum(mass).over(earlier), F.lit(0)))
        .withColumn("total", F.sum(mass).over(whole))
    )


def average_rank(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean rank of an occurrence; the most frequent token has rank 1."""
    table = count_of_counts(counts, keys)
    ranks = F.col("m") * F.col("cnt") * (F.col("rank_before") + (F.col("m") + 1) / 2)
    return table.groupBy(*keys).agg((F.sum(ranks) / F.max("total")).alias("avg_rank"))


def coverage_95(counts: DataFrame, keys: Sequence[str], percent: int = 95) -> DataFrame:
    """Index of the first token that takes the cumulative share above `percent`, and its count.

    Integer arithmetic: no rounding near the boundary.
    """
    table = count_of_counts(counts, keys)
    reached = 100 * (F.col("seen_before") + F.col("m") * F.col("cnt")) > percent * F.col("total")
    crossing = table.where(reached).where(100 * F.col("seen_before") <= percent * F.col("total"))
    place = F.expr(f"({percent} * total - 100 * seen_before) div (100 * cnt)")
    return crossing.select(
        *keys, F.col("cnt").alias("freq_at_95"), (F.col("rank_before") + place).alias("tokens_to_cover_95")
    )


def entropy(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """In nats. Tokens that never occur add nothing."""
    seen = with_probability(counts.where(F.col("cnt") > 0), keys)
    return seen.groupBy(*keys).agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))


def average_log_probability(counts: DataFrame, sentences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the log probabilities of all occurrences per sentence; `sentences` has n_sentences."""
    seen = with_probability(counts.where(F.col("cnt") > 0), keys)
    sums = seen.groupBy(*keys).agg(F.sum(F.col("cnt") * F.ln("p")).alias("_sum"))
    joined = sums.join(sentences, list(keys))
    return joined.select(*keys, (F.col("_sum") / F.col("n_sentences")).alias("avg_log_prob"))


def divergence_from_uniform(counts: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Half the L1 distance to the uniform distribution over `vocab_size` pieces, unseen ones included."""
    seen = with_probability(counts.where(F.col("cnt") > 0), keys).join(sizes, list(keys))
    gap = F.abs(F.col("p") - 1 / F.col("vocab_size"))
    sums = seen.groupBy(*keys).agg(
        F.sum(gap).alias("_gap"), F.count("*").alias("_seen"), F.max("vocab_size").alias("_size")
    )
    unseen = (F.col("_size") - F.col("_seen")) / F.col("_size")
    return sums.select(*keys, ((F.col("_gap") + unseen) / 2).alias("divergence"))


def characters_per_token(counts: DataFrame, keys: Sequence[str], count_unknown: bool = False) -> DataFrame:
    """Characters per token from frequencies. Unknowns are skipped, or count as 0 characters."""
    unknown = F.col("token") == "<unk>"
    size = F.when(unknown, 0).otherwise(F.length("token"))
    tokens = F.col("cnt") if count_unknown else F.when(unknown, 0).otherwise(F.col("cnt"))
    return counts.groupBy(*keys).agg((F.sum(F.col("cnt") * size) / F.sum(tokens)).alias("chars_per_token"))


def characters_per_token_from_text(texts: DataFrame, keys: Sequence[str], text: str, tokens: str) -> DataFrame:
    """All characters of the text over all tokens, unknown ones included."""
    return texts.groupBy(*keys).agg((F.sum(F.length(text)) / F.sum(F.size(tokens))).alias("chars_per_token"))


def piece_lengths(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Occurrences by piece length, for any length."""
    return counts.groupBy(*keys, F.length("token").alias("piece_length")).agg(F.sum("cnt").alias("n"))


def fertility(words: DataFrame, keys: Sequence[str], pieces: str = "n_pieces", weight: str | None = None) -> DataFrame:
    """Pieces per word and the share of words in more than one piece.

    One row per word occurrence, or per distinct word with its count as `weight`.
    """
    n = F.col(weight) if weight else F.lit(1).cast("long")
    split = F.sum(F.when(F.col(pieces) > 1, n).otherwise(0))
    return words.groupBy(*keys).agg(
        (F.sum(F.col(pieces) * n) / F.sum(n)).alias("fertility"), (split / F.sum(n)).alias("continued_share")
    )


def mean_of_means(sentences: DataFrame, source: str, n_tokens: str) -> DataFrame:
    """Mean sentence length per source, then the plain mean over sources."""
    per_source = sentences.groupBy(source).agg(F.avg(n_tokens).alias("_mean"))
    return per_source.agg(F.avg("_mean").alias("mean_length"))


def js_distances(counts: DataFrame, group: str, pairs: DataFrame) -> DataFrame:
    """Jensen-Shannon distance (natural log) of given pairs of groups, left_grp < right_grp.

    A token has one row per group on either side of the join, so no key is heavy. Only shared tokens are joined. Tokens of one side alone contribute through the shared mass;
    a pair without shared tokens is at sqrt(ln 2).
    """
    p = with_probability(counts.where(F.col("cnt") > 0), [group]).select(group, "token", "p")
    left = p.select(F.col(group).alias("left_grp"), "token", F.col("p").alias("p"))
    right = p.select(F.col(group).alias("right_grp"), "token", F.col("p").alias("q"))
    shared = left.join(right, "token").where(F.col("left_grp") < F.col("right_grp"))
    mid = F.col("p") + F.col("q")
    terms = F.col("p") * F.ln(2 * F.col("p") / mid) + F.col("q") * F.ln(2 * F.col("q") / mid)
    sums = shared.groupBy("left_grp", "right_grp").agg(F.sum(mid).alias("_mass"), F.sum(terms).alias("_terms"))
    divergence = F.ln(F.lit(2.0)) * (1 - F.coalesce("_mass", F.lit(0.0)) / 2) + F.coalesce("_terms", F.lit(0.0)) / 2
    return pairs.join(sums, ["left_grp", "right_grp"], "left").select(
        "left_grp", "right_grp", F.sqrt(F.greatest(divergence, F.lit(0.0))).alias("js_distance")
    )


def group_pairs(counts: DataFrame, group: str) -> DataFrame:
    """Each unordered pair of distinct groups (languages or sources: few by nature)."""
    names = counts.select(F.sort_array(F.collect_set(group)).alias("names"))
    left = names.select("names", F.explode("names").alias("left_grp"))
    return left.select("left_grp", F.explode(F.filter("names", lambda n: n > F.col("left_grp"))).alias("right_grp"))
