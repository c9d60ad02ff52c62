"""Merging vocabularies: scores of the union, and a greedy search for what to merge.

A set of vocabularies is one table (tokenizer, tok_ord, piece_id, piece, score, type).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD_START, has_text, space_words
from ..session import checkpointed, fan_out, stored
from .counting import rare_token_counts
from .lattice import Block, Lattices, block_of, lattices
from .ordering import dense_index, exact_sample
from .segment import UNKNOWN_PENALTY

def merged_scores(vocabs: DataFrame, by: Sequence[str] = (), log_scores: bool = True) -> DataFrame:
    """by, piece, score, first_ord, first_id for the union of the ordinary pieces.

    Log mode averages probabilities, where a vocabulary without the piece counts as zero. Rank mode
    averages scores, where a missing piece counts as minus the number of distinct pieces.
    """
    sizes = vocabs.groupBy(*by).agg(F.count_distinct("tokenizer").alias("_n"))
    normal = vocabs.where(F.col("type") == "NORMAL")
    pieces = normal.groupBy(*by, "piece").agg(
        F.sum(F.exp("score")).alias("_mass"),
        F.sum("score").alias("_sum"),
        F.count("*").alias("_m"),
        F.min(F.struct("tok_ord", "piece_id")).alias("_first"),
    )
    if by:
        pieces = pieces.join(sizes, list(by))
    else:
        pieces = pieces.withColumn("_n", sizes.scalar())
    if log_scores:
        score = F.ln(F.col("_mass") / F.col("_n"))
    else:
        distinct = pieces.groupBy(*by).agg(F.count("*").alias("_d"))
        pieces = pieces.join(distinct, list(by)) if by else pieces.withColumn("_d", distinct.scalar())
        score = (F.col("_sum") - (F.col("_n") - F.col("_m")) * F.col("_d")) / F.col("_n")
    first = [F.col("_first.tok_ord").alias("first_ord"), F.col("_first.piece_id").alias("first_id")]
    return pieces.select(*by, "piece", score.alias("score"), *first)


def merge(vocabs: DataFrame, log_scores: bool = True) -> DataFrame:
    """piece_id, piece, score, type: the special pieces of the first vocabulary, then all others by
    score; equal scores keep the order in which the pieces were first seen."""
    scored = merged_scores(vocabs, (), log_scores)
    # Rounded for the order only, so that sums of the same numbers in another order still tie.
    ordered = scored.withColumn("_s", -F.round("score", 12))
    ranked = dense_index(ordered, ["_s", "first_ord", "first_id"], F.floor(F.col("_s") * 16), name="_rank")
    first = vocabs.agg(F.min("tok_ord")).scalar()
    special = vocabs.where((F.col("type") != "NORMAL") & (F.col("tok_ord") == first))
    shift = special.agg(F.count("*")).scalar()
    place = F.row_number().over(Window.partitionBy("tok_ord").orderBy("piece_id")) - 1
    head = special.select(place.cast("long").alias("piece_id"), "piece", "score", "type")
    tail = ranked.select((F.col("_rank") + shift).alias("piece_id"), "piece", "score", F.lit("NORMAL").alias("type"))
    return head.unionByName(tail)


def trim(vocab: DataFrame, size: int) -> DataFrame:
    """The first `size` pieces, special ones included; an error if there are fewer."""
    # Written first: the ids are computed with scalar subqueries that a filter should not be pushed into.
    kept = checkpointed(vocab).where(F.col("piece_id") < size)
    if kept.count() < size:
        raise ValueError(f"the vocabulary has fewer than {size} pieces")
    return kept


def ranked_groups(vocabs: DataFrame) -> DataFrame:
    """grp, tokenizer, tok_ord, size, size_rank: the vocabularies of each group from small to large.

    There are few vocabularies, however large the corpus.
    """
    sizes = vocabs.groupBy("grp", "tokenizer", "tok_ord").agg(F.count("*").alias("size"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("size", "tok_ord")) - 1
    return sizes.withColumn("size_rank", rank)


def group_by_name(vocabs: DataFrame, pattern: str) -> DataFrame:
    """Add grp: the part of the tokenizer name that matches `pattern`. No match is an error."""
    found = F.trim(F.regexp_extract("tokenizer", pattern, 0))
    return vocabs.withColumn("grp", F.when(found != "", found).otherwise(F.raise_error(F.lit("a tokenizer has no group"))))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The candidate with the smallest metric, the first in group order on ties."""
    return candidates.agg(F.min_by(F.struct(*candidates.columns), F.struct("metric", "cand")).alias("b")).select("b.*")


def corpus_words(lines: DataFrame, source: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Distinct words with their counts per source, and the number of lines per source."""
    kept = lines.where(has_text(F.col(text)))
    counts = rare_token_counts(kept, source, space_words(F.col(text)))
    per_source = counts.select(F.col(source).alias("src"), F.concat(F.lit(WORD_START), "token").alias("word"), "cnt")
    words = per_source.groupBy("word").agg(F.collect_list(F.struct("src", "cnt")).alias("uses"))
    return words, kept.groupBy(F.col(source).alias("src")).agg(F.count("*").alias("n_lines"))


def _piece_numbers(word: str, index: dict[str, int], scores: np.ndarray, longest: int, unknown: np.ndarray) -> np.ndarray:
    """Number of pieces of the best split of a word under every candidate at once.

    scores[i] holds the score of piece i per candidate, -inf where the candidate lacks it.
    """
    block = block_of([word], index, scores, longest)
    block.set_unknown(unknown)
    return block.best()[1][0]


def word_lattices(words: DataFrame, pieces: DataFrame) -> tuple[Lattices, DataFrame]:
    """Where the pieces (a column `piece`, repeated or not) stand in the distinct words; and the numbers of the pieces."""
    numbers = stored(pieces.select("piece").distinct().withColumn("pid", F.monotonically_increasing_id()), "numbers")
    longest = numbers.agg(F.coalesce(F.max(F.length("piece")), F.lit(1)).alias("n")).first()["n"]
    items = words.select("word", F.lit(1.0).alias("cnt"), F.lit(None).cast("long").alias("own"))
    return lattices(items, numbers, longest), numbers


def mean_sentence_length(
    words: DataFrame, line_counts: DataFrame, candidates: DataFrame, prepared: tuple[Lattices, DataFrame] | None = None
) -> DataFrame:
    """cand, metric: mean tokens per line of each source, averaged over sources.

    `candidates` has (cand, piece, score). Each piece gets an array with its score in every candidate, and each distinct word is
    split once for all of them: pieces never cross words, so lines need not be read again. The driver knows the candidates'
    names and lowest scores only. `prepared` is what `word_lattices` makes of the words and all pieces that candidates may have.
    """
    table, numbers = prepared or word_lattices(words, candidates)
    low = {r["cand"]: r["low"] for r in candidates.groupBy("cand").agg(F.min("score").alias("low")).collect()}
    names = sorted(low)
    unknown = np.array([low[c] for c in names]) - UNKNOWN_PENALTY
    by_candidate = F.map_from_entries(F.collect_list(F.struct("cand", "score")))
    scores = candidates.groupBy("piece").agg(by_candidate.alias("_s")).join(numbers, "piece")
    scores = scores.select("pid", F.array(*[F.element_at("_s", F.lit(c)) for c in names]).alias("score"))

    def work(block: Block) -> dict[str, list]:
        block.set_unknown(unknown)
        return {"word": block.names.to_pylist(), "n": block.best()[1].tolist()}

    numbers_of_pieces = table.solved(scores, len(names), "word string, n array<long>", work)
    uses = words.select("word", F.explode("uses").alias("use")).join(numbers_of_pieces, "word")
    sums = [F.sum(F.col("n")[j] * F.col("use.cnt")).alias(f"c{j}") for j in range(len(names))]
    totals = uses.groupBy("use.src").agg(*sums).join(line_counts, "src")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cand"), (F.col(f"c{j}") / F.col("n_lines")).alias("_mean")) for j, c in enumerate(names)]))
    means = totals.select("src", each.alias("m")).select("src", "m.*")
    return means.groupBy("cand").agg(F.avg("_mean").alias("metric"))


Metric = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def evaluate_candidates(
    vocabs: DataFrame, groups: Sequence[tuple[str, int]], pointers: dict[str, int], words: DataFrame,
    line_counts: DataFrame, metric: Metric = mean_sentence_length,
) -> DataFrame:
    """cand, grp, size, metric: for each group, the merge with that group one step further.

    `vocabs` carries grp and size_rank; `groups` lists (grp, number of vocabularies) in order.
    Groups that are at their end have no candidate.
    """
    spark = vocabs.sparkSession
    rows = []
    for i, (grp, n) in enumerate(groups):
        if pointers[grp] + 1 < n:
            rows += [(i, grp, g, pointers[g] + (g == grp)) for g, _ in groups]
    picks = spark.createDataFrame(rows, "cand int, cand_grp string, grp string, size_rank int")
    chosen = vocabs.join(F.broadcast(picks), ["grp", "size_rank"])
    scored = merged_scores(chosen, ["cand", "cand_grp"])
    first = chosen.groupBy("cand").agg(F.min("tok_ord").alias("tok_ord"))
    specials = chosen.where(F.col("type") != "NORMAL").join(first, ["cand", "tok_ord"])
    sizes = scored.select("cand", "cand_grp").unionByName(specials.select("cand", "cand_grp"))
    sizes = sizes.groupBy("cand", F.col("cand_grp").alias("grp")).agg(F.count("*").alias("size"))
    values = metric(words, line_counts, scored.select("cand", "piece", "score"))
    return sizes.join(values, "cand")


@dataclass
class MergeResult:
    """The merged vocabulary, the rounds as (group, metric, size), and whether the target was reached."""

    vocab: DataFrame
    rounds: list[tuple[str, float, int]]
    reached: bool


def greedy_merge(
    vocabs: DataFrame, lines: DataFrame, target: int, source: str = "src", text: str = "line", key: Sequence[str] = (),
    sample_lines: int = 0, seed: int = 0, extra_step: bool = True, metric: Metric = mean_sentence_length,
) -> MergeResult:
    """Start from the smallest vocabulary of each group and enlarge, one step at a time, the group that
    shortens the text most, until the merge has `target` pieces; then trim to it.

    `extra_step` advances the last winner once more before trimming. `sample_lines` draws that many
    lines per source anew in each round.
    """
    groups_table = checkpointed(ranked_groups(vocabs))
    vocabs = checkpointed(vocabs.join(groups_table.select("tokenizer", "size_rank"), "tokenizer"))
    info = groups_table.groupBy("grp").agg(F.count("*").alias("n"), F.min("tok_ord").alias("o")).orderBy("o").collect()
    groups = [(r["grp"], r["n"]) for r in info]
    pointers = {g: 0 for g, _ in groups}

    def current() -> DataFrame:
        picks = vocabs.sparkSession.createDataFrame(list(pointers.items()), "grp string, size_rank int")
        chosen = vocabs.join(F.broadcast(picks), ["grp", "size_rank"])
        # The first group's vocabulary gives the special pieces.
        return merge(chosen.withColumn("tok_ord", _group_order(groups)))

    def data(round_no: int) -> tuple[DataFrame, DataFrame]:
        drawn = lines
        if sample_lines:
            drawn = exact_sample(lines, sample_lines, F.concat_ws(":", *key), seed + round_no, [source])
        words, counts = corpus_words(drawn, source, text)
        return checkpointed(fan_out(words)), checkpointed(counts)

    # Every piece of every vocabulary may come up, so where they stand in the words is found once for all rounds.
    every = vocabs.where(F.col("type") == "NORMAL").select("piece")

    def prepared(words: DataFrame) -> Metric:
        return partial(metric, prepared=word_lattices(words, every)) if metric is mean_sentence_length else metric

    words, line_counts = data(0)
    measure = prepared(words)
    size = current().count()
    rounds: list[tuple[str, float, int]] = []
    ordered = vocabs.withColumn("tok_ord", _group_order(groups))
    while size < target and any(pointers[g] + 1 < n for g, n in groups):
        if sample_lines and rounds:
            words, line_counts = data(len(rounds))
            _release(measure)
            measure = prepared(words)
        best = best_candidate(evaluate_candidates(ordered, groups, pointers, words, line_counts, measure)).first()
        pointers[best["grp"]] += 1
        size = best["size"]
        rounds.append((best["grp"], best["metric"], size))
    _release(measure)
    reached = size >= target
    if rounds and extra_step:
        last = rounds[-1][0]
        pointers[last] = min(pointers[last] + 1, dict(groups)[last] - 1)
    merged = current()
    return MergeResult(trim(merged, target) if reached else merged, rounds, reached)


def _release(metric: Metric) -> None:
    if isinstance(metric, partial) and "prepared" in metric.keywords:
        metric.keywords["prepared"][0].done()


def _group_order(groups: Sequence[tuple[str, int]]):
    order = F.lit(len(groups))
    for i, (g, _) in enumerate(groups):
        order = F.when(F.col("grp") == g, i).otherwise(order)
    return order
