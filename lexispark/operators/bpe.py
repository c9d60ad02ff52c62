"""Training a byte-pair style vocabulary by joining the most frequent adjacent symbols.

Words are strings of symbols with one space between. All adjacent pairs are counted once; a round takes as many of the
best pairs as cannot influence one another, so the result is the same as with one pair per round, and changes the counts
by what it changed.

Which words a round reads: as long as its pairs are frequent, all of them, next to one another in memory. Once they
are rare, an index from pairs to the words that hold them is written, sorted by pair, so that the few words of a round are
found by a pushed-down filter and the others are not read. Words that a round has touched since the index was written stay in
memory as `recent`; pairs with new symbols stand in such words only. When these are a large share of all words, a new index is written.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import characters
from ..session import checkpointed, fan_out, scratch_path
from .unigram import SPECIALS, character_counts, covered_characters, vocab_frame

# Pairs looked at per round; a bound on what reaches the driver, not on what is counted.
LOOK_AT = 2000
CHECKPOINT_EVERY = 8
# Words are found by an index once a round's pairs are this share of all pairs, looked at every so many rounds; it is
# written anew when the words touched since are this share of all words.
INDEX_BELOW = 0.002
LOOK_AFTER = 16
RECENT_SHARE = 0.25


def as_symbols(words: DataFrame) -> DataFrame:
    return words.select(F.array_join(characters(F.col("word")), " ").alias("symbols"), "cnt")


# Adjacent symbols of `symbols`. As text: a round builds these plans anew, and one call is cheaper than many.
ADJACENT = "arrays_zip(split(symbols, ' '), slice(split(symbols, ' '), 2, 1 << 30))"
ADJACENT = f"transform(filter({ADJACENT}, s -> s['1'] IS NOT NULL), s -> struct(s['0'] AS left, s['1'] AS right))"


def pair_rows(words: DataFrame) -> DataFrame:
    """left, right, n: each adjacent pair of each weighted word."""
    pairs = words.selectExpr("cnt AS n", f"{ADJACENT} AS pairs").where("size(pairs) > 0")
    return pairs.selectExpr("n", "inline(pairs)").select("left", "right", "n")


def pair_counts(words: DataFrame) -> DataFrame:
    """left, right, n: adjacent symbols over weighted words."""
    return pair_rows(words).groupBy("left", "right").agg(F.sum("n").alias("n"))


def independent_prefix(
    ranked: Sequence[tuple[str, str, int]], complete: bool, known: set[str], limit: int, min_count: int
) -> list[tuple[str, str, int]]:
    """The pairs that can be joined in one round with the same outcome as one after the other.

    Joining a pair changes only pairs that share a symbol with it, and a new pair is never more
    frequent than the changed pair it comes from. So a pair may follow while it shares no symbol
    with those before it and is strictly more frequent than every pair they change. A result that
    is already a symbol ends the round, because its pairs gain counts from two sides.
    """
    taken: list[tuple[str, str, int]] = []
    used: set[str] = set()
    floor = 0 if complete or not ranked else ranked[-1][2]
    names = set(known)
    for left, right, n in ranked:
        if n < min_count or len(taken) == limit:
            break
        if taken:
            if left in used or right in used:
                break
            done = {(a, b) for a, b, _ in taken}
            touched = (m for a, b, m in ranked if (a in used or b in used) and (a, b) not in done)
            changed = max(touched, default=floor)
            if n <= max(changed, floor):
                break
        taken.append((left, right, n))
        used |= {left, right}
        if left + right in names:
            break
        names.add(left + right)
    return taken


def join_pairs(symbols: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Join each of the pairs, leftmost first, in one regular expression pass."""
    either = "|".join(f"({re.escape(a)}) ({re.escape(b)})" for a, b in pairs)
    back = "".join(f"${i + 1}" for i in range(2 * len(pairs)))
    return F.regexp_replace(symbols, rf"(?<![^ ])(?:{either})(?![^ ])", back)


class Words:
    """All distinct words as symbols, and how a round reaches those that hold its pairs."""

    def __init__(self, words: DataFrame, index_below: float = INDEX_BELOW) -> None:
        self.spark = words.sparkSession
        self.index_below = index_below
        self.base: DataFrame | None = None
        self.index: DataFrame | None = None
        self.recent = checkpointed(fan_out(words.select("word", F.array_join(characters(F.col("word")), " ").alias("symbols"), "cnt")))
        self.total = self.recent.count()
        self.symbols: set[str] = set()

    def build_index(self, share: float) -> None:
        """Write the index if a round's pairs stand in so small a share of the words that it pays off."""
        if not self.total or share >= self.index_below:
            return
        if self.index is not None and self.recent.count() < self.total * RECENT_SHARE:
            return
        base = checkpointed(self._all())
        pairs = f"explode(array_distinct(transform({ADJACENT}, p -> concat(p.left, ' ', p.right)))) AS pair"
        rows = base.selectExpr("word", "symbols", "cnt", pairs)
        path = scratch_path(self.spark, "pairs")
        # The words come with the index, so that a look-up reads nothing else.
        rows.repartitionByRange("pair").sortWithinPartitions("pair").write.parquet(path)
        self.index = self.spark.read.schema(rows.schema).parquet(path)
        self.base = base
        self.recent = base.limit(0)
        self.symbols = set()

    def _all(self) -> DataFrame:
        if self.base is None:
            return self.recent
        return self.base.join(self.recent.select("word"), "word", "left_anti").unionByName(self.recent)

    def join(self, pairs: Sequence[tuple[str, str]]) -> DataFrame:
        """Join the pairs and return left, right, n: what the words that changed take from the counts and add to them."""
        rows = self.recent
        # A pair with a symbol made since the index was written stands in recent words only.
        known = [f"{a} {b}" for a, b in pairs if a not in self.symbols and b not in self.symbols]
        if self.index is not None and known:
            held = self.index.where(F.col("pair").isin(known)).select("word", "symbols", "cnt").dropDuplicates(["word"])
            rows = rows.unionByName(held.join(rows.select("word"), "word", "left_anti"))
        self.symbols |= {a + b for a, b in pairs}
        changed = rows.withColumnRenamed("symbols", "old").withColumn("symbols", join_pairs(F.col("old"), pairs)).persist()
        self.recent = changed.select("word", "symbols", "cnt")
        self.kept = changed
        both = "inline(array(struct(symbols, cnt), struct(old AS symbols, -cnt AS cnt)))"
        return pair_rows(changed.where("old <> symbols").selectExpr(both))


def train_bpe(
    words: DataFrame,
    vocab_size: int,
    coverage: float = 0.9995,
    specials: Sequence[str] = SPECIALS,
    min_count: int = 1,
    max_batch: int = 40,
    index_below: float = INDEX_BELOW,
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The vocabulary (specials, joined pieces in order, characters) and the list of joins."""
    spark = words.sparkSession
    chars = covered_characters(character_counts(words), coverage).orderBy(F.col("cnt").desc(), "char").toPandas()
    alphabet = list(chars["char"])
    known = set(alphabet)
    state = Words(words.select("word", "cnt"), index_below)
    merges: list[tuple[str, str]] = []
    joined: list[str] = []
    room = vocab_size - len(specials) - len(alphabet)
    counts = checkpointed(pair_counts(state.recent))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rounds = 0
    held: list[DataFrame] = []
    # Characters outside the alphabet never take part in a piece.
    letters = F.array_remove(F.split(F.concat("left", "right"), ""), "")
    inside = F.size(F.array_except(letters, F.lit(alphabet))) == 0 if coverage < 1 else F.lit(True)
    order, added = [F.col("n").desc(), F.col("left"), F.col("right")], F.sum("n").alias("n")
    while len(joined) < room:
        top = counts.where(inside).orderBy(*order).limit(LOOK_AT).collect()
        ranked = [(r["left"], r["right"], r["n"]) for r in top]
        batch = independent_prefix(ranked, len(ranked) < LOOK_AT, known, min(max_batch, room - len(joined)), min_count)
        if not batch:
            break
        for left, right, _ in batch:
            merges.append((left, right))
            if left + right not in known:
                joined.append(left + right)
                known.add(left + right)
        if rounds % LOOK_AFTER == 0:
            state.build_index(sum(n for _, _, n in batch) / max(total, 1))
        # Kept in memory for the next round; lineage back to the last checkpoint survives a lost executor.
        change = state.join([(a, b) for a, b, _ in batch])
        counts = counts.union(change).groupBy("left", "right").agg(added).where("n > 0").persist()
        held += [state.kept, counts]
        rounds += 1
        if rounds % CHECKPOINT_EVERY == 0:
            counts, state.recent = checkpointed(counts), checkpointed(state.recent)
            for old in held:
                old.unpersist()
            held = []
    for old in held:
        old.unpersist()
    pieces = [(p, -float(i)) for i, p in enumerate(joined + alphabet)]
    return vocab_frame(spark, pieces, specials), merges
