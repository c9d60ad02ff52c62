"""Periodic runs of words by recompression.

The words of a batch of texts are numbered and compressed by alternate steps, each of which renames equal things alike:
block compression turns a stretch of one symbol into one symbol, pair compression splits the symbols into left and right
ones by a hash and turns each left symbol with a right one behind it into one symbol. Every text ends as one symbol, so
the levels are a run-length grammar of all texts. Texts stand between marks that never take part in a step.

How far the words from two places on agree (`Grammar.ahead`, and `Grammar.back` to the left) is answered on the grammar: on the way up,
what may be cut by a place's own left context is compared and left behind (the rest of a block, or one right symbol), so
both places stand at the start of a symbol of the next level; at the first level where the symbols differ, the way down
compares first children only. Both ways take a fixed number of steps a level, for all queries at once.

A run with period q and at least 2q words holds a place t, a multiple of q, with t - q in it too. So the candidates are the
pairs (t - q, t), some n ln n of them: those with equal words are extended both ways by the grammar, which gives the maximal
stretch with period q. A stretch found with several periods is a run with the least of them.

Words are `[^\\x20\\x09-\\x0D]+`. Null, empty and blank texts have no words and no runs. Every row is a document: repeated rows and
ties of doc_id give repeated rows, null doc_ids stay, extra columns are ignored, empty tables give empty tables. A text of any length is one
unit of work; its memory is some hundred bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, _slices

#: A run has at least so many words.
SHORTEST = 12
#: Text taken at once; a longer text is one piece.
SLICE_BYTES = 2 << 20
#: Texts of up to so many words take their candidates from one table.
TABLE = 1 << 15
#: Candidates extended at once.
AT_ONCE = 1 << 20

_MARK = 0


@dataclass
class Level:
    """Symbols, and the step that makes the next level: where its symbols begin, and which of them holds each place."""

    symbols: np.ndarray
    pairs: bool
    first: np.ndarray
    parent: np.ndarray
    right: np.ndarray  # for pairs: which places hold right symbols; left ones are neither right nor marks


def _right(symbols: np.ndarray, seed: int) -> np.ndarray:
    """A fair bit for each symbol."""
    x = (symbols.astype(np.uint64) + np.uint64(seed * 2654435761 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(63)).astype(bool)


class Grammar:
    """The levels over `symbols`, numbers from 1 on; 0 marks stand before, between and behind texts of one symbol at least."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels: list[Level] = []
        self.names = int(symbols.max(initial=0)) + 1
        roots = 2 * int((symbols == _MARK).sum()) - 1
        while len(symbols) > roots:
            symbols = self._blocks(symbols)
            if len(symbols) > roots:
                symbols = self._pairs(symbols, len(self.levels))
        self.top = symbols

    def _level(self, symbols: np.ndarray, starts: np.ndarray, pairs: bool, right: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(starts)
        # One more entry: behind the last symbol.
        first = np.append(first, len(symbols)).astype(np.int32)
        self.levels.append(Level(symbols, pairs, first, (np.cumsum(starts) - 1).astype(np.int32), right))
        return first

    def _named(self, keys: np.ndarray) -> np.ndarray:
        """New names, alike for equal keys."""
        distinct, number = np.unique(keys, return_inverse=True)
        named = number + self.names
        self.names += len(distinct)
        return named

    def _blocks(self, symbols: np.ndarray) -> np.ndarray:
        starts = np.ones(len(symbols), bool)
        starts[1:] = symbols[1:] != symbols[:-1]
        first = self._level(symbols, starts, False, starts)
        sizes, out = np.diff(first), symbols[first[:-1]].copy()
        long = sizes > 1
        out[long] = self._named(out[long].astype(np.int64) * len(symbols) + sizes[long])
        return out

    def _pairs(self, symbols: np.ndarray, seed: int) -> np.ndarray:
        right = _right(symbols, seed) & (symbols != _MARK)
        left = ~right & (symbols != _MARK)
        joined = left[:-1] & right[1:]
        starts = np.ones(len(symbols), bool)
        starts[1:] = ~joined
        first = self._level(symbols, starts, True, right)
        two = np.diff(first) > 1
        out, at = symbols[first[:-1]].copy(), first[:-1][two]
        out[two] = self._named(symbols[at].astype(np.int64) * self.names + symbols[at + 1])
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from places i and j on agree, i < j in one text."""
        return self._extend(i, j, 1) - i

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to places i and j agree, i < j in one text."""
        return i - self._extend(i, j, -1)

    def _extend(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """Where, from i on, the first symbol stands that differs from its partner."""
        p, q = i.astype(np.int32), j.astype(np.int32)
        height = np.full(len(p), len(self.levels), np.int32)
        live = np.arange(len(p))
        for k, level in enumerate(self.levels):
            a, b = p[live], q[live]
            same = level.symbols[a] == level.symbols[b]
            height[live[~same]] = k
            live, a, b = live[same], a[same], b[same]
            if not len(live):
                break
            if level.pairs:
                # Going right, a right symbol may be the second of a pair; going left, a left one may be the first.
                loose = level.right[a] if way > 0 else ~level.right[a]
                a, b = a + way * loose, b + way * loose
            else:
                edge_a, edge_b = self._edge(level, a, way), self._edge(level, b, way)
                start_a, start_b = self._edge(level, a, -way), self._edge(level, b, -way)
                whole = (a == start_a) & (b == start_b)
                rest_a, rest_b = way * (edge_a - a) + 1, way * (edge_b - b) + 1
                move = way * np.where(whole, 0, np.minimum(rest_a, rest_b))
                a, b = a + move, b + move
                ends = ~whole & (rest_a != rest_b)
                height[live[ends]] = k
                p[live[ends]], q[live[ends]] = a[ends], b[ends]
                live, a, b = live[~ends], a[~ends], b[~ends]
            p[live], q[live] = level.parent[a], level.parent[b]
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            live = np.flatnonzero(height > k)
            if not len(live):
                continue
            a, b = self._child(level, p[live], way), self._child(level, q[live], way)
            same = level.symbols[a] == level.symbols[b]
            if level.pairs:
                move = way * same
            else:
                rest_a, rest_b = (way * (self._edge(level, x, way) - x) + 1 for x in (a, b))
                move = way * np.where(same, np.minimum(rest_a, rest_b), 0)
            p[live], q[live] = a + move, b + move
        return p.astype(np.int64)

    @staticmethod
    def _edge(level: Level, places: np.ndarray, way: int) -> np.ndarray:
        """The last place (way 1) or the first (way -1) of the block around each place."""
        block = level.parent[places]
        return level.first[block + 1] - 1 if way > 0 else level.first[block]

    @staticmethod
    def _child(level: Level, above: np.ndarray, way: int) -> np.ndarray:
        return level.first[above] if way > 0 else level.first[above + 1] - 1


class Grid:
    """Pairs (t - q, t) with q a divisor of t, by t."""

    def __init__(self, size: int = TABLE) -> None:
        multiples = [np.arange(q, size, q, dtype=np.int32) for q in range(1, size)]
        periods = np.repeat(np.arange(1, size, dtype=np.int32), [len(m) for m in multiples])
        places = np.concatenate(multiples)
        order = np.argsort(places, kind="stable")
        self.size, self.t, self.q = size, places[order], periods[order]
        self.before = self.t - self.q
        self.upto = np.searchsorted(self.t, np.arange(size + 1))

    def equal(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(t - q, t) of the pairs with equal words and 2q at most the number of words."""
        n = len(words)
        if n <= self.size:
            m = self.upto[n]
            found = np.flatnonzero(words[self.before[:m]] == words[self.t[:m]])
            found = found[2 * self.q[found] <= n]
            yield self.before[found], self.t[found]
            return
        kept, total = [], 0
        for q in range(1, n // 2 + 1):
            at = np.flatnonzero(words[: n - q : q] == words[q::q]) * q
            if len(at):
                kept.append((at, at + q))
                total += len(at)
            if total > AT_ONCE:
                yield tuple(np.concatenate(x) for x in zip(*kept))
                kept, total = [], 0
        if kept:
            yield tuple(np.concatenate(x) for x in zip(*kept))


def find_runs(words: list[np.ndarray], grid: Grid, shortest: int = SHORTEST) -> list[np.ndarray]:
    """For each text, a row (start, length, period) for each run, by start, then period. Words are numbers from 1 on."""
    texts = [w for w in words if len(w)]
    if not texts:
        return [np.zeros((0, 3), np.int64) for _ in words]
    mark = np.zeros(1, np.int32)
    grammar = Grammar(np.concatenate([mark, *(x for w in texts for x in (w.astype(np.int32), mark))]))
    starts = np.cumsum([1, *(len(w) + 1 for w in texts)])[:-1]
    found: list[np.ndarray] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def extend() -> None:
        i, j = (np.concatenate(x).astype(np.int64) for x in zip(*waiting))
        waiting.clear()
        for k in range(0, len(i), AT_ONCE):
            found.append(_stretches(grammar, i[k : k + AT_ONCE], j[k : k + AT_ONCE], shortest))
        if len(found) > 1:
            found[:] = [_least(np.concatenate(found))]

    waiting_rows = 0
    for start, w in zip(starts.tolist(), texts):
        for i, j in grid.equal(w):
            waiting.append((i.astype(np.int64) + start, j.astype(np.int64) + start))
            waiting_rows += len(i)
            if waiting_rows > AT_ONCE:
                extend()
                waiting_rows = 0
    if waiting:
        extend()
    rows = _least(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)
    bounds = iter(np.searchsorted(rows[:, 0], np.append(starts, len(grammar.levels[0].symbols) if grammar.levels else starts[-1] + 2)).tolist())
    low, out, firsts = next(bounds), [], iter(starts.tolist())
    for w in words:
        if not len(w):
            out.append(np.zeros((0, 3), np.int64))
            continue
        high = next(bounds)
        own = rows[low:high].copy()
        own[:, 0] -= next(firsts)
        out.append(own)
        low = high
    return out


def _stretches(grammar: Grammar, i: np.ndarray, j: np.ndarray, shortest: int) -> np.ndarray:
    """(start, length, period) of the stretches around candidates that are long enough."""
    q = j - i
    start = i + 1 - grammar.back(i, j)
    length = j + grammar.ahead(i, j) - start
    keep = length >= np.maximum(shortest, 2 * q)
    return np.stack([start[keep], length[keep], q[keep]], 1)


def _least(rows: np.ndarray) -> np.ndarray:
    """Each stretch once, with its least period, by start, then period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where the words of each text begin and end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    word = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    return flat.filter(pa.array(word)), np.concatenate([[0], np.cumsum(word)])[offsets]


RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed of each row of `docs` (doc_id, text).

    collapsed: the words, joined by one space, without those that stand in a run behind its first period.
    """
    arrow = _arrow_schema(docs.sparkSession, RUNS)
    struct = arrow.field("runs").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid()
        for batch in batches:
            for part in _slices(batch, SLICE_BYTES):
                words, bounds = split_words(part.column(1))
                ids = words.dictionary_encode().indices.to_numpy() + 1
                found = find_runs([ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])], grid, shortest)
                rows, sizes = np.concatenate(found), np.array([len(f) for f in found])
                starts = rows[:, 0] + np.repeat(bounds[:-1], sizes)
                change = np.zeros(len(ids) + 1, np.int64)
                np.add.at(change, starts + rows[:, 2], 1)
                np.add.at(change, starts + rows[:, 1], -1)
                keep = np.cumsum(change)[:-1] == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
                lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep)))
                runs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(struct))
                columns = [
                    part.column(0), pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), runs),
                    pc.binary_join(lists, " "),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RUNS)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Rewrite the texts of a tenth of the documents, chosen by the crc32 of doc_id, so that the words from one place on repeat with a period.

    Documents without doc_id keep their text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != "")

    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").isNotNull()
    rows = docs.withColumn("_words", F.when(chosen, words))
    n, g = F.size("_words"), F.floor(h / 10)
    first = F.when(n > 0, g % n).cast("int")
    rows = rows.withColumn("_first", first)
    rows = rows.withColumn("_period", (F.lit(1) + F.floor((n - F.col("_first")) / (F.lit(3) + g % 8))).cast("int"))
    again = F.transform(
        F.sequence(F.lit(0), n - F.lit(1)),
        lambda i: F.get("_words", F.when(i >= F.col("_first"), F.col("_first") + (i - F.col("_first")) % F.col("_period")).otherwise(i)),
    )
    text = F.when(F.col("_first").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("_words", "_first", "_period")


def run_digests(found: DataFrame) -> DataFrame:
    """The runs' number, the longest (ties: smallest start, then period) and the digests of runs and collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    rows = found.withColumn("_longest", longest)
    return rows.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), (-F.col("_longest.s")).alias("start"),
        F.col("_longest.length").alias("length"), (-F.col("_longest.p")).alias("period"),
        F.expr("1000 * _longest.length div -_longest.p").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
