"""Predictions against labels. Sequences stay arrays: nothing is exploded unless a class needs it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import explode_rows

# Fixed value: the label id that is never scored.
IGNORED = -100


def scored_positions(labels: Column, preds: Column) -> Column:
    """Array of (label, pred) without the ignored positions."""
    both = F.zip_with(labels, preds, lambda y, p: F.struct(y.alias("label"), p.alias("pred")))
    return F.filter(both, lambda s: s["label"] != F.lit(IGNORED))


def accuracy(df: DataFrame, label: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    hit = F.when(F.col(label) == F.col(pred), 1.0).otherwise(0.0)
    return df.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))


def _kind(tag: Column) -> Column:
    return F.substring(tag, 1, 1)


def _type(tag: Column) -> Column:
    """What follows the first character and, if there is one after it, the first dash; an empty type is '_'."""
    rest = F.substring(tag, F.lit(2), F.length(tag))
    named = F.when(F.instr(rest, "-") > 0, F.substring(rest, F.instr(rest, "-") + 1, F.length(rest))).otherwise(rest)
    return F.when(named == "", F.lit("_")).otherwise(named)


def _begins(prev: Column, cur: Column) -> Column:
    """Does a chunk begin at `cur`, coming from `prev`? Lenient: I after O also begins one."""
    p, c = _kind(prev), _kind(cur)
    return (
        c.isin("B", "S")
        | (c.isin("I", "E") & p.isin("E", "S"))
        | ((c != "O") & ((p == "O") | (_type(prev) != _type(cur))))
    )


def chunks(tags: Column) -> Column:
    """Array of (type, first, last) for the chunks of a tag sequence."""
    n = F.size(tags)
    outside = F.array(F.lit("O"))
    before = F.concat(outside, F.slice(tags, F.lit(1), F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.when(n > 1, F.slice(tags, F.lit(2), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<string>")), outside)
    starts = F.zip_with(before, tags, _begins)
    stops = F.zip_with(tags, after, lambda c, x: (_kind(c) != "O") & (_begins(c, x) | (_kind(x) == "O")))
    first = F.filter(F.transform(starts, lambda s, i: F.when(s, i)), lambda i: i.isNotNull())
    last = F.filter(F.transform(stops, lambda s, i: F.when(s, i)), lambda i: i.isNotNull())
    return F.zip_with(
        first, last, lambda a, b: F.struct(_type(F.get(tags, a)).alias("type"), a.alias("first"), b.alias("last"))
    )


def _ratios(df: DataFrame) -> DataFrame:
    tp, found, gold = F.col("tp"), F.col("n_pred"), F.col("support")
    precision = F.when(found > 0, tp / found).otherwise(0.0)
    recall = F.when(gold > 0, tp / gold).otherwise(0.0)
    out = df.withColumn("precision", precision).withColumn("recall", recall)
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def entity_scores(df: DataFrame, tags: str, preds: str) -> DataFrame:
    """Chunk precision, recall and F1 per type and overall (`type` = 'overall'), and token accuracy.

    Chunks of a batch of sequences are found and compared where they are, so only counts per type are shuffled, and one
    pass over the sequences gives everything.
    """
    names = ["support", "n_pred", "tp", "n_tokens", "n_right"]
    counted = df.select(tags, preds).mapInArrow(_count_chunks, "type string, " + ", ".join(f"{n} long" for n in names))
    # Totals have no type, which no chunk lacks.
    sums = [F.sum(name).alias(name) for name in names]
    totals = counted.rollup("type").agg(*sums, F.grouping("type").alias("_all")).where("_all = 1 or type IS NOT NULL")
    # The table has one row per type by now.
    whole = Window.partitionBy(F.lit(1))
    accuracy = F.max(F.when(F.col("_all") == 1, F.col("n_right") / F.col("n_tokens"))).over(whole)
    kind = F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col("type"))
    rows = totals.withColumn("accuracy", accuracy).withColumn("type", kind)
    return _ratios(rows.drop("_all", "n_tokens", "n_right"))


def _type_of(tag: str) -> str:
    """As `_type`, of a value."""
    rest = tag[1:]
    return rest[rest.find("-") + 1 :] or "_"


def _starts_chunk(prev: str | None, cur: str | None) -> bool:
    """As `_begins`, of values; a null tag begins nothing."""
    if cur is None or cur[:1] in ("B", "S"):
        return cur is not None
    if prev is None:
        return False
    p, c = prev[:1], cur[:1]
    return (c in ("I", "E") and p in ("E", "S")) or (c != "O" and (p == "O" or _type_of(prev) != _type_of(cur)))


def _stops_chunk(cur: str | None, after: str | None) -> bool:
    return cur is not None and cur[:1] != "O" and after is not None and (_starts_chunk(cur, after) or after[:1] == "O")


def _of_pairs(test: Callable, left: np.ndarray, right: np.ndarray, names: list) -> np.ndarray:
    """`test` of each pair of tags, which is asked once for each different pair."""
    pairs, place = np.unique(left * len(names) + right, return_inverse=True)
    return np.array([test(names[p // len(names)], names[p % len(names)]) for p in pairs.tolist()], bool)[place]


def _found_chunks(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, names: list) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and last tags of all chunks; `names` ends with the tag that stands outside of a sequence."""
    outside = len(names) - 1
    before, after = np.concatenate([[outside], codes[:-1]]), np.concatenate([codes[1:], [outside]])
    some = size > 0
    before[begin[some]] = outside
    after[(begin + size)[some] - 1] = outside
    return np.flatnonzero(_of_pairs(_starts_chunk, before, codes, names)), np.flatnonzero(_of_pairs(_stops_chunk, codes, after, names))


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a batch by type, and one row without a type for its tokens. Tags are numbers here, so all sequences are one array."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = [batch.column(i).flatten() for i in (0, 1)]
        size = [pc.fill_null(pc.list_value_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)]
        begin = [np.cumsum(n) - n for n in size]
        coded = pa.concat_arrays(flat).dictionary_encode()
        names = [*coded.dictionary.to_pylist(), None, "O"]
        codes = coded.indices.fill_null(len(names) - 2).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = [codes[: len(flat[0])], codes[len(flat[0]) :]]
        types = sorted({_type_of(n) for n in names if n is not None})
        kind = np.array([-1 if n is None else types.index(_type_of(n)) for n in names])
        width = max(1, int(max(n.max() for n in size)))
        row = [np.repeat(np.arange(len(n)), n) for n in size]
        # The place of a token: the same in both sequences of a row.
        place = [row[i] * width + np.arange(len(codes[i])) - begin[i][row[i]] for i in (0, 1)]
        chunk = []
        for i in (0, 1):
            first, last = _found_chunks(codes[i], begin[i], size[i], names) if len(codes[i]) else (np.zeros(0, np.int64),) * 2
            chunk.append((place[i][first], place[i][last], kind[codes[i][first]]))
        (a, a_last, a_type), (b, b_last, b_type) = chunk
        _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        hit = a_type[x][(a_last[x] == b_last[y]) & (a_type[x] == b_type[y])]
        _, x, y = np.intersect1d(*place, assume_unique=True, return_indices=True)
        right = int(((codes[0][x] == codes[1][y]) & (codes[0][x] != len(names) - 2)).sum())
        counts = [np.bincount(t, minlength=len(types)) for t in (a_type, b_type, hit)]
        use = np.flatnonzero(counts[0] + counts[1])
        columns = [[*c[use].tolist(), 0] for c in counts]
        zero = [0] * len(use)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*(types[t] for t in use), None], pa.string()), *(pa.array(c, pa.int64()) for c in (*columns, [*zero, len(codes[0])], [*zero, right]))],
            ["type", "support", "n_pred", "tp", "n_tokens", "n_right"],
        )


def class_scores(df: DataFrame, label: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, over classes seen as label or prediction."""
    confusion = df.groupBy(*keys, F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    same = F.col("y") == F.col("p")
    gold = confusion.groupBy(*keys, F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(same, F.col("n")).otherwise(0)).alias("tp"))
    guess = confusion.groupBy(*keys, F.col("p").alias("class")).agg(F.sum("n").alias("n_pred"))
    both = gold.join(guess, [*keys, "class"], "full").na.fill(0, ["support", "tp", "n_pred"])
    return _ratios(both)


def macro_scores(df: DataFrame, label: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Plain means over classes and the accuracy, one row per `keys`."""
    per_class = class_scores(df, label, pred, keys)
    means = [F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    return per_class.groupBy(*keys).agg(*means, (F.sum("tp") / F.sum("support")).alias("accuracy"))


def flatten_class_scores(scores: DataFrame, name: str = "class") -> DataFrame:
    """One (metric, value) row per class and measure, named <class>_<measure>."""
    measures = F.array(*[F.struct(F.lit(m).alias("m"), F.col(c).cast("double").alias("v")) for m, c in (
        ("precision", "precision"), ("recall", "recall"), ("f1", "f1"), ("number", "support"))])
    rows = scores.select(F.col(name).alias("_class"), F.explode(measures).alias("e"))
    return rows.select(F.concat_ws("_", "_class", "e.m").alias("metric"), F.col("e.v").alias("value"))


def perplexity(loss: Column) -> Column:
    """exp of the loss; too large a loss gives infinity."""
    return F.exp(loss)


def capped_count(df: DataFrame, cap: int | None, keys: Sequence[str] = ()) -> DataFrame:
    n = F.count("*")
    return df.groupBy(*keys).agg((F.least(n, F.lit(cap)) if cap else n).cast("long").alias("n_samples"))
