"""Token counters. A count table is (group, token, cnt); nothing else is kept in memory."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import explode_rows
from ..session import checkpointed


def token_counts(df: DataFrame, keys: Sequence[str], tokens: Column | str) -> DataFrame:
    """One row per (keys, token) with its number of occurrences in an array column."""
    exploded = explode_rows(df, keys, tokens, "token")
    return exploded.groupBy(*keys, "token").agg(F.count("*").alias("cnt"))


#: So many tokens of a batch are counted at a time.
SLICE_TOKENS = 4_000_000


def list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def list_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch whose lists in `column` have some SLICE_TOKENS elements together."""
    upto = np.cumsum(list_sizes(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_TOKENS, "right")))
        yield batch.slice(at, end - at)
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, words to doc, tokens, counts; rows without words go."""
    for batch in batches:
        for part in list_slices(batch, 1):
            row = np.repeat(np.arange(part.num_rows), list_sizes(part.column(1)))
            coded = part.column(1).flatten().dictionary_encode()
            width = max(1, len(coded.dictionary))
            found, counts = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
            tokens = coded.dictionary.take(pa.array(found % width))
            kept, first = np.unique(found // width, return_index=True)
            bounds = pa.array(np.append(first, len(found)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (tokens, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), *lists], ["doc", "tokens", "counts"])


def document_counts(df: DataFrame, doc: str, words: Column) -> DataFrame:
    """One row per document with its distinct tokens and how often each occurs (doc, tokens, counts).

    Words are counted where their row is read and no token is shuffled. Rows that share a document are counted together
    by a shuffle of their tokens; documents without words have no row. `df` is read twice, mostly by the column `doc`.
    """
    schema = f"{doc} {dict(df.dtypes)[doc]}, tokens array<string>, counts array<bigint>"
    several = df.groupBy(F.col(doc).alias("_doc")).agg(F.count("*").alias("_n")).where("_n > 1")
    several = checkpointed(several.select("_doc"))
    if not several.limit(1).count():
        return df.select(doc, words.alias("words")).mapInArrow(_counted, schema)
    same = F.col(doc).eqNullSafe(F.col("_doc"))
    alone = df.join(several, same, "left_anti").select(doc, words.alias("words")).mapInArrow(_counted, schema)
    shared = token_counts(df.join(several, same, "left_semi"), [doc], words)
    packed = shared.groupBy(doc).agg(F.collect_list(F.struct("token", "cnt")).alias("_c"))
    return alone.unionByName(packed.select(doc, F.col("_c.token").alias("tokens"), F.col("_c.cnt").alias("counts")))


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """group, tokens to group, token, n: each token of a batch once for each group."""
    for batch in batches:
        for part in list_slices(batch, 1):
            groups = part.column(0).dictionary_encode(null_encoding="encode")
            coded = part.column(1).flatten().dictionary_encode()
            width = max(1, len(coded.dictionary))
            group = np.repeat(groups.indices.to_numpy().astype(np.int64), list_sizes(part.column(1)))
            found, counts = np.unique(group * width + coded.indices.to_numpy(), return_counts=True)
            columns = [groups.dictionary.take(pa.array(found // width)), coded.dictionary.take(pa.array(found % width)), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["group", "token", "n"])


def rare_token_counts(df: DataFrame, key: str, tokens: Column | str, parts: int = 0) -> DataFrame:
    """As `token_counts` by one key, for tokens that are mostly rare, such as n-grams of words.

    Sums before a shuffle would hold nearly as many tokens as there are and spill them. Here only the tokens of a batch are put
    together before the shuffle, and the rest is summed after it, in `parts` partitions or as many as the session names, if more.
    """
    parts = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lists = df.select(key, (F.col(tokens) if isinstance(tokens, str) else tokens).alias("tokens"))
    pooled = lists.mapInArrow(_pooled, f"{key} {dict(df.dtypes)[key]}, token string, n long")
    return pooled.repartition(parts, key, "token").groupBy(key, "token").agg(F.sum("n").alias("cnt"))


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column(0).flatten().value_counts()
        yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["token", "n"])


def tallied(df: DataFrame, tokens: str, name: str = "cnt") -> DataFrame:
    """token and its number of occurrences in the array column `tokens`; those of a batch are put together before they are summed."""
    counts = df.select(tokens).mapInArrow(_tallied, "token string, n long")
    return counts.groupBy("token").agg(F.sum("n").alias(name))


def documents_with(counts: DataFrame) -> DataFrame:
    """token, df: in how many rows of `document_counts` a token is."""
    return tallied(counts, "tokens", "df")


def add_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum counters of finer groups into counters of `keys`."""
    return counts.groupBy(*keys, "token").agg(F.sum("cnt").alias("cnt"))


def over_vocabulary(vocab: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts for every piece of the vocabulary, zeros included."""
    named = counts.withColumnRenamed("token", "piece")
    joined = vocab.join(named, [*keys, "piece"], "left")
    return joined.withColumn("cnt", F.coalesce("cnt", F.lit(0)).cast("long"))


def sorted_counts(dense: DataFrame, unknown: str = "<unk>") -> DataFrame:
    """(count, piece) from high to low without the unknown piece; ties by piece, high to low."""
    return dense.where(F.col("piece") != unknown).orderBy(F.col("cnt").desc(), F.col("piece").desc())


def unknown_count(dense: DataFrame, keys: Sequence[str], unknown: str = "<unk>") -> DataFrame:
    """The count of the unknown piece, which must be piece 0."""
    first = F.max(F.when(F.col("piece_id") == 0, F.col("piece")))
    checked = F.when(first == unknown, F.sum(F.when(F.col("piece") == unknown, F.col("cnt")).otherwise(0)))
    guard = F.coalesce(checked, F.raise_error(F.lit("piece 0 must be the unknown piece")).cast("long"))
    return dense.groupBy(*keys).agg(guard.alias("n_unknown"))


def with_probability(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add p = cnt / total of the group. Totals are one row per group."""
    totals = counts.groupBy(*keys).agg(F.sum("cnt").alias("total"))
    return counts.join(totals, list(keys)).withColumn("p", F.col("cnt") / F.col("total"))


def prune_rare(dense: DataFrame, cutoff: int, keys: Sequence[str], bucket_width: int = 100_000) -> DataFrame:
    """Pieces with more than `cutoff` occurrences, except piece 0, re-numbered from 0 in id order."""
    from .ordering import dense_index

    kept = dense.where((F.col("piece_id") != 0) & (F.col("cnt") > cutoff))
    bucket = F.floor(F.col("piece_id") / bucket_width)
    return dense_index(kept, ["piece_id"], bucket, keys, "new_id")
