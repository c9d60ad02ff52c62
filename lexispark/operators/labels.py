"""Label tables and the alignment of word labels with pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.rows import explode_rows
from .scoring import IGNORED


def label_array(df: DataFrame, tags: str) -> DataFrame:
    """One row holding the sorted distinct labels; a label's id is its place."""
    distinct = explode_rows(df, [], tags, "label").distinct()
    return distinct.agg(F.sort_array(F.collect_list("label")).alias("labels"))


def label_table(df: DataFrame, tags: str) -> DataFrame:
    """label, label_id, inside_id: `inside_id` is the id of I-X for B-X where I-X exists."""
    rows = label_array(df, tags).select("labels", F.posexplode("labels").alias("label_id", "label"))
    return rows.select("label", "label_id", inside_id(F.col("labels"), F.col("label")).alias("inside_id"))


def label_id(labels: Column, label: Column) -> Column:
    return (F.array_position(labels, label) - 1).cast("int")


def inside_id(labels: Column, label: Column) -> Column:
    inside = F.replace(label, F.lit("B-"), F.lit("I-"))
    usable = label.startswith("B-") & F.array_contains(labels, inside)
    return F.when(usable, label_id(labels, inside)).otherwise(label_id(labels, label))


def adopt_order(dataset: DataFrame, model: DataFrame) -> DataFrame:
    """label, label_id, adopted: the model's ids if both have the same labels, else the dataset's.

    Both inputs are label tables (label, label_id).
    """
    both = dataset.withColumnRenamed("label_id", "own").join(model.withColumnRenamed("label_id", "theirs"), "label", "full")
    odd = both.agg(F.sum((F.col("own").isNull() | F.col("theirs").isNull()).cast("int")))
    rows = both.where(F.col("own").isNotNull()).withColumn("adopted", odd.scalar() == 0)
    return rows.select("label", F.when(F.col("adopted"), F.col("theirs")).otherwise(F.col("own")).alias("label_id"), "adopted")


def align_labels(
    df: DataFrame, tags: str, n_pieces: str, labels: DataFrame, max_length: int, label_all_pieces: bool = False
) -> DataFrame:
    """Add label_ids and first_piece for `<s>` + the pieces of all words + `</s>`.

    The first piece of a word carries its label, the others the ignored label or, with
    `label_all_pieces`, the inside label. `first_piece` gives each position the position of the
    first piece of its word. All sequences of a batch are aligned as one array.
    """
    # The distinct labels are few.
    known = list(labels.first()[0])
    ids = [pa.int32(), pa.list_(pa.int32())]
    out = StructType([*df.schema.fields, *(StructField(c, ArrayType(IntegerType())) for c in ("label_ids", "first_piece"))])
    at = [df.columns.index(c) for c in (tags, n_pieces)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = (batch.column(i) for i in at)
            coded = words.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            # The label of a first piece and of the others, by tag; a null tag has a null label.
            first = pa.array([*(_place(known, n) for n in names), None], ids[0])
            rest = pa.array([*(_inside_place(known, n) if label_all_pieces else IGNORED for n in names), None if label_all_pieces else IGNORED], ids[0])
            tag = coded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            size = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (words, counts)]
            begin = [np.cumsum(n) - n for n in size]
            n = counts.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), size[1])
            place = np.arange(len(n)) - begin[1][row]
            own = place < size[0][row]
            tags_at = np.full(len(n), len(names), np.int64)
            tags_at[own] = tag[(begin[0][row] + place)[own]]
            # Words without pieces do not count; those past the room are not looked at.
            use = n > 0
            row, n, tags_at = row[use], np.minimum(n[use], max_length), tags_at[use]
            before = np.cumsum(n) - n
            new = np.flatnonzero(np.diff(row, prepend=-1))
            start = before - np.repeat(before[new], np.diff(np.append(new, len(row))))
            kept = np.clip(max_length - 2 - start, 0, n)
            word = np.repeat(np.arange(len(row)), kept)
            inner = np.arange(len(word)) - np.repeat(np.cumsum(kept) - kept, kept)
            label = pc.if_else(pa.array(inner == 0), first.take(pa.array(tags_at[word])), rest.take(pa.array(tags_at[word])))
            pieces = np.bincount(row[word], minlength=batch.num_rows).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(pieces + 2)])
            # All places of a batch: a special one, the pieces, a special one.
            middle = np.ones(bounds[-1], bool)
            middle[bounds[:-1]] = middle[bounds[1:] - 1] = False
            order = np.full(bounds[-1], len(label), np.int64)
            order[middle] = np.arange(len(label))
            label_ids = pa.concat_arrays([label, pa.array([IGNORED], ids[0])]).take(pa.array(order))
            pointers = np.zeros(bounds[-1], np.int32)
            pointers[middle] = start[word] + 1
            pointers[bounds[1:] - 1] = pieces + 1
            missing = pc.or_(words.is_null(), counts.is_null())
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v, ids[0])) for v in (label_ids, pointers)]
            lists = [pc.if_else(missing, pa.scalar(None, ids[1]), x) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=out.names)

    return df.mapInArrow(run, out)


def _place(labels: list[str], tag: str | None) -> int | None:
    return None if tag is None else labels.index(tag) if tag in labels else -1


def _inside_place(labels: list[str], tag: str | None) -> int | None:
    """As `inside_id`, of a value."""
    inside = tag and tag.replace("B-", "I-")
    return _place(labels, inside if tag and tag.startswith("B-") and inside in labels else tag)
