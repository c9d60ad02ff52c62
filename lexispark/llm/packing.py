"""Best-fit packing of token sequences in bulk-synchronous steps.

Documents longer than a sequence are cut into whole sequences, the shorter rest first. Pieces of one length are alike for
packing, and so are open sequences with one gap, so both are kept as range-sorted runs: (length, first rank, count) and
(gap, first sequence, count). In each step a sweep from the largest value down gives every piece the smallest gap that is
no smaller than the piece and not taken; where more pieces than gaps meet, the longer piece wins, then the lower rank.
Then gaps are updated and the next step begins. When no piece fits any gap, new sequences are opened for the longest.

What is decided in steps depends on the number of lengths (the capacity) and not on the number of pieces; ranks and
places of the pieces are computed where the pieces are. Null texts count as empty and hold the end id only.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, _slices, written
from .tokens import END_ID, Encoder

CAPACITY = 1024


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, for ranks, task and place among the task's pieces of that length."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
    arrow = _arrow_schema(docs.sparkSession, schema)
    rows = docs.select("doc_id", "text", F.spark_partition_id().alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, end_id)
        seen: Counter = Counter()
        for batch in batches:
            for part in _slices(batch):
                task = part.column(2)[0].as_py() if part.num_rows else 0
                out: dict[str, list] = {f.name: [] for f in arrow}
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    start, data = 0, ids.astype("<u4")
                    for k, length in enumerate(cut(len(ids), capacity)):
                        row = (doc_id, k, start, length, zlib.crc32(data[start : start + length].tobytes()), task, seen[length])
                        for name, value in zip(out, row):
                            out[name].append(value)
                        seen[length] += 1
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return rows.mapInArrow(run, schema)


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of n ids: whole sequences, and the rest first."""
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def sweep(docs: list[tuple], gaps: list[tuple], capacity: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """One step: (placements, pieces left, gaps left) from runs of pieces and gaps.

    A placement is (length, first rank, count, first sequence, offset). Values come in descending order; a piece takes the
    gap that came last and is free, which is the smallest one at least as large.
    """
    placed, left, updated, free = [], [], [], []
    gaps = sorted(gaps, key=lambda g: (-g[0], g[1]))
    k = 0
    for size, first, n in sorted(docs, key=lambda d: (-d[0], d[1])):
        while k < len(gaps) and gaps[k][0] >= size:
            free.append(gaps[k])
            k += 1
        while n and free:
            gap, sequence, m = free.pop()
            t = min(n, m)
            placed.append((size, first, t, sequence, capacity - gap))
            if gap > size:
                updated.append((gap - size, sequence, t))
            if m > t:
                free.append((gap, sequence + t, m - t))
            first, n = first + t, n - t
        if n:
            left.append((size, first, n))
    return placed, left, updated + free + gaps[k:]


def open_new(docs: list[tuple], opened: int, capacity: int) -> tuple[list[tuple], list[tuple], list[tuple], int]:
    """Open as few sequences as the ids left may fit into, each with one of the longest pieces left."""
    need = -(-sum(size * n for size, _, n in docs) // capacity)
    placed, left, gaps = [], [], []
    for size, first, n in sorted(docs, key=lambda d: (-d[0], d[1])):
        t = min(n, need)
        # Pieces over half a sequence never share one, so each of them needs its own.
        t = n if 2 * size > capacity else t
        if t:
            placed.append((size, first, t, opened, 0))
            if size < capacity:
                gaps.append((capacity - size, opened, t))
            opened, need = opened + t, max(0, need - t)
        if n > t:
            left.append((size, first + t, n - t))
    return placed, left, gaps, opened


def joined_runs(gaps: list[tuple]) -> list[tuple]:
    """Runs of neighbouring sequences with one gap as one run."""
    out: list[list] = []
    for gap, sequence, n in sorted(gaps, key=lambda g: (g[0], g[1])):
        if out and out[-1][0] == gap and out[-1][1] + out[-1][2] == sequence:
            out[-1][2] += n
        else:
            out.append([gap, sequence, n])
    return [tuple(g) for g in out]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """All placements and the number of sequences, from the number of pieces of each length."""
    docs = [(size, 0, n) for size, n in counts.items()]
    gaps: list[tuple] = []
    placed: list[tuple] = []
    opened = 0
    while docs:
        new, docs, gaps = sweep(docs, gaps, capacity)
        gaps = joined_runs(gaps)
        placed += new
        if docs and not new:
            new, docs, more, opened = open_new(docs, opened, capacity)
            gaps += more
            placed += new
    return placed, opened


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of `docs` (doc_id, text)."""
    rows = written(pieces(docs, capacity, tokenizer, end_id), "pieces")
    per_task = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranked = rows.join(per_task.withColumn("before", F.coalesce(before, F.lit(0))).drop("n"), ["length", "task"])
    # One count per length, `capacity` rows at most.
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed, _ = plan(counts, capacity)
    by_length: dict[int, np.ndarray] = {}
    for size in counts:
        by_length[size] = np.array(sorted(p[1:] for p in placed if p[0] == size), np.int64)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for size in np.unique(lengths).tolist():
                own, runs = lengths == size, by_length[size]
                k = np.searchsorted(runs[:, 0], ranks[own], "right") - 1
                sequence[own] = runs[k, 2] + ranks[own] - runs[k, 0]
                offset[own] = runs[k, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], schema=arrow)

    return ranked.select(*names, (F.col("before") + F.col("place")).alias("rank")).mapInArrow(run, schema)
