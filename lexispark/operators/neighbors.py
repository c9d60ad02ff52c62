"""Exact k nearest neighbours by pivots: the data step of a neighbour embedding.

Rows are grouped around a bounded set of pivot rows, and groups that lie near each other form blocks; a big group is cut into
several. A row is compared with its own block first: its k-th distance there bounds how far a neighbour can be, so the
triangle inequality tells which other blocks the row must visit. A row is copied once for each block it visits, never for each group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .clustering import _dense, distances

MAX_PIVOTS = 512
BLOCK_ROWS = 2048
# Blocks grow with the table up to this size, so that rows are copied to few of them.
MAX_BLOCK_ROWS = 16384
FEW_BLOCKS = 16
# Rows that a task holds distances of at a time.
SLICE_ROWS = 256
# Slack for rounding when distances are compared with bounds.
SLACK = 1e-9
# Pairs of rows that a task subtracts at a time.
PAIRS = 1 << 15


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), SLICE_ROWS):
            yield batch.iloc[i : i + SLICE_ROWS].reset_index(drop=True)


def _chain(between: np.ndarray) -> list[int]:
    """All pivots, each followed by the nearest one that is left."""
    left = np.ones(len(between), bool)
    order = [0]
    left[0] = False
    while len(order) < len(between):
        order.append(int(np.where(left, np.nan_to_num(between[order[-1]], nan=np.inf, posinf=1e300), np.inf).argmin()))
        left[order[-1]] = False
    return order


def _blocks(order: list[int], size: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """By cell: its first block and its number of blocks. Small cells share one."""
    first, parts = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
    used, shared, filled = 0, -1, 0
    for cell in order:
        n = int(size[cell])
        if n > block_rows:
            first[cell], parts[cell] = used, -(-n // block_rows)
            used += int(parts[cell])
        else:
            if shared < 0 or filled + n > block_rows:
                shared, filled, used = used, 0, used + 1
            first[cell] = shared
            filled += n
    return first, parts


class _Side:
    """Rows of a block with what their distances need."""

    def __init__(self, rows: pd.DataFrame, center: np.ndarray) -> None:
        self.v = _dense(rows["_v"])
        self.moved = self.v - center
        self.norm = np.einsum("ij,ij->i", self.moved, self.moved)


def _codes(q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys as numbers; a null key equals no other."""
    codes = pd.factorize(np.concatenate([q, m]))[0]
    return np.where(codes[: len(q)] < 0, -2, codes[: len(q)]), codes[len(q) :]


def _squares(q: _Side, m: _Side, at: slice, qc: np.ndarray, mc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of some rows by one matrix product, own rows infinite; and how far they may be off."""
    out = q.norm[at, None] + m.norm[None, :] - 2 * (q.moved[at] @ m.moved.T)
    out[qc[at, None] == mc[None, :]] = np.inf
    return out, 1e-10 * (q.norm[at] + (np.nanmax(m.norm) if len(m.norm) else 0.0))


def _exact(q: _Side, m: _Side, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    out = np.empty(len(at))
    for i in range(0, len(at), PAIRS):
        diff = q.v[at[i : i + PAIRS]] - m.v[other[i : i + PAIRS]]
        out[i : i + PAIRS] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return np.round(out, 9)


def _step(members: int) -> int:
    return max(1, min(SLICE_ROWS, (1 << 22) // max(1, members)))


def nearest_neighbors(df: DataFrame, key: str, vector: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, neighbor, distance, rank: the k nearest other rows of each row, ties by key."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
    key_type = dict(rows.dtypes)["_key"]
    n = rows.count()
    n_pivots = max(1, min(MAX_PIVOTS, math.ceil(n / block_rows) * 16, n))
    chosen = rows.orderBy(F.xxhash64("_key"), "_key").limit(n_pivots).toPandas()
    pivots = _dense(chosen["_v"])
    between = distances(pivots, pivots)
    center = pivots.mean(axis=0)
    block_rows = max(block_rows, min(MAX_BLOCK_ROWS, n // FEW_BLOCKS))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            dist = distances(_dense(batch["_v"]), pivots)
            cell = dist.argmin(axis=1)
            yield batch.assign(cell=cell, radius=dist[np.arange(len(batch)), cell])

    members = rows.mapInPandas(to_cells, f"_key {key_type}, _v array<double>, cell int, radius double")
    stats = members.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("r")).toPandas()
    size, radius = np.zeros(n_pivots, dtype=np.int64), np.full(n_pivots, -np.inf)
    size[stats["cell"]], radius[stats["cell"]] = stats["n"], stats["r"]
    order = _chain(between)
    first, parts = _blocks(order, size, block_rows)
    # Cells that share a block are visited as one.
    cells = np.array(order)[np.argsort(first[order], kind="stable")]
    starts = np.flatnonzero(np.diff(first[cells], prepend=-1))
    group_first, group_parts = first[cells][starts], parts[cells][starts]

    def add_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in to_cells(batches):
            cell = batch["cell"].to_numpy()
            yield batch[["_key", "_v"]].assign(first=first[cell], parts=parts[cell])

    block = (F.col("first") + F.pmod(F.xxhash64("_key"), F.col("parts"))).alias("block")
    placed = rows.mapInPandas(add_blocks, f"_key {key_type}, _v array<double>, first long, parts long").select("_key", "_v", block)

    def at_home(m: pd.DataFrame) -> pd.DataFrame:
        side, (qc, mc) = _Side(m, center), _codes(m["_key"].to_numpy(), m["_key"].to_numpy())
        bound = np.full(len(m), np.inf)
        step = _step(len(m))
        for i in range(0, len(m) if len(m) > k else 0, step):
            at = slice(i, i + step)
            near, slack = _squares(side, side, at, qc, mc)
            bound[at] = np.sqrt(np.maximum(np.partition(near, k - 1, axis=1)[:, k - 1] + slack, 0.0)) + SLACK
        return m.assign(bound=bound)

    home = placed.repartition(tasks, "block").groupBy("block").applyInPandas(at_home, f"_key {key_type}, _v array<double>, block long, bound double")
    # Read for the number of visits, for the visits and as members.
    home = stored(home, "neighbors")

    def visits(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        dist = distances(_dense(batch["_v"]), pivots)
        own = dist.argmin(axis=1)
        nearest = dist[np.arange(len(batch)), own]
        gap = between[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(gap > 0, (dist**2 - nearest[:, None] ** 2) / (2 * gap), -np.inf)
        low = np.maximum(dist - radius[None, :], plane)
        cell = (size[None, :] > 0) & (low <= batch["bound"].to_numpy()[:, None] + SLACK)
        at, group = np.nonzero(np.logical_or.reduceat(cell[:, cells], starts, axis=1))
        several = group_parts[group]
        part = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
        return np.repeat(at, several), np.repeat(group_first[group], several) + part

    n_blocks = int((first + parts).max())

    def count_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_blocks, dtype=np.int64)
        for batch in _slices(batches):
            total += np.bincount(visits(batch)[1], minlength=n_blocks)
        yield pd.DataFrame({"block": np.arange(n_blocks), "n": total})

    visited = home.mapInPandas(count_visits, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).toPandas()
    n_visits = np.zeros(n_blocks, dtype=np.int64)
    n_visits[visited["block"]] = visited["n"]
    query_parts = np.maximum(1, -(-n_visits // block_rows))

    def to_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            at, to = visits(batch)
            # As many rows again as came in, at most, for each yield.
            for i in range(0, len(at), 16 * SLICE_ROWS):
                a, b = at[i : i + 16 * SLICE_ROWS], to[i : i + 16 * SLICE_ROWS]
                yield batch.iloc[a][["_key", "_v", "bound"]].assign(block=b, parts=query_parts[b])

    queries = home.mapInPandas(to_visits, f"_key {key_type}, _v array<double>, bound double, block long, parts long").select(
        "_key", "_v", "bound", "block", F.pmod(F.xxhash64("_key"), F.col("parts")).alias("part"),
    )
    copies = F.element_at(F.array(*[F.lit(int(p)) for p in query_parts]), (F.col("block") + 1).cast("int"))
    held = home.select("_key", "_v", "block", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1)).alias("part"))

    def best(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        qk, mk = q["_key"].to_numpy(), m["_key"].to_numpy()
        found = [(qk[:0], mk[:0], np.zeros(0))]
        if len(q) and len(m):
            left, right = _Side(q, center), _Side(m, center)
            qc, mc = _codes(qk, mk)
            bound = q["bound"].to_numpy()
            step = _step(len(m))
            for i in range(0, len(q), step):
                near, slack = _squares(left, right, slice(i, i + step), qc, mc)
                limit = (bound[i : i + step] + 2 * SLACK) ** 2 + slack
                if len(m) > k and not np.isfinite(limit).all():
                    limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack + SLACK)
                at, other = np.nonzero((near <= limit[:, None]) & ~np.isposinf(near))
                dist = _exact(left, right, at + i, other)
                order = np.lexsort((mk[other], dist, at))
                at, other, dist = at[order], other[order], dist[order]
                new = np.flatnonzero(np.diff(at, prepend=-1))
                place = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
                use = (place < k) & np.isfinite(dist)
                found.append((qk[at[use] + i], mk[other[use]], dist[use]))
        keys, others, dists = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame({"_key": keys, "neighbor": others, "distance": dists})

    on = ["block", "part"]
    found = queries.repartition(tasks, *on).groupBy(*on).cogroup(held.repartition(tasks, *on).groupBy(*on)).applyInPandas(
        best, f"_key {key_type}, neighbor {key_type}, distance double"
    )
    rank = F.row_number().over(Window.partitionBy("_key").orderBy("distance", "neighbor"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("_key").alias(key), "neighbor", "distance", "rank")
