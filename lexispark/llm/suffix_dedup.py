"""Exact removal of repeated byte strings by longest previous factors.

A byte goes if it lies in a string of `LENGTH` bytes that also starts earlier: in an earlier document, or earlier in its
own. The longest previous factor of a place is the longest string there that starts earlier as well; in suffix order it
is found at the previous or the next smaller place. Only whether it reaches LENGTH counts, so suffixes are ordered by
their first LENGTH bytes and then by place: the previous smaller place with LENGTH bytes in common, if there is one, is
the neighbour before.

Suffixes of different texts need not be sorted together. Of each window of LENGTH bytes the 32-byte gram with the least
hash is its anchor (winnowing), so equal windows have equal anchors. Neighbouring windows with one anchor are a stretch.
1. Stretches whose anchor occurs once hold no repeat. 2. Of equal stretches all but the first are repeats; their digests
meet as partial minima, so a passage in a third of all documents is no large group. 3. First stretches with one anchor
but different bytes are ordered by suffix, group after group. A group of more than `GROUP` stretches is spread by the
hash of its windows instead, each task handing on the first of equal windows only.

Null texts count as empty. Texts shorter than LENGTH lose nothing. Rows without doc_id come last in the order; different
texts with one doc_id are ordered by hash; repeated rows (same doc_id and text) are one document and lose the same bytes.
Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, _slices, with_side, written

LENGTH = 100
GRAM = 32
#: Stretches with one anchor that one task orders by suffix.
GROUP = 256
_PLACE_BITS = 28
_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: A place is the rank of a text among those with its doc_id, times this, plus the byte.
_ROOM = 1 << 40


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor, hash) of the stretches of texts that lie one after another in `data`.

    `ends` are the ends of the texts. Windows that would cross an end are left out.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    hashes, size = _TABLE[data], 1
    while size < GRAM:
        hashes = _mix(hashes[:-size] * _FACTOR + hashes[size:])
        size *= 2
    keys = (hashes & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    slide, size = LENGTH - GRAM + 1, 1
    while 2 * size <= slide:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    if size < slide:
        keys = np.minimum(keys[: len(keys) - (slide - size)], keys[slide - size :])
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(data) + 1, np.int32)
    full = ends - starts >= LENGTH
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, ends[full] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(keys)])
    if not len(windows):
        return none, none, none, np.zeros(0, np.uint64)
    owner = keys[windows]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (windows[1:] != windows[:-1] + 1)])
    first = windows[new]
    counts = np.diff(np.concatenate([np.flatnonzero(new), [len(windows)]]))
    anchors = (owner[new] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    return first, counts, anchors, hashes[anchors]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each ends."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def _ordered(docs: DataFrame) -> DataFrame:
    """doc (nulls last), base (place of the text's first byte among the texts with its doc_id), text."""
    docs = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "text")
    twice = docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
    if not twice.limit(1).count():
        return docs.select("doc", F.lit(0).cast("long").alias("base"), "text")
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    versions = hashed.join(twice, "doc", "left_semi").select("doc", "hash").distinct()
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("hash")) - 1
    ranked = written(versions.select("doc", "hash", (rank * F.lit(_ROOM)).cast("long").alias("base")), "versions")
    return hashed.join(ranked, ["doc", "hash"], "left").select("doc", F.coalesce("base", F.lit(0)).alias("base"), "text")


def _anchor_hashes(docs: DataFrame) -> DataFrame:
    arrow = _arrow_schema(docs.sparkSession, "anchor long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 4 << 20):
                found = stretches(*_bytes_of(part.column(0)))[3]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], schema=arrow)

    return docs.select("text").mapInArrow(run, "anchor long")


STRETCH = "anchor long, digest long, doc long, at long, n int"


def _stretch_rows(docs: DataFrame) -> DataFrame:
    """One row per stretch: anchor, digest of its bytes and the anchor's place in them, doc, first place, windows."""
    arrow = _arrow_schema(docs.sparkSession, STRETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 4 << 20):
                data, ends = _bytes_of(part.column(2))
                first, counts, anchors, hashes = stretches(data, ends)
                view = memoryview(data)
                spans = zip(first.tolist(), (first + counts + LENGTH - 1).tolist(), (anchors - first).tolist())
                digests = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b], s) for a, b, s in spans), np.uint64, len(first))
                row = np.searchsorted(ends, first, "right")
                starts = np.concatenate([[0], ends[:-1]])[row] if len(first) else first
                doc, base = part.column(0).to_numpy()[row], part.column(1).to_numpy()[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(digests.view(np.int64)), pa.array(doc), pa.array(base + first - starts), pa.array(counts.astype(np.int32))],
                    schema=arrow,
                )

    return docs.select("doc", "base", "text").mapInArrow(run, STRETCH)


def _with_bytes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (anchor, doc, at, n, hot) with the bytes of their windows, read from the documents."""
    shape = F.col("n") * 2 + F.col("hot").cast("int")
    per_doc = rows.groupBy("doc").agg(F.flatten(F.collect_list(F.array("anchor", "at", shape.cast("long")))).alias("spans"))
    chosen = with_side(docs, written(per_doc, "spans"), "doc", items=F.size("spans"))
    schema = "anchor long, doc long, at long, n int, hot boolean, data binary"
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 4 << 20):
                out: list[tuple] = []
                for doc, base, text, spans in zip(*(part.column(i).to_pylist() for i in range(4))):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    for anchor, place, shape in zip(spans[::3], spans[1::3], spans[2::3]):
                        at, n = place - base, shape // 2
                        if 0 <= at < len(data):  # else it belongs to another text with this doc_id
                            out.append((anchor, doc, place, n, shape % 2 == 1, data[at : at + n + LENGTH - 1]))
                columns = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    # Repeated rows give the same stretch twice.
    return chosen.select("doc", "base", "text", "spans").mapInArrow(run, schema).where(F.length("data") == F.col("n") + LENGTH - 1)


def repeated_windows(rows: list[tuple[int, int, bytes]]) -> list[bool]:
    """For the windows of stretches (doc, at, bytes), one after another: does an equal one start earlier?

    Windows are put in suffix order, ties by place; a window is a repeat if it equals its neighbour before, which then is
    its previous smaller place with LENGTH bytes in common.
    """
    data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    sizes = np.array([len(r[2]) for r in rows])
    counts = sizes - LENGTH + 1
    begin = np.cumsum(sizes) - sizes
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(begin, counts) + inner
    doc = np.repeat(np.array([r[0] for r in rows], np.int64), counts)
    place = np.repeat(np.array([r[1] for r in rows], np.int64), counts) + inner
    by_place = np.lexsort((place, doc))
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[starts[by_place]])
    order = np.argsort(suffixes.view(f"S{LENGTH}").ravel(), kind="stable")
    ranked = suffixes[order]
    same = np.concatenate([[False], (ranked[1:] == ranked[:-1]).all(1)])
    # The same place twice (a repeated row) is not an earlier one.
    d, p = doc[by_place][order], place[by_place][order]
    twin = np.concatenate([[False], (d[1:] == d[:-1]) & (p[1:] == p[:-1])])
    out = np.zeros(len(starts), bool)
    run_same = same & ~twin
    # A twin is a repeat if the one it equals is.
    for i in np.flatnonzero(same & twin):
        run_same[i] = run_same[i - 1]
    out[by_place[order]] = run_same
    return out


def _runs(marks: np.ndarray, rows: list[tuple[int, int, bytes]]) -> tuple[list, list, list]:
    """Runs of marked windows as (doc, place, count)."""
    docs, places, counts, at = [], [], [], 0
    for doc, place, data in rows:
        n = len(data) - LENGTH + 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], marks[at : at + n], [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            docs.append(doc)
            places.append(place + a)
            counts.append(b - a)
        at += n
    return docs, places, counts


RANGE = "doc long, at long, n int"


def _repeats_in_groups(rows: DataFrame, together: int = 4096) -> DataFrame:
    """Repeated windows of stretches (anchor, doc, at, data) that differ but share an anchor, as ranges of places."""
    arrow = _arrow_schema(rows.sparkSession, RANGE)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.select("anchor", "doc", "at", "data").repartition(parts, "anchor").sortWithinPartitions("anchor", "doc", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def flush() -> pa.RecordBatch:
            docs, places, counts = _runs(repeated_windows(held), held)
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(counts, pa.int32())], schema=arrow)

        for batch in batches:
            for anchor, doc, at, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if len(held) >= together and anchor != last:
                    yield flush()
                    held = []
                held.append((doc, at, data))
                last = anchor
        if held:
            yield flush()

    return grouped.mapInArrow(run, RANGE)


def _repeats_by_window(rows: DataFrame, buckets: int) -> DataFrame:
    """The same for groups of any size: windows meet by their 128-bit hash, spread over `buckets`.

    A task keeps the first of its equal windows and reports the others; what it hands on is packed, a row for a bucket.
    """
    schema = f"kind int, bucket int, {RANGE}, high array<long>, low array<long>, docs array<long>, places array<long>"
    arrow = _arrow_schema(rows.sparkSession, schema)

    def first_of(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which windows come first among equal ones; the same place twice counts as one."""
        order = np.lexsort((places, docs, hashes[:, 1], hashes[:, 0]))
        h, d, p = hashes[order], docs[order], places[order]
        same = np.concatenate([[False], (h[1:] == h[:-1]).all(1)])
        twin = np.concatenate([[False], (d[1:] == d[:-1]) & (p[1:] == p[:-1])]) & same
        first = ~same
        for i in np.flatnonzero(twin):
            first[i] = first[i - 1]
        out = np.zeros(len(order), bool)
        out[order] = first
        return out

    def ranges(docs: np.ndarray, places: np.ndarray) -> list[dict]:
        order = np.lexsort((places, docs))
        d, p = docs[order], places[order]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)])) if len(d) else np.zeros(0, int)
        ends = np.concatenate([new[1:], [len(d)]]) if len(d) else new
        return [{"kind": 0, "doc": int(d[a]), "at": int(p[a]), "n": int(p[b - 1] - p[a] + 1)} for a, b in zip(new, ends)]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1 << 20):
                digests, docs, places = [], [], []
                for doc, at, data in zip(*(part.column(i).to_pylist() for i in range(3))):
                    n = len(data) - LENGTH + 1
                    digests += [xxhash.xxh3_128_digest(data[i : i + LENGTH]) for i in range(n)]
                    docs += [doc] * n
                    places += range(at, at + n)
                hashes = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                docs, places = np.array(docs, np.int64), np.array(places, np.int64)
                first = first_of(hashes, docs, places)
                out = ranges(docs[~first], places[~first])
                hashes, docs, places = hashes[first], docs[first], places[first]
                bucket = (hashes[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    own = order[edges[b] : edges[b + 1]]
                    out.append({"kind": 1, "bucket": b, "high": hashes[own, 0].tolist(), "low": hashes[own, 1].tolist(), "docs": docs[own].tolist(), "places": places[own].tolist()})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        bucket = None

        def flush() -> pa.RecordBatch:
            high, low, docs, places = (np.concatenate([h[i] for h in held]) for i in range(4))
            first = first_of(np.stack([high, low], 1), docs, places)
            return pa.RecordBatch.from_pylist([{k: r[k] for k in ("doc", "at", "n")} for r in ranges(docs[~first], places[~first])], schema=_arrow_range)

        for batch in batches:
            for i in range(batch.num_rows):
                here = batch.column(0)[i].as_py()
                if held and here != bucket:
                    yield flush()
                    held = []
                bucket = here
                held.append(tuple(batch.column(k)[i].values.to_numpy() for k in range(1, 5)))
        if held:
            yield flush()

    _arrow_range = _arrow_schema(rows.sparkSession, RANGE)
    spread = written(rows.select("doc", "at", "data").mapInArrow(expand, schema), "windows")
    packed = spread.where("kind = 1").select("bucket", "high", "low", "docs", "places").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return spread.where("kind = 0").select("doc", "at", "n").unionByName(packed.mapInArrow(meet, RANGE))


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc, spans (places from, to) of the repeated bytes of `docs` (doc, base, text); overlapping spans are not joined yet."""
    # A table, so that the join's sides are plain exchanges, whose large parts Spark can split.
    some = written(_anchor_hashes(docs).groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor"), "anchors")
    rows = written(_stretch_rows(docs).join(some, "anchor"), "stretches")
    firsts = rows.groupBy("anchor", "digest").agg(F.min(F.struct("doc", "at")).alias("first"), F.max("n").alias("n"), F.count("*").alias("m"))
    firsts = written(firsts, "firsts")
    again = rows.join(firsts.where("m > 1").select("anchor", "digest", "first"), ["anchor", "digest"])
    copies = again.where(F.struct("doc", "at") != F.col("first")).select("doc", "at", "n")

    groups = written(firsts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "groups")
    mixed = firsts.join(groups, "anchor").select("anchor", "first.doc", "first.at", "n", (F.col("kinds") > GROUP).alias("hot"))
    mixed = written(_with_bytes(docs, written(mixed, "mixed")), "bytes")
    ordered = _repeats_in_groups(mixed.where("NOT hot"))
    hot = mixed.where("hot")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), hot.count() // 4096 + 1)
    every = copies.unionByName(ordered).unionByName(_repeats_by_window(hot, buckets))
    end = F.col("at") + F.col("n") + LENGTH - 1
    return every.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct(F.col("at").alias("a"), end.alias("b")))).alias("spans"))


def _joined_spans(spans: DataFrame) -> DataFrame:
    """Maximal runs of the sorted spans of each document; a few rows' worth of numbers in place of one for each stretch."""
    arrow = _arrow_schema(spans.sparkSession, "doc long, runs array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                pairs = batch.column(1)[i].values
                a, b = pairs.field(0).to_numpy(), np.maximum.accumulate(pairs.field(1).to_numpy())
                new = np.concatenate([[True], a[1:] > b[:-1]])
                ends = b[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(b) - 1]])]
                out.append(np.stack([a[new], ends], 1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow.field(1).type)], schema=arrow)

    return spans.select("doc", "spans").mapInArrow(run, "doc long, runs array<long>")


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) for every row of `docs` (doc_id, text)."""
    ordered = _ordered(docs)
    runs = written(_joined_spans(removed_spans(ordered)), "runs")
    joined = with_side(ordered, runs, "doc", "left", F.size("runs"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 8 << 20):
                out: list[tuple] = []
                for doc, base, text, cuts in zip(*(part.column(i).to_pylist() for i in range(4))):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    own = [(a - base, b - base) for a, b in zip((cuts or [])[::2], (cuts or [])[1::2]) if 0 <= a - base < max(1, len(data))]
                    at, kept = 0, []
                    for a, b in own:
                        kept.append(data[at:a])
                        at = b
                    kept.append(data[at:])
                    left = b"".join(kept)
                    out.append((None if doc == 2**63 - 1 else doc, len(data), len(data) - len(left), len(own), left))
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return joined.select("doc", "base", "text", "runs").mapInArrow(run, schema)
