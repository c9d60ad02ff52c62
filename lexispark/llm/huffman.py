"""Token ids in canonical length-limited Huffman code.

The code comes from global counts of the ids: package-merge gives the best lengths up to `LONGEST` bits, and the lengths
alone fix the code words (canonical: shorter first, then by id). A file row is a block of whole documents in ascending
doc_id order. Inside a block the bit offset of every `STRIDE`-th id is kept, so that a reader decodes from any of them;
here all stretches of a block are decoded side by side, one table look-up per id.

Null texts count as empty: they hold the end id only. Ties of doc_id are ordered by text. An empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, _slices, written
from .tokens import END_ID, Encoder

#: The longest code word in bits: decoding tables have 2^20 entries whatever the input.
LONGEST = 20
#: Ids between two bit-offset checkpoints.
STRIDE = 256
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 18
MAGIC = b"HUF1"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The lengths (0: unused) of the best prefix code with words of up to `longest` bits, by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    if n > 1 << longest:
        raise ValueError("more symbols than code words")
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.float64)
    # Each level merges the symbols with packages of two items of the level before; kept: which items are symbols.
    levels = []
    packages = np.zeros(0)
    for _ in range(longest):
        merged = np.concatenate([weights, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < n)
        row = merged[place]
        packages = row[0 : len(row) // 2 * 2 : 2] + row[1 : len(row) // 2 * 2 : 2]
    take, out = 2 * n - 2, np.zeros(n, np.int64)
    for symbols in reversed(levels):
        chosen = int(symbols[:take].sum())
        out[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = out
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words from lengths: shorter first, then by id."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        sizes = lengths[order].astype(np.int64)
        # A code word is the sum of the shares of all before it, in units of the longest word.
        longest = int(sizes[-1])
        shares = np.int64(1) << (longest - sizes)
        codes[order] = (np.cumsum(shares) - shares) >> (longest - sizes)
    return codes


class Code:
    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths
        self.codes = canonical_codes(lengths)
        self.longest = max(1, int(lengths.max(initial=0)))
        self._tables: tuple[np.ndarray, np.ndarray] | None = None

    def pack(self, ids: np.ndarray) -> bytes:
        """A block: magic, number of ids, the checkpoints, the bits."""
        sizes = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        bits = int(ends[-1]) if len(ids) else 0
        # A code word lies in one number of 32 bits or in two; words share no bit, so sums are unions, exact as floats.
        shifted = self.codes[ids].astype(np.uint64) << (64 - sizes - (starts & 31)).astype(np.uint64)
        first = starts >> 5
        size = bits // 32 + 2
        total = np.bincount(first, weights=shifted >> np.uint64(32), minlength=size)
        rest = shifted & np.uint64(0xFFFFFFFF)
        over = np.flatnonzero(rest)
        total += np.bincount(first[over] + 1, weights=rest[over], minlength=size)
        total = np.frombuffer(total.astype(">u4").tobytes(), np.uint8)[: (bits + 7) // 8 + 4]
        head = np.array([len(ids), bits], "<u8").tobytes()
        return MAGIC + head + starts[::STRIDE].astype("<u8").tobytes() + total.tobytes()

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length for each possible run of `longest` bits."""
        if self._tables is None:
            used = np.flatnonzero(self.lengths)
            order = used[np.lexsort((used, self.lengths[used]))]
            shares = np.int64(1) << (self.longest - self.lengths[order].astype(np.int64))
            free = (1 << self.longest) - int(shares.sum())
            ids = np.concatenate([np.repeat(order, shares), np.zeros(free, np.int64)]).astype(np.uint32)
            sizes = np.concatenate([np.repeat(self.lengths[order], shares), np.zeros(free, np.uint8)]).astype(np.int64)
            self._tables = ids, sizes
        return self._tables

    def unpack(self, block: bytes, stretches: slice = slice(None)) -> np.ndarray:
        """The ids of a block, or of some of its stretches of STRIDE ids."""
        if block[:4] != MAGIC:
            raise ValueError("not a block")
        n = int(np.frombuffer(block, "<u8", 1, 4)[0])
        marks = -(-n // STRIDE)
        at = np.frombuffer(block, "<u8", marks, 20).astype(np.int64)
        data = np.frombuffer(block, np.uint8, offset=20 + 8 * marks).astype(np.uint32)
        words = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
        sizes = np.full(marks, STRIDE)
        if marks:
            sizes[-1] = n - (marks - 1) * STRIDE
        at, sizes = at[stretches].copy(), sizes[stretches]
        ids, widths = self.tables()
        out = np.zeros((STRIDE, len(at)), np.uint32)
        mask, top = np.int64((1 << self.longest) - 1), 32 - self.longest
        last = len(words) - 1
        for k in range(STRIDE if len(at) else 0):
            window = words[np.minimum(at >> 3, last)].astype(np.int64)
            code = (window >> (top - (at & 7))) & mask
            out[k] = ids[code]
            at += widths[code]
        return out.T[np.arange(STRIDE) < sizes[:, None]]


def _id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """part, place, doc_id, n_tokens, ids (little-endian, two bytes each if the vocabulary allows), in doc_id order."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, "doc_id")
    ranged = ranged.sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    schema = "part int, place long, doc_id long, n_tokens long, ids binary"
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, end_id)
        kind = _id_type(encoder.tokenizer.get_vocab_size())
        place = 0
        for batch in batches:
            for piece in _slices(batch):
                ids = encoder.encode(piece.column(1))
                n = len(ids)
                places = pa.array(range(place, place + n), pa.int64())
                place += n
                yield pa.RecordBatch.from_arrays(
                    [piece.column(2), places, piece.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())],
                    schema=arrow,
                )

    return ranged.mapInArrow(run, schema)


def id_counts(rows: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all rows. What reaches the driver has one number per id of the vocabulary at most."""
    kind = _id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            data = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(data, kind), minlength=vocabulary)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    sums = rows.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(vocabulary, np.int64)
    for r in sums:
        out[r["id"]] = r["n"]
    return out


BLOCK = "part int, block long, doc_id array<long>, n_tokens array<long>, data binary"


def blocks(rows: DataFrame, code: Code, vocabulary: int) -> DataFrame:
    """Blocks of whole documents from stored `encoded` rows, which each task reads in their order.

    A block is named by the place of its first document in its part; no row moves.
    """
    kind = _id_type(vocabulary)
    arrow = _arrow_schema(rows.sparkSession, BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, then = 0, None

        def flush() -> pa.RecordBatch:
            data = code.pack(np.frombuffer(b"".join(h[4] for h in held), kind))
            row = {"part": held[0][0], "block": held[0][1], "doc_id": [h[2] for h in held], "n_tokens": [h[3] for h in held], "data": data}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for piece in _slices(batch):
                for row in zip(*(piece.column(i).to_pylist() for i in range(5))):
                    if held and (row[:2] != then or size >= BLOCK_IDS):
                        yield flush()
                        held, size = [], 0
                    held.append(row)
                    size += row[3]
                    then = row[0], row[1] + 1
        if held:
            yield flush()

    return rows.select("part", "place", "doc_id", "n_tokens", "ids").mapInArrow(run, BLOCK)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write `path`/code (id, bits of each id's word) and `path`/blocks."""
    spark = docs.sparkSession
    vocabulary = Encoder(tokenizer, end_id).tokenizer.get_vocab_size()
    rows = written(encoded(docs, tokenizer, end_id), "ids")
    code = Code(code_lengths(id_counts(rows, vocabulary)))
    table = [(int(i), int(code.lengths[i])) for i in np.flatnonzero(code.lengths)]
    spark.createDataFrame(table, "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    blocks(rows, code, vocabulary).write.parquet(f"{path}/blocks")


def read_code(spark: SparkSession, path: str) -> Code:
    """The code of a file; one row per id of the vocabulary at most."""
    rows = spark.read.schema("id int, bits int").parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return Code(lengths)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the blocks."""
    stored = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    n = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = stored.select("part", "block", n.alias("n"))
    # Two levels: running totals inside a part, and of the parts, of which there is one narrow row each.
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sums = totals.groupBy("part").agg(F.sum("n").alias("all"))
    before = F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    starts = totals.select("part", "block", F.coalesce(inside, F.lit(0)).alias("inside")).join(sums, "part")
    starts = starts.select("part", "block", (F.col("part_start") + F.col("inside")).alias("start"))
    code = read_code(spark, path)
    schema = "part int, block long, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    arrow = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, doc_ids, sizes, data in zip(*(batch.column(i) for i in range(5))):
                ids = code.unpack(data.as_py())
                ends = np.cumsum(np.asarray(sizes.values))
                bounds = np.concatenate([[0], ends])
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                digests = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds.tolist(), ends.tolist())]
                columns = [pa.repeat(part, len(ends)), pa.repeat(block, len(ends)), doc_ids.values, pa.array(bounds[:-1]), sizes.values, pa.array(digests, pa.int64())]
                if with_ids:
                    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                    columns.append(lists.cast(arrow.field("ids").type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    found = stored.mapInArrow(run, schema).join(starts, ["part", "block"])
    return found.withColumn("start", F.col("start") + F.col("before")).select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
