"""Document fingerprints from prefix polynomial hashes.

`PrefixHash` keeps, for a text's code points, the running values of two polynomials modulo a prime. From them the hash of
any span follows by one subtraction, so that the equality of two spans takes constant time and the longest common
extension of two places takes a binary search. A fingerprint holds the hash of the whole text and the `SKETCH` smallest
hashes of all its spans of `SPAN` code points, each read from the prefix arrays; the likeness of two fingerprints is the
share of spans in common (Dice), estimated from the smallest hashes of both.

Null texts count as empty. Empty texts have an empty sketch: likeness 1 to each other, 0 to any other text. A text shorter
than a span is one span. Equal texts have equal fingerprints. Ties of doc_id are ordered by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, _slices

PRIME = (1 << 31) - 1
BASES = (1_000_003, 912_839_107)
SPAN = 16
SKETCH = 64

_P = np.uint64(PRIME)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2^62, by adding the high bits to the low ones."""
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return np.where(x >= _P, x - _P, x)


def _power_arrays(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i below n, by doubling."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        arrays = []
        for b in (base, pow(base, -1, PRIME)):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                out[done : 2 * done] = _mod(out[:done] * np.uint64(pow(b, done, PRIME)))
                done *= 2
            arrays.append(out)
        have = _powers[base] = (arrays[0], arrays[1])
    return have


class PrefixHash:
    """Prefix arrays of one text: sums of code point times base^position, modulo the prime, for two bases."""

    def __init__(self, text: str) -> None:
        # Code points start at 1 so that leading zeros count.
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for base in BASES:
            powers, _ = _power_arrays(base, self.n + 1)
            terms = _mod(points * powers[: self.n])
            out = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=out[1:])
            self.sums.append(_mod(out))

    def spans(self, length: int) -> np.ndarray:
        """The 62-bit hashes of all spans of `length`."""
        starts = self.n - length + 1
        parts = []
        for base, sums in zip(BASES, self.sums):
            _, inverse = _power_arrays(base, self.n + 1)
            parts.append(_mod(_mod(sums[length:] + _P - sums[:starts]) * inverse[:starts]))
        return parts[0] << np.uint64(31) | parts[1]

    def span(self, start: int, length: int) -> int:
        """The 62-bit hash of one span."""
        out = 0
        for base, sums in zip(BASES, self.sums):
            _, inverse = _power_arrays(base, self.n + 1)
            out = out << 31 | (int(sums[start + length]) - int(sums[start])) * int(inverse[start]) % PRIME
        return out

    def common_extension(self, other: PrefixHash, mine: int = 0, theirs: int = 0) -> int:
        """How many code points agree from place `mine` here and place `theirs` in `other` on."""
        low, high = 0, min(self.n - mine, other.n - theirs)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(mine, middle) == other.span(theirs, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _scramble(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers, so that small values are a fair draw of the spans."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprint(text: str, prefix: PrefixHash | None = None) -> str:
    """The whole text's hash, a colon, and the sorted sketch as 12 hex digits each."""
    prefix = prefix or PrefixHash(text)
    if not prefix.n:
        return "0:"
    drawn = _scramble(prefix.spans(min(SPAN, prefix.n))) >> np.uint64(16)
    if len(drawn) > 4 * SKETCH:
        # The smallest distinct values are among the smallest values that hold SKETCH distinct ones.
        k = 4 * SKETCH
        small = np.unique(np.partition(drawn, k)[:k])
        drawn = small if len(small) >= SKETCH else np.unique(drawn)
    least = np.unique(drawn)[:SKETCH]
    return f"{prefix.span(0, prefix.n) * (1 << 32) + prefix.n:x}:" + "".join(f"{v:012x}" for v in least.tolist())


def likeness(a: str, b: str) -> float:
    """The share of spans in common, 0 to 1, from two fingerprints."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 12] for i in range(0, len(s), 12)} for s in (a.partition(":")[2], b.partition(":")[2]))
    if not x or not y:
        return float(not x and not y)
    union = sorted(x | y)[: min(SKETCH, len(x | y))] if len(x) >= SKETCH or len(y) >= SKETCH else sorted(x | y)
    jaccard = sum(v in x and v in y for v in union) / len(union)
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    """`text` with its last half (rounded down) replaced by as many code points of the start of `following`, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def _compare(doc_id, text: str, mark: str, prefix: PrefixHash, following: str, next_mark: str) -> dict:
    changed = edited(text, following)
    other = PrefixHash(changed)
    changed_mark = fingerprint(changed, other)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": mark, "edited_fingerprint": changed_mark, "near_edited": likeness(mark, changed_mark),
        "near_next": likeness(mark, next_mark), "common_prefix": prefix.common_extension(other),
    }


def _in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Add `bucket`, ranges of doc_id with about as many rows each; rows without doc_id are in the first one."""
    inner = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000) if ranges > 1 else F.lit(None)
    cuts = sorted({float(c) for c in docs.agg(inner.alias("cuts")).first()[0] or []})
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]
    number = docs.withColumn("_number", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300)))
    return Bucketizer(splits=splits, inputCol="_number", outputCol="bucket").transform(number).drop("_number")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text), compared with its edited text and with the next document.

    Documents are shuffled once, by ranges of doc_id. The first document of each range also goes to the range before (that
    of the first range to the last), where it follows the last document. Rows without doc_id come first.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clean = _in_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 2 * parts)
    firsts = clean.groupBy("bucket").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text"))
    # One row for each range, of which there are twice as many as shuffle partitions.
    order = Window.orderBy("bucket")
    ahead = firsts.withColumn("_before", F.lag("bucket").over(order)).withColumn("_last", F.max("bucket").over(Window.partitionBy()))
    ahead = ahead.select(F.coalesce("_before", "_last").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("ahead"))
    rows = clean.select("bucket", "doc_id", "text", F.lit(False).alias("ahead")).unionByName(ahead)
    ranged = rows.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "ahead", "doc_id", "text")
    arrow = _arrow_schema(docs.sparkSession, ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for piece in _slices(batch, 8 << 20):
                out = []
                for doc_id, text, last in zip(*(piece.column(i).to_pylist() for i in range(3))):
                    prefix = PrefixHash(text)
                    mark = fingerprint(text, prefix)
                    if before is not None:
                        out.append(_compare(*before, text, mark))
                    before = None if last else (doc_id, text, mark, prefix)
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ranged.select("doc_id", "text", "ahead").mapInArrow(run, ROW)
