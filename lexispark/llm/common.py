"""Tables in the shared folder, side tables of documents, arrow batches and word bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: A side table up to this many rows (and, by its caller's arithmetic, some MB) is sent to all tasks instead of shuffled.
SIDE_ROWS = 500_000
#: And so is one whose arrays hold up to so many numbers, 64 MB of them.
SIDE_NUMBERS = 8_000_000

# ASCII letters and digits are word bytes, and so is every byte of a non-ASCII character.
_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
WORD_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, used: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends at files that every executor can reach.

    The path is added to `used`, for `removed` when nothing reads the table any more.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if used is not None:
        used.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, used: list[str]) -> None:
    """Remove tables of finished steps. Call it once what was made of them is written."""
    for path in used:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    used.clear()


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_bytes(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of letters, digits and non-ASCII characters, as UTF-8."""
    return utf8(text).translate(WORD_BYTES).split()


def per_batch(
    df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[dict[str, list]], Iterable[dict[str, list]]]]
) -> DataFrame:
    """Rows of `schema` from batches of `columns`.

    `make` runs once in each task and returns a function from a batch, as lists by column, to output batches.
    """
    narrow = df.select(*columns)
    arrow = _arrow_schema(narrow.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in _slices(batch):
                for out in work({c: part.column(i).to_pylist() for i, c in enumerate(columns)}):
                    if out and len(next(iter(out.values()))):
                        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return narrow.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about `most_bytes`, one row at least."""
    pieces = max(1, min(batch.num_rows, batch.nbytes // most_bytes + 1))
    step = -(-batch.num_rows // pieces) if batch.num_rows else 1
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def with_side(big: DataFrame, side: DataFrame, key: str, how: str = "inner", items: Column | None = None) -> DataFrame:
    """Join wide rows with a narrow table that has one row per key.

    `side` is counted first and must be cheap to read. Up to SIDE_ROWS rows (and SIDE_NUMBERS `items`, the length of its
    arrays) it goes to the tasks, so the wide rows stay where they are; a larger one is joined by a shuffle, which adaptive
    execution splits where it is skewed.
    """
    if items is not None:
        total = side.agg(F.coalesce(F.sum(items), F.lit(0))).first()[0]
        if total > SIDE_NUMBERS:
            return big.join(side, key, how)
    rows = side.limit(SIDE_ROWS + 1).count()
    return big.join(F.broadcast(side) if rows <= SIDE_ROWS else side, key, how)
