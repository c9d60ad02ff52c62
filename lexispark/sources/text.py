"""Line- and document-structured text files, with file and line provenance.

Lines are numbered where they are read: a task reads a split in order and counts, and what precedes the split in its file
comes from a first pass that sends counts only. Text is not shuffled for this.
"""

from __future__ import annotations

import codecs
import io
import lzma
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import has_text, strip_right
from ..operators.ordering import dense_index, running_total
from ..session import as_bytes


#: Tables of splits up to this size, some 400 MB, are sent to the tasks. Splits are counted as if all files were small.
MOST_SPLITS = 4_000_000


def _split_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """src, split (byte offset), value. A task reads its splits one after another, each in order."""
    return _placed(spark.read.text(list(paths) if not isinstance(paths, str) else paths))


def _placed(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("split"), "value")


def _split_starts(rows: DataFrame, flag: str) -> DataFrame:
    """src, split, lines_before, before and total: lines and flagged lines earlier in the file, and flagged ones in the file."""
    per_split = rows.groupBy("src", "split").agg(F.count("*").alias("_lines"), F.sum(F.col(flag).cast("long")).alias("_n"))
    earlier = Window.partitionBy("src").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.select(
        "src", "split", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("before"), F.sum("_n").over(Window.partitionBy("src")).alias("total"),
    )


def _with_starts(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Join each row with what precedes its split. The table has a row per split, some hundred bytes for 128 MB of text.

    Both passes are one plan, so they cut the files alike; the number of splits is bounded from the tasks of the scan.
    """
    conf = rows.sparkSession.conf
    size, cost = (as_bytes(conf.get(f"spark.sql.files.{k}")) for k in ("maxPartitionBytes", "openCostInBytes"))
    splits = rows.rdd.getNumPartitions() * max(1, size // max(1, cost))
    return rows.join(F.broadcast(starts) if splits <= MOST_SPLITS else starts, ["src", "split"])


def _runs(src: pa.Array, split: np.ndarray) -> Iterator[tuple[int, int, tuple]]:
    """Stretches of a batch with one split: first and last row, and the split."""
    names = src.dictionary_encode()
    codes = names.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(split) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(split)]):
        if b > a:
            yield a, b, (names.dictionary[codes[a]].as_py(), int(split[a]))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, split, kept, line to src, split, place, line: kept lines with their number in the split."""
    current, count = None, 0
    for batch in batches:
        kept = batch.column(2).to_numpy(zero_copy_only=False)
        place = np.cumsum(kept) - kept
        for a, b, key in _runs(batch.column(0), batch.column(1).to_numpy()):
            if key != current:
                current, count = key, 0
            place[a:b] += count - place[a]
            count += int(kept[a:b].sum())
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place, pa.int64()), batch.column(3)], names=["src", "split", "place", "line"])
        yield out.filter(pa.array(kept))


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], max_lines: int | None = None, filter_empty: bool = True
) -> DataFrame:
    """src, line_no, line: right-stripped, numbered from 0 over the lines that are kept."""
    rows = _split_lines(spark, paths).withColumn("line", strip_right(F.col("value")))
    kept = (F.col("line") != "") if filter_empty else F.lit(True)
    rows = _in_order(rows.select("src", "split", kept.alias("kept"), "line"))
    return rows.where(F.col("line_no") < max_lines) if max_lines else rows


def raw_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """src, line_no, line: all lines as they are."""
    return _in_order(_split_lines(spark, paths).select("src", "split", F.lit(True).alias("kept"), F.col("value").alias("line")))


def _in_order(rows: DataFrame) -> DataFrame:
    """src, line_no, line of the kept rows of src, split, kept, line."""
    numbered = rows.mapInArrow(_numbered, "src string, split long, place long, line string")
    placed = _with_starts(numbered, _split_starts(rows, "kept"))
    return placed.select("src", (F.col("before") + F.col("place")).alias("line_no"), "line")


def document_blocks(lines: DataFrame, max_documents: int | None = None, keep_tail: bool = False) -> DataFrame:
    """src, doc_ord, start_line, lines from numbered lines that carry separator counts.

    A separator is an entirely empty line. Two in a row make an empty document; lines after the
    last separator of a file are dropped unless `keep_tail`.
    """
    rows = lines if keep_tail else lines.where(F.col("doc_ord") < F.col("total_doc_ord"))
    if max_documents:
        rows = rows.where(F.col("doc_ord") < max_documents)
    text = F.when(F.col("is_sep") == 0, F.struct("file_line", "line"))
    return (
        rows.groupBy("src", "doc_ord")
        .agg(
            (F.min("file_line") + 1).alias("start_line"),
            F.sort_array(F.collect_list(text)).alias("_lines"),
        )
        .select("src", "doc_ord", "start_line", F.col("_lines.line").alias("lines"))
    )


SEGMENTS = "src string, split long, number long, first long, lines array<string>, closed boolean"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, split, is_sep, line to the stretches between separators: number and first line in the split, and whether it ends there.

    A stretch that is open at the end of its split, if it has lines, goes on in the next split.
    """
    current: tuple | None = None
    number = first = row = 0
    waiting: list[str] = []
    for batch in batches:
        out: dict[str, list] = {c.split()[0]: [] for c in SEGMENTS.split(", ")}

        def add(closed: bool) -> None:
            for name, x in zip(out, (*current, number, first, waiting, closed)):
                out[name].append(x)

        separators, lines = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_pylist()
        for a, b, key in _runs(batch.column(0), batch.column(1).to_numpy()):
            if key != current:
                if waiting:
                    add(False)
                current, number, first, row, waiting = key, 0, 0, 0, []
            start = a
            for at in (np.flatnonzero(separators[a:b]) + a).tolist():
                waiting = waiting + lines[start:at]
                add(True)
                number, first, start, waiting = number + 1, row + at - a + 1, at + 1, []
            waiting = waiting + lines[start:b]
            row += b - a
        yield _segment_batch(out)
    if waiting:
        yield _segment_batch({name: [x] for name, x in zip((c.split()[0] for c in SEGMENTS.split(", ")), (*current, number, first, waiting, False))})


def _segment_batch(rows: dict[str, list]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows.values(), types)], names=list(rows))


def read_document_lines(
    spark: SparkSession, paths: str | Sequence[str], max_documents: int | None = None, keep_tail: bool = False
) -> DataFrame:
    """Blank-line separated documents as arrays of right-stripped lines, with their start line.

    Documents inside one split are put together where they are read. Those that lie across the bounds of splits are joined from
    their parts, a few for each split: only these are shuffled. Files that are too small to be cut are read once, larger ones
    once more for the starts of their splits and once more for such parts.
    """
    raw = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    # No split has fewer bytes than this unless its file ends, so files of this size are never cut.
    least = min(as_bytes(spark.conf.get(f"spark.sql.files.{k}")) for k in ("maxPartitionBytes", "openCostInBytes"))
    uncut = _segmented(_placed(raw.where(F.col("_metadata.file_size") <= least)))
    uncut = uncut.where(F.lit(keep_tail) | F.col("closed")).select("src", F.col("number").alias("doc_ord"), (F.col("first") + 1).alias("start_line"), "lines")
    if max_documents:
        uncut = uncut.where(F.col("doc_ord") < max_documents)
    raw = _placed(raw.where(F.col("_metadata.file_size") > least))
    parts = _with_starts(_segmented(raw), _split_starts(raw.select("src", "split", (F.col("value") == "").alias("is_sep")), "is_sep"))
    parts = parts.withColumn("doc_ord", F.col("before") + F.col("number"))
    parts = parts.withColumn("start_line", F.col("lines_before") + F.col("first") + 1)
    if not keep_tail:
        parts = parts.where(F.col("doc_ord") < F.col("total"))
    if max_documents:
        parts = parts.where(F.col("doc_ord") < max_documents)
    # A stretch behind a separator of its split, or at the start of the file, has no part in an earlier split.
    whole = F.col("closed") & ((F.col("number") > 0) | (F.col("lines_before") == 0))
    joined = parts.where(~whole).groupBy("src", "doc_ord").agg(
        F.min("start_line").alias("start_line"), F.expr("flatten(sort_array(collect_list(struct(split, lines))).lines)").alias("lines")
    )
    return uncut.unionByName(parts.where(whole).select("src", "doc_ord", "start_line", "lines")).unionByName(joined)


def _segmented(raw: DataFrame) -> DataFrame:
    rows = raw.select("src", "split", (F.col("value") == "").alias("is_sep"), strip_right(F.col("value")).alias("line"))
    return rows.mapInArrow(_segments, SEGMENTS)


def read_documents(
    spark: SparkSession, paths: str | Sequence[str], max_documents: int | None = None, keep_tail: bool = False
) -> DataFrame:
    """As `read_document_lines`, with the lines of a document joined by one space."""
    docs = read_document_lines(spark, paths, max_documents, keep_tail)
    return docs.select("src", "doc_ord", "start_line", F.array_join("lines", " ").alias("text"))


def documents_from_lines(lines: DataFrame, order: str, bucket_width: int = 100_000, strip=strip_right) -> DataFrame:
    """Document blocks of a line table (src, `order`, line) whose order is an integer column.

    Separators are lines that are empty as they stand; `strip` is applied to the others.
    """
    rows = lines.withColumn("is_sep", (F.col("line") == "").cast("long"))
    bucket = F.floor(F.col(order) / bucket_width)
    rows = running_total(rows, "is_sep", [order], bucket, ["src"], "doc_ord")
    totals = rows.groupBy("src").agg(F.sum("is_sep").alias("total_doc_ord"))
    rows = rows.join(totals, "src").withColumn("file_line", F.col(order))
    return document_blocks(rows.withColumn("line", strip(F.col("line"))))


_BLOCK = 1 << 20


def _plain_lines(src: str, content: bytes) -> Iterator[list[str]]:
    """Lines of an xz file, decoded as a stream: only one block of plain text is held at a time.

    As in text mode, a line ends at a line feed, a carriage return or both.
    """
    decoder, rest, data = lzma.LZMADecompressor(), "", content
    text = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")(), translate=True)
    while True:
        plain = decoder.decompress(data, max_length=_BLOCK)
        data = b""
        if decoder.eof and decoder.unused_data:
            data, decoder = decoder.unused_data, lzma.LZMADecompressor()
            finished = False
        else:
            finished = decoder.eof
        parts = (rest + text.decode(plain, final=finished)).split("\n")
        rest = parts.pop()
        if finished and rest:
            parts.append(rest)
        if parts:
            yield parts
        if finished:
            return
        if not plain and not data and decoder.needs_input:
            raise EOFError(f"{src} ends before its xz stream does")


def _unpack(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in files:
        for src, content in zip(batch["src"], batch["content"]):
            number = 0
            for parts in _plain_lines(src, content):
                yield pd.DataFrame({"src": src, "file_line": range(number, number + len(parts)), "line": parts})
                number += len(parts)


def unpack_xz(files: DataFrame) -> DataFrame:
    """src, file_line, line from (src, content). A compressed file cannot be split: one task each."""
    return files.select("src", "content").mapInPandas(_unpack, "src string, file_line long, line string")


def _unpack_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, content to src, doc_ord, start_line, lines: what stands before each empty line, stripped on both sides."""
    for batch in batches:
        for src, content in zip(batch.column(0), batch.column(1)):
            number, row, first, waiting = 0, 0, 1, []
            for parts in _plain_lines(src.as_py(), content.as_py()):
                ords, starts, lines = [], [], []
                for line in parts:
                    row += 1
                    if line:
                        waiting.append(line.strip())
                    else:
                        ords.append(number)
                        starts.append(first)
                        lines.append(waiting)
                        number, first, waiting = number + 1, row + 1, []
                columns = [pa.repeat(src, len(ords)), pa.array(ords, pa.int64()), pa.array(starts, pa.int64()), pa.array(lines, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["src", "doc_ord", "start_line", "lines"])


def read_documents_xz(spark: SparkSession, paths: str | Sequence[str], max_docs: int | None = None) -> DataFrame:
    """Documents of xz files, at most `max_docs` of each; an empty line separates, the others are stripped on both sides."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths) if not isinstance(paths, str) else paths)
    return documents_from_xz(files.select(F.col("path").alias("src"), "content"), max_docs)


def documents_from_xz(files: DataFrame, max_docs: int | None = None) -> DataFrame:
    """As above from (src, content). With a limit of 0, a file still gives its first document if its first line is empty.

    A file is read by one task anyway, so its documents are put together there and no line is shuffled.
    """
    docs = files.select("src", "content").mapInArrow(_unpack_documents, "src string, doc_ord long, start_line long, lines array<string>")
    if max_docs is None:
        return docs
    if max_docs == 0:
        return docs.where((F.col("doc_ord") == 0) & (F.size("lines") == 0))
    return docs.where(F.col("doc_ord") < max_docs)


def read_splits(spark: SparkSession, files: dict[str, Sequence[str]]) -> DataFrame:
    """Text lines with the name of the split they belong to."""
    parts = [spark.read.text(list(p)).select(F.lit(s).alias("split"), F.col("value").alias("text")) for s, p in files.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_blank(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(has_text(F.col(column)))


def line_counts(lines: DataFrame, by: str = "src") -> DataFrame:
    return lines.groupBy(by).agg(F.count("*").alias("n_lines"))


def resources_for(counts: DataFrame) -> DataFrame:
    """Memory and CPUs for a training job, from its number of lines."""
    millions = F.expr("n_lines div 1000000")
    return counts.withColumn("memory_gb", millions * 10 + 15).withColumn("cpus", millions + 1)


def number_documents(docs: DataFrame, order: str, by: str, bucket_width: int = 100_000) -> DataFrame:
    """Add doc_ord: the 0-based place of a document in its source."""
    bucket = F.floor(F.col(order) / bucket_width)
    return dense_index(docs, [order], bucket, [by], "doc_ord")
