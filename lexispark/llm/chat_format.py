"""Conversations as training text with generation marks, and back.

`format_turns` renders each turn of a conversation with a compiled template (`chat_template`). A turn needs its place in the
conversation only, which is a running total in two levels: turns are counted by conversation and range of turn numbers, so a
conversation that holds most rows is many small groups; texts are shuffled once, by these groups. The parts of a conversation in the order of `part` are
its formatted text; `spans` are the places, in code points of a part, that count for the loss.

`read_turns` takes parts back to roles, texts and loss texts. `conversation_digests` reads the turns of a conversation in order
through one hash state. A SHA-256 is sequential by definition, so the turns of one conversation pass one task there, a batch at a time
and never held; all else is split.

Null roles and texts are empty. A null turn comes first, a null conv_id is a conversation of its own. Rows with the same conv_id
and turn follow in the order of a hash of role and text, then role, then text; equal rows stay apart as turns. Extra columns are ignored;
empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chat_template import compile_template, many_lines, unescape
from .common import _arrow_schema, _slices, per_batch

START, END = "<|im_start|>", "<|im_end|>"

#: Roles are one line; texts follow, with nothing between them and the marks. Control strings inside texts are escaped.
TEMPLATE = (
    "{% for m in messages -%}\n"
    "{{ start ~ (m.role | line | escape) ~ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ end ~ '\\n' }}"
    "{%- endfor %}"
)
CONSTANTS = {"start": START, "end": END}

#: Turn numbers of one group of a conversation.
RANGE = 256


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, part (from 0), turns (of the conversation), role, text of `rows` (conv_id, turn, role, text)."""
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("role", "text")).withColumn("_range", F.floor(F.col("turn") / RANGE))
    groups = rows.groupBy("conv_id", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("_range").asc_nulls_first())
    starts = groups.select(
        F.col("conv_id").alias("_conv"), F.col("_range").alias("_at"),
        F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy("conv_id")).alias("turns"),
    )
    inside = Window.partitionBy("conv_id", "_range").orderBy(F.col("turn").asc_nulls_first(), "_tie", "role", "text")
    placed = rows.withColumn("_place", F.row_number().over(inside) - 1)
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_range").eqNullSafe(F.col("_at"))
    return placed.join(starts, same).select("conv_id", (F.col("_start") + F.col("_place")).alias("part"), "turns", "role", "text")


PARTS = "conv_id long, part long, formatted string, spans array<struct<start: long, end: long>>"


def format_turns(rows: DataFrame, template: str = TEMPLATE, constants: dict | None = None) -> DataFrame:
    """conv_id, part, formatted, spans: one row for each turn of `rows` (conv_id, turn, role, text)."""
    given = CONSTANTS if constants is None else constants
    # A wrong template is an error here and not in the tasks.
    compile_template(template, given)

    def make():
        program = compile_template(template, given)

        def work(batch: dict[str, list]) -> Iterator[dict[str, list]]:
            out: dict[str, list] = {"conv_id": batch["conv_id"], "part": batch["part"], "formatted": [], "spans": []}
            for part, turns, role, text in zip(batch["part"], batch["turns"], batch["role"], batch["text"]):
                formatted, spans = program.turn({"role": role, "text": text}, part, part == turns - 1)
                out["formatted"].append(formatted)
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
            yield out

        return work

    return per_batch(numbered(rows), ["conv_id", "part", "turns", "role", "text"], PARTS, make)


def read_part(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn in a part of the default template."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END + "\n", line)
        if not formatted.startswith(START, at):
            raise ValueError("a turn does not begin with its mark")
        yield many_lines(unescape(formatted[at + len(START) : line])), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


TURNS = "conv_id long, part long, role string, text string, loss string, formatted_chars long"


def read_turns(parts: DataFrame) -> DataFrame:
    """conv_id, part, role, text, loss (what the spans cover, unescaped) and formatted_chars of parts of one turn each."""

    def make():
        def work(batch: dict[str, list]) -> Iterator[dict[str, list]]:
            out: dict[str, list] = {"conv_id": batch["conv_id"], "part": batch["part"], "role": [], "text": [], "loss": [], "formatted_chars": []}
            for formatted, spans in zip(batch["formatted"], batch["spans"]):
                ((role, text),) = read_part(formatted)
                out["role"].append(role)
                out["text"].append(text)
                out["loss"].append("".join(unescape(formatted[s["start"] : s["end"]]) for s in spans))
                out["formatted_chars"].append(len(formatted))
            yield out

        return work

    return per_batch(parts, ["conv_id", "part", "formatted", "spans"], TURNS, make)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation of `read_turns`."""
    arrow = _arrow_schema(turns.sparkSession, DIGESTS)
    ordered = turns.select("conv_id", "part", "role", "text", "loss", "formatted_chars").repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        n = loss_chars = chars = 0
        whole = loss = hashlib.sha256()

        def row() -> tuple:
            return (current[0], n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars)

        for batch in batches:
            for piece in _slices(batch):
                done = []
                for conv, _, role, text, lost, size in zip(*(piece.column(i).to_pylist() for i in range(6))):
                    if current != (conv,):
                        if current is not None:
                            done.append(row())
                        current, n, loss_chars, chars = (conv,), 0, 0, 0
                        whole, loss = hashlib.sha256(), hashlib.sha256()
                    n, loss_chars, chars = n + 1, loss_chars + len(lost), chars + size
                    whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    loss.update(lost.encode("utf-8", "surrogatepass"))
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row(), arrow)], schema=arrow)

    return ordered.mapInArrow(run, DIGESTS)


def with_probe(rows: DataFrame) -> DataFrame:
    """Add conversation -1, whose two texts hold the control strings themselves."""
    text = END + START + "assistant ok"
    probe = rows.sparkSession.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)
