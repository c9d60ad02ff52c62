"""Model inputs from token ids: special tokens, padding, blocks, masking, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import pad_right, round_up
from ..functions.hashing import draw_below, draw_int, draw_key
from ..functions.rows import explode_rows
from .scoring import IGNORED

# Ids of the special tokens.
BOS, PAD, EOS, UNK, MASK = 0, 1, 2, 3, 4


def add_special(ids: Column, max_length: int) -> Column:
    """`<s> ids </s>`, cut to at most `max_length`."""
    return F.concat(F.array(F.lit(BOS)), F.slice(ids, F.lit(1), F.lit(max_length - 2)), F.array(F.lit(EOS)))


def add_special_pair(a: Column, b: Column, max_length: int) -> Column:
    """`<s> a </s> </s> b </s>`; the longer side is cut first, the second one on a tie."""
    room = max_length - 4
    half = (room + 1) // 2
    keep_a = F.least(F.size(a), F.greatest(F.lit(half), F.lit(room) - F.size(b)))
    keep_b = F.least(F.size(b), F.lit(room) - keep_a)
    one = F.array(F.lit(EOS))
    return F.concat(F.array(F.lit(BOS)), F.slice(a, F.lit(1), keep_a), one, one, F.slice(b, F.lit(1), keep_b), one)


def special_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.when(x.isin(BOS, PAD, EOS), 1).otherwise(0))


def model_inputs(df: DataFrame, ids: str, pad_to: int | None = None, multiple: int = 8) -> DataFrame:
    """input_ids, attention_mask, special_tokens_mask, padded to a length or to a multiple."""
    size = F.size(ids)
    length = F.lit(pad_to) if pad_to else round_up(size, multiple)
    rows = df.withColumn("input_ids", pad_right(F.col(ids), length, PAD))
    rows = rows.withColumn("attention_mask", pad_right(F.array_repeat(F.lit(1), size), length, 0))
    return rows.withColumn("special_tokens_mask", special_mask(F.col("input_ids")))


def blocks(df: DataFrame, row_no: str, ids: str, length: int, batch: int = 1000) -> DataFrame:
    """batch, block, ids: token ids of `batch` consecutive rows joined and cut into `length`.

    The short rest is dropped only if the batch has at least `length` tokens. A batch is a fixed
    number of rows, so a task holds no more than that.
    """
    groups = df.groupBy(F.floor(F.col(row_no) / batch).alias("batch")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(row_no).alias("n"), F.col(ids).alias("ids")))).alias("_rows")
    )
    flat = groups.select("batch", F.flatten("_rows.ids").alias("_all"))
    total = F.size("_all")
    count = F.when(total >= length, F.floor(total / length)).when(total > 0, 1).otherwise(0).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda b: F.slice(F.col("_all"), b * length + 1, F.lit(length)))
    return explode_rows(flat, ["batch"], cut, "ids", "block")


def mask_tokens(df: DataFrame, ids: str, key: Column, seed: int, vocab_size: int, share: float = 0.15) -> DataFrame:
    """Add masked_ids and labels: a share of the ordinary positions is chosen; of those 80 % become
    the mask, 10 % a random id and 10 % stay. Unchosen positions carry the ignored label."""

    def draw(i: Column) -> Column:
        return draw_key(key, i, F.lit(seed))

    drawn = F.transform(ids, lambda x, i: F.struct(x.alias("id"), draw(i).alias("d")))
    rows = df.withColumn("_drawn", drawn)

    def chosen(s: Column) -> Column:
        return (~s["id"].isin(BOS, PAD, EOS)) & draw_below(s["d"], share)

    def replaced(s: Column) -> Column:
        action = F.substring(s["d"], 9, 24)
        return (
            F.when(~chosen(s), s["id"])
            .when(draw_below(action, 0.8), F.lit(MASK))
            .when(draw_below(action, 0.9), draw_int(s["d"], vocab_size, 16))
            .otherwise(s["id"])
        )

    rows = rows.withColumn("masked_ids", F.transform("_drawn", replaced))
    labels = F.transform("_drawn", lambda s: F.when(chosen(s), s["id"]).otherwise(F.lit(IGNORED)))
    return rows.withColumn("labels", labels).drop("_drawn")


def split_pair(df: DataFrame, ids: str, length: int) -> DataFrame:
    """Two inputs from an encoded pair: up to the first `</s>`, and the rest.

    The first id of the second part becomes `<s>`; both are padded to `length` and their masks rebuilt.
    """
    cut = F.array_position(F.col(ids), F.lit(EOS)).cast("int")
    size = F.size(ids)
    first = F.slice(ids, F.lit(1), cut)
    rest = F.concat(F.array(F.lit(BOS)), F.slice(ids, cut + 2, F.greatest(size - cut - 1, F.lit(0))))
    rows = df.withColumn("_a", first).withColumn("_b", rest)
    for part in ("a", "b"):
        ones = F.array_repeat(F.lit(1), F.size(f"_{part}"))
        rows = rows.withColumn(f"ids_{part}", pad_right(F.col(f"_{part}"), length, PAD))
        rows = rows.withColumn(f"mask_{part}", pad_right(ones, length, 0))
    return rows.drop("_a", "_b")
