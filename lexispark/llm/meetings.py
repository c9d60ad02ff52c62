"""Links between members of lists that are similar, found without emitting all pairs of a large list.

Members of a list (a shared token or block) are candidates for each other. In small lists pairs are met by a join. Larger
lists would square, so they are cut into blocks (or first put together to families, the components through shared large
lists), and each pair of blocks is compared inside one task, which returns links that connect what is similar and no more
than it has members. Either way every two similar members end up connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, _slices, removed, written
from .components import components

#: Members of a block on average.
BLOCK = 384

#: Blocks of so many members together are handed over for comparison, one pair of blocks at least.
TOGETHER = 8 * BLOCK
#: From the payloads of different members, and pairs of blocks as places of their members with the number of those in the
#: first block: links as pairs of places. With -1, all pairs of a block are compared; else only those between the two blocks.
Compare = Callable[[list[bytes], list[tuple[list[int], int]]], list[tuple[int, int]]]


def connecting_links(
    lists: DataFrame, compatible: Callable[[Column, Column], Column], payload: Callable[[DataFrame], DataFrame],
    similar: Callable[[list[bytes], list[bytes]], Sequence[bool]], compare: Callable[[], Compare], small: int, families: bool,
) -> DataFrame:
    """Links (a, b) that connect all members of `lists` that similarity connects.

    `lists`: token, member (long), need (how many lists a pair must share, the smaller of the two), info (a struct for
    `compatible`). `payload` gives (member, data) for a table of members; `similar` and `compare` decide by data. Lists of
    up to `small` members are joined. With `families`, members of larger lists are put together by all of these, which
    suits members that share many lists; without, each large list is cut into blocks of its own.
    """
    spark, used = lists.sparkSession, []
    lists = lists.select("token", "member", "need", "info")
    sizes = written(lists.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "sizes", used)
    sized = written(lists.join(sizes, "token"), "lists", used)
    pairs = written(_pairs(sized.where(F.col("size") <= small).drop("size"), compatible), "pairs", used)
    large = sized.where(F.col("size") > small).select("token", "member")
    ends = pairs.select(F.col("a").alias("member")).unionByName(pairs.select(F.col("b").alias("member")))
    members = written(ends.unionByName(large.select("member")).distinct(), "members", used)
    data = written(payload(members), "payload", used)
    links = _similar_pairs(pairs, data, similar)
    if large.limit(1).count():
        groups = _families(large) if families else _own_families(large)
        links = links.unionByName(_in_blocks(groups, data, compare))
    found = written(links.distinct(), "links")
    removed(spark, used)
    return found


def _pairs(small: DataFrame, compatible) -> DataFrame:
    """Distinct pairs that meet in as many lists as they need. A pair that also shares a large list may be left out."""
    x, y = (small.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("member", "need", "info")]) for s in "xy")
    met = x.join(y, "token").where((F.col("member_x") < F.col("member_y")) & compatible(F.col("info_x"), F.col("info_y")))
    pairs = met.groupBy(F.col("member_x").alias("a"), F.col("member_y").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("need_x", "need_y")).alias("need"))
    return pairs.where("shared >= need").select("a", "b")


def _similar_pairs(pairs: DataFrame, data: DataFrame, similar: Callable[[list[bytes], list[bytes]], Sequence[bool]]) -> DataFrame:
    one = data.select(F.col("member").alias("a"), F.col("data").alias("x"))
    two = data.select(F.col("member").alias("b"), F.col("data").alias("y"))
    arrow = _arrow_schema(pairs.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                keep = pa.array(similar(batch.column(2).to_pylist(), batch.column(3).to_pylist()), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=arrow)

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _families(large: DataFrame) -> DataFrame:
    """member, family, lead, blocks: which members large lists bring together, and into how many blocks they are cut."""
    first = large.groupBy("token").agg(F.min("member").alias("first"))
    labels = components(large.join(first, "token").select(F.col("first").alias("a"), F.col("member").alias("b")).distinct())
    counts = labels.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return labels.join(counts, "comp").select(F.col("node").alias("member"), F.col("comp").alias("family"), F.col("comp").alias("lead"), "blocks")


def _own_families(large: DataFrame) -> DataFrame:
    """The same with each large list as a family of its own; those of one block with the same least member have the same lead."""
    blocks = large.groupBy("token").agg(F.min("member").alias("lead"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    lead = F.when(F.col("blocks") == 1, F.col("lead")).otherwise(F.col("token"))
    return large.join(blocks, "token").select("member", F.col("token").alias("family"), lead.alias("lead"), "blocks")


def _in_blocks(families: DataFrame, data: DataFrame, compare: Callable[[], Compare]) -> DataFrame:
    """Links from comparing each pair of blocks of a family, and each block with itself, in one task each.

    Families with one lead, which have members in common, come to one task one after the other, and are compared together.
    """
    own = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    placed = families.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = placed.select("lead", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "member")
    rows = keyed.join(data, "member")
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("lead", "i", "j", "family", "own")
    grouped = rows.repartition(parts, "lead", "i", "j").sortWithinPartitions(*order).select(*order, "member", "data")
    arrow = _arrow_schema(spark, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = compare()
        held: list[tuple] = []
        places: dict[int, int] = {}
        payloads: list[bytes] = []
        waiting: list[tuple[list[int], int]] = []
        key = None

        def ended() -> None:
            if len(held) > 1:
                own = [h[0] for h in held]
                cut = -1 if key[1] == key[2] else own.index(key[2]) if key[2] in own else len(own)
                for _, member, data in held:
                    if places.setdefault(member, len(payloads)) == len(payloads):
                        payloads.append(data)
                waiting.append(([places[member] for _, member, _ in held], cut))

        def flush() -> pa.RecordBatch:
            found, members = links(payloads, waiting), list(places)
            out = [pa.array([members[pair[end]] for pair in found], pa.int64()) for end in (0, 1)]
            for kept in (places, payloads, waiting):
                kept.clear()
            return pa.RecordBatch.from_arrays(out, schema=arrow)

        for batch in batches:
            for lead, i, j, family, own, member, data in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if key != (family, i, j):
                    ended()
                    if sum(len(w[0]) for w in waiting) >= TOGETHER:
                        yield flush()
                    held, key = [], (family, i, j)
                held.append((own, member, data))
        ended()
        if waiting:
            yield flush()

    return grouped.mapInArrow(run, "a long, b long")


class Forest:
    """Connected places, for leaving out pairs that are connected already."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Connect two places; false if they were connected."""
        a, b = self.find(x), self.find(y)
        self.up[a] = b
        return a != b
