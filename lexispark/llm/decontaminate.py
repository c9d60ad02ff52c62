"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are hashed and combined to hashes of `GRAM` words; of each `SLIDE` neighbouring hashes the smallest is kept with
its place. A span of GRAM + SLIDE - 1 = 10 words holds one whole slide, so every window of 10 words that a document and a
benchmark item share has a kept hash in both. Documents are read once for their kept hashes, which meet those of the
benchmark; only documents that meet one are read again, and each meeting is extended to the windows around it, which are
compared word for word. Items of fewer words are one window of their own and are looked for by their first 4, 2 or 1
words at every place.

Null and empty texts have no words, hits or items. Repeated rows are kept, each with the same result. Items without words
never occur; an item_id that is null still marks words but is in no list. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import explode_rows
from .common import SIDE_ROWS, written

WINDOW = 10
GRAM = 4
SLIDE = WINDOW - GRAM + 1
_PLACE_BITS = 27  # places below 2^27 words; the other 36 bits hold the hash
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a text of ASCII characters only takes the faster function."""
    filled = F.coalesce(text, F.lit(""))
    lower = F.when(F.length(filled) == F.octet_length(filled), F.lower(filled)).otherwise(F.translate(filled, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, _BETWEEN), "")


def _neighbours(array: Column, n: Column, step: int, combine) -> Column:
    """combine(x[i], x[i + step]) for an array of n elements, n >= step."""
    return F.zip_with(F.slice(array, F.lit(1), n - step), F.slice(array, F.lit(step + 1), n - step), combine)


def _keyed(array: Column, kind: int) -> Column:
    """Hash and place in one number, the hash in the high bits."""
    mask = (1 << (63 - _PLACE_BITS)) - 1
    return F.transform(array, lambda x, i: F.shiftleft(F.xxhash64(x, F.lit(kind)).bitwiseAND(F.lit(mask)), _PLACE_BITS).bitwiseOR(i.cast("long")))


def _kept(df: DataFrame, anchors: list[int]) -> DataFrame:
    """Add `kept` to rows with `words` and `n`: keyed winnowed hashes, and all keyed hashes of `anchors` words.

    Each step is a column of its own, so that none is computed twice.
    """
    n = F.col("n")
    none = F.array().cast("array<long>")
    df = df.withColumn("_h1", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_h2", F.when(n >= 2, _neighbours(F.col("_h1"), n, 1, lambda a, b: F.xxhash64(a, b))).otherwise(none))
    df = df.withColumn("_h4", F.when(n >= 4, _neighbours(F.col("_h2"), n - 1, 2, lambda a, b: F.xxhash64(a, b))).otherwise(none))
    df = df.withColumn("_m1", F.when(n >= WINDOW, _keyed(F.col("_h4"), 0)).otherwise(none))
    df = df.withColumn("_m2", F.when(n >= WINDOW, _neighbours(F.col("_m1"), n - 3, 1, lambda a, b: F.least(a, b))).otherwise(none))
    df = df.withColumn("_m4", F.when(n >= WINDOW, _neighbours(F.col("_m2"), n - 4, 2, lambda a, b: F.least(a, b))).otherwise(none))
    df = df.withColumn("_m7", F.when(n >= WINDOW, _neighbours(F.col("_m4"), n - 6, 3, lambda a, b: F.least(a, b))).otherwise(none))
    parts = [F.array_distinct("_m7"), *[_keyed(F.col(f"_h{a}"), a) for a in anchors]]
    return df.withColumn("kept", F.concat(*parts)).drop("_h1", "_h2", "_h4", "_m1", "_m2", "_m4", "_m7")


def _anchor(m: int) -> int:
    return 4 if m >= 4 else 2 if m >= 2 else 1


def _window_texts(places: Column) -> Column:
    """Structs of start, size and text of the windows at `places` (structs of start and size)."""
    return F.transform(places, lambda p: F.struct(p["at"].alias("at"), p["size"].alias("size"), F.array_join(F.slice("words", p["at"] + 1, p["size"]), " ").alias("window")))


def _side(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    return big.join(F.broadcast(small) if rows <= SIDE_ROWS else small, on, how)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and text_hash for every row of `docs`."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    items = written(items.where("n > 0"), "items")
    short = sorted(r["n"] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())  # 9 values at most
    anchors = sorted({_anchor(m) for m in short})

    # The benchmark: distinct windows with their items, and the hashes to look for.
    size = F.least("n", F.lit(WINDOW))
    places = F.transform(F.sequence(F.lit(0), F.col("n") - size), lambda s: F.struct(s.alias("at"), size.alias("size")))
    windows = explode_rows(items, ["item_id"], _window_texts(places), "w").select("item_id", "w.window").distinct()
    windows = written(windows, "windows")
    window_rows = windows.limit(SIDE_ROWS + 1).count()
    long_marks = explode_rows(_kept(items.where(F.col("n") >= WINDOW), []), [], "kept", "v").select(F.shiftright("v", _PLACE_BITS).alias("mark"), F.lit(0).alias("kind"))
    marks = long_marks
    for m in short:
        first = _kept(items.where(F.col("n") == m), [_anchor(m)]).select(F.explode("kept").alias("v"))
        at_start = F.col("v").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) == 0
        marks = marks.unionByName(first.where(at_start).select(F.shiftright("v", _PLACE_BITS).alias("mark"), F.lit(_anchor(m)).alias("kind")))
    marks = written(marks.distinct(), "marks")
    mark_rows = marks.limit(SIDE_ROWS + 1).count()

    # Documents: their kept hashes, and one row (a negative number) that carries the number of words.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    kept = _kept(keyed, anchors).select("doc_id", "key", F.concat(F.array((-1 - F.col("n")).cast("long")), "kept").alias("all"))
    rows = explode_rows(kept, ["doc_id", "key"], "all", "v")
    # The carrying rows get marks that no benchmark has, and differ, so that no task gets all of them.
    own = -1 - F.shiftright(F.xxhash64("doc_id", "key"), 1).bitwiseAND(F.lit((1 << 40) - 1))
    rows = rows.withColumn("mark", F.when(F.col("v") < 0, own).otherwise(F.shiftright("v", _PLACE_BITS)))
    met = _side(rows, marks, ["mark"], "left", mark_rows).where("v < 0 OR kind IS NOT NULL")
    met = written(met.select("doc_id", "key", "v", "kind"), "met")

    place = F.col("v").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
    found = met.where("v >= 0").select("doc_id", "key", F.struct(place.alias("at"), "kind").alias("hit"))
    candidates = written(found.groupBy("doc_id", "key").agg(F.collect_set("hit").alias("hits")), "candidates")
    size_of = candidates.agg(F.count("*"), F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()
    # Small in rows and in places: else the texts are shuffled to their candidates.
    near = F.broadcast(candidates) if size_of[0] <= SIDE_ROWS and size_of[1] <= 4 * SIDE_ROWS else candidates
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    again = texts.join(near, texts["doc_id"].eqNullSafe(near["doc_id"]) & (texts["key"] == near["key"])).select(texts["doc_id"], texts["key"], "text", "hits")
    again = again.dropDuplicates(["doc_id", "key"]).withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))

    def around(hit: Column) -> Column:
        low, high = F.greatest(hit["at"] - SLIDE + 1, F.lit(0)), F.least(hit["at"], F.col("n") - WINDOW)
        starts = F.when((hit["kind"] == 0) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        wide = F.transform(starts, lambda s: F.struct(s.alias("at"), F.lit(WINDOW).alias("size")))
        fits = [
            F.when((hit["kind"] == _anchor(m)) & (hit["at"] + m <= F.col("n")), F.array(F.struct(hit["at"].alias("at"), F.lit(m).alias("size"))))
            .otherwise(F.array().cast("array<struct<at:int,size:int>>"))
            for m in short
        ]
        return F.concat(wide, *fits)

    spans = again.withColumn("places", F.array_distinct(F.flatten(F.transform("hits", around))))
    tried = explode_rows(spans, ["doc_id", "key"], _window_texts(F.col("places")), "w").select("doc_id", "key", "w.at", "w.size", "w.window")
    distinct_windows = windows.select("window").distinct()
    hits = written(_side(tried, distinct_windows, ["window"], "inner", window_rows), "hits")

    # Words covered by the windows of a document: what each adds beyond the furthest end before it.
    order = Window.partitionBy("doc_id", "key").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("size")
    added = F.greatest(F.lit(0), end - F.greatest(F.col("at"), F.coalesce(F.max(end).over(order), F.lit(0))))
    covered = hits.withColumn("added", added).groupBy("doc_id", "key").agg(F.sum("added").alias("n_hit"))
    pairs = _side(hits.select("doc_id", "key", "window").distinct(), windows, ["window"], "inner", window_rows)
    lists = pairs.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    result = covered.join(lists, (covered["doc_id"].eqNullSafe(lists["doc_id"])) & (covered["key"] == lists["key"])).select(covered["doc_id"].alias("_id"), covered["key"].alias("_key"), "n_hit", "items")
    every = met.where("v < 0").select("doc_id", "key", (-1 - F.col("v")).alias("n_words"))
    joined = every.join(result, every["doc_id"].eqNullSafe(result["_id"]) & (every["key"] == result["_key"]), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.col("key").alias("text_hash"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that share no window with the benchmark."""
    found = decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    found = written(found, "contaminated")
    rows = found.limit(SIDE_ROWS + 1).count()
    side = F.broadcast(found) if rows <= SIDE_ROWS else found
    return docs.join(side, docs["doc_id"].eqNullSafe(side["_id"]) & (F.xxhash64(docs["text"]) == side["_hash"]), "left_anti")
