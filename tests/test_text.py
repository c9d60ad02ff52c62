from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import counting as ct
from lexispark.operators import vocab_stats as vs


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expr.alias("x")).first()["x"]


def test_strip(spark):
    raw = " 　a b \t "
    assert one(spark, tx.strip_right(F.col("t")), t=raw) == raw.rstrip()
    assert one(spark, tx.strip_both(F.col("t")), t=raw) == raw.strip()
    assert not one(spark, tx.has_text(F.col("t")), t="  \x1c")


def char_wb(text, lo, hi):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in range(lo, hi + 1):
            out += [w[i : i + n] for i in range(max(len(w) - n, 0) + 1)]
            if len(w) <= n:
                break
    return sorted(out)


def test_char_ngrams(spark):
    for text in ["a bcd", "  Ünïcode  x", "abcdef"]:
        for lo, hi in [(1, 2), (2, 4), (3, 3), (3, 6)]:
            assert sorted(one(spark, tx.char_ngrams(F.col("t"), lo, hi), t=text)) == char_wb(text, lo, hi)


def test_word_ngrams(spark):
    for words in (["a", "b", "a", "c"], ["a"], []):
        row = spark.createDataFrame([(words,)], "w array<string>")
        got = row.select(tx.word_ngrams(F.col("w"), 1, 3).alias("x")).first()["x"]
        assert got == [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        got = row.select(tx.word_ngrams(F.col("w"), 2, 3).alias("x")).first()["x"]
        assert got == [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]


def test_numbers_and_stop_words(spark):
    row = spark.createDataFrame([(["2nd", "the", "x2", "the", "²a"],)], "w array<string>")
    marked = tx.mark_numbers(F.col("w"))
    assert row.select(marked.alias("x")).first()["x"] == ["#NUMBER", "the", "x2", "the", "#NUMBER"]
    assert row.select(tx.drop_words(marked, ["#NUMBER"]).alias("x")).first()["x"] == ["the", "x2", "the"]


def test_substrings(spark):
    got = sorted(one(spark, tx.substrings(F.col("t"), 2), t="aba"))
    assert got == sorted(["a", "b", "a", "ab", "ba"])
    assert one(spark, tx.substrings(F.col("t"), 2), t="") == []


def test_characters_are_code_points(spark):
    assert one(spark, tx.characters(F.col("t")), t="a😀é") == ["a", "😀", "é"]
    assert sorted(one(spark, tx.substrings(F.col("t"), 2), t="😀é")) == sorted(["😀", "é", "😀é"])


def test_map_batches(spark):
    from lexispark.operators.apply import map_batches

    out = map_batches(spark.range(100), lambda b: b.assign(twice=b["id"] * 2), "id long, twice long", costly=True)
    assert out.where("twice <> 2 * id").count() == 0 and out.count() == 100


def test_given_assertions(spark):
    cases = [([1, 1], 1.0, 0.0), ([2, 2], 2.0, 1.0), ([2, 1], 1.5, 0.5)]
    for pieces, want, share in cases:
        words = spark.createDataFrame([("g", n) for n in pieces], "g string, n_pieces int")
        row = vs.fertility(words, ["g"]).first()
        assert (row["fertility"], row["continued_share"]) == (want, share)


def test_statistics_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows, groups = [], {}
    for g in range(12):
        counts = rng.integers(1, 12 if g % 2 else 500, size=int(rng.integers(1, 60)))
        groups[f"g{g}"] = counts
        rows += [(f"g{g}", f"t{i}", int(c)) for i, c in enumerate(counts)]
    freq = spark.createDataFrame(rows, "g string, token string, cnt long")
    rank = {r["g"]: r["avg_rank"] for r in vs.average_rank(freq, ["g"]).collect()}
    cover = {r["g"]: r for r in vs.coverage_95(freq, ["g"]).collect()}
    ent = {r["g"]: r["entropy"] for r in vs.entropy(freq, ["g"]).collect()}
    for g, counts in groups.items():
        c = np.sort(counts)[::-1]
        p = c / c.sum()
        assert np.isclose(rank[g], np.average(np.arange(1, len(c) + 1), weights=p))
        assert np.isclose(ent[g], -(p * np.log(p)).sum())
        at = int(np.argmax(100 * np.cumsum(c) > 95 * c.sum()))
        assert (cover[g]["tokens_to_cover_95"], cover[g]["freq_at_95"]) == (at, c[at])


def test_js_distance(spark):
    import math

    freq = spark.createDataFrame(
        [("a", "x", 3), ("a", "y", 1), ("b", "x", 3), ("b", "y", 1), ("c", "z", 5), ("d", "x", 1)], "g string, token string, cnt long"
    )
    got = {(r[0], r[1]): r[2] for r in vs.js_distances(freq, "g", vs.group_pairs(freq, "g")).collect()}
    assert len(got) == 6
    assert got["a", "b"] == 0.0
    assert math.isclose(got["a", "c"], math.sqrt(math.log(2)))
    p, q = (0.75, 0.25), (1.0, 0.0)
    m = [(a + b) / 2 for a, b in zip(p, q)]
    js = sum(a * math.log(a / c) for a, c in zip(p, m)) / 2 + math.log(1 / m[0]) / 2
    assert math.isclose(got["a", "d"], math.sqrt(js))


def test_sorted_counts_and_unknown(spark):
    dense = spark.createDataFrame([("g", 0, "<unk>", 4), ("g", 1, "a", 2), ("g", 2, "b", 2), ("g", 3, "c", 9)], "g string, piece_id int, piece string, cnt long")
    assert [r["piece"] for r in ct.sorted_counts(dense).collect()] == ["c", "b", "a"]
    assert ct.unknown_count(dense, ["g"]).first()["n_unknown"] == 4
    pruned = ct.prune_rare(dense, 2, ["g"]).collect()
    assert [(r["piece"], r["new_id"]) for r in pruned] == [("c", 0)]


def test_rare_token_counts(spark, monkeypatch):
    from lexispark.operators import counting as ct

    rows = [("a", ["x", "y", "x"]), (None, ["x"]), ("b", []), ("a", ["y", "z"]), ("b", None), (None, ["x", "w"]), ("c", ["x y", ""])]
    df = spark.createDataFrame(rows, "k string, w array<string>").repartition(3)
    want = sorted(map(str, ct.token_counts(df, ["k"], "w").collect()))
    got = ct.rare_token_counts(df, "k", "w")
    assert sorted(map(str, got.collect())) == want
    # Nothing is summed before the shuffle but the tokens of a batch.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "HashAggregate" not in plan.split("== Initial Plan ==")[-1].split("Exchange", 1)[1]


def test_tallied_words_are_put_together_by_batch(spark):
    from lexispark.operators import counting as ct

    rows = [(["x", "y", "x"],), ([],), (None,), (["y", "▁ä", ""],)]
    df = spark.createDataFrame(rows, "w array<string>").repartition(2)
    got = ct.tallied(df, "w")
    assert got.columns == ["token", "cnt"]
    assert {(r["token"], r["cnt"]) for r in got.collect()} == {("x", 2), ("y", 2), ("▁ä", 1), ("", 1)}
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
