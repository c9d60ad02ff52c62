import hashlib

import pytest
from pyspark.sql import functions as F

from lexispark.operators import ordering as od
from lexispark.operators.joins import join_with_hot_keys


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_sample_and_rank(spark, partitions):
    # One group holds most of the rows.
    rows = [(i, "hot" if i % 10 else f"g{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(partitions)
    for n in (0, 1, 57, 3000, 5000):
        got = sorted(r["id"] for r in od.exact_sample(df, n, F.col("id"), 9).collect())
        assert got == sorted(sorted(range(3000), key=lambda i: md5(i, 9))[:n])
    got = od.exact_sample(df, 40, F.col("id"), 9, ["g"]).collect()
    for g in {g for _, g in rows}:
        ids = [i for i, h in rows if h == g]
        assert sorted(r["id"] for r in got if r["g"] == g) == sorted(sorted(ids, key=lambda i: md5(i, 9))[:40])
    order = sorted(range(3000), key=lambda i: md5(i, 4))
    ranks = {r["id"]: r["shuffled_pos"] for r in od.shuffle_rank(df, F.col("id"), 4).collect()}
    assert [ranks[i] for i in order] == list(range(3000))


def test_running_total(spark):
    rows = [("a" if i % 7 else "b", i, (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r["k"], r["o"]): r["before"] for r in od.running_total(df, "v", ["o"], F.floor(F.col("o") / 13), ["k"]).collect()}
    for k in "ab":
        total = 0
        for key, o, value in rows:
            if key == k:
                assert got[k, o] == total
                total += value


def test_top_n(spark):
    rows = [(i % 5, f"r{i:03d}") for i in range(200)]
    df = spark.createDataFrame(rows, "v long, name string")
    for n in (1, 40, 41, 99, 200, 300):
        got = sorted((r["v"], r["name"]) for r in od.top_n(df, n, "v", "name").collect())
        assert got == sorted(sorted(rows, key=lambda r: (-r[0], r[1]))[:n])


def test_split_share(spark):
    df = spark.range(20000).withColumnRenamed("id", "x")
    n = od.percent_split(df, F.col("x"), 10, 1).where("split = 'validation'").count()
    assert 1800 < n < 2200
    assert od.percent_split(df, F.col("x"), 100, 1).where("split = 'train'").count() == 0


def test_hot_keys(spark):
    facts = spark.createDataFrame([("the" if i % 3 else f"w{i}", i) for i in range(3000)] + [("none", -1)], "k string, v long")
    dim = facts.where("k <> 'none'").groupBy("k").agg(F.count("*").alias("n"))
    joined = join_with_hot_keys(facts, dim, ["k"], "n")
    assert joined.count() == 3000
    assert joined.where("k = 'the'").agg(F.min("n")).first()[0] == 2000
