import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import clustering as cl
from lexispark.operators import neighbors as nb
from lexispark.operators import vectorize as vz


def skewed(n=400, d=6):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, d))
    x[: n // 2] = 0.01 * x[: n // 2] + 3  # half of the rows in one spot
    x[5] = x[7]
    return x


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_nearest_neighbors(spark, block_rows):
    x = skewed()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = nb.nearest_neighbors(df, "id", "v", 5, block_rows).toPandas().sort_values(["id", "rank"])
    dist = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(dist, np.inf)
    want = np.array([sorted(range(len(x)), key=lambda j: (dist[i, j], j))[:5] for i in range(len(x))])
    assert np.array_equal(got["neighbor"].to_numpy().reshape(-1, 5), want)


def brute_silhouette(x, labels):
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    scores = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = dist[i, own].sum() / (own.sum() - 1)
        b = min(dist[i, labels == k].mean() for k in set(labels) - {c})
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


def test_silhouette(spark, monkeypatch):
    monkeypatch.setattr(cl, "BLOCK_ROWS", 64)
    x = skewed(300)
    x[np.abs(x) < 0.3] = 0
    labels = np.arange(300) % 4
    labels[0] = 9
    rows = [(i, int(c), v.tolist(), np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist()) for i, (v, c) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "id long, c int, v array<double>, ids array<long>, weights array<double>")
    want = brute_silhouette(x, labels)
    assert np.isclose(cl.silhouette(df, "id", "c", 10_000, 0, "v").first()[0], want)
    assert np.isclose(cl.silhouette(df, "id", "c", 10_000, 0).first()[0], want, atol=1e-6)


def test_agreement(spark):
    def row(pairs):
        return cl.agreement(spark.createDataFrame(pairs, "t long, k long"), "t", "k").first()

    same = row([(0, 5), (0, 5), (1, 6), (1, 6)])
    assert (same["homogeneity"], same["completeness"], same["v_measure"], same["adjusted_rand"]) == (1.0, 1.0, 1.0, 1.0)
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 2), (2, 2)]
    a, b = row(pairs), row([(k, t) for t, k in pairs])
    assert np.isclose(a["homogeneity"], b["completeness"]) and np.isclose(a["adjusted_rand"], b["adjusted_rand"])
    assert row([(0, 0), (0, 1)])["homogeneity"] == 1.0


def test_kmeans_finds_groups(spark):
    rows = [(i, [10.0 * (i % 3), float(i % 2)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    labelled, model = cl.kmeans(df, "v", 3, starts=4)
    groups = labelled.groupBy((F.col("id") % 3).alias("g")).agg(F.count_distinct("cluster").alias("n")).collect()
    assert [g["n"] for g in groups] == [1, 1, 1] and len(model.clusterCenters()) == 3


def test_tfidf(spark):
    docs = {0: "a b b", 1: "a c", 2: "a b"}
    rows = [(d, t, list(w.split()).count(t)) for d, w in docs.items() for t in set(w.split())]
    counts = spark.createDataFrame(rows, "doc long, token string, cnt long")
    n = spark.range(3).agg(F.count("*"))
    out = {(r["doc"], r["token"]): r["weight"] for r in vz.tfidf(counts, vz.document_frequency(counts, n, 1, 1.0), "doc").collect()}
    idf = {"a": 1.0, "b": np.log(4 / 3) + 1, "c": np.log(4 / 2) + 1}
    raw = np.array([1.0, 2 * idf["b"]])
    assert np.allclose([out[0, "a"], out[0, "b"]], raw / np.linalg.norm(raw))
    assert {r["token"] for r in vz.document_frequency(counts, n, 2, 0.7).collect()} == {"b"}


def test_pooling(spark):
    rows = [(0, 0, 1, [1.0, 2.0]), (0, 0, 0, [3.0, 4.0]), (1, 0, 0, [5.0, 6.0])]
    df = spark.createDataFrame(rows, "k long, w int, m int, v array<double>")
    got = {r["k"]: r["mean_vector"] for r in vz.masked_mean(df, "k", "v", "m").collect()}
    assert got == {0: [1.0, 2.0], 1: [0.0, 0.0]}
    words = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "k long, w int")
    got = {(r["k"], r["w"]): r["pooled"] for r in vz.pool_all_words(words, df, "k", "w", "v", 2).collect()}
    assert got == {(0, 0): [4.0, 6.0], (0, 1): [0.0, 0.0], (1, 0): [5.0, 6.0]}


def test_neighbors_copy_rows_by_block_not_by_cell():
    rng = np.random.default_rng(4)
    pivots = rng.normal(size=(512, 6))
    between = cl.distances(pivots, pivots)
    size = np.full(512, 4)
    size[7] = 5000
    order = nb._chain(between)
    first, parts = nb._blocks(order, size, 1024)
    assert sorted(order) == list(range(512))
    # 2,044 rows of small cells fill two or three blocks, the big cell has five of its own.
    assert int((first + parts).max()) <= 9 and parts[7] == 5 and not np.isin(np.delete(first, 7), first[7] + np.arange(5)).any()


def test_neighbors_without_anything_to_prune(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 24))
    x[100:140] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got = nb.nearest_neighbors(df, "id", "v", 5, 64).toPandas().sort_values(["id", "rank"])
    dist = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(dist, np.inf)
    want = np.array([sorted(range(len(x)), key=lambda j: (dist[i, j], j))[:5] for i in range(len(x))])
    assert np.array_equal(got["neighbor"].to_numpy().reshape(-1, 5), want)


@pytest.mark.parametrize("most", [0, 2, 100])
def test_weights_by_document_equal_those_by_posting(spark, monkeypatch, most):
    from lexispark.operators.counting import document_counts, token_counts

    monkeypatch.setattr(vz, "MOST_TERMS", most)
    rows = [(0, ["a", "b", "b"]), (1, ["a", "c", "d"]), (1, ["c", "e"]), (None, ["a", "d"]), (None, ["b"]), (2, []), (3, None), (4, ["zz", "b", "f"]), (5, ["only"])]
    docs = spark.createDataFrame(rows, "doc long, words array<string>").repartition(3)
    n = spark.range(9).agg(F.count("*"))
    long = token_counts(docs, ["doc"], "words").cache()
    by_doc = document_counts(docs, "doc", F.col("words")).cache()
    assert sorted(map(str, long.collect())) == sorted(map(str, by_doc.select("doc", F.explode(F.arrays_zip("tokens", "counts")).alias("z")).select("doc", F.col("z.tokens").alias("token"), F.col("z.counts").alias("cnt")).collect()))
    frequency = vz.document_frequency(long, n, 1, 0.5).where("token <> 'only'").cache()
    assert sorted(map(str, vz.document_frequency(by_doc, n, 1, 0.5).where("token <> 'only'").collect())) == sorted(map(str, frequency.collect()))
    old, new = vz.tfidf(long, frequency, "doc"), vz.tfidf(by_doc, frequency, "doc").cache()
    ordered = [[(r["doc"], r["token"], round(r["weight"], 9)) for r in w.orderBy("doc", "token").collect()] for w in (old, vz.long_weights(new, "doc"))]
    assert ordered[0] == ordered[1] and len(ordered[0]) == 12 and new.count() == 4
    terms = vz.term_table(frequency)
    sparse = [[(r["doc"], r["ids"], [round(x, 9) for x in r["weights"]]) for r in vz.sparse_rows(w, terms, "doc").orderBy("doc").collect()] for w in (old, new)]
    assert sparse[0] == sparse[1]


def test_postings_of_common_terms_are_not_shuffled(spark):
    from lexispark.operators.counting import document_counts

    docs = spark.range(50).select("id", F.array(*[F.lit(f"w{i}") for i in range(20)]).alias("words"))
    frequency = spark.createDataFrame([(f"w{i}", 50, 1.0) for i in range(20)], "token string, df long, idf double")
    plan = vz.tfidf(document_counts(docs, "id", F.col("words")), frequency, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
