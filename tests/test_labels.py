import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import examples as ex
from lexispark.operators import labels as lb
from lexispark.operators import results as rs
from lexispark.operators import scoring as sc


def chunk_oracle(tags):
    """The lenient reading of BIOES tags, one tag at a time."""
    out, prev, start, kind = [], "O", None, None
    for i, tag in enumerate(tags + ["O"]):
        p, t = tag[0], tag[2:] if "-" in tag else tag[1:]
        pp, pt = prev[0], prev[2:] if "-" in prev else prev[1:]
        begins = p in "BS" or (p in "IE" and pp in "ESO") or (p != "O" and pt != t)
        if start is not None and (begins or p == "O"):
            out.append((kind, start, i - 1))
            start = None
        if begins:
            start, kind = i, t
        prev = tag
    return out


def test_chunks(spark):
    rng = random.Random(1)
    names = ["O"] + [f"{p}-{t}" for p in "BIES" for t in ("X", "Y")]
    rows = [([rng.choice(names) for _ in range(rng.randint(1, 9))],) for _ in range(300)]
    df = spark.createDataFrame(rows, "t array<string>")
    for r in df.select("t", sc.chunks(F.col("t")).alias("c")).collect():
        assert [tuple(c) for c in r["c"]] == chunk_oracle(r["t"])


def test_pair_truncation(spark):
    rows = [(list(range(10, 10 + a)), list(range(50, 50 + b))) for a in range(0, 14) for b in range(0, 14)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    for length in (8, 11):
        for r in df.select("a", "b", ex.add_special_pair(F.col("a"), F.col("b"), length).alias("x")).collect():
            a, b = list(r["a"]), list(r["b"])
            while len(a) + len(b) + 4 > length:
                (a if len(a) > len(b) else b).pop()
            assert r["x"] == [0, *a, 2, 2, *b, 2]


def test_split_pair(spark):
    df = spark.createDataFrame([([0, 7, 8, 2, 2, 9, 2],), ([0, 2, 2, 2],)], "x array<int>")
    rows = ex.split_pair(df, "x", 6).collect()
    assert (rows[0]["ids_a"], rows[0]["ids_b"]) == ([0, 7, 8, 2, 1, 1], [0, 9, 2, 1, 1, 1])
    assert (rows[0]["mask_a"], rows[0]["mask_b"]) == ([1, 1, 1, 1, 0, 0], [1, 1, 1, 0, 0, 0])
    assert (rows[1]["ids_a"], rows[1]["ids_b"]) == ([0, 2, 1, 1, 1, 1], [0, 2, 1, 1, 1, 1])


def test_inputs(spark):
    df = spark.createDataFrame([([5, 6, 7],)], "x array<int>").withColumn("x", ex.add_special(F.col("x"), 4))
    row = ex.model_inputs(df, "x", pad_to=6).first()
    assert row["input_ids"] == [0, 5, 6, 2, 1, 1] and row["attention_mask"] == [1, 1, 1, 1, 0, 0]
    assert row["special_tokens_mask"] == [1, 0, 0, 1, 1, 1]
    assert len(ex.model_inputs(df, "x", multiple=8).first()["input_ids"]) == 8


@pytest.mark.parametrize("sizes", [[3] * 10, [1, 2], [0, 0], [40]])
def test_blocks(spark, sizes):
    rows, at = [], 0
    for i, n in enumerate(sizes):
        rows.append((i, list(range(at, at + n))))
        at += n
    df = spark.createDataFrame(rows, "n long, ids array<int>")
    got = [r["ids"] for r in ex.blocks(df, "n", "ids", 8, batch=4).orderBy("batch", "block").collect()]
    want = []
    for g in range(0, len(rows), 4):
        flat = [x for _, ids in rows[g : g + 4] for x in ids]
        keep = len(flat) // 8 * 8 if len(flat) >= 8 else len(flat)
        want += [flat[i : min(i + 8, keep)] for i in range(0, keep, 8)]
    assert got == want


def test_masking_shares(spark):
    df = spark.range(2000).withColumn("ids", F.array_repeat(F.lit(77), 50)).withColumn("ids", ex.add_special(F.col("ids"), 99))
    rows = ex.mask_tokens(df, "ids", F.col("id"), 1, 1000).select(F.explode(F.arrays_zip("ids", "masked_ids", "labels")).alias("z")).select("z.*").toPandas()
    special = rows["ids"].isin([0, 2])
    assert (rows[special]["labels"] == -100).all() and (rows[special]["masked_ids"] == rows[special]["ids"]).all()
    body = rows[~special]
    hit = body[body["labels"] != -100]
    assert abs(len(hit) / len(body) - 0.15) < 0.01 and (hit["labels"] == 77).all()
    assert abs((hit["masked_ids"] == ex.MASK).mean() - 0.8) < 0.02 and abs((hit["masked_ids"] == 77).mean() - 0.1) < 0.02
    assert (body[body["labels"] == -100]["masked_ids"] == 77).all()


def test_alignment(spark):
    df = spark.createDataFrame([(["B-X", "O", "I-X", "B-Y"], [2, 0, 3, 2])], "tags array<string>, n array<int>")
    labels = spark.createDataFrame([(["B-X", "B-Y", "I-X", "O"],)], "labels array<string>")
    plain = lb.align_labels(df, "tags", "n", labels, 99).first()
    assert plain["label_ids"] == [-100, 0, -100, 2, -100, -100, 1, -100, -100]
    assert plain["first_piece"] == [0, 1, 1, 3, 3, 3, 6, 6, 8]
    every = lb.align_labels(df, "tags", "n", labels, 6, label_all_pieces=True).first()
    assert every["label_ids"] == [-100, 0, 2, 2, 2, -100] and every["first_piece"] == [0, 1, 1, 3, 3, 5]


def test_label_order(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "label string, label_id int")
    b = spark.createDataFrame([("y", 0), ("x", 1)], "label string, label_id int")
    got = {r["label"]: (r["label_id"], r["adopted"]) for r in lb.adopt_order(a, b).collect()}
    assert got == {"x": (1, True), "y": (0, True)}
    got = {r["label"]: (r["label_id"], r["adopted"]) for r in lb.adopt_order(a, b.where("label = 'x'")).collect()}
    assert got == {"x": (0, False), "y": (1, False)}


def test_macro_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 3)], "y int, p int")
    row = sc.macro_scores(df, "y", "p").first()
    assert math.isclose(row["precision"], (1 + 0.5 + 0 + 0) / 4) and math.isclose(row["recall"], (0.5 + 1 + 0 + 0) / 4)
    assert math.isclose(row["f1"], (2 / 3 + 2 / 3) / 4) and row["accuracy"] == 0.5


def test_perplexity(spark):
    df = spark.createDataFrame([(0.0,), (1e4,)], "loss double")
    assert [r[0] for r in df.select(sc.perplexity(F.col("loss"))).collect()] == [1.0, math.inf]


def test_correlations(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=200), 1)
    y = np.round(x + rng.normal(size=200), 1)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)] + [("g", None, 1.0)], "regime string, x double, y double")
    row = rs.with_p_values(rs.correlations(df, "x", "y")).first()

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert row["n"] == 200 and np.isclose(row["pearson"], np.corrcoef(x, y)[0, 1])
    assert np.isclose(row["spearman"], np.corrcoef(ranks(x), ranks(y))[0, 1])


@pytest.mark.parametrize("r, n, p", [(0.5, 10, 0.14111328125), (0.0, 30, 1.0), (0.9, 4, 0.1)])
def test_p_value(r, n, p):
    if n == 10:
        # Exact for eight degrees of freedom: the tail is a polynomial in r.
        t = r
        p = 1 - (35 / 16) * (t - t**3 + 3 * t**5 / 5 - t**7 / 7)
    assert math.isclose(rs._tail(r, n), p, rel_tol=1e-9, abs_tol=1e-12)


def test_families(spark):
    rows = [(m, "x", 0.1) for m in ("k_1", "k_2", "Chung", "beta", "unigram", "a", "b")]
    df = spark.createDataFrame(rows, "model string, lang_tgt string, value double")
    got = sorted((r["family"], r["model"]) for r in rs.family_views(df).collect())
    assert got == sorted([("Chung", "Chung"), ("Chung", "unigram"), ("beta", "beta"), ("beta", "unigram"), ("k_", "k_1"), ("k_", "k_2"), ("k_", "unigram")])
    assert rs.family_views(df.where("model <> 'a'")).count() == 0


def test_regimes_and_bootstrap(spark):
    rows = [("m", s, a, b, (s + ord(a) + ord(b)) / 100) for s in (1, 2) for a in "ef" for b in "ef"]
    df = spark.createDataFrame(rows, "model string, seed int, lang_src string, lang_tgt string, value double")
    tagged = rs.with_regimes(df, F.lit("e"))
    sizes = {r["regime"]: r["count"] for r in tagged.groupBy("regime").count().collect()}
    assert sizes == {"in": 4, "en_all": 4, "en_other": 2, "cross": 4}
    boot = rs.bootstrap(tagged).groupBy("regime").agg(F.count("*").alias("n"), F.count_distinct(F.round("mean_value", 9)).alias("kinds")).collect()
    assert {r["regime"]: r["n"] for r in boot} == rs.REPLICATES
    assert all(1 < r["kinds"] <= 4 for r in boot)


def test_resampling_weights(spark):
    from lexispark.functions.hashing import draw_key

    rows = spark.range(50_000).select(rs.resampling_weight(draw_key(F.col("id"))).alias("w")).groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 50_000 for r in rows}
    for k in range(4):
        assert abs(share[k] - math.exp(-1) / math.factorial(k)) < 0.01


def test_entity_scores_next_to_chunks_by_column(spark):
    """Counts of a batch equal those of the chunks that the column expression finds in each row."""
    import random

    rng = random.Random(1)
    tags = ["O", "B-PER", "I-PER", "E-PER", "S-LOC", "I-LOC", "B", "I", "B-a-b"]
    rows = [([rng.choice(tags) for _ in range(n)], [rng.choice(tags) for _ in range(n)]) for n in (0, 1, 2, 3, 9, 30, 0, 17, 200)]
    df = spark.createDataFrame(rows, "t array<string>, p array<string>").coalesce(1)
    got = {r["type"]: r for r in sc.entity_scores(df, "t", "p").collect()}
    found = df.select(sc.chunks(F.col("t")).alias("g"), sc.chunks(F.col("p")).alias("h")).collect()
    for name in {e["type"] for r in found for c in r for e in c}:
        gold = {(i, *e) for i, r in enumerate(found) for e in r["g"] if e["type"] == name}
        guess = {(i, *e) for i, r in enumerate(found) for e in r["h"] if e["type"] == name}
        assert got[name]["support"] == len(gold) and abs(got[name]["precision"] - len(gold & guess) / max(1, len(guess))) < 1e-12
    pairs = [x == y for t, p in rows for x, y in zip(t, p)]
    assert got["overall"]["support"] == sum(len(r["g"]) for r in found) and abs(got["overall"]["accuracy"] - sum(pairs) / len(pairs)) < 1e-12


def test_align_labels_of_a_batch_next_to_plain_python(spark):
    import random

    rng = random.Random(2)
    names = ["B-A", "B-B", "I-A", "O"]
    rows = [(i, [rng.choice([*names, None, "X"]) for _ in range(n)], [rng.choice([0, 1, 2, 5, 40, None]) for _ in range(n)]) for i, n in enumerate((0, 3, 1, 30, 0, 9, 12, 200))]
    rows += [(8, None, [1]), (9, ["O"], None)]
    df = spark.createDataFrame(rows, "i int, t array<string>, n array<int>").coalesce(1)
    labels = spark.createDataFrame([(names,)], "labels array<string>")

    def place(t):
        return None if t is None else names.index(t) if t in names else -1

    for every in (False, True):
        got = {r["i"]: (r["label_ids"], r["first_piece"]) for r in lb.align_labels(df, "t", "n", labels, 20, every).collect()}
        for i, tags, counts in rows:
            if tags is None or counts is None:
                assert got[i] == (None, None)
                continue
            ids, first = [], []
            for t, n in zip(tags, counts):
                inside = place("I-A" if t == "B-A" else t) if every else -100
                at = len(ids) + 1
                ids += ([place(t)] + [inside] * (n - 1)) if n else []
                first += [at] * (n or 0)
            assert got[i] == ([-100, *ids[:18], -100], [0, *first[:18], len(first[:18]) + 1])


def test_token_ids_hash_each_word(spark, tmp_path):
    """Ids of a batch with empty lines, repeated words and other scripts are those of each word."""
    from hashlib import md5

    from lexispark.plans import views

    texts = {0: "a b  a\n\n 　\né 😀 b\n", 1: "", 2: "a", 3: None}
    rows = [(i, t, "en", "web", 1) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["pos"]): r["ids"] for r in views.token_ids(spark, str(tmp_path)).collect()}
    slot = lambda w: int(md5(w.encode()).hexdigest()[:6], 16) % 30000 + 5
    assert got == {(0, 0): [slot("a"), slot("b"), slot("a")], (0, 3): [slot("é"), slot("😀"), slot("b")], (2, 0): [slot("a")]}
