import itertools
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexispark.operators import bpe, decompose, lattice, segment, unigram
from lexispark.operators import vocab_merge as vm
from lexispark.operators.ordering import largest_n
from lexispark.session import checkpointed


def all_splits(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        out, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                out.append(word[start:i])
                start = i
        yield out + [word[start:]]


def split_score(parts, scores, unknown):
    total = 0.0
    for p in parts:
        if p in scores:
            total += scores[p]
        elif len(p) == 1:
            total += unknown
        else:
            return -math.inf
    return total


SCORES = {"a": -3.0, "b": -4.0, "ab": -4.5, "ba": -5.5, "aba": -6.0, "bb": -7.25}


def test_best_split_and_expectation_by_enumeration():
    for n in range(1, 8):
        for letters in itertools.product("abz", repeat=n):
            word = "".join(letters)
            scored = [(split_score(s, SCORES, -14.0), s) for s in all_splits(word)]
            best, parts = segment.best_split(word, SCORES, 3, -14.0)
            assert math.isclose(best, max(s for s, _ in scored))
            assert all(p is None or p in SCORES for p in parts)
            total, expected = unigram.expected_pieces(word, SCORES, 3, -14.0)
            mass = {s_i: math.exp(s) for s_i, (s, _) in enumerate(scored) if s > -math.inf}
            z = sum(mass.values())
            assert math.isclose(total, math.log(z))
            want = {}
            for i, m in mass.items():
                for p in scored[i][1]:
                    if p in SCORES:
                        want[p] = want.get(p, 0.0) + m / z
            got = {}
            for p, x in expected:
                got[p] = got.get(p, 0.0) + x
            assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], rel_tol=1e-9) for p in want)


def plain_merge(word, scores):
    parts = list(word)
    while True:
        usable = [(scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
        if not usable:
            return parts
        at = -max(usable)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_merge_split_is_pair_by_pair():
    rng = random.Random(0)
    for _ in range(300):
        scores = {c: -9.0 for c in "abc"} | {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))): -float(rng.randrange(1, 6)) for _ in range(12)}
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
        assert segment.merge_split(word, scores, 4, -99.0)[1] == [p if p in scores else None for p in plain_merge(word, scores)]


def test_long_words_take_about_linear_time():
    scores = {c: -9.0 for c in "ab"} | {"ab": -1.0, "abab": -0.5}
    start = time.perf_counter()
    assert len(segment.merge_split("ab" * 50_000, scores, 4, -99.0)[1]) == 25_000
    assert time.perf_counter() - start < 5


def test_unknown_runs_are_one_piece():
    assert segment.best_split("azzb", SCORES, 3, -14.0)[1] == ["a", None, "b"]
    assert segment.merge_split("azzab", SCORES, 3, -14.0)[1] == ["a", None, "ab"]


def vocab(spark, scores):
    rows = [(0, "<unk>", 0.0, "UNKNOWN")] + [(i + 1, p, s, "NORMAL") for i, (p, s) in enumerate(scores.items())]
    return spark.createDataFrame(rows, "piece_id int, piece string, score double, type string")


@pytest.mark.parametrize("model", ["unigram", "bpe"])
@pytest.mark.parametrize("out", ["ids", "pieces"])
def test_join_path_equals_broadcast_path(spark, model, out):
    pieces = vocab(spark, {"▁": -3.5, **SCORES, "▁a": -5.0})
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["ab  aba\tz", "", "bbb abab", "ab " * 40])], "k long, t string")
    a = sorted(map(tuple, segment.encode(texts, pieces, "t", ["k"], out, model).collect()))
    b = sorted(map(tuple, segment.encode(texts, pieces, "t", ["k"], out, model, max_broadcast=2).collect()))
    assert a == b and len(a) == 4
    words = segment.distinct_words(texts, "t")
    a = sorted(map(str, segment.encode_words(words, pieces, model).collect()))
    assert a == sorted(map(str, segment.encode_words(words, pieces, model, max_broadcast=2).collect()))


def test_encoding_marks_word_starts(spark):
    texts = spark.createDataFrame([(0, "ab ba")], "k long, t string")
    pieces = vocab(spark, {"▁": -3.5, **SCORES})
    got = segment.encode(texts, pieces, "t", ["k"], "pieces").first()["pieces"]
    assert got == ["▁", "ab", "▁", "ba"] and "".join(got).replace("▁", " ").strip() == "ab ba"


def naive_bpe(words, n):
    state = [(list(w), c) for w, c in words]
    merges = []
    for _ in range(n):
        counts = {}
        for s, c in state:
            for a, b in zip(s, s[1:]):
                counts[a, b] = counts.get((a, b), 0) + c
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        merges.append(best)
        for s, _ in state:
            i = 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == best:
                    s[i : i + 2] = [s[i] + s[i + 1]]
                i += 1
    return merges


def test_bpe_equals_one_pair_per_round(spark):
    rng = random.Random(3)
    words = {}
    for _ in range(400):
        w = "".join(rng.choice("abcde.") for _ in range(rng.randint(1, 9)))
        words[w] = words.get(w, 0) + rng.randint(1, 50)
    df = spark.createDataFrame(list(words.items()), "word string, cnt long")
    table, merges = bpe.train_bpe(df, 3 + 6 + 25, coverage=1.0)
    assert merges == naive_bpe(words.items(), len(merges))
    assert table.count() == 3 + 6 + 25
    assert [r["piece"] for r in table.orderBy("piece_id").limit(3).collect()] == ["<unk>", "<s>", "</s>"]


@pytest.mark.parametrize("share", [0.02, 1.1])
def test_bpe_by_index_equals_one_pair_per_round(spark, monkeypatch, share):
    """The index is written at once, and again and again as words are touched; the joins stay the same."""
    monkeypatch.setattr(bpe, "LOOK_AFTER", 2)
    monkeypatch.setattr(bpe, "RECENT_SHARE", share / 4)
    built = []
    plain = bpe.Words.build_index

    def build(self, part):
        before = self.index
        plain(self, part)
        built.append(self.index is not before)

    monkeypatch.setattr(bpe.Words, "build_index", build)
    rng = random.Random(7)
    words = {}
    for _ in range(500):
        w = "".join(rng.choice("aabbcdefgh") for _ in range(rng.randint(1, 9)))
        words[w] = words.get(w, 0) + rng.randint(1, 50)
    df = spark.createDataFrame(list(words.items()), "word string, cnt long")
    _, merges = bpe.train_bpe(df, 3 + 8 + 24, coverage=1.0, index_below=1.1)
    assert merges == naive_bpe(words.items(), len(merges)) and len(merges) >= 24
    assert sum(built) > (1 if share < 1 else 0)


def test_a_round_by_index_reads_only_words_that_hold_its_pairs(spark):
    words = {f"{a}{b}{c}": 1 for a in "abcdefgh" for b in "klmnopqr" for c in "stuvwxyz"}
    state = bpe.Words(spark.createDataFrame(list(words.items()), "word string, cnt long"), 1.1)
    state.build_index(0.0)
    assert state.recent.count() == 0
    change = {(r["left"], r["right"]): r["n"] for r in state.join([("a", "k")]).groupBy("left", "right").agg(F.sum("n").alias("n")).collect() if r["n"]}
    assert state.recent.count() == 8
    assert change == {("a", "k"): -8} | {("k", c): -1 for c in "stuvwxyz"} | {("ak", c): 1 for c in "stuvwxyz"}
    state.join([("ak", "s"), ("b", "l")]).count()
    assert state.recent.count() == 16
    assert {r["symbols"] for r in state._all().collect()} >= {"aks", "ak t", "bl s", "c k s"} and state._all().count() == 512


def test_join_pairs_overlap(spark):
    df = spark.createDataFrame([("a a a a b . c",), ("a a a",), ("xa a",)], "s string")
    got = [r[0] for r in df.select(bpe.join_pairs(F.col("s"), [("a", "a"), (".", "c")])).collect()]
    assert got == ["aa aa b .c", "aa a", "xa a"]


def test_blocks_next_to_single_words():
    """Best paths and piece numbers of words side by side, in two slots, equal those of each word alone."""
    rng = random.Random(11)
    for _ in range(30):
        words = ["".join(rng.choice("abcz") for _ in range(rng.randint(0, 12))) for _ in range(20)]
        models = [{w: -float(rng.randint(1, 9)) for w in {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(15)}} for _ in range(2)]
        index = {p: i for i, p in enumerate({**models[0], **models[1]})}
        score = np.array([[m.get(p, -math.inf) for m in models] for p in index])
        block = lattice.block_of(words, index, score, 4)
        block.set_unknown(np.array([-20.0, -25.0]))
        best, count, last = block.best()
        edges = block.path_edges(last)
        for w, word in enumerate(words):
            for g, m in enumerate(models):
                value, parts = segment.best_split(word, m, 4, (-20.0, -25.0)[g])
                assert math.isclose(best[w, g], value) and count[w, g] == len(parts)
            own = [(block.start[e], block.end[e]) for e in edges[block.word[edges] == w]]
            assert sorted(own) == sorted(zip([0, *sorted(e for _, e in own)], sorted(e for _, e in own)))
            assert math.isclose(sum(models[0].get(word[a:b], -20.0) for a, b in own), best[w, 0])


def plain_step(words, scores, scale):
    unknown, longest = min(scores.values()) - 10, max(map(len, scores))
    freq, likelihood = {}, 0.0
    for w, c in words.items():
        splits = [s for s in all_splits(w)]
        logs = np.array([split_score(s, scores, unknown) for s in splits])
        total = np.logaddexp.reduce(logs)
        likelihood += c * total
        for s, x in zip(splits, np.exp(logs - total)):
            for p in s:
                if p in scores:
                    freq[p] = freq.get(p, 0.0) + c * x
    freq = {p: max(f, 1e-3) for p, f in freq.items() if f >= 0.5 or len(p) == 1}
    mass = sum(freq.values())
    return {p: scale(f) - scale(mass) for p, f in freq.items()}, likelihood


def plain_digamma(x):
    return math.log(x + 50) - 1 / (2 * (x + 50)) - 1 / (12 * (x + 50) ** 2) - sum(1 / (x + i) for i in range(50))


def toy(spark):
    words = {w: n for n, w in enumerate(["abab", "aba", "babz", "abba", "cab", "zz", "a", "abababab"], 3)}
    df = spark.createDataFrame([(w, n, None) for w, n in words.items()], "word string, cnt long, own long")
    scores = {p: -1.0 - i / 3 for i, p in enumerate(["a", "b", "c", "ab", "ba", "aba", "bab", "abab", "cab"])}
    pieces = spark.createDataFrame([(i * 7, p, s) for i, (p, s) in enumerate(scores.items())], "pid long, piece string, score double")
    return words, df, scores, pieces


@pytest.mark.parametrize("sparse", [False, True])
def test_steps_equal_plain_expectation_maximisation(spark, monkeypatch, sparse):
    monkeypatch.setattr(lattice, "BLOCK", 3)
    words, df, scores, pieces = toy(spark)
    table = lattice.lattices(df, pieces.select("pid", "piece"), 4)
    for _ in range(2):
        scores, want = plain_step(words, scores, plain_digamma if sparse else math.log)
        pieces, got, low = unigram.em_step(table, pieces, sparse)
        assert math.isclose(got, want, rel_tol=1e-9)
        assert {r["piece"]: r["score"] for r in pieces.collect()} == pytest.approx(scores, rel=1e-7)
        assert low == pytest.approx(min(scores.values()), rel=1e-7)


def test_likelihood_rises(spark):
    """Where nothing is unknown or dropped; the first scores are no distribution."""
    words = [(w, 1000 + n, None) for n, w in enumerate(["abab", "aba", "bab", "abba", "cab", "a", "abababab"])]
    table = spark.createDataFrame(words, "word string, cnt long, own long")
    _, _, _, pieces = toy(spark)
    table = lattice.lattices(table, pieces.select("pid", "piece"), 4)
    seen = []
    for _ in range(4):
        pieces, likelihood, _ = unigram.em_step(table, pieces, sparse=False)
        seen.append(likelihood)
    assert seen[1] < seen[2] < seen[3]


def test_losses_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 3)
    words, df, scores, pieces = toy(spark)
    unknown = min(scores.values()) - 10
    numbers = pieces.select("pid", "piece")
    several = pieces.where(F.length("piece") > 1).select(F.col("piece").alias("word"), F.lit(1.0).alias("cnt"), F.col("pid").alias("own"))
    got = unigram.prune_losses(lattice.lattices(df, numbers, 4), lattice.lattices(several, numbers, 4), pieces)
    freq = dict.fromkeys(scores, 0.0)
    for w, c in words.items():
        for p in segment.best_split(w, scores, 4, unknown)[1]:
            if p is not None:
                freq[p] += c
    total = sum(freq.values())
    for r in got.collect():
        piece, f = r["piece"], freq[r["piece"]]
        if len(piece) == 1:
            assert r["loss"] == math.inf
            continue
        other, parts = segment.best_split(piece, {p: s for p, s in scores.items() if p != piece}, 4, unknown)
        if other > scores[piece] or not f:
            assert r["loss"] == -math.inf
        else:
            without = sum(math.log(freq[p] + f) for p in parts) - len(parts) * math.log(total + f * (len(parts) - 1))
            assert math.isclose(r["loss"], f / total * (math.log(f) - math.log(total) - without), rel_tol=1e-9)


def test_largest_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1.0, 2.0, 2.0, -math.inf, math.inf]), f"k{i:04}") for i in range(500)]
    df = checkpointed(spark.createDataFrame(rows, "v double, k string"))
    for n in (0, 1, 77, 300, 500, 900):
        got = sorted(map(tuple, largest_n(df, n, [F.col("v").desc(), F.col("k")]).collect()))
        assert got == sorted(sorted(rows, key=lambda r: (-r[0], r[1]))[:n])


def test_unigram_training(spark):
    words = {f"▁{stem}{end}": 20 + i for i, stem in enumerate(["walk", "talk", "jump", "play"]) for end in ("", "ing", "ed", "s")}
    df = spark.createDataFrame(list(words.items()), "word string, cnt long")
    table = unigram.train_unigram(df, 40, coverage=1.0, seed_size=500)
    rows = table.orderBy("piece_id").collect()
    assert [r["piece_id"] for r in rows] == list(range(len(rows))) and len(rows) <= 40
    pieces = {r["piece"] for r in rows}
    assert set("".join(words)) <= pieces and {"ing"} & pieces | {"▁walk"} & pieces
    scores = [r["score"] for r in rows if r["type"] == "NORMAL"]
    assert scores == sorted(scores, reverse=True)


def test_character_coverage(spark):
    counts = spark.createDataFrame([("a", 90), ("b", 9), ("c", 1)], "char string, cnt long")
    assert sorted(r["char"] for r in unigram.covered_characters(counts, 0.99).collect()) == ["a", "b"]
    assert unigram.covered_characters(counts, 1.0).count() == 3


def tokenizer_rows(name, order, grp, pieces):
    rows = [(name, order, grp, 0, "<unk>", 0.0, "UNKNOWN"), (name, order, grp, 1, "<s>", 0.0, "CONTROL")]
    return rows + [(name, order, grp, i + 2, p, s, "NORMAL") for i, (p, s) in enumerate(pieces.items())]


TOK_SCHEMA = "tokenizer string, tok_ord int, grp string, piece_id int, piece string, score double, type string"


def brute_merge(models, log_scores=True):
    pieces = {}
    for m in models:
        for p, s in m.items():
            pieces.setdefault(p, []).append(s)
    n, d = len(models), len(pieces)
    if log_scores:
        scored = {p: math.log(sum(map(math.exp, s)) / n) for p, s in pieces.items()}
    else:
        scored = {p: (sum(s) - (n - len(s)) * d) / n for p, s in pieces.items()}
    return sorted(scored.items(), key=lambda x: -round(x[1], 12))


@pytest.mark.parametrize("log_scores", [True, False])
def test_merge(spark, log_scores):
    models = [{"a": -1.0, "b": -2.0, "c": -3.0}, {"b": -1.0, "d": -2.0, "a": -4.0}, {"e": -2.0, "f": -2.0}]
    rows = [r for i, m in enumerate(models) for r in tokenizer_rows(f"t{i}", i, "g", m)]
    out = vm.merge(spark.createDataFrame(rows, TOK_SCHEMA), log_scores).orderBy("piece_id").collect()
    assert [r["piece"] for r in out] == ["<unk>", "<s>"] + [p for p, _ in brute_merge(models, log_scores)]
    assert all(math.isclose(r["score"], s) for r, (_, s) in zip(out[2:], brute_merge(models, log_scores)))
    with pytest.raises(ValueError):
        vm.trim(vm.merge(spark.createDataFrame(rows, TOK_SCHEMA)), 99)


def brute_greedy(groups, lines, target, extra_step=True):
    pointers = {g: 0 for g in groups}

    def build(p):
        return dict(brute_merge([groups[g][p[g]] for g in groups]))

    def metric(scores):
        unknown, longest = min(scores.values()) - 10, max(map(len, scores))
        means = []
        for src in lines:
            means.append(np.mean([sum(len(segment.best_split("▁" + w, scores, longest, unknown)[1]) for w in line.split()) for line in lines[src]]))
        return np.mean(means)

    size, rounds = len(build(pointers)) + 2, []
    while size < target and any(pointers[g] + 1 < len(groups[g]) for g in groups):
        options = []
        for i, g in enumerate(groups):
            if pointers[g] + 1 < len(groups[g]):
                p = {**pointers, g: pointers[g] + 1}
                options.append((metric(build(p)), i, g, p))
        value, _, g, pointers = min(options, key=lambda o: (round(o[0], 9), o[1]))
        size = len(build(pointers)) + 2
        rounds.append((g, value, size))
    return rounds


def test_greedy_merge(spark):
    rng = random.Random(5)
    letters = {"▁": -3.0, **{c: -4.0 - i / 10 for i, c in enumerate("abcd")}}

    def model(n):
        extra = {}
        while len(extra) < n:
            extra["".join(rng.choice("▁abcd"[bool(extra):]) for _ in range(rng.randint(2, 3)))] = -5.0 - rng.random()
        return {**letters, **extra}

    groups = {g: [model(n) for n in (2, 5, 9)] for g in ("x", "y")}
    lines = {s: ["".join(rng.choice("abcd  ") for _ in range(30)).strip() or "a" for _ in range(12)] for s in ("s1", "s2")}
    rows = [r for gi, (g, ms) in enumerate(groups.items()) for j, m in enumerate(ms) for r in tokenizer_rows(f"{g}{j}", gi * 3 + j, g, m)]
    corpus = spark.createDataFrame([(s, t) for s in lines for t in lines[s]], "src string, line string")
    want = brute_greedy(groups, lines, 19)
    got = vm.greedy_merge(spark.createDataFrame(rows, TOK_SCHEMA), corpus, 19)
    assert [(g, n) for g, _, n in got.rounds] == [(g, n) for g, _, n in want]
    assert np.allclose([m for _, m, _ in got.rounds], [m for _, m, _ in want])
    assert got.reached and got.vocab.count() == 19
    far = vm.greedy_merge(spark.createDataFrame(rows, TOK_SCHEMA), corpus, 500)
    assert not far.reached and len(far.rounds) == 4


def test_candidates_at_once():
    index = {p: i for i, p in enumerate(SCORES)}
    full = np.array(list(SCORES.values()))[:, None].repeat(2, axis=1)
    full[index["ab"], 1] = -np.inf
    unknown = np.array([-20.0, -20.0])
    less = {p: s for p, s in SCORES.items() if p != "ab"}
    for word in ["abab", "zzab", "bbaz", "a"]:
        got = vm._piece_numbers(word, index, full, 3, unknown)
        assert list(got) == [len(segment.best_split(word, m, 3, -20.0)[1]) for m in (SCORES, less)]


def test_svd(spark):
    rng = np.random.default_rng(0)
    dense = rng.random((60, 5)) @ rng.random((5, 30)) + (rng.random((60, 30)) < 0.1) * 0.05
    dense[dense < 0.6] = 0.0
    dense[7] = 0.0
    rows = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(dense)]
    df = spark.createDataFrame(rows, "doc long, ids array<long>, weights array<double>")
    emb, values, v = decompose.truncated_svd(df, "doc", 30, 4, iterations=7)
    assert np.allclose(values, np.linalg.svd(dense)[1][:4], rtol=1e-4)
    table = emb.orderBy("doc").toPandas()
    got = np.stack(table["embedding"])
    assert len(got) == 60 and not got[7].any()
    axes = np.zeros((30, 4))
    for r in v.collect():
        axes[r["term_id"]] = r["vector"]
    assert np.allclose(got, dense[table["doc"]] @ axes, atol=1e-6)
    long = pd.DataFrame([(i, j, dense[i, j]) for i in range(60) for j in range(30) if dense[i, j]], columns=["doc", "token", "weight"])
    ratio = decompose.explained_variance(emb, "embedding", spark.createDataFrame(long), 60).first()[0]
    assert np.isclose(ratio, np.var(dense @ axes, axis=0).sum() / np.var(dense, axis=0).sum())


def test_svd_sends_a_vector_per_term_of_a_block(spark, monkeypatch):
    """Blocks of documents are multiplied in place; documents that come twice add up."""
    monkeypatch.setattr(decompose, "BLOCK_POSTINGS", 200)
    rng = np.random.default_rng(1)
    dense = rng.random((50, 3)) @ rng.random((3, 12)) + 0.5
    rows = [(i % 40, list(range(12)), r.tolist()) for i, r in enumerate(dense)] + [(99, [], [])]
    df = spark.createDataFrame(rows, "doc long, ids array<long>, weights array<double>")
    blocks = decompose._Blocks.of(df, "doc")
    n_blocks = blocks.rows.select("block").distinct().count()
    assert 1 < n_blocks <= 3 and blocks.needs.count() == 12 * n_blocks
    blocks.rows.unpersist()
    emb, values, _ = decompose.truncated_svd(df, "doc", 12, 2, iterations=1)
    merged = dense[:40].copy()
    merged[:10] += dense[40:]
    assert np.allclose(values, np.linalg.svd(merged)[1][:2], rtol=1e-4)
    got = emb.collect()
    assert len(got) == 51 and {r["doc"] for r in got if not any(r["embedding"])} == {99}


def test_unigram_queries_use_whole_seed_vocabularies(spark, tmp_path, monkeypatch):
    """A repeated word of 13 characters, the mark included, is one piece; training keeps the operator's number of seeds."""
    from lexispark.plans import model_queries

    rows = [(i, "abcdefghijkl " * 3 + "xy", "en", "s", 41) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    seeds = {r["piece"] for r in model_queries.subword_vocab(spark, str(tmp_path), unigram.SEED_SIZE, unigram.LONGEST_PIECE).collect()}
    word, other = "▁abcdefghijkl", "▁xy"
    assert seeds == {w[a:b] for w in (word, other) for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
    assert all(r["n_tokens"] == 4 for r in model_queries.encode_unigram(spark, str(tmp_path)).collect())
    monkeypatch.setattr(unigram, "train_unigram", lambda words, size, **limits: (size, limits))
    assert model_queries.train_unigram(spark, str(tmp_path)) == (2000, {})


def test_substring_counts_over_ranges(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("aab▁é😀") for _ in range(rng.randint(1, 24))) for _ in range(400)})
    counts = [rng.randint(1, 4) for _ in words]
    want = {}
    for w, c in zip(words, counts):
        for a in range(len(w)):
            for b in range(a + 1, min(len(w), a + 16) + 1):
                want[w[a:b]] = want.get(w[a:b], 0) + c
    want = {p: n for p, n in want.items() if n > 1 or len(p) == 1}
    df = spark.createDataFrame(list(zip([*words, ""], [*counts, 5])), "word string, cnt long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = unigram.substring_counts(df, 16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(want) and {r["piece"]: r["cnt"] for r in rows} == want


def test_a_million_seeds_and_all_characters_are_sent_to_tasks():
    assert segment.MAX_BROADCAST_PIECES > unigram.SEED_SIZE + 100_000


@pytest.mark.parametrize("sent, scores_sent", [(1_200_000, 8_000_000), (1_200_000, 0), (3, 0)])
def test_lattices_in_tasks_equal_joined_ones(spark, monkeypatch, sent, scores_sent):
    """Words meet the pieces where they are, without a shuffle of their substrings; with more pieces than are sent, by a join."""
    monkeypatch.setattr(lattice, "BLOCK", 3)
    monkeypatch.setattr(lattice, "MAX_BROADCAST_PIECES", sent)
    monkeypatch.setattr(lattice, "MAX_SENT_SCORES", scores_sent)
    words, df, scores, pieces = toy(spark)
    numbers = pieces.select("pid", "piece")
    several = pieces.where(F.length("piece") > 1).select(F.col("piece").alias("word"), F.lit(1.0).alias("cnt"), F.col("pid").alias("own"))
    table, others = lattice.lattices(df, numbers, 4), lattice.lattices(several, numbers, 4)
    assert (table.ids is not None) == (sent > 3)
    assert sorted(w for r in table.blocks.collect() for w in r["word"]) == sorted(words)
    # A piece without a score is no piece in this pass, and the word that it is has no loss.
    without = checkpointed(pieces.where("piece <> 'bab'"))
    del scores["bab"]
    want, likelihood = plain_step(words, scores, math.log)
    new, got, _ = unigram.em_step(table, without, sparse=False)
    assert math.isclose(got, likelihood, rel_tol=1e-9)
    assert {r["piece"]: r["score"] for r in new.collect()} == pytest.approx(want, rel=1e-7)
    losses = {r["piece"]: r["loss"] for r in unigram.prune_losses(table, others, without).collect()}
    assert losses.keys() == scores.keys() and losses["a"] == math.inf and losses["aba"] > -math.inf


def test_svd_removes_the_tables_of_finished_steps(spark):
    """Of the vectors of all steps only the last ones and the products are left in the shared folder."""
    import os

    from lexispark.session import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rng = np.random.RandomState(3)
    rows = [(i, sorted(rng.choice(40, 6, False).tolist()), rng.rand(6).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<long>, weights array<double>")
    embedded, values, terms = decompose.truncated_svd(df, "doc_id", 40, 3)
    assert embedded.count() == 50 and terms.count() == len({t for _, ids, _ in rows for t in ids}) and len(values) == 3
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"vectors", "products"}
    assert len(set(os.listdir(folder)) - before) == 2


def test_term_rows_are_written_without_a_shuffle_of_their_own(spark, tmp_path):
    """Rows of terms are read from a table, of each document one, those without terms included."""
    from lexispark.plans.model_queries import lsa_input

    texts = ["red green blue", "red green", "blue yellow", "yellow red pink", "", None]
    docs = spark.createDataFrame([(i, "en", "s", t) for i, t in enumerate(texts)], "doc_id long, lang string, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows, terms, _ = lsa_input(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan or "FileScan" in plan
    ids = {r["term_id"]: r["token"] for r in terms.collect()}
    found = {r["doc_id"]: {ids[i] for i in r["ids"]} for r in rows.collect()}
    assert found == {i: set((t or "").split()) & {"red", "green", "blue", "yellow"} for i, t in enumerate(texts)}
