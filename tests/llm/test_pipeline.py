"""The stages of the pipeline next to plain Python on a small corpus, and on awkward tables."""

import random

import corpus_pipeline
import pytest
from lexispark.llm import line_dedup, toxicity
from lexispark.llm.tokens import Encoder
from test_operators import brute_components, brute_hits, text

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_lines(docs):
    """doc_id to text without lines that repeat an earlier one exactly (after normalising) or within the stated limits."""
    places = [(d, k, line_dedup.normal(x)) for d, t in docs for k, x in enumerate((t or "").split("\n"))]
    names = sorted({n for _, _, n in places if n})
    bits = dict(zip(names, line_dedup.SimHasher().hashes(names).tolist()))
    group = {n: n for n in names}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            near = ((bits[a] ^ bits[b]) & (2**64 - 1)).bit_count() <= line_dedup.MOST_BITS
            if near and min(len(a), len(b)) >= line_dedup.SHORTEST and line_dedup.edit_similarity(a.decode(), b.decode()) >= line_dedup.SIMILARITY:
                group[find(a)] = find(b)
    seen, gone = set(), set()
    for d, k, n in places:
        if n and find(n) in seen:
            gone.add((d, k))
        if n:
            seen.add(find(n))
    out = {}
    for d, t in docs:
        left = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
        if left == t or line_dedup.normal(left):
            out[d] = left
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    shared = [text(rng, 14) for _ in range(4)]
    items = [(i, text(rng, 30)) for i in range(5)]
    rows, labels = [], []
    for i in range(90):
        lines = [text(rng, rng.randrange(6, 30)) for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.3:
            lines.append(rng.choice(shared))
        if i % 9 == 4 and i > 9:
            lines = rows[i - 3][1].split("\n") if rows[i - 3][1] else lines
            lines[-1] += " zz"
        if i == 62:
            # A copy in other lines: none of them is like a line of the original, so only the n-grams tell.
            words = [*rows[59][1].split(), "zz"]
            lines = [" ".join(words[k : k + 4]) for k in range(0, len(words), 4)]
        if i % 11 == 5:
            lines.append(rng.choice(items)[1] + " tail")
        if i % 7 == 0:
            lines.append("you are a " + rng.choice(["stupid clown", "blargish thing"]))
        rows.append((i, "\n".join(lines)))
        labels.append((i, 1, int(i % 7 == 0)))
    rows[40] = (40, None)
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages_next_to_plain_python(spark, corpus):
    path, rows, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    grammar = toxicity.fit_from_tables(docs, spark.read.parquet(f"{path}/labels.parquet"))
    want = [(i, t) for i, t in rows if grammar.score(grammar.kinds(t, {})) < 0.5]
    expected = [want]
    lines = brute_lines(want)
    want = [(i, lines[i]) for i, _ in want if i in lines]
    expected.append(want)
    comps, sizes = brute_components([t for _, t in want], 5, 80)
    want = [w for k, w in enumerate(want) if comps[k] == k or not sizes[k]]
    expected.append(want)
    hits = brute_hits(want, items)
    want = [w for w in want if not hits[w[0]][4]]
    expected.append(want)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, path)
        assert docs.columns == COLUMNS
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None) == sorted(w for w in expected[k] if w[1] is not None)
        assert [r["doc_id"] for r in docs.collect() if r["text"] is None] == [40]
        assert all(r["n_chars"] == len(r["text"] or "") for r in docs.collect())
        assert k == 0 or len(expected[k]) < len(expected[k - 1])
    packed = corpus_pipeline.run(spark, path).collect()
    lengths = {i: len(Encoder().whole([t or ""])[0]) for i, t in want}
    assert {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in lengths} == lengths
    assert {r["doc_id"] for r in packed} == set(lengths)


def test_stages_on_awkward_tables(spark, awkward, nothing, corpus):
    path = corpus[0]
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns and out.count() <= docs.count()


def test_near_copies_with_one_changed_word_are_gone(spark, corpus, tmp_path):
    """Documents of several lines, and copies with one changed word in one line: only the originals are packed."""
    rng = random.Random(41)
    rows = []
    for i in range(30):
        lines = [text(rng, rng.randrange(20, 40)) for _ in range(4)]
        rows.append((i, "\n".join(lines)))
        k = rng.randrange(4)
        words = lines[k].split()
        words[rng.randrange(len(words))] = "changed"
        lines[k] = " ".join(words)
        rows.append((100 + i, "\n".join(lines)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, path).select("doc_id").distinct().collect()}
    assert len(found) > 20 and all(i < 100 for i in found)
