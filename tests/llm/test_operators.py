"""Each operator next to brute force on small tables, and on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lexispark.llm import (
    components,
    decontaminate,
    fingerprint,
    html_text,
    huffman,
    licenses,
    line_dedup,
    ngram_join,
    packing,
    suffix_dedup,
    toxicity,
)
from lexispark.llm.tokens import Encoder
from lexispark.session import scratch_path

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("sa", "te", "vi", "zo", "du", "xy")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- n-gram join

def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("percent,k", [(90, 3), (80, 5)])
def test_ngram_components(spark, percent, k):
    rng = random.Random(percent)
    texts = [None, "", "  ", "one", "One", "two words"]
    for _ in range(12):
        base = text(rng, rng.choice([4, 12, 60, 150])).split()
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4, 12])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                near[rng.randrange(len(near))] = rng.choice(WORDS) + "q"
            texts.append(" ".join(near))
    got = ngram_join.ngram_components(docs_of(spark, texts), ngram_join.Similar(k, percent)).collect()
    want, sizes = brute_components(texts, k, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (sizes[i], want[i]) for i in range(len(texts))}


def test_prefix_choice_keeps_every_partner():
    like = ngram_join.Similar(3, 90)
    rng = random.Random(3)
    df = {t: rng.choice([1, 1, 2, 5, 50]) for t in range(3000)}
    for _ in range(200):
        x = set(rng.sample(range(3000), 200))
        drop = rng.randrange(0, 12)
        y = set(list(x)[drop:]) | set(rng.sample(range(3000), rng.randrange(0, 10)))
        if 100 * len(x & y) < 90 * len(x | y):
            continue
        lists = []
        for s in (x, y):
            for t in s:
                df[t] = max(df[t], 2) if t in x & y else df[t]
        for s in (x, y):
            order = sorted(s)  # by hash, here the token itself; the first tenth and a half of the space is the zone
            zone = sum(t < 450 for t in order)
            kept = order[: max(zone, len(s) - like.overlap(len(s)) + ngram_join.MOST_MATCHES)]
            shared = np.array([(df[t], t, i) for i, t in enumerate(kept) if df[t] > 1], np.int64).reshape(-1, 3)
            lists.append(ngram_join.choose_prefix(len(s), zone, shared[:, 0], shared[:, 1], shared[:, 2], like))
        (a, ka), (b, kb) = lists
        assert len(set(a.tolist()) & set(b.tolist())) >= min(ka, kb)


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(40)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(50))
    assert all(got[a] == got[b] <= min(a, b) for a, b in links if a != b)


def test_new_words_are_encoded_as_one_list():
    encoder = Encoder()
    words = [" word", "word", "étude", " Überzug", "x"]
    ids, sizes = encoder._words(words)
    want = [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert sizes == list(map(len, want)) and ids == [i for w in want for i in w] and encoder._words([]) == ([], [])
    texts = ["étude (word), word!", "x word", "", "x"] * 2
    assert [i.tolist() for i in encoder.encode(pa.array(texts))] == [i.tolist() for i in encoder.whole(texts)]


# --- tokens, Huffman code, packing

def test_encoder_is_the_tokenizer():
    encoder = Encoder()
    texts = ["", None, "a  b", " a", "a ", "a\n b", "x \n", "a\tb c", "  ", "don't we'll  x", "\n", "a\n\nb", "a   b", "s. x, y!", "x\0y\x01z", "<|endoftext|> a", "a b", "日本語 テスト。", "naïve Straße x²", "!!! a%%% b&&&.", "thble,\nThat| the.) (x"]
    for _ in range(2):
        for mine, t in zip(encoder.encode(pa.array(texts)), texts):
            assert mine.tolist() == [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def test_code_is_optimal_within_its_limit():
    rng = np.random.default_rng(1)
    counts = np.zeros(3000, np.int64)
    counts[rng.choice(3000, 700, replace=False)] = (rng.pareto(0.7, 700) * 5).astype(np.int64) + 1
    free, tight = huffman.code_lengths(counts, 40), huffman.code_lengths(counts, 11)
    assert tight.max() <= 11 and sum(2.0 ** -int(x) for x in tight if x) <= 1

    def plain(weights):
        import heapq

        heap, total = list(map(int, weights)), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            total += s
            heapq.heappush(heap, s)
        return total

    assert int((counts * free).sum()) == plain(counts[counts > 0])
    code = huffman.Code(tight)
    ids = rng.choice(np.flatnonzero(counts), 5000).astype(np.uint32)
    block = code.pack(ids)
    assert (code.unpack(block) == ids).all() and (code.unpack(block, slice(2, 4)) == ids[512:1024]).all()
    assert len(code.unpack(code.pack(ids[:0]))) == 0


def test_ids_round_trip(spark, awkward, nothing):
    path = scratch_path(spark, "t")
    huffman.write_ids(awkward, path)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], tuple(r["ids"])) for r in huffman.read_ids(spark, path, with_ids=True).collect())
    rows = sorted(((r["doc_id"], r["text"] or "") for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ids = [x.tolist() for x in Encoder().whole([t for _, t in rows])]
    start, want = 0, []
    for (doc_id, _), own in zip(rows, ids):
        want.append((start, doc_id, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), tuple(own)))
        start += len(own)
    assert got == want
    empty = scratch_path(spark, "t")
    huffman.write_ids(nothing, empty)
    assert huffman.read_ids(spark, empty).count() == 0


def test_packing(spark, awkward, nothing):
    rows = packing.pack(awkward, capacity=64).collect()
    ids = {}
    for r in awkward.collect():
        ids.setdefault(r["doc_id"], []).append(Encoder().whole([r["text"] or ""])[0])
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["length"] for r in rows) == sum(len(x) for own in ids.values() for x in own)
    assert packing.pack(nothing).count() == 0


def test_plan_is_near_the_bound():
    rng = random.Random(2)
    for scale in (3.0, 5.8):
        counts = Counter(p for _ in range(5000) for p in packing.cut(int(rng.lognormvariate(scale, 1.2)) + 1, 1024))
        placed, opened = packing.plan(dict(counts))
        assert sum(p[2] for p in placed) == sum(counts.values())
        bound = max(-(-sum(s * n for s, n in counts.items()) // 1024), sum(n for s, n in counts.items() if s > 512))
        assert opened <= bound * 1.01 + 1


# --- decontamination

def brute_hits(texts, items):
    def words(t):
        return bytes(line_dedup_table[b] for b in (t or "").encode()).split()

    from lexispark.llm.common import WORD_BYTES as line_dedup_table

    windows = {}
    for i, t in items:
        w = words(t)
        m = min(len(w), 10)
        for s in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add(i)
    out = {}
    for d, t in texts:
        w = words(t)
        hit, found = set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                own = windows.get(tuple(w[s : s + m]))
                if own is not None:
                    hit |= set(range(s, s + m))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark):
    rng = random.Random(11)
    items = [(i, text(rng, n)) for i, n in enumerate([1, 2, 3, 5, 8, 9, 10, 11, 25, 40, 40])]
    items = [(i, f"zz{i} " + t if i < 6 else t) for i, t in items] + [(20, None), (21, "..."), (22, items[9][1]), (None, items[10][1])]
    docs = [(0, None), (1, ""), (2, "short")]
    for i in range(3, 40):
        parts = [text(rng, rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w)) if w else 0
            parts += [", ".join(w[max(0, a - 12) : a + 12]).upper(), text(rng, rng.randrange(20))]
        docs.append((i, " ".join(parts)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.decontaminate(d, b).collect()}
    assert got == brute_hits(docs, items) and any(v[4] for v in got.values())
    plan = decontaminate.decontaminate(d, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination_of_awkward_rows(spark, awkward, nothing):
    bench = awkward.selectExpr("doc_id AS item_id", "text", "n")
    got = decontaminate.decontaminate(awkward, bench).collect()
    assert len(got) == awkward.count() and sum(r["contaminated"] for r in got) == 9
    assert all(r["n_hit"] == 0 for r in decontaminate.decontaminate(awkward, bench.where("1 = 0")).collect())
    assert decontaminate.decontaminate(nothing, bench).count() == 0


# --- toxicity, licenses, pages

def test_clause_kinds():
    g = toxicity.Grammar()
    kind = lambda t: dict(g.kinds(t, {}))
    assert kind("You are such an idiot.") == {"insult_at_target": 1}
    assert kind("He said the man is an idiot") == {"insult_reported": 1}
    assert kind("That was not stupid") == {"insult_negated": 1}
    assert kind("I will kill you. Nice weather") == {"threat_at_target": 1}
    assert kind("a bad day") == kind("") == kind(None) == {}


def test_stems_are_learned(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        words = text(rng, 30).split() + ([rng.choice(["blarg", "blargous", "blargish"])] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    t = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.score_documents(spark, t.select("doc_id", "text"), t.select("doc_id", "toxic")).collect()
    assert all(r["predicted"] == rows[r["doc_id"]][2] for r in out if r["held_out"]) and len(out) == 400


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = awkward.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    out = toxicity.score_documents(spark, awkward, labels).collect()
    assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_documents(spark, nothing, labels.where("1 = 0")).count() == 0
    assert toxicity.without_toxic(awkward, toxicity.Grammar()).columns == awkward.columns


def test_licenses(spark, awkward):
    texts = ["Released under the MIT License. mit-license", "Relesed undr the MIT License", "LICENSED under cc by-nc 4.0", "This work is licenced under the GNU General Publc License, version 3", "smit licenses apache\n  License", None, ""]
    got = {r["doc_id"]: r for r in licenses.license_scan(docs_of(spark, texts)).collect()}
    places = {i: [(p["label"], p["first_word"]) for p in r["places"]] for i, r in got.items()}
    assert places == {0: [("mit", 3), ("mit", 5)], 1: [("mit", 3)], 2: [("cc-by", 2)], 3: [], 4: [("apache", 2)], 5: [], 6: []}
    spans = {i: {s["label"] for s in r["spans"]} for i, r in got.items()}
    assert spans[0] == spans[1] == {"mit-notice"} and spans[2] == {"cc-by-nc-4.0"} and spans[3] == {"gpl-3.0"} and not spans[4]
    assert licenses.license_scan(awkward).count() == awkward.count()


def test_pieces_find_every_copy_within_the_errors():
    rng = random.Random(6)
    scanner = licenses.Scanner(licenses.NOTICES)
    for notice, _, errors in scanner.notices:
        for _ in range(5):
            copy = list(notice)
            for _ in range(errors):
                copy[rng.randrange(1, len(copy) - 1)] = "x"
            found = scanner.spans(" before it " + "".join(copy) + " after it ")
            # A copy may be as close to another notice, but something is found there with no more errors.
            assert any(f[1] < 12 + len(notice) and f[2] > 10 and f[3] <= errors for f in found)


def test_license_copies_side_by_side_and_versions():
    scanner = licenses.Scanner(licenses.NOTICES)
    labels = lambda t: [scanner.notices[f[0]][1] for f in scanner.spans(f" {t} ")]
    copies = ["relezsed undor the mit license", "relezsed under the mit license", "released under the mit license"]
    for n in range(1, 4):
        for _ in range(2):
            assert labels(" ".join(copies[:n])) == ["mit-notice"] * n
            copies.reverse()
    gpl = "licensed under the gnu general public license version"
    assert labels(f"{gpl} 2") == labels(f"{gpl} 2 and") == ["gpl-2.0"] and labels(f"this work is {gpl} 3") == ["gpl-3.0"]
    for version in ("3", "3 and", "1", "20", "12"):
        assert labels(f"{gpl} {version}") == []
    assert labels("licensed under the apache license version 1 1") == [] and labels("licensed under cc by sa 3 0") == []
    assert labels("licensed undr cc by sa 4 0") == ["cc-by-sa-4.0"]


PAGE = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><header><a href="/">Home</a> Site</header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice">We use cookies, yes.</div>
<div id="wrap"><div class="content"><h1>A   title &amp; more</h1><p>First paragraph, with some words, and commas, and enough text to count.
<br>Second&nbsp;line<p>Another paragraph, long enough to be part of the text, says <b>bold</b> and <a href="/x">linked</a> words.</div>
<div class="sidebar"><p>Related things, that are not part of it, but are long enough.</p></div></div>
<section id="comments"><p>I like this article, very much, it is the best, thank you so much.</p></section><form>Name <input></form>
<footer>&copy; me, 2024</footer></body></html>"""


def test_main_text():
    want = "A title & more\nFirst paragraph, with some words, and commas, and enough text to count. Second line\nAnother paragraph, long enough to be part of the text, says bold and linked words."
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE[:-9]) == want
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<article><p>x<p>y</article") == "x\ny"


def test_main_text_under_wrapper_classes():
    body = "A paragraph with some words, and commas, and enough text to count as part of the page."
    for names in ("layout has-sidebar", "no-sidebar", "with-sidebar", "elementor-widget", "share", "sidebar"):
        page = f'<body><div class="{names}"><div><p>{body}<p>{body} Again, and more, of it.</div></div><div class="footer">Imprint, and so on, of this page.</div></body>'
        assert html_text.main_text(page) == f"{body}\n{body} Again, and more, of it.", names
    for names in ("entry-header", "post-header", "header"):
        assert html_text.main_text(f'<article><div class="{names}"><h1>Title</h1></div><p>{body}</article>') == f"Title\n{body}"
    for names in ("sidebar", "site-footer", "cookie-notice", "comment-list", "main_nav", "x related", "widget-area"):
        page = f'<div><p>{body}<p>{body}</div><div class="{names}"><p>Other text, that is no part of it, but long enough.</div>'
        assert html_text.main_text(page) == f"{body}\n{body}", names
    comments = f'<div><p>{body}</div><div id="comments"><p>{body} One.<p>{body} Two.<p>{body} Three.</div>'
    assert html_text.main_text(comments) == body


def test_main_text_between_kept_siblings():
    long = "A paragraph with some words, and commas, and enough text, to count, as part, of the page, " * 4
    page = f"<body><div><p>{long}<p>{long}</div><h2>Next</h2><p>Short.</p><ul><li>one<li>two</ul><table><tr><td>cell</table><div><p>{long}</div><ul><li><a href=x>link</a></ul></body>"
    assert html_text.main_text(page) == "\n".join([long.strip(), long.strip(), "Next", "Short.", "one", "two", "cell", long.strip()])


def test_pages_table(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 2), (None, "v", "<div>" * 3000 + "deep text", 3)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 9), (1, 181), (1, 181), (2, 0)]


# --- fingerprints

def test_prefix_hash():
    rng = random.Random(8)
    a = "".join(rng.choice("abé😀") for _ in range(300))
    b = a[:120] + "#" + a[100:]
    x, y = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
    for i in range(0, 300, 7):
        for j in range(0, 320, 11):
            want = 0
            while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
                want += 1
            assert x.common_extension(y, i, j) == want
    assert [x.span(i, 16) for i in range(285)] == x.spans(16).tolist()


def test_fingerprints(spark, awkward, nothing):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = fingerprint.fingerprints(awkward).collect()
    assert len(got) == len(rows)
    want = Counter((d, len(t), hashlib.sha256(fingerprint.edited(t, rows[(i + 1) % len(rows)][1]).encode()).hexdigest()) for i, (d, t) in enumerate(rows))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprint.fingerprints(nothing).count() == 0


def test_likeness():
    rng = random.Random(9)
    a = text(rng, 900)
    f = fingerprint.fingerprint
    assert fingerprint.likeness(f(a), f(a)) == 1 and fingerprint.likeness(f(a), f(text(rng, 900))) < 0.1
    assert 0.3 < fingerprint.likeness(f(a), f(fingerprint.edited(a, text(rng, 900)))) < 0.7
    assert fingerprint.likeness(f(""), f("")) == 1 and fingerprint.likeness(f(""), f("x")) == 0


# --- lines

def plain_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def test_edit_similarity():
    rng = random.Random(10)
    for _ in range(300):
        x = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 60)))
        y = list(x)
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randrange(2)] = rng.choice(["", "z", "ab"])
        y = "".join(y)
        true = 1 - plain_distance(x, y) / max(len(x), len(y))
        got = line_dedup.edit_similarity(x, y, 0.8)
        assert got == pytest.approx(true) if true >= 0.8 else got == 0


def test_line_dedup(spark):
    rng = random.Random(12)
    lines = [text(rng, rng.choice([2, 8, 15, 40])) for _ in range(25)] + ["", "---", "Page 1 of 9", "Page 2 of 9"]
    texts = []
    for _ in range(30):
        own = []
        for _ in range(rng.randrange(8)):
            line = rng.choice(lines)
            if rng.random() < 0.4 and len(line) > 30:
                line = line[:20] + "x" + line[20:]
            own.append(line.upper() + "." if rng.random() < 0.2 else line)
        texts.append("\n".join(own))
    texts[3] = None
    places = [(d, k, line_dedup.normal(line)) for d, t in enumerate(texts) for k, line in enumerate((t or "").split("\n"))]
    places = [p for p in places if p[2]]
    names = sorted({p[2] for p in places})
    sim = dict(zip(names, line_dedup.SimHasher().hashes(names).tolist()))
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if min(len(a), len(b)) >= line_dedup.SHORTEST and ((sim[a] ^ sim[b]) & (2**64 - 1)).bit_count() <= line_dedup.MOST_BITS:
                if line_dedup.edit_similarity(a.decode(), b.decode()) >= line_dedup.SIMILARITY:
                    root[find(a)] = find(b)
    seen, gone = set(), set()
    for d, k, n in places:
        if find(n) in seen:
            gone.add((d, k))
        seen.add(find(n))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    want = {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in enumerate(texts)}
    assert got == want and len({find(n) for n in names}) < len(names)


def test_line_dedup_finds_similar_lines_without_a_filter(spark):
    """Next to brute force over all pairs: changed words and typos in lines of all lengths."""
    rng = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lines = []
    for n in [2, 2, 3, 3, 4, 5, 6, 8, 10, 15, 20, 30, 45] * 12:
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n)]
        other = list(words)
        other[rng.randrange(n)] = "".join(rng.choice(letters) for _ in range(rng.randrange(2, 8)))
        typo = list(" ".join(words))
        typo[rng.randrange(len(typo))] = rng.choice(["", "q", "qx"])
        lines += [" ".join(words), " ".join(other), "".join(typo)]
    names = sorted({line_dedup.normal(x) for x in lines})
    pairs = {(a, b) for i, b in enumerate(names) for a in names[:i] if line_dedup.edit_similarity(a.decode(), b.decode()) >= line_dedup.SIMILARITY}
    short = {p for p in pairs if min(map(len, p)) < line_dedup.SHORT}
    keys = {n: {("b", k, x) for k, x in enumerate(b)} | {("c", x) for x in c} for n, b, c in zip(names, *line_dedup.keys_of(names)[:2])}
    met = {p for p in pairs if keys[p[0]] & keys[p[1]]}
    assert len(pairs) > 200 and len(short) > 40 and short <= met and len(met) >= 0.99 * len(pairs)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in met:
        root[find(a)] = find(b)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs_of(spark, lines)).collect()}
    assert sum(got.values()) == len(lines) - len({find(n) for n in names})


def test_line_dedup_of_awkward_rows(awkward, nothing):
    out = line_dedup.dedup_lines(awkward)
    assert out.columns == [*awkward.columns, "n_lines", "n_removed"] and out.count() == awkward.count()
    assert line_dedup.without_repeats(awkward).columns == awkward.columns
    assert line_dedup.dedup_lines(nothing).count() == 0


# --- repeated bytes

def brute_bytes(texts):
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        cut = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                cut[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        spans = sum(1 for i, c in enumerate(cut) if c and (i == 0 or not cut[i - 1]))
        out.append((len(data), sum(cut), spans, bytes(b for b, c in zip(data, cut) if not c)))
    return out


@pytest.mark.parametrize("group", [1, 256])
def test_suffix_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(13)
    passage = text(rng, 60)
    texts = [None, "", "x" * 99, "y" * 400, "y" * 150, "z" * 100, "z" * 100, "é" * 80, "é" * 80, "ab" * 300]
    for _ in range(30):
        a = rng.randrange(200)
        texts.append(text(rng, rng.randrange(60)) + passage[a : a + rng.randrange(300)] + text(rng, rng.randrange(40)))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup_bytes(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(brute_bytes(texts)))


def test_suffix_dedup_of_awkward_rows(spark, awkward, nothing):
    got = suffix_dedup.dedup_bytes(awkward).collect()
    assert len(got) == awkward.count() and sum(r["n_removed"] > 0 for r in got) >= 1
    assert suffix_dedup.dedup_bytes(nothing).count() == 0


def test_ngram_join_of_awkward_rows(awkward, nothing):
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(awkward).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (None, None)} <= got
    assert ngram_join.ngram_components(nothing).count() == 0
    kept = ngram_join.one_of_each(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9]


def test_blocks_give_the_same_groups(spark, monkeypatch):
    """With every list taken for a large one, and small blocks, the groups are those of brute force as well."""
    from lexispark.llm import meetings

    monkeypatch.setattr(meetings, "BLOCK", 5)
    for module in (ngram_join, line_dedup):
        monkeypatch.setattr(module, "connecting_links", lambda *a, **b: meetings.connecting_links(*a, **b | {"small": 1}))
    test_ngram_components(spark, 90, 3)
    test_line_dedup(spark)
