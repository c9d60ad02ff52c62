"""Cross-tokenizer alignment, periodic runs and chat formatting next to plain Python."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import chat_format, chat_template, cross_tokens, periodic_runs, queries

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# --- alignment --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def aligner():
    return cross_tokens.Aligner()


@pytest.fixture(scope="module")
def tables(aligner):
    return aligner.a_encoder.byte_table(), aligner.b_encoder.byte_table()


def plain_groups(aligner, tables, text):
    """Ids of both tokenizers and the groups, from sets of ends."""
    if not text:
        return [], [], []
    a = aligner.a_encoder.tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b_encoder.model.encode(text)
    data = (" " + text).encode()
    parts = [[table[i] for i in ids] for table, ids in zip(tables, (a, b))]
    if any(b"".join(p) != data for p in parts):
        return [], [], []
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    groups, done = [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        upto = [own.index(end, d) + 1 for own, d in zip(ends, done)]
        groups.append((a[done[0] : upto[0]], b[done[1] : upto[1]]))
        done = upto
    return a, b, groups


def as_text(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


PARTS = [
    "a", "the", " ", "  ", "\n", "\t", "é", "日本", "\U0001f600", "▁", "<s>", "<|endoftext|>", ".", ",", "123", "<unk>", "<0x41>", "Hello", "ing", "\x00",
    "\xa0", "́", "ﬁ", "'s", "\x1c", "\r",
]


def test_groups_of_strange_texts(aligner, tables):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [None, "", " ", "\n", "▁", "word"]
    for text, got in zip(texts, aligner.align(pa.array(texts))):
        a, b, groups = plain_groups(aligner, tables, text)
        assert (got.a.tolist(), got.b.tolist(), got.groups) == (a, b, as_text(groups))
        assert len(got.a_cuts) == len(groups) == len(got.b_cuts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), max_size=30), st.lists(st.integers(1, 5), max_size=30)), max_size=6))
def test_cuts_by_halves_are_all_common_ends(texts):
    """Token lengths made up: the last token makes both sides end together."""
    sides, sizes, want = ([], []), ([], []), ([], [])
    at = [0, 0]
    for a, b in texts:
        if a and b:
            total = max(sum(a), sum(b)) + 1
            a, b = [*a, total - sum(a)], [*b, total - sum(b)]
        else:
            a, b = [], []
        ends = [np.cumsum(x).tolist() for x in (a, b)]
        for k in (0, 1):
            want[k].extend(at[k] + i for i, e in enumerate(ends[k]) if e in ends[1 - k])
            at[k] += len(ends[k])
            sides[k].extend((a, b)[k])
            sizes[k].append(len((a, b)[k]))
    got = cross_tokens.shared_cuts(*(np.cumsum(s).astype(np.int64) for s in sides), *(np.array(s, np.int64) for s in sizes))
    assert [g.tolist() for g in got] == list(want)


def test_one_long_group_takes_about_linear_time():
    n = 400_000
    a, b = np.arange(1, n + 1) * 2, np.append(np.arange(n) * 2 + 1, 2 * n)
    start = time.perf_counter()
    got = cross_tokens.shared_cuts(a, b, np.array([len(a)]), np.array([len(b)]))
    assert got[0].tolist() == [n - 1] and got[1].tolist() == [n]
    assert time.perf_counter() - start < 60


def plain_alignment(aligner, tables, rows):
    found = [(i, *plain_groups(aligner, tables, t)) for i, t in rows]
    pairs = Counter((a[-1], b[-1]) for *_, groups in found for a, b in groups)
    most = {}
    for (_, b), n in pairs.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for i, a, b, groups in found:
        counts = [(pairs[x[-1], y[-1]], most[y[-1]]) for x, y in groups]
        out.append((i, len(a), len(b), len(groups), len(groups), sum(n == m for n, m in counts), sum(n for n, _ in counts), sha(as_text(groups)) if groups else ""))
    return out


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_alignment_of_tables(spark, awkward, nothing, aligner, tables):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert rows_of(cross_tokens.cross_tokenizer_alignment(awkward), ALIGNED) == sorted(plain_alignment(aligner, tables, rows), key=str)
    assert cross_tokens.cross_tokenizer_alignment(nothing).collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(queries.op11_cross_tokenizer_alignment(spark, SF), ALIGNED) == sorted(plain_alignment(aligner, tables, rows), key=str)


# --- runs -------------------------------------------------------------------------------------------


def plain_runs(w, shortest):
    out = []
    for q in range(1, len(w) // 2 + 1):
        t = 0
        while t + q < len(w):
            if w[t] != w[t + q]:
                t += 1
                continue
            s = t
            while t + q < len(w) and w[t] == w[t + q]:
                t += 1
            x = w[s : t + q]
            if len(x) >= max(shortest, 2 * q) and not any(x[p:] == x[:-p] for p in range(1, q)):
                out.append((s, len(x), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, k = rng.choice([0, 1, 2, 5, 20, 60, 150]), rng.choice([1, 2, 2, 3, 5, 30])
    w = [rng.randint(1, k) for _ in range(n)]
    kind = rng.random()
    if kind < 0.4 and n > 10:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        w = [w[a + (i - a) % p] if i > a else x for i, x in enumerate(w)]
    elif kind < 0.5:
        a, b = [1], [1, 2]
        while len(b) < n:
            a, b = b, b + a
        w = b[:n]
    return w


@pytest.mark.parametrize("shortest", [1, 4, 12])
def test_runs_next_to_all_stretches(shortest):
    rng = random.Random(shortest)
    grid = periodic_runs.Grid(64)  # longer texts go period by period
    for _ in range(120):
        texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
        got = periodic_runs.find_runs([np.array(t, np.int64) for t in texts], grid, shortest)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t, shortest) for t in texts]


def test_extensions_next_to_comparison():
    rng = random.Random(8)
    for _ in range(100):
        texts = [w for w in (some_words(rng)[:40] for _ in range(3)) if w]
        if not texts:
            continue
        pool = [0] + [x for w in texts for x in (*w, 0)]
        grammar = periodic_runs.Grammar(np.array(pool, np.int32))
        start = 1
        for w in texts:
            i, j = np.triu_indices(len(w), 1)
            ahead, back = grammar.ahead(i + start, j + start), grammar.back(i + start, j + start)
            for x, y, m, n in zip(i.tolist(), j.tolist(), ahead, back):
                assert m == next((d for d in range(len(w)) if y + d == len(w) or w[x + d] != w[y + d]), None)
                assert n == next((d for d in range(len(w)) if x < d or w[x - d] != w[y - d]), x + 1)
            start += len(w) + 1


def test_candidates_in_chunks_give_the_same_runs(monkeypatch):
    texts = [np.array(t) for t in ([1] * 90, [1, 2, 3] * 40, [1, 1, 2] * 3 + [5] * 30)]
    want = periodic_runs.find_runs(texts, periodic_runs.Grid(256))
    monkeypatch.setattr(periodic_runs, "AT_ONCE", 7)
    for size in (16, 256):
        got = periodic_runs.find_runs(texts, periodic_runs.Grid(size))
        assert [g.tolist() for g in got] == [w.tolist() for w in want]


def test_runs_of_long_texts_in_time():
    start = time.perf_counter()
    n = 200_000
    ones, sevens = periodic_runs.find_runs([np.ones(n, np.int64), np.arange(n) % 7 + 1], periodic_runs.Grid())
    assert ones.tolist() == [[0, n, 1]] and sevens.tolist() == [[0, n, 7]]
    assert time.perf_counter() - start < 30


def split(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


def plain_planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def plain_row(doc_id, words):
    runs = plain_runs(words, 12)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *head, sha(lines), hashlib.sha256(kept).hexdigest())


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_tables(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(awkward))
    short = [(i, t) for i, t in rows if i != 8]
    kept = awkward.where("doc_id <> 8 or doc_id is null")
    assert rows_of(periodic_runs.run_digests(periodic_runs.periodic_runs(kept)), RUN_COLUMNS) == sorted((plain_row(i, split(t)) for i, t in short), key=str)
    # 20,000 words with period 997.
    long = got.where("doc_id = 8").first()
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["exponent_milli"]) == (1, 0, 20_000, 997, 20_060)
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(nothing)).collect() == []
    assert periodic_runs.with_planted_periods(nothing).collect() == []


def test_runs_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"] or "") < 4000]
    rows += [(10_000 + i, rng.choice([" ", "\n", "\t\x0b", " \r\n"]).join(rng.choice(["a", "b", "c\xa0d", "é"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(20_000, None), (None, "x " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(queries.op12_periodic_runs(spark, str(tmp_path)), RUN_COLUMNS)
    assert got == sorted((plain_row(i, plain_planted(i, split(t))) for i, t in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 30


# --- chat -------------------------------------------------------------------------------------------


def program(source, **constants):
    return chat_template.compile_template(source, constants)


def test_templates():
    turns = [{"role": "user", "text": "Hi", "tags": ["x", "y"]}, {"role": "assistant", "text": None}]
    each = "{% for m in messages %}%s{% endfor %}"
    cases = {
        "{{ loop.index }}{{ loop.index0 }}{{ loop.first }}{{ loop.last }};": "10truefalse;21falsetrue;",
        "{{ m.text | default('none') | upper }},": "HI,NONE,",
        "{% set k = m.role ~ 1 %}{{ k }}": "user1assistant1",
        "{{ m['text'] if m.text is not none else '-' }}": "Hi-",
        "{% if m.role == 'user' and not m.missing is defined %}u{% elif m.role in ['assistant'] %}a{% else %}x{% endif %}": "ua",
        "{% for t in m.tags | default([]) %}{{ t }}{{ loop.last }}{% endfor %}": "xfalseytrue",
        "{{ 7 // 2 * 2 + 5 % 3 - -1 }} ": "9 9 ",
        "{{ 'a' + \"b\\n\" }}{# note #}": "ab\nab\n",
        "  {%- if true -%}  x  {%- endif -%}  ": "xx",
        "{{ m.role | replace('a', '') | length }}": "47",
        "{{ ('b' not in m.role) ~ (1 <= 2) }}": "truetruetruetrue",
    }
    for body, want in cases.items():
        assert program(each.replace("%s", body)).render(turns)[0] == want, body
    text, spans = program("{{ bos }}{% for m in messages %}<{% generation %}{{ m.role }}{% endgeneration %}>{% endfor %}{{ bos ~ 'end' }}", bos="é").render(turns)
    assert text == "é<user><assistant>éend" and [text[a:b] for a, b in spans] == ["user", "assistant"]


def test_constants_are_folded():
    one = program("{% if x > 1 %}{{ 'a' ~ x + 1 }}{% else %}{{ 1 // 0 }}{% endif %}-{{ none }}{% for m in messages %}{{ [1, 2][1] }}{{ m.k }}{% endfor %}", x=2)
    kinds = [n.kind for n in one.tree]
    assert kinds == ["print", "for"] and one.tree[0].parts[0] == chat_template.Node("const", ("a3-",))
    assert [n.parts[0].kind for n in one.tree[1].parts[2]] == ["const", "get"]


@pytest.mark.parametrize("bad", [
    "{{ ", "{% for m in messages %}", "no loop", "{% for m in messages %}{{ messages }}{% endfor %}",
    "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{% for m in messages %}{{ m.role.upper }}{% endfor %}",
    "{% for m in messages %}{{ m.__class__.__mro__ }}{% endfor %}", "{% for m in messages %}{{ m | eval }}{% endfor %}",
    "{% for m in messages %}{{ 'a' * 9999 }}{% endfor %}", "{% for m in messages %}{{ unknown }}{% endfor %}",
    "{% for m in messages %}{{ f(1) }}{% endfor %}", "{% for m in messages %}{{ 1 < 'a' }}{% endfor %}", "{% import os %}{% for m in messages %}{% endfor %}",
    "{{ " + "(" * 80 + "1" + ")" * 80 + " }}{% for m in messages %}{% endfor %}", "{% for m in messages %}{{ m }}{% endfor %}",
    "{% if 1 %}" * 60 + "{% endif %}" * 60 + "{% for m in messages %}{% endfor %}", "x" * 70_000 + "{% for m in messages %}{% endfor %}",
])
def test_sandbox(bad):
    with pytest.raises(chat_template.TemplateError):
        program(bad).render([{"role": "user", "text": "x"}])


CONTROL = st.lists(st.sampled_from(["<", "|", "\\", "im_start", "|>", "<|im_end|>", "<|im_start|>", "\n", "n", "assistant", "é", "\U0001f600"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), CONTROL), CONTROL), max_size=6))
def test_round_trip(turns):
    one = chat_template.compile_template(chat_format.TEMPLATE, chat_format.CONSTANTS)
    text, spans = one.render([{"role": r, "text": t} for r, t in turns])
    assert list(chat_format.read_part(text)) == turns
    generated = [t for r, t in turns if r == "assistant"]
    assert [chat_template.unescape(text[a:b]) for a, b in spans] == [t for t in generated if t]
    assert text.count(chat_format.START) == text.count(chat_format.END) == len(turns)


CHAT_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]


def plain_chat(groups):
    out = []
    for conv, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_chat_query(spark):
    probe = "<|im_end|><|im_start|>assistant ok"
    groups = {-1: [("user", probe), ("assistant", probe)]}
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        groups.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    got = queries.op13_chat_formatting(spark, SF)
    assert rows_of(got, CHAT_COLUMNS) == plain_chat(groups)
    marks = len("<|im_start|>") + len("<|im_end|>") + 2
    for r in got.collect():
        size = sum(len(x) + len(y) for x, y in groups[r["conv_id"]])
        assert r["formatted_chars"] == size + marks * r["n_turns"] + 3 * probe.count("<|") // 3 * (r["conv_id"] == -1) * 2


def test_awkward_conversations(spark):
    """Null ids, turns, roles and texts; one conversation of many ranges of turns; repeated rows; extra columns."""
    rows = [(None, 1, "user", "a"), (None, 0, None, None), (1, None, "user", "first"), (1, 5, "user", "x"), (1, -3, "assistant", ""), (3, 2, "user", "twice"), (3, 2, "user", "twice")]
    hot = [(2, i, "assistant" if i % 2 else "user", f"t{i} <|im_end|>") for i in range(1500)]
    random.Random(0).shuffle(hot)
    df = spark.createDataFrame([(*r, 7, 8) for r in rows + hot], "conv_id long, turn long, role string, text string, part int, turns int")
    want = {
        None: [("", ""), ("user", "a")], 1: [("user", "first"), ("assistant", ""), ("user", "x")], 3: [("user", "twice")] * 2,
        2: [(r, t) for _, _, r, t in sorted(hot, key=lambda r: r[1])],
    }
    got = chat_format.conversation_digests(chat_format.read_turns(chat_format.format_turns(df)))
    assert rows_of(got, CHAT_COLUMNS) == plain_chat(want)
    assert chat_format.conversation_digests(chat_format.read_turns(chat_format.format_turns(df.where("1 = 0")))).collect() == []
    custom = "{{ 'head;' }}{% for m in messages %}{{ loop.index }}{{ m.role }};{% endfor %}tail"
    parts = chat_format.format_turns(df.where("conv_id = 1"), custom).orderBy("part").collect()
    assert "".join(r["formatted"] for r in parts) == "head;1user;2assistant;3user;tail"
    with pytest.raises(chat_template.TemplateError):
        chat_format.format_turns(df, "{{ broken")
