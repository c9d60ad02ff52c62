import lzma
import re

import pytest

from lexispark.sources import tables as tb
from lexispark.sources import text as st
from lexispark.sources import vocab as vc


def write(path, text):
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def blocks(text):
    """The reading rule, line by line."""
    docs, lines = [], []
    for line in text.split("\n"):
        if line == "":
            docs.append(lines)
            lines = []
        else:
            lines.append(line.rstrip())
    return docs


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


TEXTS = ["a\n\n\nb\n  \nc\n\ntail", "x  \n\ny\n", "\n\n", "one line", "p\n\n" * 60 + "".join(f"line {i}\n\n" if i % 3 else f"line {i} \n" for i in range(100))]


def test_documents_over_many_splits(spark, tmp_path, small_splits):
    paths = [write(tmp_path / f"f{i}.txt", t) for i, t in enumerate(TEXTS)]
    rows = st.read_document_lines(spark, paths).collect()
    for i, text in enumerate(TEXTS):
        mine = sorted((r["doc_ord"], r["lines"], r["start_line"]) for r in rows if r["src"].endswith(f"f{i}.txt"))
        want = blocks(text)[: sum(1 for line in text.split("\n")[:-1] if line == "")]
        assert [m[1] for m in mine] == want
        start = 1
        for _, lines, at in mine:
            assert at == start
            start += len(lines) + 1


def _rows_scanned(plan):
    """Rows that the file scans of an executed plan gave."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _rows_scanned(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _rows_scanned(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if name == "FileSourceScanExec" else 0
    children = plan.children()
    return own + sum(_rows_scanned(children.apply(i)) for i in range(children.size()))


def test_small_files_are_read_once(spark, tmp_path):
    paths = [write(tmp_path / f"f{i}.txt", t) for i, t in enumerate(TEXTS)]
    docs = st.read_document_lines(spark, paths)
    got = docs.collect()
    assert _rows_scanned(docs._jdf.queryExecution().executedPlan()) == sum(len(t.removesuffix("\n").split("\n")) for t in TEXTS)
    # Between these bounds some files are cut and some are not.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "9")
    try:
        for tail in (False, True):
            cut = sorted(map(str, st.read_document_lines(spark, paths, keep_tail=tail).collect()))
            assert len(cut) == len(got) + (4 if tail else 0) and (tail or cut == sorted(map(str, got)))
            assert st.read_document_lines(spark, paths, 1, tail).count() == (5 if tail else 4)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_document_limits(spark, tmp_path):
    path = write(tmp_path / "d.txt", "a\nb\n\nc\n\n")
    assert st.read_documents(spark, path, 1).collect()[0]["text"] == "a b"
    assert st.read_documents(spark, path, 0).count() == 2
    assert st.read_documents(spark, path, 99).count() == 2
    tail = write(tmp_path / "t.txt", "a\n\nb\n")
    assert st.read_documents(spark, tail).count() == 1
    assert st.read_documents(spark, tail, keep_tail=True).count() == 2


def test_lines(spark, tmp_path, small_splits):
    text = "".join(f"row {i} \r\n\n" for i in range(50)) + "last"
    path = write(tmp_path / "l.txt", text)
    rows = st.read_lines(spark, path).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == [f"row {i}" for i in range(50)] + ["last"]
    assert [r["line_no"] for r in rows] == list(range(51))
    assert st.read_lines(spark, path, max_lines=7).count() == 7
    assert st.read_lines(spark, path, filter_empty=False).count() == 101
    assert st.read_lines(spark, path, max_lines=0).count() == 51


def test_text_is_not_shuffled(spark, tmp_path, small_splits):
    """Lines are numbered in the scan; of documents only those across the bounds of splits are moved."""
    paths = [write(tmp_path / f"f{i}.txt", t) for i, t in enumerate(TEXTS)]
    for read in (st.read_lines, st.read_document_lines):
        plan = read(spark, paths)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        # Counts of splits by file, and parts of documents; no line goes through an exchange.
        keys = re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)
        moved = {re.sub(r"#\d+L?", "", k) for k in keys}
        assert moved <= {"src", "src, split", "src, doc_ord"} and (read is st.read_document_lines or "src, doc_ord" not in moved)
    docs = st.read_document_lines(spark, paths).cache()
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    assert sorted(map(str, docs.collect())) == sorted(map(str, st.read_document_lines(spark, paths).collect()))


def test_xz(spark, tmp_path):
    body = " a \nb\n \n\n" + "long " * 300000 + "\r\n\r\n\nc\rd\n\nlost"
    path = tmp_path / "d.xz"
    path.write_bytes(lzma.compress(body.encode()) + lzma.compress(b" tail\n\n"))
    rows = sorted(st.read_documents_xz(spark, str(path)).collect(), key=lambda r: r["doc_ord"])
    # A line of one blank separates nothing; it is an empty line of its document.
    assert [r["lines"] for r in rows] == [["a", "b", ""], [("long " * 300000).strip()], [], ["c", "d"], ["lost tail"]]
    assert st.read_documents_xz(spark, str(path), 2).count() == 2
    assert st.read_documents_xz(spark, str(path), 0).count() == 0


def test_xz_documents_are_not_shuffled(spark):
    bodies = {"x": "\n a\u2003\nb\n\n\n" + "line \n" * 400000 + "\nlost", "y": "", "z": "c\r\n\r\n"}
    files = spark.createDataFrame([(k, lzma.compress(b.encode())) for k, b in bodies.items()], "src string, content binary")
    docs = st.documents_from_xz(files)
    got = {(r["src"], r["doc_ord"]): (r["start_line"], r["lines"]) for r in docs.collect()}
    assert got == {("x", 0): (1, []), ("x", 1): (2, ["a", "b"]), ("x", 2): (5, []), ("x", 3): (6, ["line"] * 400000), ("z", 0): (1, ["c"])}
    assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()


def test_xz_limit_zero_reads_one_line(spark, tmp_path):
    path = tmp_path / "e.xz"
    path.write_bytes(lzma.compress(b"\na\n\n"))
    assert [r["lines"] for r in st.read_documents_xz(spark, str(path), 0).collect()] == [[]]


def test_broken_xz(spark, tmp_path):
    path = tmp_path / "d.xz"
    path.write_bytes(lzma.compress(b"a\n\n" * 1000)[:-20])
    with pytest.raises(Exception, match="ends before"):
        st.read_documents_xz(spark, str(path)).collect()


def test_vocab(spark, tmp_path):
    path = write(tmp_path / "v.tsv", "<unk>\t0\n<s>\t0\na\tb\t-1.5\n▁x\t-2\n")
    rows = vc.read_vocab(spark, path).orderBy("piece_id").collect()
    assert [(r["piece"], r["score"], r["type"]) for r in rows] == [
        ("<unk>", 0.0, "UNKNOWN"), ("<s>", 0.0, "CONTROL"), ("a\tb", -1.5, "NORMAL"), ("▁x", -2.0, "NORMAL")
    ]
    both, missing = vc.read_vocabs(spark, {"v": path, "w": str(tmp_path / "none")})
    assert missing == ["w"] and both.count() == 4


def test_labelled_columns(spark, tmp_path):
    assert tb.resolve_columns(["id", "tokens", "ner_tags"], "ner") == ("tokens", "ner_tags")
    assert tb.resolve_columns(["a", "b"], "ner") == ("a", "b")
    assert tb.resolve_columns(["a", "b", "c"], "ner", "c", "a") == ("c", "a")
    with pytest.raises(ValueError, match="csv or json"):
        tb.read_labelled(spark, "x.txt", "a string")


def test_results_paths(spark, tmp_path):
    for model, seed, src, tgt, value in [("m_k1", 1, "en", "de", 0.5), ("m_k1", 2, "en", "en", 0.25)]:
        cell = tmp_path / f"{model}_seed{seed}" / src / tgt
        cell.mkdir(parents=True)
        (cell / "eval_results.json").write_text(f'{{"eval_f1": {value}}}')
    rows = tb.read_results(spark, str(tmp_path), "f1").orderBy("seed").collect()
    assert [tuple(r) for r in rows] == [("m_k1", 1, "en", "de", 0.5), ("m_k1", 2, "en", "en", 0.25)]


def test_resources(spark):
    rows = spark.createDataFrame([("a", 999_999), ("b", 2_500_000)], "src string, n_lines long")
    got = st.resources_for(rows).orderBy("src").select("memory_gb", "cpus").collect()
    assert [tuple(r) for r in got] == [(15, 1), (35, 3)]


def test_stream_counter_reads_a_table_in_parts(spark, tmp_path):
    from lexispark.plans.io_queries import stream_counter

    rows = [(i, f"word w{i} {'again ' * i}", "en", "web", 9) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs.write.parquet(str(tmp_path / "documents_old.parquet"))
    got = {r["token"]: r["cnt"] for r in stream_counter(spark, str(tmp_path)).collect()}
    assert got == {"word": 5, "again": 10, **{f"w{i}": 1 for i in range(5)}}
