"""Every query with SQL, at the smallest scale, next to DuckDB."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted([tuple("nan" if isinstance(x, float) and math.isnan(x) else str(x) for x in r) for r in frame.itertuples(index=False)])


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_answer(spark, duck, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert {c: str(t) for c, t in mine.dtypes.items()} == {c: str(theirs[c].dtype) for c in mine.columns}
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if n.startswith("q_")))
def test_runs_in_a_plain_session(spark, name):
    """Queries without SQL give rows where Arrow conversion is off, as it is by default."""
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        rows = entry.queries()[name](spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    assert rows
    if name == "q_kmeans":
        assert sum(r["n_docs"] for r in rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_every_query_is_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert "lang" in out.columns and out.count() > 0


PARTITION_CHECKS = ["q_sample_lines", "q_doc_blocks", "q_blocks", "q_mask_tokens", "q_vocab_stats_by_lang"]


@pytest.mark.parametrize("name", PARTITION_CHECKS)
def test_partition_independence(spark, name):
    answers = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        answers.append(rows(entry.queries()[name](spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert answers[0] == answers[1]
