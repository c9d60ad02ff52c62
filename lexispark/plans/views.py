"""Views that the queries read: the given tables in the shapes the operators expect.

Each view comes with the SQL that defines it, as common table expressions for the checks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rows import explode_rows
from ..functions.text import WORD_RUN, analyzed_words, has_text, space_words, strip_right
from ..operators.counting import token_counts
from ..session import checkpointed, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select(*columns) if columns else docs)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src (language), source, doc_id, pos, line: right-stripped lines that are not blank."""
    docs = documents(spark, sf_dir, "doc_id", "lang", "source", "text")
    rows = explode_rows(docs, [F.col("lang").alias("src"), "source", "doc_id"], F.split("text", "\n"), "raw", "pos")
    return rows.where(has_text(F.col("raw"))).withColumn("line", strip_right(F.col("raw"))).drop("raw")


STRIP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINES_SQL = rf"""lines AS (
  SELECT src, source, doc_id, pos, line FROM (
    SELECT lang AS src, source, doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos,
           regexp_replace(unnest(string_split(text, chr(10))), '{STRIP}+$', '') AS line
    FROM documents) WHERE line <> '')"""


def words(spark: SparkSession, sf_dir: str, *keys: str, parts: int = 0) -> DataFrame:
    """Analyzed words of every document as an array; the texts are dealt to `parts` partitions, if given."""
    docs = documents(spark, sf_dir, *dict.fromkeys([*keys, "text"]))
    docs = docs.repartition(parts) if parts else docs
    return docs.select(*keys, analyzed_words(F.col("text")).alias("words"))


WORDS_SQL = rf"""words AS (
  SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '{WORD_RUN}')) AS token FROM documents)"""


def lang_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(words(spark, sf_dir, "lang"), ["lang"], "words")


LANG_COUNTS_SQL = WORDS_SQL + """,
freq AS (SELECT lang, token, count(*) AS cnt FROM words GROUP BY lang, token)"""


def lang_vocab(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Per language the `size` most frequent words with ln(p), after three special pieces."""
    counts = checkpointed(lang_counts(spark, sf_dir))
    totals = counts.groupBy("lang").agg(F.sum("cnt").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("cnt").desc(), "token"))
    ranked = counts.withColumn("rank", rank).where(F.col("rank") <= size).join(totals, "lang")
    normal = ranked.select(
        "lang", (F.col("rank") + 2).alias("piece_id"), F.col("token").alias("piece"),
        F.ln(F.col("cnt") / F.col("total")).alias("score"), F.lit("NORMAL").alias("type"),
    )
    names = F.array(F.lit("<unk>"), F.lit("<s>"), F.lit("</s>"))
    special = (
        counts.select("lang").distinct().select("lang", F.posexplode(names).alias("piece_id", "piece"))
        .withColumn("score", F.lit(0.0))
        .withColumn("type", F.when(F.col("piece") == "<unk>", F.lit("UNKNOWN")).otherwise(F.lit("CONTROL")))
    )
    return special.unionByName(normal)


def lang_vocab_sql(size: int) -> str:
    return LANG_COUNTS_SQL + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, token) AS rk,
                  sum(cnt) OVER (PARTITION BY lang) AS total FROM freq),
vocab AS (
  SELECT lang, CAST(rk + 2 AS INTEGER) AS piece_id, token AS piece, ln(cnt / total) AS score, 'NORMAL' AS type
  FROM ranked WHERE rk <= {size}
  UNION ALL
  SELECT lang, id, piece, 0.0, type FROM (SELECT DISTINCT lang FROM freq),
    (VALUES (0, '<unk>', 'UNKNOWN'), (1, '<s>', 'CONTROL'), (2, '</s>', 'CONTROL')) s(id, piece, type))"""


def corpus_vocab(counts: DataFrame, size: int) -> DataFrame:
    """piece_id, piece: the unknown piece and the `size` most frequent words of (lang, token, cnt)."""
    counts = counts.groupBy("token").agg(F.sum("cnt").alias("cnt"))
    top = counts.orderBy(F.col("cnt").desc(), "token").limit(size)
    packed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("n"), "token"))).alias("t"))
    return packed.select(F.posexplode(F.concat(F.array(F.lit("<unk>")), F.col("t.token"))).alias("piece_id", "piece"))


def corpus_vocab_sql(size: int) -> str:
    return LANG_COUNTS_SQL + f""",
corpus_vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY sum(cnt) DESC, token) AS INTEGER) AS piece_id, token AS piece FROM freq GROUP BY token
  QUALIFY piece_id <= {size}
  UNION ALL SELECT 0, '<unk>')"""


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, doc_id, pos, ids: every non-blank line as ids of its space-separated words.

    The id is a hash of the word into 30,000 slots after five special ids, so that inputs for the
    example operators need no vocabulary.
    """
    lines = document_lines(spark, sf_dir)
    rows = lines.select("src", "doc_id", "pos", space_words(F.col("line")).alias("words"))
    types = dict(rows.dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in ("src", "doc_id", "pos"))
    return rows.mapInArrow(_numbered, f"{keys}, ids array<int>")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a batch; each different word is hashed once."""
    for batch in batches:
        words = batch.column(3)
        coded = words.flatten().dictionary_encode()
        slots = [int(md5(w.encode()).hexdigest()[:6], 16) % 30000 + 5 for w in coded.dictionary.to_pylist()]
        size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        bounds = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        ids = pa.ListArray.from_arrays(bounds, pa.array(slots, pa.int32()).take(coded.indices))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids], ["src", "doc_id", "pos", "ids"])


TOKEN_IDS_SQL = LINES_SQL + rf""",
token_ids AS (
  SELECT src, doc_id, pos, list_transform(list_filter(regexp_split_to_array(line, '{STRIP}+'), lambda w: w <> ''),
         lambda w: CAST(('0x' || substr(md5(w), 1, 6))::INTEGER % 30000 + 5 AS INTEGER)) AS ids
  FROM lines)"""

# Fixed values of the example tagging rule: the labels and their places.
TAGS = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC", "B-ORG", "I-ORG"]


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, tokens, tags, preds: words of a line with rule-made labels and predictions."""
    lines = document_lines(spark, sf_dir)
    tokens = F.filter(F.split("line", " "), lambda w: w != "")
    rows = lines.select("src", "doc_id", "pos", tokens.alias("tokens"))
    types = dict(rows.dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in ("src", "doc_id", "pos"))
    return rows.mapInArrow(_tagged, f"{keys}, tokens array<string>, tags array<string>, preds array<string>")


def _slot(word: str, salt: str) -> int:
    return int(md5((word + salt).encode()).hexdigest()[:4], 16)


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tags and predictions of a batch; each different word is hashed once."""
    names = pa.array(TAGS)
    for batch in batches:
        tokens = batch.column(3)
        coded = tokens.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        tag = [_slot(w, "t") % len(TAGS) for w in words]
        pred = [_slot(w, "p") % len(TAGS) if _slot(w, "q") % 5 == 0 else t for w, t in zip(words, tag)]
        size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        bounds = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, names.take(pa.array(x, pa.int32()).take(coded.indices))) for x in (tag, pred)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *lists], ["src", "doc_id", "pos", "tokens", "tags", "preds"])


SEQUENCES_SQL = LINES_SQL + """,
seq_words AS (
  SELECT src, doc_id, pos, generate_subscripts(ws, 1) - 1 AS idx, unnest(ws) AS w
  FROM (SELECT src, doc_id, pos, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM lines)),
tag_names AS (SELECT ['O', 'B-PER', 'I-PER', 'B-LOC', 'I-LOC', 'B-ORG', 'I-ORG'] AS names),
seq AS (
  SELECT src, doc_id, pos, idx, w, names[('0x' || substr(md5(w || 't'), 1, 4))::INTEGER % 7 + 1] AS tag,
    CASE WHEN ('0x' || substr(md5(w || 'q'), 1, 4))::INTEGER % 5 = 0
         THEN names[('0x' || substr(md5(w || 'p'), 1, 4))::INTEGER % 7 + 1]
         ELSE names[('0x' || substr(md5(w || 't'), 1, 4))::INTEGER % 7 + 1] END AS pred
  FROM seq_words, tag_names)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, seed, lang_src, lang_tgt, value: an experiment grid with holes."""
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_discount"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation")
    src = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("lang_src"))
    tgt = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("lang_tgt"))
    joined = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    # Nations are named only after the aggregation: the keys are as good as the names until then.
    seed = (F.col("l_linenumber") % 3 + 2001).cast("int")
    cells = joined.groupBy(F.col("o_orderpriority").alias("model"), seed.alias("seed"), "c_nationkey", "s_nationkey").agg(
        F.avg("l_discount").alias("value")
    )
    return cells.join(src, "c_nationkey").join(tgt, "s_nationkey").select("model", "seed", "lang_src", "lang_tgt", "value")


BASELINE = "1-URGENT"
RESULTS_SQL = """results AS (
  SELECT o_orderpriority AS model, CAST(l_linenumber % 3 + 2001 AS INTEGER) AS seed,
         cn.n_name AS lang_src, sn.n_name AS lang_tgt, avg(l_discount) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation sn ON s_nationkey = sn.n_nationkey
  GROUP BY ALL)"""


def pivot_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of nation 0, which plays the pivot language."""
    return table(spark, sf_dir, "nation").where(F.col("n_nationkey") == 0).select("n_name")


def tok_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, lang, value, n_rows, data_amount_rank: statistics of a tokenizer for a language."""
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_tax"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    stats = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("o_orderpriority").alias("model"), "s_nationkey")
        .agg(F.avg("l_tax").alias("value"), F.count("*").alias("n_rows"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("model", F.col("n_name").alias("lang"), "value", "n_rows")
    )
    rank = F.rank().over(Window.partitionBy("model").orderBy(F.col("n_rows").desc()))
    return stats.withColumn("data_amount_rank", rank.cast("long"))


TOK_STATS_SQL = """tok_stats AS (
  SELECT *, CAST(rank() OVER (PARTITION BY model ORDER BY n_rows DESC) AS BIGINT) AS data_amount_rank FROM (
    SELECT o_orderpriority AS model, n_name AS lang, avg(l_tax) AS value, count(*) AS n_rows
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
         JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL))"""


def cross_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, lang_src, lang_tgt, overlap: statistics of a tokenizer for two languages."""
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation")
    src = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("lang_src"))
    tgt = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("lang_tgt"))
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("o_orderpriority").alias("model"), "c_nationkey", "s_nationkey")
        .agg(F.avg("l_quantity").alias("overlap"))
        .join(src, "c_nationkey").join(tgt, "s_nationkey")
        .select("model", "lang_src", "lang_tgt", "overlap")
    )


CROSS_STATS_SQL = """cross_stats AS (
  SELECT o_orderpriority AS model, cn.n_name AS lang_src, sn.n_name AS lang_tgt, avg(l_quantity) AS overlap
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation sn ON s_nationkey = sn.n_nationkey
  GROUP BY ALL)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return spread(rows).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
