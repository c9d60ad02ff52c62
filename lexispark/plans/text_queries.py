"""Queries over lines, documents and words: reading rules, samples, orders, n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import draw_key
from ..functions.rows import explode_rows
from ..operators import ordering as od
from ..operators.counting import rare_token_counts, token_counts
from ..sources import text as st
from . import views as v
from .registry import query

SHA = "md5(concat_ws(':', {}, '{}'))"


@query("q_lines_clean", f"WITH {v.LINES_SQL} SELECT src, doc_id, pos, line FROM lines")
def lines_clean(spark, d):
    return v.document_lines(spark, d).select("src", "doc_id", "pos", "line")


@query("q_line_counts", f"""WITH {v.LINES_SQL}
SELECT src, count(*) AS n_lines, count(*) // 1000000 * 10 + 15 AS memory_gb, count(*) // 1000000 + 1 AS cpus
FROM lines GROUP BY src""")
def line_counts(spark, d):
    return st.resources_for(st.line_counts(v.document_lines(spark, d)))


LINE_KEY = "md5(concat_ws(':', doc_id, pos, '{}'))"


@query("q_sample_lines", f"""WITH {v.LINES_SQL}
SELECT src, doc_id, pos, line FROM lines ORDER BY {LINE_KEY.format(42)} LIMIT 1000""")
def sample_lines(spark, d):
    lines = v.document_lines(spark, d).select("src", "doc_id", "pos", "line")
    return od.exact_sample(lines, 1000, F.concat_ws(":", "doc_id", "pos"), 42).orderBy("src", "doc_id", "pos")


@query("q_sample_lines_per_source", f"""WITH {v.LINES_SQL}
SELECT source, doc_id, pos, line FROM lines
QUALIFY row_number() OVER (PARTITION BY source ORDER BY {LINE_KEY.format(7)}) <= 100""")
def sample_lines_per_source(spark, d):
    lines = v.document_lines(spark, d).select("source", "doc_id", "pos", "line")
    return od.exact_sample(lines, 100, F.concat_ws(":", "doc_id", "pos"), 7, ["source"])


@query("q_pick_examples", """SELECT conv_id, turn, role FROM conversations
ORDER BY md5(concat_ws(':', conv_id, turn, '3')) LIMIT 10""")
def pick_examples(spark, d):
    rows = v.table(spark, d, "conversations").select("conv_id", "turn", "role")
    key = draw_key(F.concat_ws(":", "conv_id", "turn"), 3)
    return od.first_n(rows, 10, key)


@query("q_shuffle_first_n", """SELECT doc_id, lang, row_number() OVER (ORDER BY md5(concat_ws(':', doc_id, '42'))) - 1 AS shuffled_pos
FROM documents QUALIFY shuffled_pos < 500""")
def shuffle_first_n(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", "lang")
    return od.shuffle_rank(docs, F.col("doc_id"), 42).drop("draw").where(F.col("shuffled_pos") < 500)


@query("q_seeded_shuffle", """SELECT doc_id, lang, md5(concat_ws(':', doc_id, '42')) AS draw FROM documents""")
def seeded_shuffle(spark, d):
    return od.seeded_shuffle(v.table(spark, d, "documents").select("doc_id", "lang"), F.col("doc_id"), 42)


@query("q_first_per_source", """SELECT source, doc_id FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10""")
def first_per_source(spark, d):
    docs = st.number_documents(v.table(spark, d, "documents").select("source", "doc_id"), "doc_id", "source")
    return docs.where(F.col("doc_ord") < 10).select("source", "doc_id")


@query("q_split_percent", f"""WITH {v.LINES_SQL}
SELECT src, doc_id, pos, CASE WHEN substr({LINE_KEY.format(5)}, 1, 8) < '0ccccccc' THEN 'validation' ELSE 'train' END AS split
FROM lines""")
def split_percent(spark, d):
    lines = v.document_lines(spark, d).select("src", "doc_id", "pos")
    return od.percent_split(lines, F.concat_ws(":", "doc_id", "pos"), 5, 5)


@query("q_sort_by_length", """SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents""")
def sort_by_length(spark, d):
    return v.documents(spark, d, "doc_id", "text").select("doc_id", F.length("text").alias("n")).orderBy("n")


SOURCE_DOCS_SQL = """source_docs AS (
  SELECT source AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS doc_ord, doc_id,
         string_split(text, chr(10)) AS lines FROM documents)"""


def source_documents(spark, d):
    """Each source as one corpus file: its documents in id order as arrays of lines."""
    docs = v.documents(spark, d, "source", "doc_id", "text")
    docs = docs.select(F.col("source").alias("src"), "doc_id", F.split("text", "\n").alias("lines"))
    return st.number_documents(docs, "doc_id", "src")


START_LINES_SQL = SOURCE_DOCS_SQL + """,
starts AS (
  SELECT src, doc_ord, doc_id, lines,
    CAST(coalesce(sum(len(lines) + 1) OVER (PARTITION BY src ORDER BY doc_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS start_line
  FROM source_docs)"""


@query("q_start_lines", f"WITH {START_LINES_SQL} SELECT src, doc_ord, doc_id, start_line FROM starts")
def start_lines(spark, d):
    return od.start_lines(source_documents(spark, d)).select("src", "doc_ord", "doc_id", "start_line")


@query("q_words", f"""SELECT lang, token, count(*) AS cnt FROM (
  SELECT lang, unnest(regexp_extract_all(text, '{tx.WORD_OR_SYMBOL}')) AS token FROM documents) GROUP BY ALL""")
def words(spark, d):
    docs = v.documents(spark, d, "lang", "text")
    return token_counts(docs, ["lang"], tx.word_list(F.col("text")))


WORD_LISTS_SQL = rf"""word_lists AS (
  SELECT doc_id, lang, regexp_extract_all(lower(text), '{tx.WORD_RUN}') AS ws FROM documents)"""


#: So many bytes of text are a partition of n-grams: some million of them, which are summed in memory.
NGRAM_BYTES = 8 << 20


@query("q_word_ngrams", f"""WITH {WORD_LISTS_SQL},
grams AS (
  SELECT lang, unnest(ws) AS token FROM word_lists
  UNION ALL
  SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM word_lists
  UNION ALL
  SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM word_lists)
SELECT lang, token, count(*) AS cnt FROM grams GROUP BY ALL""")
def word_ngrams(spark, d):
    size = v.documents(spark, d, "text").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // NGRAM_BYTES + 1
    # A text has some nine times its bytes in n-grams: tasks of little text keep theirs in memory until they are shuffled.
    docs = v.words(spark, d, "lang", parts=max(parts // 2, spark.sparkContext.defaultParallelism))
    return rare_token_counts(docs, "lang", tx.word_ngrams(F.col("words"), 1, 3), parts)


CHAR_WB_SQL = rf"""padded AS (
  SELECT doc_id, lang, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '{v.STRIP}+'), lambda w: w <> '')) || ' ' AS w
  FROM documents),
char_grams AS (
  SELECT p.doc_id, p.lang, unnest(list_transform(range(1, greatest(length(w) - n, 0) + 2), lambda i: substr(w, i, n))) AS token
  FROM padded p JOIN (VALUES (2), (3), (4)) s(n) ON n = 2 OR length(w) > n - 1)"""


@query("q_char_wb", f"WITH {CHAR_WB_SQL} SELECT lang, token, count(*) AS cnt FROM char_grams GROUP BY ALL")
def char_wb(spark, d):
    # n-grams never cross words: the corpus is read for its distinct words, and only these are cut.
    docs = v.documents(spark, d, "lang", "text")
    words = token_counts(docs, ["lang"], tx.padded_words(F.col("text")))
    grams = explode_rows(words, ["lang", "cnt"], tx.word_char_ngrams(F.col("token"), 2, 4), "gram")
    return grams.groupBy("lang", F.col("gram").alias("token")).agg(F.sum("cnt").alias("cnt"))


@query("q_number_norm", f"""WITH {v.WORDS_SQL},
marked AS (SELECT lang, CASE WHEN regexp_matches(token, '{tx.LEADING_DIGIT}') THEN '#NUMBER' ELSE token END AS token FROM words)
SELECT lang, token, count(*) AS cnt FROM marked GROUP BY ALL""")
def number_norm(spark, d):
    docs = v.words(spark, d, "lang")
    return token_counts(docs, ["lang"], tx.mark_numbers(F.col("words")))


# A short example list; a full list is a parameter of the operator.
STOP_WORDS = ["the", "and", "of", "to", "in", "de", "la", "el", "der", "die", "und", "les", "#NUMBER"]


@query("q_stop_words", f"""WITH {v.WORDS_SQL},
marked AS (SELECT doc_id, CASE WHEN regexp_matches(token, '{tx.LEADING_DIGIT}') THEN '#NUMBER' ELSE token END AS token FROM words)
SELECT doc_id, count(*) AS n_kept, count(DISTINCT token) AS n_distinct FROM marked
WHERE token NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)}) GROUP BY doc_id""")
def stop_words(spark, d):
    docs = v.words(spark, d, "doc_id")
    kept = docs.select("doc_id", tx.drop_words(tx.mark_numbers(F.col("words")), STOP_WORDS).alias("kept"))
    sizes = kept.select("doc_id", F.size("kept").cast("long").alias("n_kept"), F.size(F.array_distinct("kept")).cast("long").alias("n_distinct"))
    return sizes.where(F.col("n_kept") > 0)


# Source files of blank-line separated documents: the lines of a source, numbered over the source.
BLOCKS_SQL = START_LINES_SQL + rf""",
numbered AS (
  SELECT src, start_line - 1 + generate_subscripts(lines, 1) - 1 AS line_no, unnest(lines) AS line FROM starts
  UNION ALL SELECT src, start_line - 1 + len(lines), '' FROM starts),
seps AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER
      (PARTITION BY src ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block
  FROM numbered),
blocks AS (
  SELECT src, block AS doc_ord, CAST(min(line_no) + 1 AS BIGINT) AS start_line,
    coalesce(string_agg(regexp_replace(line, '{v.STRIP}+$', ''), ' ' ORDER BY line_no) FILTER (WHERE line <> ''), '') AS text
  FROM seps GROUP BY src, block)"""


@query("q_doc_blocks", f"WITH {BLOCKS_SQL} SELECT src, doc_ord, start_line, text FROM blocks")
def doc_blocks(spark, d):
    placed = od.start_lines(source_documents(spark, d))
    first = (F.col("start_line") - 1).alias("first")
    lines = explode_rows(placed, ["src", first], F.concat("lines", F.array(F.lit(""))), "line", "pos").select("src", (F.col("first") + F.col("pos")).alias("line_no"), "line")
    blocks = st.documents_from_lines(lines, "line_no")
    return blocks.select("src", "doc_ord", "start_line", F.array_join("lines", " ").alias("text"))
