"""The query of each operator, named opN_<name>, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (
    chat_format, cross_tokens, decontaminate, fingerprint, html_text, huffman, licenses, line_dedup, ngram_join, packing, periodic_runs, suffix_dedup,
    toxicity,
)
from .common import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), ngram_join.Similar(words=3, percent=90))


ORACLES["op1_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
rare AS (SELECT * FROM tokens WHERE t IN (SELECT t FROM tokens GROUP BY t HAVING count(*) > 1)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


@query
def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as Huffman-coded ids and read them back."""
    path = scratch_path(spark, "huffman")
    huffman.write_ids(table(spark, sf_dir, "documents"), path)
    return huffman.read_ids(spark, path)


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


ORACLES["op3_decontamination"] = r"""
WITH bench AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT least(len(w), 10) AS m FROM bench WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bench WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, sizes WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, m, win FROM doc_windows WHERE win IN (SELECT win FROM item_windows)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
lists AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN item_windows USING (win)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN lists USING (doc_id)"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places by exact phrases; labels also from notices with errors; score: the best share of unchanged characters."""
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["first_word"])
    base = F.transform("places", lambda p: p["label"])
    more = F.transform("spans", lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    near = F.transform("spans", lambda s: F.lit(1.0) - s["errors"] / F.greatest(F.length(s["found"]), F.lit(1)))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(near), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), F.size("spans").cast("long").alias("n_spans"),
    )


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that repeat an earlier line, exactly or nearly."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.cross_tokenizer_alignment(table(spark, sf_dir, "documents"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, a tenth of which are made periodic first."""
    docs = periodic_runs.with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


@query
def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all conversations and one of control strings as marked text, and read them back."""
    parts = chat_format.format_turns(chat_format.with_probe(table(spark, sf_dir, "conversations")))
    return chat_format.conversation_digests(chat_format.read_turns(written(parts, "chat")))
