"""Queries over document-term weights, vectors and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import pair_features
from ..operators import clustering as cl
from ..operators import neighbors as nb
from ..operators import vectorize as vz
from ..operators.counting import document_counts, token_counts
from ..session import checkpointed, stored
from . import views as v
from .registry import plain_zero, query
from .text_queries import CHAR_WB_SQL


@query("q_term_weights", f"""WITH {v.WORDS_SQL}, c AS (SELECT doc_id, token, count(*) AS cnt FROM words GROUP BY ALL)
SELECT doc_id, token, 1.0::DOUBLE AS binary_weight, round(cnt / sum(cnt) OVER (PARTITION BY doc_id), 9) AS relative_weight FROM c""")
def term_weights(spark, d):
    counts = token_counts(v.words(spark, d, "doc_id"), ["doc_id"], "words")
    both = vz.term_weights(vz.term_weights(counts, "doc_id").withColumnRenamed("weight", "binary_weight"), "doc_id", "relative")
    return both.select("doc_id", "token", "binary_weight", F.round("weight", 9).alias("relative_weight"))


def n_docs(spark, d):
    return v.table(spark, d, "documents").agg(F.count("*"))


def word_tfidf(spark, d):
    """One row per document with its tokens and weights, and the frequencies of the tokens."""
    words = v.words(spark, d, "doc_id")
    # Read twice, for the frequencies and the weights, so it is written once.
    counts = stored(document_counts(words, "doc_id", tx.mark_numbers(F.col("words"))), "counts")
    frequency = checkpointed(vz.document_frequency(counts, n_docs(spark, d), 2, 0.5))
    return vz.tfidf(counts, frequency, "doc_id"), frequency


def _tfidf_sql(counts: str, min_df: int, max_df: float) -> str:
    return f"""{counts},
dfs AS (SELECT token, count(*) AS df FROM c GROUP BY token HAVING count(*) >= {min_df} AND count(*) <= {max_df} * (SELECT count(*) FROM documents)),
raw AS (SELECT doc_id, token, cnt * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN dfs USING (token)),
tfidf AS (SELECT doc_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM raw)"""


WORD_TFIDF_SQL = _tfidf_sql(f"""{v.WORDS_SQL},
c AS (SELECT doc_id, CASE WHEN regexp_matches(token, '{tx.LEADING_DIGIT}') THEN '#NUMBER' ELSE token END AS token, count(*) AS cnt FROM words GROUP BY ALL)""", 2, 0.5)


@query("q_tfidf", f"WITH {WORD_TFIDF_SQL} SELECT * FROM tfidf")
def tfidf(spark, d):
    return vz.long_weights(word_tfidf(spark, d)[0], "doc_id").withColumn("weight", F.round("weight", 9))


@query("q_tfidf_char", "WITH " + _tfidf_sql(CHAR_WB_SQL + ", c AS (SELECT doc_id, token, count(*) AS cnt FROM char_grams WHERE length(token) <= 3 GROUP BY ALL)", 5, 0.9) + " SELECT * FROM tfidf")
def tfidf_char(spark, d):
    docs = v.documents(spark, d, "doc_id", "text")
    counts = stored(document_counts(docs, "doc_id", tx.char_ngrams(F.col("text"), 2, 3)), "counts")
    frequency = checkpointed(vz.document_frequency(counts, n_docs(spark, d), 5, 0.9))
    return vz.long_weights(vz.tfidf(counts, frequency, "doc_id"), "doc_id").withColumn("weight", F.round("weight", 9))


@query("q_term_table", f"""WITH {WORD_TFIDF_SQL}
SELECT token, df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 9) AS idf, row_number() OVER (ORDER BY token) - 1 AS term_id FROM dfs""")
def term_table(spark, d):
    return vz.term_table(word_tfidf(spark, d)[1]).withColumn("idf", F.round("idf", 9))


UNIT_SQL = """vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
elems AS (SELECT vec_id, label, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS x FROM vecs)"""


@query("q_l2_embeddings", plain_zero(f"""WITH {UNIT_SQL}
SELECT vec_id, CAST(i AS INTEGER) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM elems""", "x"))
def l2_embeddings(spark, d):
    unit = vz.l2_normalize(v.embeddings(spark, d), "embedding")
    return unit.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


ASSIGN_SQL = UNIT_SQL + """,
centers AS (SELECT label AS c, i, avg(x) AS m FROM elems GROUP BY label, i),
dist AS (SELECT vec_id, label, c, sqrt(sum((x - m) * (x - m))) AS dd FROM elems JOIN centers USING (i) GROUP BY ALL),
assigned AS (SELECT vec_id, label, arg_min(c, dd) AS cluster, min(dd) AS distance FROM dist GROUP BY ALL)"""


def nearest_centroid(spark, d):
    rows = v.embeddings(spark, d)
    return cl.assign_nearest(rows, "embedding", cl.centroids(rows, "embedding", "label"), "label")


@query("q_kmeans_step", f"WITH {ASSIGN_SQL} SELECT vec_id, label, cluster, round(distance, 6) AS distance FROM assigned")
def kmeans_step(spark, d):
    return nearest_centroid(spark, d).select("vec_id", "label", "cluster", F.round("distance", 6).alias("distance"))


@query("q_cluster_agreement", f"""WITH {ASSIGN_SQL},
cells AS (SELECT label AS c, cluster AS k, count(*)::DOUBLE AS n FROM assigned GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER (PARTITION BY k) AS nk, sum(n) OVER () AS t FROM cells),
mc AS (SELECT DISTINCT c, nc, t FROM m), mk AS (SELECT DISTINCT k, nk, t FROM m),
h AS (SELECT (SELECT -sum(nc / t * ln(nc / t)) FROM mc) AS hc, (SELECT -sum(nk / t * ln(nk / t)) FROM mk) AS hk,
  (SELECT sum(n / t * ln(n * t / (nc * nk))) FROM m) AS mi,
  (SELECT sum(n * (n - 1) / 2) FROM m) AS a, (SELECT sum(nc * (nc - 1) / 2) FROM mc) AS b, (SELECT sum(nk * (nk - 1) / 2) FROM mk) AS c2,
  (SELECT max(t) * (max(t) - 1) / 2 FROM m) AS np)
SELECT round(mi / hc, 6) AS homogeneity, round(mi / hk, 6) AS completeness, round(2 * mi / (hc + hk), 6) AS v_measure,
  round((a - b * c2 / np) / ((b + c2) / 2 - b * c2 / np), 6) AS adjusted_rand FROM h""")
def cluster_agreement(spark, d):
    out = cl.agreement(nearest_centroid(spark, d), "label", "cluster")
    return out.select(*[F.round(c, 6).alias(c) for c in ("homogeneity", "completeness", "v_measure", "adjusted_rand")])


@query("q_silhouette", f"""WITH {UNIT_SQL},
pd AS (SELECT a.vec_id, a.label AS own, b.label AS other, a.vec_id = b.vec_id AS self, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS dd
  FROM elems a JOIN elems b USING (i) GROUP BY a.vec_id, a.label, b.label, b.vec_id),
g AS (SELECT vec_id, own, other, sum(dd) AS s, count(*) AS n FROM pd GROUP BY ALL),
ab AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS size, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a,
  min(CASE WHEN own <> other THEN s / n END) AS b FROM g GROUP BY vec_id)
SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""")
def silhouette(spark, d):
    out = cl.silhouette(v.embeddings(spark, d), "vec_id", "label", 10_000, 0, "embedding")
    return out.select(F.round("silhouette", 6).alias("silhouette"))


@query("q_knn", f"""WITH {UNIT_SQL},
pd AS (SELECT a.vec_id, b.vec_id AS neighbor, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 9) AS distance
  FROM elems a JOIN elems b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL)
SELECT vec_id, neighbor, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS INTEGER) AS rank
FROM pd QUALIFY rank <= 15""")
def knn(spark, d):
    return nb.nearest_neighbors(v.embeddings(spark, d), "vec_id", "embedding", 15).withColumn("distance", F.round("distance", 6))


@query("q_pair_features", plain_zero(f"""WITH {UNIT_SQL},
pairs AS (SELECT a.vec_id, a.i, a.x AS xa, b.x AS xb FROM elems a JOIN elems b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(xa, 6) AS x FROM pairs
UNION ALL SELECT vec_id, CAST(i + 64 AS INTEGER), round(xb, 6) FROM pairs
UNION ALL SELECT vec_id, CAST(i + 128 AS INTEGER), round(xa * xb, 6) FROM pairs""", "x"))
def pair_feature_vectors(spark, d):
    rows = v.embeddings(spark, d)
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    joined = rows.join(nxt, "vec_id").select("vec_id", pair_features(F.col("embedding"), F.col("b")).alias("f"))
    return joined.select("vec_id", F.posexplode("f").alias("i", "x")).withColumn("x", F.round("x", 6))


def token_vectors(spark, d):
    """Embeddings as token vectors: eight form a sentence, two or three of them a word."""
    rows = v.embeddings(spark, d)
    return rows.select(
        F.floor(F.col("vec_id") / 8).alias("sent"),
        F.floor(F.col("vec_id") % 8 / 3).cast("int").alias("word_pos"),
        F.when(F.col("label") < 7, 1).otherwise(0).alias("mask"),
        "embedding",
    )


TOKEN_VEC_SQL = UNIT_SQL + """,
tok AS (SELECT vec_id // 8 AS sent, CAST(vec_id % 8 // 3 AS INTEGER) AS word_pos, CASE WHEN label < 7 THEN 1 ELSE 0 END AS mask, i, x FROM elems)"""


@query("q_masked_mean", plain_zero(f"""WITH {TOKEN_VEC_SQL}
SELECT sent, CAST(i AS INTEGER) AS i, round(sum(x * mask) / greatest(sum(mask), 1), 6) AS x FROM tok GROUP BY sent, i""", "x"))
def masked_mean(spark, d):
    out = vz.masked_mean(token_vectors(spark, d), "sent", "embedding", "mask")
    return out.select("sent", F.posexplode("mean_vector").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("q_word_pool", plain_zero(f"""WITH {TOKEN_VEC_SQL}
SELECT sent, word_pos, CAST(i AS INTEGER) AS i, round(sum(x), 6) AS total, round(avg(x), 6) AS mean FROM tok GROUP BY ALL""", "total", "mean"))
def word_pool(spark, d):
    tokens = token_vectors(spark, d)
    both = vz.pool_words(tokens, "sent", "word_pos", "embedding").join(
        vz.pool_words(tokens, "sent", "word_pos", "embedding", "mean").withColumnRenamed("pooled", "mean"), ["sent", "word_pos"]
    )
    rows = both.select("sent", "word_pos", F.posexplode(F.arrays_zip("pooled", "mean")).alias("i", "v"))
    return rows.select("sent", "word_pos", "i", F.round("v.pooled", 6).alias("total"), F.round("v.mean", 6).alias("mean"))
