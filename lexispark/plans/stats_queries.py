"""Queries over token counts: frequencies, coverage, entropy, divergence, fertility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import counting as ct
from ..operators import vocab_stats as vs
from ..session import checkpointed
from . import views as v
from .registry import query


@query("q_doc_counters", f"WITH {v.WORDS_SQL} SELECT doc_id, token, count(*) AS cnt FROM words GROUP BY ALL")
def doc_counters(spark, d):
    return ct.token_counts(v.words(spark, d, "doc_id"), ["doc_id"], "words")


@query("q_corpus_counter", f"WITH {v.LANG_COUNTS_SQL} SELECT token, CAST(sum(cnt) AS BIGINT) AS cnt FROM freq GROUP BY token")
def corpus_counter(spark, d):
    return ct.add_counts(v.lang_counts(spark, d), [])


DENSE_SQL = v.corpus_vocab_sql(5000) + """,
langs AS (SELECT DISTINCT lang FROM freq),
mapped AS (SELECT lang, coalesce(piece, '<unk>') AS piece, sum(cnt) AS cnt FROM freq LEFT JOIN corpus_vocab ON piece = token GROUP BY ALL),
dense AS (
  SELECT langs.lang, piece_id, corpus_vocab.piece, CAST(coalesce(cnt, 0) AS BIGINT) AS cnt FROM langs CROSS JOIN corpus_vocab
  LEFT JOIN mapped ON langs.lang = mapped.lang AND corpus_vocab.piece = mapped.piece)"""


def with_unknown(counts, known):
    """Counts of (lang, token, cnt) where a token that is not in `known` counts as the unknown piece."""
    keys = [c for c in ("lang", "token") if c in known.columns]
    marked = counts.join(known.withColumn("_known", F.lit(True)), keys, "left")
    token = F.when(F.col("_known"), F.col("token")).otherwise("<unk>")
    return ct.add_counts(marked.select("lang", token.alias("token"), "cnt"), ["lang"])


def dense_counts(spark, d):
    """Counts of each language over the vocabulary of the whole corpus: most pieces are unseen, other words are unknown."""
    counts = checkpointed(v.lang_counts(spark, d))
    langs = counts.agg(F.collect_set("lang")).scalar()
    pieces = checkpointed(v.corpus_vocab(counts, 5000))
    mapped = with_unknown(counts, pieces.select(F.col("piece").alias("token")))
    return ct.over_vocabulary(pieces.withColumn("lang", F.explode(langs)), mapped, ["lang"]).select("lang", "piece_id", "piece", "cnt")


@query("q_dense_freqs", f"WITH {DENSE_SQL} SELECT * FROM dense")
def dense_freqs(spark, d):
    return dense_counts(spark, d)


@query("q_sorted_freqs", f"WITH {DENSE_SQL} SELECT lang, piece, cnt FROM dense WHERE piece <> '<unk>'")
def sorted_freqs(spark, d):
    return ct.sorted_counts(dense_counts(spark, d)).select("lang", "piece", "cnt")


@query("q_unknown_count", f"""WITH {v.lang_vocab_sql(1000)}
SELECT f.lang, CAST(sum(CASE WHEN v.piece IS NULL THEN cnt ELSE 0 END) AS BIGINT) AS n_unknown
FROM freq f LEFT JOIN vocab v ON f.lang = v.lang AND f.token = v.piece GROUP BY f.lang""")
def unknown_count(spark, d):
    vocab, counts = v.lang_vocab(spark, d, 1000), v.lang_counts(spark, d)
    mapped = with_unknown(counts, vocab.select("lang", F.col("piece").alias("token")))
    return ct.unknown_count(ct.over_vocabulary(vocab, mapped, ["lang"]), ["lang"])


@query("q_probs", f"""WITH {v.LANG_COUNTS_SQL}
SELECT lang, token, cnt, round(cnt / sum(cnt) OVER (PARTITION BY lang), 9) AS p FROM freq""")
def probs(spark, d):
    return ct.with_probability(v.lang_counts(spark, d), ["lang"]).select("lang", "token", "cnt", F.round("p", 9).alias("p"))


@query("q_cpt", f"""WITH {v.WORDS_SQL}, freq AS (SELECT lang, token, count(*) AS cnt FROM words GROUP BY ALL),
marked AS (SELECT lang, CASE WHEN regexp_matches(token, '{tx.LEADING_DIGIT}') THEN '<unk>' ELSE token END AS token, cnt FROM freq),
texts AS (SELECT lang, sum(length(text)) / sum(len(regexp_extract_all(lower(text), '{tx.WORD_RUN}'))) AS from_text FROM documents GROUP BY lang)
SELECT lang, round(from_text, 6) AS from_text,
  round(sum(cnt * length(token)) FILTER (WHERE token <> '<unk>') / sum(cnt) FILTER (WHERE token <> '<unk>'), 6) AS from_freqs,
  round(sum(cnt * length(token)) FILTER (WHERE token <> '<unk>') / sum(cnt), 6) AS from_freqs_with_unknown
FROM marked JOIN texts USING (lang) GROUP BY lang, from_text""")
def cpt(spark, d):
    docs = v.documents(spark, d, "lang", "text").withColumn("words", tx.analyzed_words(F.col("text")))
    from_text = vs.characters_per_token_from_text(docs, ["lang"], "text", "words")
    unknown = F.when(F.col("token").rlike(tx.LEADING_DIGIT), F.lit("<unk>")).otherwise(F.col("token"))
    counts = ct.add_counts(v.lang_counts(spark, d).withColumn("token", unknown), ["lang"])
    plain = vs.characters_per_token(counts, ["lang"]).withColumnRenamed("chars_per_token", "from_freqs")
    punished = vs.characters_per_token(counts, ["lang"], True).withColumnRenamed("chars_per_token", "from_freqs_with_unknown")
    joined = from_text.withColumnRenamed("chars_per_token", "from_text").join(plain, "lang").join(punished, "lang")
    return joined.select("lang", *[F.round(c, 6).alias(c) for c in ("from_text", "from_freqs", "from_freqs_with_unknown")])


@query("q_piece_length_hist", f"""WITH {v.LANG_COUNTS_SQL}
SELECT lang, CAST(length(token) AS INTEGER) AS piece_length, CAST(sum(cnt) AS BIGINT) AS n FROM freq GROUP BY ALL""")
def piece_length_hist(spark, d):
    return vs.piece_lengths(v.lang_counts(spark, d), ["lang"])


@query("q_avg_rank", f"""WITH {v.LANG_COUNTS_SQL},
ranked AS (SELECT lang, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, token) AS rk FROM freq)
SELECT lang, round(sum(rk * cnt) / sum(cnt), 6) AS avg_rank FROM ranked GROUP BY lang""")
def avg_rank(spark, d):
    return vs.average_rank(v.lang_counts(spark, d), ["lang"]).select("lang", F.round("avg_rank", 6).alias("avg_rank"))


@query("q_fertility", f"""WITH {v.LANG_COUNTS_SQL},
cut AS (SELECT lang, cnt, (length(token) + 3) // 4 AS n FROM freq)
SELECT lang, round(sum(n * cnt) / sum(cnt), 6) AS fertility,
  round(sum(CASE WHEN n > 1 THEN cnt ELSE 0 END) / sum(cnt), 6) AS continued_share FROM cut GROUP BY lang""")
def fertility(spark, d):
    words = v.lang_counts(spark, d).withColumn("n_pieces", F.ceil(F.length("token") / 4))
    out = vs.fertility(words, ["lang"], weight="cnt")
    return out.select("lang", *[F.round(c, 6).alias(c) for c in ("fertility", "continued_share")])


@query("q_alp", f"""WITH {v.LANG_COUNTS_SQL},
p AS (SELECT lang, cnt, cnt / sum(cnt) OVER (PARTITION BY lang) AS p FROM freq),
{v.LINES_SQL}, sentences AS (SELECT src AS lang, count(*) AS n FROM lines GROUP BY src)
SELECT lang, round(sum(cnt * ln(p)) / max(n), 6) AS avg_log_prob FROM p JOIN sentences USING (lang) GROUP BY lang""")
def alp(spark, d):
    sentences = v.document_lines(spark, d).groupBy(F.col("src").alias("lang")).agg(F.count("*").alias("n_sentences"))
    out = vs.average_log_probability(v.lang_counts(spark, d), sentences, ["lang"])
    return out.select("lang", F.round("avg_log_prob", 6).alias("avg_log_prob"))


@query("q_vocab_stats_by_lang", f"""WITH {v.LANG_COUNTS_SQL},
cum AS (
  SELECT lang, token, cnt, row_number() OVER w - 1 AS idx, sum(cnt) OVER (w ROWS UNBOUNDED PRECEDING) AS upto,
    sum(cnt) OVER (PARTITION BY lang) AS total, count(*) OVER (PARTITION BY lang) AS n_types
  FROM freq WINDOW w AS (PARTITION BY lang ORDER BY cnt DESC, token)),
crossing AS (SELECT lang, min(idx) AS idx, max(cnt) AS freq FROM cum WHERE 100 * upto > 95 * total GROUP BY lang)
SELECT cum.lang, round(-sum(cnt / total * ln(cnt / total)), 6) AS entropy,
  max(crossing.freq) AS freq_at_95, max(crossing.idx) AS tokens_to_cover_95,
  round((sum(abs(cnt / total - 1 / (n_types + 3))) + 3 / max(n_types + 3)) / 2, 6) AS divergence,
  round(sum(cnt * length(token)) / max(total), 6) AS chars_per_token
FROM cum JOIN crossing ON cum.lang = crossing.lang GROUP BY cum.lang""")
def vocab_stats_by_lang(spark, d):
    # The corpus is read once; every statistic comes from the table of counts.
    counts = checkpointed(v.lang_counts(spark, d))
    sizes = counts.groupBy("lang").agg((F.count("*") + 3).alias("vocab_size"))
    stats = vs.entropy(counts, ["lang"])
    for part in (
        vs.coverage_95(counts, ["lang"]),
        vs.divergence_from_uniform(counts, sizes, ["lang"]),
        vs.characters_per_token(counts, ["lang"]),
    ):
        stats = stats.join(part, "lang")
    rounded = [F.round(c, 6).alias(c) for c in ("entropy", "divergence", "chars_per_token")]
    return stats.select("lang", "freq_at_95", "tokens_to_cover_95", *rounded)


def _jsd_sql(group: str) -> str:
    return f"""WITH {v.WORDS_SQL}, freq AS (SELECT {group} AS g, token, count(*) AS cnt FROM words GROUP BY ALL),
p AS (SELECT g, token, cnt / sum(cnt) OVER (PARTITION BY g) AS p FROM freq),
grid AS (SELECT a.g AS left_grp, b.g AS right_grp FROM (SELECT DISTINCT g FROM p) a, (SELECT DISTINCT g FROM p) b WHERE a.g < b.g),
tokens AS (SELECT DISTINCT token FROM p),
both_sides AS (
  SELECT left_grp, right_grp, token, sum(CASE WHEN g = left_grp THEN p ELSE 0 END) AS p, sum(CASE WHEN g = right_grp THEN p ELSE 0 END) AS q
  FROM grid JOIN p ON g = left_grp OR g = right_grp GROUP BY ALL)
SELECT left_grp, right_grp, round(sqrt(greatest(sum(
    CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 6) AS js_distance
FROM both_sides GROUP BY ALL"""


def _jsd(counts, group):
    counts = checkpointed(counts)
    out = vs.js_distances(counts, group, vs.group_pairs(counts, group))
    return out.withColumn("js_distance", F.round("js_distance", 6))


@query("q_jsd_langs", _jsd_sql("lang"))
def jsd_langs(spark, d):
    return _jsd(v.lang_counts(spark, d), "lang")


@query("q_jsd_sources", _jsd_sql("source"))
def jsd_sources(spark, d):
    return _jsd(ct.token_counts(v.words(spark, d, "source"), ["source"], "words"), "source")


@query("q_mean_len", f"""WITH {v.LINES_SQL},
means AS (SELECT source, avg(len(regexp_extract_all(lower(line), '{tx.WORD_RUN}'))) AS m FROM lines GROUP BY source)
SELECT round(avg(m), 6) AS mean_length FROM means""")
def mean_len(spark, d):
    lines = v.document_lines(spark, d).select("source", F.size(tx.analyzed_words(F.col("line"))).alias("n_tokens"))
    return vs.mean_of_means(lines, "source", "n_tokens").select(F.round("mean_length", 6).alias("mean_length"))


@query("q_vocab_cutoff", f"""WITH {DENSE_SQL}
SELECT lang, piece_id, piece, cnt, row_number() OVER (PARTITION BY lang ORDER BY piece_id) - 1 AS new_id
FROM dense WHERE piece_id <> 0 AND cnt > 2""")
def vocab_cutoff(spark, d):
    return ct.prune_rare(dense_counts(spark, d), 2, ["lang"])
