"""Queries that encode, train, merge and decompose."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD_START
from ..operators import bpe, clustering, decompose, segment, unigram
from ..operators import vectorize as vz
from ..operators import vocab_merge as vm
from ..operators.counting import tallied, token_counts
from ..operators.ordering import dense_index
from ..operators.vocab_stats import fertility
from ..session import checkpointed, stored
from ..sources.vocab import vocab_from_pairs, with_specials
from . import views as v
from .registry import query

PIECES, LONGEST = unigram.SEED_SIZE, unigram.LONGEST_PIECE


def marked_words(spark, d):
    """word, cnt over the corpus: lowercased words with the word start mark."""
    return tallied(v.words(spark, d), "words").select(F.concat(F.lit(WORD_START), "token").alias("word"), "cnt")


SUBWORDS_SQL = v.WORDS_SQL + f""",
marked AS (SELECT '▁' || token AS word, count(*) AS cnt FROM words GROUP BY token),
starts AS (SELECT word, cnt, unnest(range(1, length(word) + 1)) AS s FROM marked),
subs AS (SELECT cnt, unnest(list_transform(range(1, least({LONGEST}, length(word) - s + 1) + 1), lambda n: substr(word, s, n))) AS piece FROM starts),
sub_counts AS (SELECT piece, CAST(sum(cnt) AS BIGINT) AS cnt FROM subs GROUP BY piece),
seeds AS (
  SELECT piece, cnt FROM sub_counts WHERE length(piece) = 1
  UNION ALL
  (SELECT piece, cnt FROM sub_counts WHERE length(piece) > 1 AND cnt > 1 ORDER BY cnt * length(piece) DESC, piece LIMIT {PIECES}))"""


@query("q_unigram_seeds", f"WITH {SUBWORDS_SQL} SELECT * FROM seeds")
def unigram_seeds(spark, d):
    return unigram.seed_pieces(marked_words(spark, d), PIECES, LONGEST)


def subword_vocab(spark, d, size=PIECES, longest=LONGEST):
    seeds = checkpointed(unigram.seed_pieces(marked_words(spark, d), size, longest))
    total = seeds.agg(F.sum("cnt")).scalar()
    ranked = dense_index(seeds.withColumn("_n", -F.col("cnt")), ["_n", "piece"], F.floor(-8 * F.ln("cnt")), name="_place")
    return checkpointed(ranked.select((F.col("_place") + 1).cast("int").alias("piece_id"), "piece", F.ln(F.col("cnt") / total).alias("score")))


# Best score per position of each word, position after position: bests[i] is the best score of the first i - 1 characters.
# And its number of pieces: ns[i]. Every character of the words is a piece, so nothing is unknown.
BEST_SQL = f"""{SUBWORDS_SQL},
pieces AS (SELECT piece, ln(cnt / (SELECT sum(cnt) FROM seeds)) AS score FROM seeds),
longest AS (SELECT max(length(piece)) AS m FROM pieces),
cuts AS (SELECT word, s, unnest(range(1, least((SELECT m FROM longest), length(word) - s + 1) + 1)) AS n FROM starts),
edges AS MATERIALIZED (
  SELECT word, CAST(s AS BIGINT) AS s, CAST(s + n - 1 AS BIGINT) AS e, score FROM cuts JOIN pieces ON piece = substr(word, s, n)),
best AS (
  SELECT word, CAST(0 AS BIGINT) AS e, [0.0::DOUBLE] AS bests, [0] AS ns FROM marked
  UNION ALL
  SELECT b.word, b.e + 1, list_append(any_value(b.bests), max(b.bests[g.s] + g.score)),
    list_append(any_value(b.ns), arg_max(b.ns[g.s] + 1, b.bests[g.s] + g.score))
  FROM best b JOIN edges g ON g.word = b.word AND g.e = b.e + 1 GROUP BY b.word, b.e),
solved AS (SELECT word, bests[-1] AS score, ns[-1] AS n FROM best WHERE e = length(word))"""


@query("q_encode_score", f"WITH RECURSIVE {BEST_SQL} SELECT word, round(score, 6) AS score FROM solved")
def encode_score(spark, d):
    words = marked_words(spark, d)
    return segment.encode_words(words, subword_vocab(spark, d)).select("word", F.round("score", 6).alias("score"))


@query("q_encode_unigram")
def encode_unigram(spark, d):
    docs = v.documents(spark, d, "doc_id", "text").select("doc_id", F.lower("text").alias("text"))
    vocab = subword_vocab(spark, d, unigram.SEED_SIZE, unigram.LONGEST_PIECE)
    out = segment.encode(docs, vocab, "text", ["doc_id"], "ids")
    return out.select("doc_id", F.size("ids").alias("n_tokens"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("q_fertility_unigram", f"""WITH RECURSIVE {BEST_SQL},
by_lang AS (SELECT lang, '▁' || token AS word, count(*) AS c FROM words GROUP BY ALL)
SELECT lang, round(sum(n * c) / sum(c), 9) AS fertility, round(sum(CASE WHEN n > 1 THEN c ELSE 0 END) / sum(c), 9) AS continued_share
FROM by_lang JOIN solved USING (word) GROUP BY lang""")
def fertility_unigram(spark, d):
    counts = v.lang_counts(spark, d).withColumn("word", F.concat(F.lit(WORD_START), "token"))
    encoded = segment.encode_words(counts.select("word").distinct(), subword_vocab(spark, d))
    pieces = counts.join(encoded.select("word", F.size("pieces").alias("n_pieces")), "word")
    out = fertility(pieces, ["lang"], weight="cnt")
    return out.select("lang", *[F.round(c, 9).alias(c) for c in ("fertility", "continued_share")])


@query("q_char_coverage", f"""WITH {v.WORDS_SQL}, chars AS (
  SELECT unnest(string_split('▁' || token, '')) AS char FROM words), c AS (SELECT char, count(*) AS cnt FROM chars WHERE char <> '' GROUP BY char),
cum AS (SELECT char, cnt, sum(cnt) OVER (ORDER BY cnt DESC, char ROWS UNBOUNDED PRECEDING) - cnt AS before, sum(cnt) OVER () AS total FROM c)
SELECT char, cnt FROM cum WHERE before < 0.9995 * total""")
def char_coverage(spark, d):
    return unigram.covered_characters(unigram.character_counts(marked_words(spark, d)))


@query("q_bpe_pairs", f"""WITH {v.WORDS_SQL}, marked AS (SELECT '▁' || token AS word, count(*) AS cnt FROM words GROUP BY token),
pairs AS (SELECT unnest(list_transform(range(1, length(word)), lambda i: substr(word, i, 2))) AS p, cnt FROM marked)
SELECT substr(p, 1, 1) AS "left", substr(p, 2, 1) AS "right", CAST(sum(cnt) AS BIGINT) AS n FROM pairs GROUP BY p""")
def bpe_pairs(spark, d):
    return bpe.pair_counts(bpe.as_symbols(marked_words(spark, d)))


@query("q_train_unigram")
def train_unigram(spark, d):
    return unigram.train_unigram(marked_words(spark, d), 2000)


@query("q_train_bpe")
def train_bpe(spark, d):
    return bpe.train_bpe(marked_words(spark, d), 150)[0]


# --- vocabularies of languages -------------------------------------------------------------------

SIZES = (500, 1000, 2000)


def vocab_set(spark, d, size=2000):
    """One vocabulary per language, in name order."""
    vocab = checkpointed(v.lang_vocab(spark, d, size))
    order = vocab.agg(F.sort_array(F.collect_set("lang"))).scalar()
    rows = vocab.withColumn("_langs", order)
    return rows.select(
        F.col("lang").alias("tokenizer"), (F.array_position("_langs", F.col("lang")) - 1).cast("int").alias("tok_ord"),
        "piece_id", "piece", "score", "type",
    )


def _merge_sql(score: str, size: int = 2000) -> str:
    return v.lang_vocab_sql(size) + f""",
ords AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS o FROM (SELECT DISTINCT lang FROM vocab)),
normal AS (SELECT piece, count(*) AS m, sum(exp(score)) AS mass, sum(score) AS total, min(o * 1000000 + piece_id) AS seen
  FROM vocab JOIN ords USING (lang) WHERE type = 'NORMAL' GROUP BY piece),
consts AS (SELECT count(*) AS n, (SELECT count(*) FROM normal) AS dd FROM ords),
scored AS (SELECT piece, {score} AS score, seen FROM normal, consts),
merged AS (
  SELECT row_number() OVER (ORDER BY round(score, 12) DESC, seen) + 2 AS piece_id, piece, score, 'NORMAL' AS type FROM scored
  UNION ALL SELECT piece_id, piece, score, type FROM vocab WHERE type <> 'NORMAL' AND lang = (SELECT min(lang) FROM vocab))"""


@query("q_merge_log", f"WITH {_merge_sql('ln(mass / n)')} SELECT piece_id, piece, round(score, 6) AS score, type FROM merged")
def merge_log(spark, d):
    return vm.merge(vocab_set(spark, d)).withColumn("score", F.round("score", 6))


@query("q_merge_rank", f"WITH {_merge_sql('(total - (n - m) * dd) / n')} SELECT piece_id, piece, round(score, 6) AS score, type FROM merged")
def merge_rank(spark, d):
    return vm.merge(vocab_set(spark, d), log_scores=False).withColumn("score", F.round("score", 6))


@query("q_merge_trim", f"WITH {_merge_sql('ln(mass / n)')} SELECT piece_id, piece, round(score, 6) AS score, type FROM merged WHERE piece_id < 1500")
def merge_trim(spark, d):
    return vm.trim(vm.merge(vocab_set(spark, d)), 1500).withColumn("score", F.round("score", 6))


def sized_vocabs(spark, d):
    """Vocabularies of several sizes per language, named <lang>_<size>."""
    base = vocab_set(spark, d, max(SIZES)).withColumnRenamed("tokenizer", "lang")
    sizes = F.array(*[F.lit(s) for s in SIZES])
    rows = base.select("*", F.posexplode(sizes).alias("size_ord", "size")).where(F.col("piece_id") < F.col("size") + 3)
    named = rows.withColumn("tokenizer", F.concat_ws("_", "lang", "size"))
    return vm.group_by_name(named.withColumn("tok_ord", F.col("tok_ord") * len(SIZES) + F.col("size_ord")), "^[a-z]+").drop("lang", "size", "size_ord")


@query("q_vocab_groups", v.lang_vocab_sql(2000).join(["WITH ", f""",
sized AS (SELECT lang AS grp, lang || '_' || s AS tokenizer, s FROM vocab, (VALUES {', '.join(f'({s})' for s in SIZES)}) t(s) WHERE piece_id < s + 3)
SELECT grp, tokenizer, count(*) AS size, CAST(row_number() OVER (PARTITION BY grp ORDER BY count(*), min(s)) - 1 AS INTEGER) AS size_rank
FROM sized GROUP BY grp, tokenizer"""]))
def vocab_groups(spark, d):
    return vm.ranked_groups(sized_vocabs(spark, d)).drop("tok_ord")


@query("q_vocab_types", f"""WITH {v.lang_vocab_sql(1000)}, s AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY piece_id) + 4 AS piece_id, piece, score FROM vocab WHERE type = 'NORMAL')
SELECT lang AS tokenizer, CAST(piece_id AS INTEGER) AS piece_id, piece, round(score, 6) AS score, 'NORMAL' AS type FROM s
UNION ALL SELECT lang, i, p, 0.0, CASE p WHEN '<unk>' THEN 'UNKNOWN' ELSE 'CONTROL' END FROM (SELECT DISTINCT lang FROM vocab),
  (VALUES (0, '<s>'), (1, '<pad>'), (2, '</s>'), (3, '<unk>'), (4, '<mask>')) t(i, p)""")
def vocab_types(spark, d):
    pairs = v.lang_vocab(spark, d, 1000).where(F.col("type") == "NORMAL")
    named = pairs.withColumn("place", F.col("piece_id") - 3).withColumnRenamed("lang", "tokenizer")
    return with_specials(vocab_from_pairs(named, "place", ["tokenizer"]), ["<s>", "<pad>", "</s>", "<unk>", "<mask>"]).withColumn("score", F.round("score", 6))


@query("q_merge_candidates")
def merge_candidates(spark, d):
    vocabs = checkpointed(sized_vocabs(spark, d))
    ranks = vm.ranked_groups(vocabs)
    groups = [(r["grp"], r["n"]) for r in ranks.groupBy("grp").agg(F.count("*").alias("n")).orderBy("grp").collect()]
    words, lines = vm.corpus_words(lower_lines(spark, d), "src", "line")
    words, lines = stored(words, "uses"), stored(lines, "line_counts")
    with_rank = vocabs.join(ranks.select("tokenizer", "size_rank"), "tokenizer")
    return vm.evaluate_candidates(marked_vocabs(with_rank), groups, {g: 0 for g, _ in groups}, words, lines)


#: Subword vocabularies of a language: its characters, and so many pieces of several characters.
SUBWORD_SIZES = (200, 1000, 5000)


def subword_vocabs(counts):
    """Three subword vocabularies for each language, named <lang>_<rank>, from one list of seeds per language of the words `counts`."""
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    parts = []
    for i, lang in enumerate(langs):
        seeds = unigram.seed_pieces(counts.where(F.col("lang") == lang).select("word", "cnt"), max(SUBWORD_SIZES), LONGEST)
        parts.append(seeds.select(F.lit(lang).alias("grp"), F.lit(i).alias("o"), "piece", "cnt"))
    seeds = stored(reduce(DataFrame.unionByName, parts), "lang_seeds")
    totals = seeds.groupBy("grp").agg(F.sum("cnt").alias("total"))
    single = F.length("piece") == 1
    # At most as many rows for each language as its largest vocabulary has.
    rank = F.row_number().over(Window.partitionBy("grp", single).orderBy((F.col("cnt") * F.length("piece")).desc(), "piece"))
    ranked = seeds.withColumn("rank", F.when(single, 0).otherwise(rank)).join(F.broadcast(totals), "grp")
    sized = ranked.select("*", F.posexplode(F.array(*map(F.lit, SUBWORD_SIZES))).alias("r", "n")).where("rank <= n")
    pieces = sized.select(
        F.concat_ws("_", "grp", "r").alias("tokenizer"), (F.col("o") * len(SUBWORD_SIZES) + F.col("r")).alias("tok_ord"), "grp",
        (F.col("rank") + 1).alias("piece_id"), "piece", F.ln(F.col("cnt") / F.col("total")).alias("score"), F.lit("NORMAL").alias("type"),
    )
    heads = pieces.select("tokenizer", "tok_ord", "grp").distinct()
    unknown = heads.select("*", F.lit(0).alias("piece_id"), F.lit("<unk>").alias("piece"), F.lit(0.0).alias("score"), F.lit("UNKNOWN").alias("type"))
    return stored(pieces.unionByName(unknown), "subwords")


def _round_sql(i: int) -> str:
    """Candidates of a round: scores, best splits of all words, sizes and metrics."""
    return f"""
scored{i} AS (SELECT cand, piece, ln(sum(exp(score)) / (SELECT count(*) FROM ords)) AS score FROM tok JOIN ptr{i} USING (lang, r) GROUP BY cand, piece),
edges{i} AS MATERIALIZED (SELECT cand, word, CAST(s AS BIGINT) AS s, CAST(s + n - 1 AS BIGINT) AS e, score FROM cuts JOIN scored{i} ON piece = substr(word, s, n)),
best{i} AS (
  SELECT cand, word, CAST(0 AS BIGINT) AS e, [0.0::DOUBLE] AS bests, [0] AS ns FROM every, (SELECT DISTINCT cand FROM ptr{i})
  UNION ALL
  SELECT b.cand, b.word, b.e + 1, list_append(any_value(b.bests), max(b.bests[g.s] + g.score)),
    list_append(any_value(b.ns), arg_max(b.ns[g.s] + 1, b.bests[g.s] + g.score))
  FROM best{i} b JOIN edges{i} g ON g.cand = b.cand AND g.word = b.word AND g.e = b.e + 1 GROUP BY b.cand, b.word, b.e),
solved{i} AS (SELECT cand, word, ns[-1] AS n FROM best{i} WHERE e = length(word)),
totals{i} AS (SELECT cand, lang, sum(n * cnt) AS total FROM marked JOIN solved{i} USING (word) GROUP BY cand, lang),
metric{i} AS (SELECT cand, avg(total / n_lines) AS metric FROM totals{i} JOIN line_counts USING (lang) GROUP BY cand),
size{i} AS (SELECT cand, count(*) + 1 AS size FROM scored{i} GROUP BY cand)"""


@query("q_merge_subwords", f"""WITH RECURSIVE {v.WORDS_SQL}, {v.LINES_SQL},
marked AS (SELECT lang, '▁' || token AS word, count(*) AS cnt FROM words GROUP BY lang, token),
every AS (SELECT DISTINCT word FROM marked),
line_counts AS (SELECT src AS lang, count(*) AS n_lines FROM lines GROUP BY src),
starts AS (SELECT lang, word, cnt, unnest(range(1, length(word) + 1)) AS s FROM marked),
subs AS (SELECT lang, cnt, unnest(list_transform(range(1, least({LONGEST}, length(word) - s + 1) + 1), lambda n: substr(word, s, n))) AS piece FROM starts),
sub_counts AS (SELECT lang, piece, CAST(sum(cnt) AS BIGINT) AS cnt FROM subs GROUP BY lang, piece),
ranked AS (
  SELECT lang, piece, cnt, 0 AS rk FROM sub_counts WHERE length(piece) = 1
  UNION ALL
  SELECT lang, piece, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt * length(piece) DESC, piece) AS rk FROM sub_counts WHERE length(piece) > 1 AND cnt > 1),
kept AS (SELECT lang, piece, rk, ln(cnt / sum(cnt) OVER (PARTITION BY lang)) AS score FROM ranked WHERE rk <= {max(SUBWORD_SIZES)}),
tok AS (SELECT lang, t.r, piece, score FROM kept JOIN (VALUES {', '.join(f'({r}, {n})' for r, n in enumerate(SUBWORD_SIZES))}) t(r, n) ON rk <= n),
ords AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS o FROM (SELECT DISTINCT lang FROM marked)),
mostly AS (SELECT max(length(piece)) AS m FROM kept),
cuts AS (SELECT word, s, unnest(range(1, least((SELECT m FROM mostly), length(word) - s + 1) + 1)) AS n FROM (SELECT word, unnest(range(1, length(word) + 1)) AS s FROM every)),
ptr1 AS (SELECT c.o AS cand, g.lang, CASE WHEN c.o = g.o THEN 1 ELSE 0 END AS r FROM ords c, ords g),{_round_sql(1)},
winner AS (SELECT cand AS w FROM metric1 ORDER BY round(metric, 9), cand LIMIT 1),
ptr2 AS (SELECT c.o AS cand, g.lang, CASE WHEN c.o = g.o THEN 1 ELSE 0 END + CASE WHEN g.o = w THEN 1 ELSE 0 END AS r FROM ords c, ords g, winner),{_round_sql(2)}
SELECT 1 AS round, cand, lang AS grp, size, round(metric, 9) AS metric FROM metric1 JOIN size1 USING (cand) JOIN ords ON o = cand
UNION ALL SELECT 2, cand, lang, size, round(metric, 9) FROM metric2 JOIN size2 USING (cand) JOIN ords ON o = cand""")
def merge_subwords(spark, d):
    """Two rounds of the greedy merge over subword vocabularies: every candidate with its size and metric."""
    counts = stored(v.lang_counts(spark, d).select("lang", F.concat(F.lit(WORD_START), "token").alias("word"), "cnt"), "lang_words")
    vocabs = subword_vocabs(counts)
    ranks = vm.ranked_groups(vocabs)
    vocabs = stored(vocabs.join(F.broadcast(ranks.select("tokenizer", "size_rank")), "tokenizer"), "ranked")
    names = sorted(r["grp"] for r in ranks.select("grp").distinct().collect())
    groups, pointers = [(g, len(SUBWORD_SIZES)) for g in names], dict.fromkeys(names, 0)
    uses = counts.groupBy("word").agg(F.collect_list(F.struct(F.col("lang").alias("src"), "cnt")).alias("uses"))
    words = stored(uses, "uses")
    lines = stored(v.document_lines(spark, d).groupBy("src").agg(F.count("*").alias("n_lines")), "line_counts")
    metric = partial(vm.mean_sentence_length, prepared=vm.word_lattices(words, vocabs.where(F.col("type") == "NORMAL")))
    rounds = []
    for i in (1, 2):
        found = stored(vm.evaluate_candidates(vocabs, groups, pointers, words, lines, metric).withColumn("metric", F.round("metric", 9)), "candidates")
        rounds.append(found.select(F.lit(i).alias("round"), "cand", "grp", "size", "metric"))
        pointers[vm.best_candidate(found).first()["grp"]] += 1
    return rounds[0].unionByName(rounds[1])


def lower_lines(spark, d):
    lines = v.document_lines(spark, d)
    return lines.select("src", "doc_id", "pos", F.lower("line").alias("line"))


def marked_vocabs(vocabs):
    """Word vocabularies as piece vocabularies: ordinary pieces carry the word start mark."""
    marked = F.when(F.col("type") == "NORMAL", F.concat(F.lit(WORD_START), "piece")).otherwise(F.col("piece"))
    return vocabs.withColumn("piece", marked)


@query("q_greedy_merge")
def greedy_merge(spark, d):
    vocabs = marked_vocabs(sized_vocabs(spark, d))
    out = vm.greedy_merge(vocabs, lower_lines(spark, d), 3000, key=["doc_id", "pos"])
    return out.vocab


# --- decomposition and clusters ------------------------------------------------------------------


def lsa_input(spark, d):
    from .vector_queries import word_tfidf

    weights, frequency = word_tfidf(spark, d)
    terms = checkpointed(vz.term_table(frequency))
    docs = v.table(spark, d, "documents").select("doc_id")
    rows = stored(vz.sparse_rows(weights, terms, "doc_id", docs), "rows")
    return rows, terms, vz.long_weights(weights, "doc_id")


@query("q_svd")
def svd(spark, d):
    rows, terms, weights = lsa_input(spark, d)
    embedded, values, _ = decompose.truncated_svd(rows, "doc_id", terms.count(), 10)
    n = v.table(spark, d, "documents").count()
    ratio = decompose.explained_variance(embedded, "embedding", weights, n)
    singular = F.array(*[F.lit(round(float(x), 4)) for x in values])
    return ratio.select(F.posexplode(singular).alias("component", "singular_value"), F.round("explained_variance", 4).alias("explained_variance"))


@query("q_svd_full_rank", f"""WITH {v.WORDS_SQL}, c AS (SELECT DISTINCT doc_id, token FROM words),
top AS (SELECT token FROM c GROUP BY token ORDER BY count(*) DESC, token LIMIT 24)
SELECT (SELECT count(*) FROM documents) AS n_docs, round(count(*)::DOUBLE, 4) AS squares, 1.0::DOUBLE AS explained_variance FROM c WHERE token IN (SELECT token FROM top)""")
def svd_full_rank(spark, d):
    """At full rank, over the most frequent terms: the squared singular values add up to the squared weights, nothing is lost."""
    counts = token_counts(v.words(spark, d, "doc_id"), ["doc_id"], "words").select("doc_id", "token", F.lit(1.0).alias("weight"))
    counts = checkpointed(counts)
    top = counts.groupBy("token").agg(F.count("*").alias("df")).orderBy(F.col("df").desc(), "token").limit(24)
    terms = checkpointed(vz.term_table(top))
    weights = checkpointed(counts.join(F.broadcast(terms.select("token")), "token"))
    rows = checkpointed(vz.sparse_rows(weights, terms, "doc_id", v.table(spark, d, "documents")))
    embedded, values, _ = decompose.truncated_svd(rows, "doc_id", 24, 24)
    n = rows.count()
    ratio = decompose.explained_variance(embedded, "embedding", weights, n)
    squares = F.lit(round(float((values**2).sum()), 4))
    return ratio.select(F.lit(n).cast("long").alias("n_docs"), squares.alias("squares"), F.round("explained_variance", 4).alias("explained_variance"))


@query("q_kmeans")
def kmeans(spark, d):
    rows, terms, _ = lsa_input(spark, d)
    embedded, _, _ = decompose.truncated_svd(rows, "doc_id", terms.count(), 20)
    unit = checkpointed(vz.l2_normalize(embedded, "embedding"))
    labelled, _ = clustering.kmeans(unit, "embedding", 8)
    return labelled.groupBy("cluster").agg(F.count("*").alias("n_docs"))


@query("q_silhouette_tfidf")
def silhouette_tfidf(spark, d):
    rows, _, _ = lsa_input(spark, d)
    langs = v.table(spark, d, "documents").select("doc_id", "lang")
    return clustering.silhouette(rows.join(langs, "doc_id"), "doc_id", "lang", 2000, 0)
