"""Queries that write files to the shared folder and read them back."""

from __future__ import annotations

import lzma

import pandas as pd
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from ..functions.arrays import argmax
from ..functions.rows import explode_rows
from ..operators import clustering, scoring
from ..operators import vectorize as vz
from ..operators.ordering import percent_split, start_lines
from ..session import scratch_path
from ..sinks import writers as wr
from ..sources import tables as tb
from ..sources import text as st
from ..sources.vocab import read_vocabs
from ..streaming import counters
from . import views as v
from .label_queries import SCORES_SQL, joined
from .model_queries import vocab_set
from .registry import query
from .result_queries import GRID_SQL, REGIME_SQL, by_regime
from .text_queries import LINE_KEY, START_LINES_SQL, source_documents
from .vector_queries import word_tfidf


def in_files(docs):
    """Documents with the name of a file of their language, for at most a hundred of them, in order."""
    named = docs.withColumn("file", F.concat_ws("-", "lang", F.floor(F.col("doc_id") / 100)))
    return named.repartition("file").sortWithinPartitions("file", "doc_id")


NUMBERED_SQL = f"""SELECT lang || '-' || doc_id // 100 AS src,
  row_number() OVER (PARTITION BY lang, doc_id // 100 ORDER BY doc_id, pos) - 1 AS line_no, line
FROM (SELECT src AS lang, doc_id, pos, line FROM lines)"""


@query("q_read_lines", f"WITH {v.LINES_SQL} {NUMBERED_SQL}")
def read_lines(spark, d):
    path = scratch_path(spark, "lines")
    in_files(v.documents(spark, d, "doc_id", "lang", "text")).select("file", "text").write.partitionBy("file").text(path)
    lines = st.read_lines(spark, path)
    return lines.select(F.regexp_extract("src", "file=([^/]+)", 1).alias("src"), "line_no", "line")


DOCUMENTS_SQL = rf"""SELECT lang || '-' || doc_id // 100 AS cluster,
  row_number() OVER w - 1 AS doc_ord,
  CAST(coalesce(sum(len(string_split(text, chr(10))) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS start_line,
  array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{v.STRIP}+$', '')), ' ') AS text
FROM documents WINDOW w AS (PARTITION BY lang, doc_id // 100 ORDER BY doc_id)"""


@query("q_read_documents", DOCUMENTS_SQL)
def read_documents(spark, d):
    path = scratch_path(spark, "clusters")
    docs = in_files(v.documents(spark, d, "doc_id", "lang", "text")).select("file", F.split("text", "\n").alias("lines"))
    wr.write_clusters(docs, path, "file")
    back = st.read_documents(spark, path)
    return back.select(F.regexp_extract("src", "cluster=([^/]+)", 1).alias("cluster"), "doc_ord", "start_line", "text")


def _pack(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("doc_id")
    body = "".join(f"{text}\n\n" for text in part["text"]).encode("utf-8")
    # The fast preset: packing took two thirds of the query's task seconds with the default one.
    return pd.DataFrame({"src": [part["name"].iloc[0]], "content": [lzma.compress(body, preset=1)]})


@query("q_read_xz", rf"""SELECT source || '/' || doc_id // 100 AS src,
  array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{v.STRIP}+|{v.STRIP}+$', '', 'g')), ' ') AS text FROM documents""")
def read_xz(spark, d):
    docs = v.documents(spark, d, "source", "doc_id", "text")
    # A file holds at most a hundred documents of a source, however large the source is.
    named = docs.withColumn("name", F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100)))
    files = named.groupBy("name").applyInPandas(_pack, "src string, content binary")
    path = scratch_path(spark, "xz")
    files.write.parquet(path)
    back = st.documents_from_xz(spark.read.parquet(path))
    return back.select("src", F.array_join("lines", " ").alias("text"))


@query("q_vocab_roundtrip", f"WITH {v.lang_vocab_sql(2000)} SELECT lang AS tokenizer, piece_id, piece, round(score, 6) AS score, type FROM vocab")
def vocab_roundtrip(spark, d):
    path = scratch_path(spark, "vocab")
    wr.write_vocabs_tsv(vocab_set(spark, d), path)
    langs = [r["lang"] for r in v.table(spark, d, "documents").select("lang").distinct().collect()]
    back, missing = read_vocabs(spark, {name: f"{path}/tokenizer={name}" for name in [*langs, "none"]})
    if missing != ["none"]:
        raise ValueError(f"vocabularies not found: {missing}")
    return back.withColumn("score", F.round("score", 6))


@query("q_vocab_json", f"WITH {v.lang_vocab_sql(2000)} SELECT lang AS tokenizer, piece_id AS id, piece FROM vocab")
def vocab_json(spark, d):
    path = scratch_path(spark, "vocab-json")
    wr.write_vocabs_json(vocab_set(spark, d), path)
    return spark.read.schema("piece string, id int, tokenizer string").json(path)


@query("q_text_splits", f"""WITH {v.LINES_SQL}
SELECT CASE WHEN substr({LINE_KEY.format(5)}, 1, 8) < '0ccccccc' THEN 'validation' ELSE 'train' END AS split, line AS text FROM lines""")
def text_splits(spark, d):
    path = scratch_path(spark, "splits")
    lines = percent_split(v.document_lines(spark, d), F.concat_ws(":", "doc_id", "pos"), 5, 5)
    lines.select("split", F.col("line").alias("value")).write.partitionBy("split").text(path)
    back = st.read_splits(spark, {s: [f"{path}/split={s}"] for s in ("train", "validation")})
    return st.drop_blank(back)


@query("q_labelled_json", f"""WITH {v.SEQUENCES_SQL}
SELECT string_agg(w, ' ' ORDER BY idx) AS tokens, string_agg(tag, ' ' ORDER BY idx) AS ner_tags FROM seq GROUP BY doc_id, pos""")
def labelled_json(spark, d):
    path = scratch_path(spark, "labelled") + ".json"
    v.sequences(spark, d).select("tokens", F.col("tags").alias("ner_tags")).write.json(path)
    back = tb.read_labelled(spark, path, "tokens array<string>, ner_tags array<string>")
    text, label = tb.resolve_columns(back.columns, "ner")
    return back.select(joined(F.col(text)).alias("tokens"), joined(F.col(label)).alias("ner_tags"))


@query("q_labelled_csv", """SELECT a.role AS premise, b.role AS hypothesis, CAST(length(a.text) % 3 AS INTEGER) AS label, count(*) AS n
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY ALL""")
def labelled_csv(spark, d):
    path = scratch_path(spark, "pairs") + ".csv"
    turns = v.table(spark, d, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("hypothesis"))
    pairs = turns.join(after, ["conv_id", "turn"]).select(
        F.col("role").alias("premise"), "hypothesis", (F.length("text") % 3).alias("label")
    )
    pairs.write.option("header", True).csv(path)
    back = tb.read_labelled(spark, path, "premise string, hypothesis string, label int")
    return back.groupBy("premise", "hypothesis", "label").agg(F.count("*").alias("n"))


@query("q_labelled_corpus", f"""WITH {v.SEQUENCES_SQL} SELECT doc_id, pos, count(*) AS n_tokens FROM seq WHERE src = 'de' GROUP BY doc_id, pos
HAVING substr(md5(concat_ws(':', concat_ws(':', doc_id, pos), '5')), 1, 8) >= '0ccccccc'""")
def labelled_corpus(spark, d):
    path = scratch_path(spark, "corpus")
    rows = percent_split(v.sequences(spark, d), F.concat_ws(":", "doc_id", "pos"), 5, 5)
    stored = rows.select(F.lit("ner").alias("task"), F.col("src").alias("lang"), "split", "doc_id", "pos", "tokens")
    stored.write.partitionBy("task", "lang", "split").parquet(path)
    part = tb.labelled_corpus(spark, path, "ner", "de", "train")
    return part.select("doc_id", "pos", F.size("tokens").cast("long").alias("n_tokens"))


@query("q_doc_to_label", f"WITH {START_LINES_SQL} SELECT src || ':' || start_line AS place, CAST(doc_id % 8 AS INTEGER) AS label FROM starts")
def doc_to_label(spark, d):
    path = scratch_path(spark, "doc-to-label")
    placed = start_lines(source_documents(spark, d)).withColumn("label", (F.col("doc_id") % 8).cast("int"))
    wr.write_document_labels(placed, path, "label")
    return spark.read.schema("place string, label int").option("sep", "\t").csv(path)


@query("q_predictions_tsv", f'WITH {SCORES_SQL} SELECT vec_id AS "index", pred AS prediction FROM preds')
def predictions_tsv(spark, d):
    path = scratch_path(spark, "predictions")
    rows = v.embeddings(spark, d).select("vec_id", argmax(F.col("embedding")).alias("pred"))
    wr.write_predictions_tsv(rows, path, "vec_id", "pred")
    return spark.read.schema("index long, prediction int").option("sep", "\t").option("header", True).csv(path)


LANG_CLASS_SQL = v.SEQUENCES_SQL + """,
sizes AS (SELECT src, class, count(*) FILTER (WHERE tag = class) AS support, count(*) FILTER (WHERE pred = class) AS n_pred,
    count(*) FILTER (WHERE tag = class AND pred = class) AS tp
  FROM seq JOIN (SELECT DISTINCT tag AS class FROM seq) ON tag = class OR pred = class GROUP BY src, class),
by_lang AS (SELECT src, avg(tp / n_pred) AS precision, avg(tp / support) AS recall, avg(2 * tp / (n_pred + support)) AS f1, sum(tp) / sum(support) AS accuracy
  FROM sizes GROUP BY src)"""
METRICS = ("accuracy", "f1", "recall", "precision")


@query("q_metrics_sink", f"WITH {LANG_CLASS_SQL} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, src AS lang, round({m}, 6) AS value FROM by_lang" for m in METRICS))
def metrics_sink(spark, d):
    path = scratch_path(spark, "metrics")
    seqs = explode_rows(v.sequences(spark, d), ["src"], F.arrays_zip("tags", "preds"), "z")
    pairs = seqs.select("src", F.col("z.tags").alias("tag"), F.col("z.preds").alias("pred"))
    scores = scoring.macro_scores(pairs, "tag", "pred", ["src"])
    wr.write_metric_records(scores, path, "src", METRICS)
    back = spark.read.text(path).select("metric", "lang", F.from_json("value", "map<string,double>").alias("record"))
    return back.select("metric", "lang", F.round(F.element_at("record", F.concat(F.lit("eval_"), "metric")), 6).alias("value"))


@query("q_read_results", f"WITH {REGIME_SQL} SELECT model, seed, lang_src, lang_tgt, round(value, 9) AS value FROM regimes WHERE regime = 'in'")
def read_results(spark, d):
    path = scratch_path(spark, "results")
    wr.write_results(by_regime(spark, d, "in"), path, "f1")
    return tb.read_results(spark, path, "f1").withColumn("value", F.round("value", 9))


@query("q_missing_results", f"WITH {GRID_SQL} SELECT model, seed, lang_src, lang_tgt FROM grid ANTI JOIN (SELECT * FROM results WHERE lang_src = lang_tgt) USING (model, seed, lang_src, lang_tgt) WHERE lang_src = lang_tgt")
def missing_results(spark, d):
    path = scratch_path(spark, "results")
    wr.write_results(by_regime(spark, d, "in"), path, "f1")
    keys = ["model", "seed", "lang_src", "lang_tgt"]
    grid = tb.experiment_grid(v.results(spark, d), keys).where(F.col("lang_src") == F.col("lang_tgt"))
    return tb.missing_cells(grid, tb.read_results(spark, path, "f1"), keys)


@query("q_fitted_tables")
def fitted_tables(spark, d):
    """Weights, term table and a clustering model, written and read back."""
    path = scratch_path(spark, "fitted")
    weights, frequency = word_tfidf(spark, d)
    wr.write_table(vz.long_weights(weights, "doc_id"), f"{path}/tfidf")
    wr.write_table(vz.term_table(frequency), f"{path}/terms")
    rows = v.embeddings(spark, d)
    labelled, model = clustering.kmeans(rows, "embedding", 10, starts=2)
    model.write().save(f"{path}/kmeans")
    centers = KMeansModel.load(f"{path}/kmeans").clusterCenters()
    agreement = clustering.agreement(labelled, "label", "cluster")
    wr.write_json_record(agreement, f"{path}/metrics")
    metrics = spark.read.schema("homogeneity double, completeness double, adjusted_rand double, v_measure double").json(f"{path}/metrics")
    sizes = [(spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).withColumn("part", F.lit(name))) for name in ("tfidf", "terms")]
    out = sizes[0].unionByName(sizes[1]).withColumn("n_centers", F.lit(len(centers)))
    return out.withColumn("v_measure", F.round(metrics.select("v_measure").scalar(), 6))


@query("q_stream_counter", f"WITH {v.WORDS_SQL} SELECT token, count(*) AS cnt FROM words GROUP BY token")
def stream_counter(spark, d):
    path = scratch_path(spark, "stream")
    schema = v.table(spark, d, "documents").schema
    # A pattern, as a stream takes a table of one file only by one; the table may also be a folder of files.
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]")
    counters.count_stream(stream, "text", f"{path}/counts", f"{path}/state").awaitTermination()
    return counters.corpus_counts(spark, f"{path}/counts")
