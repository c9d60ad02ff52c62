"""Queries over labelled sequences, model inputs and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import argmax
from ..functions.rows import explode_rows
from ..operators import examples as ex
from ..operators import labels as lb
from ..operators import scoring as sc
from ..operators.ordering import dense_index
from ..session import checkpointed
from . import views as v
from .registry import query


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


IN_ORDER = "len(ids) > 0"


@query("q_encode_pad", f"""WITH {v.TOKEN_IDS_SQL},
cut AS (SELECT src, doc_id, pos, list_concat(list_concat([0], ids[1:126]), [2]) AS ids FROM token_ids),
sized AS (SELECT *, len(ids) AS n, (len(ids) + 7) // 8 * 8 AS m FROM cut),
padded AS (SELECT *, list_concat(ids, list_transform(range(m - n), lambda i: 1)) AS full_ids FROM sized)
SELECT src, doc_id, pos, array_to_string(full_ids, ' ') AS input_ids,
  array_to_string(list_transform(range(m), lambda i: CASE WHEN i < n THEN 1 ELSE 0 END), ' ') AS attention_mask,
  array_to_string(list_transform(full_ids, lambda x: CASE WHEN x IN (0, 1, 2) THEN 1 ELSE 0 END), ' ') AS special_tokens_mask
FROM padded""")
def encode_pad(spark, d):
    rows = v.token_ids(spark, d)
    rows = rows.withColumn("ids", ex.add_special(F.col("ids"), 128))
    out = ex.model_inputs(rows, "ids", multiple=8)
    cols = ("input_ids", "attention_mask", "special_tokens_mask")
    return out.select("src", "doc_id", "pos", *[joined(c).alias(c) for c in cols])


@query("q_blocks", f"""WITH {v.TOKEN_IDS_SQL},
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS row_no FROM token_ids),
toks AS (SELECT row_no // 1000 AS batch, row_no, generate_subscripts(ids, 1) AS j, unnest(ids) AS id FROM numbered),
placed AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY row_no, j) - 1 AS o, count(*) OVER (PARTITION BY batch) AS total FROM toks)
SELECT batch, CAST(o // 128 AS INTEGER) AS block, string_agg(id, ' ' ORDER BY o) AS ids
FROM placed GROUP BY batch, o // 128 HAVING count(*) = 128 OR max(total) < 128""")
def blocks(spark, d):
    rows = v.token_ids(spark, d)
    numbered = dense_index(rows, ["doc_id", "pos"], F.floor(F.col("doc_id") / 1000))
    return ex.blocks(numbered, "row_no", "ids", 128).select("batch", "block", joined("ids").alias("ids"))


@query("q_mask_tokens", f"""WITH {v.TOKEN_IDS_SQL},
cut AS (SELECT doc_id, pos, list_concat(list_concat([0], ids[1:126]), [2]) AS ids FROM token_ids),
toks AS (SELECT doc_id, pos, generate_subscripts(ids, 1) - 1 AS i, unnest(ids) AS id FROM cut),
drawn AS (SELECT *, md5(concat_ws(':', concat_ws(':', doc_id, pos), i, '13')) AS u FROM toks),
chosen AS (SELECT *, id NOT IN (0, 1, 2) AND substr(u, 1, 8) < '26666666' AS hit FROM drawn),
done AS (SELECT *, CASE WHEN NOT hit THEN id WHEN substr(u, 9, 8) < 'cccccccc' THEN 4 WHEN substr(u, 9, 8) < 'e6666666'
    THEN ('0x' || substr(u, 17, 6))::INTEGER % 30005 ELSE id END AS masked, CASE WHEN hit THEN id ELSE -100 END AS label FROM chosen)
SELECT doc_id, pos, string_agg(masked, ' ' ORDER BY i) AS masked_ids, string_agg(label, ' ' ORDER BY i) AS labels FROM done GROUP BY ALL""")
def mask_tokens(spark, d):
    rows = v.token_ids(spark, d).withColumn("ids", ex.add_special(F.col("ids"), 128))
    out = ex.mask_tokens(rows, "ids", F.concat_ws(":", "doc_id", "pos"), 13, 30005)
    return out.select("doc_id", "pos", joined("masked_ids").alias("masked_ids"), joined("labels").alias("labels"))


TURN_PAIRS_SQL = rf"""turn_ids AS (
  SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(text, '{v.STRIP}+'), lambda w: w <> ''),
    lambda w: CAST(('0x' || substr(md5(w), 1, 6))::INTEGER % 30000 + 5 AS INTEGER)) AS ids FROM conversations),
turn_pairs AS (SELECT a.conv_id, a.turn, a.ids AS a, b.ids AS b FROM turn_ids a JOIN turn_ids b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
kept AS (SELECT *, least(len(a), greatest(30, 60 - len(b))) AS ka FROM turn_pairs),
enc AS (SELECT conv_id, turn, list_concat(list_concat(list_concat([0], a[1:ka]), [2, 2]), list_concat(b[1:least(len(b), 60 - ka)], [2])) AS ids FROM kept)"""


def turn_pairs(spark, d):
    from ..functions.text import space_words

    rows = v.spread(v.table(spark, d, "conversations").select("conv_id", "turn", "text"))
    slot = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 6), 16, 10).cast("int") % 30000 + 5
    ids = rows.select("conv_id", "turn", F.transform(space_words(F.col("text")), slot).alias("ids"))
    after = ids.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("b"))
    return ids.withColumnRenamed("ids", "a").join(after, ["conv_id", "turn"])


@query("q_pair_encode", f"WITH {TURN_PAIRS_SQL} SELECT conv_id, turn, array_to_string(ids, ' ') AS ids, len(ids) AS n FROM enc")
def pair_encode(spark, d):
    ids = turn_pairs(spark, d).withColumn("ids", ex.add_special_pair(F.col("a"), F.col("b"), 64))
    return ids.select("conv_id", "turn", joined("ids").alias("ids"), F.size("ids").cast("long").alias("n"))


@query("q_pair_split", f"""WITH {TURN_PAIRS_SQL},
cut AS (SELECT *, list_position(ids, 2) AS c FROM enc),
parts AS (SELECT conv_id, turn, ids[1:c] AS a, list_concat([0], ids[c + 2:]) AS b FROM cut)
SELECT conv_id, turn, array_to_string(list_concat(a, list_transform(range(64 - len(a)), lambda i: 1)), ' ') AS ids_a,
  array_to_string(list_concat(b, list_transform(range(64 - len(b)), lambda i: 1)), ' ') AS ids_b, len(a) AS n_a, len(b) AS n_b FROM parts""")
def pair_split(spark, d):
    ids = turn_pairs(spark, d).select("conv_id", "turn", ex.add_special_pair(F.col("a"), F.col("b"), 64).alias("ids"))
    out = ex.split_pair(ids, "ids", 64)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(
        "conv_id", "turn", joined("ids_a").alias("ids_a"), joined("ids_b").alias("ids_b"), total("mask_a").alias("n_a"), total("mask_b").alias("n_b")
    )


LABELS_SQL = v.SEQUENCES_SQL + """,
label_ids AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT tag AS label FROM seq)),
label_table AS (SELECT l.label, CAST(l.id AS INTEGER) AS label_id, CAST(coalesce(i.id, l.id) AS INTEGER) AS inside_id
  FROM label_ids l LEFT JOIN label_ids i ON l.label LIKE 'B-%' AND i.label = replace(l.label, 'B-', 'I-'))"""


@query("q_label_list", f"WITH {LABELS_SQL} SELECT * FROM label_table")
def label_list(spark, d):
    return lb.label_table(v.sequences(spark, d), "tags")


@query("q_label_reorder", f"""WITH {LABELS_SQL},
by_count AS (SELECT tag AS label, row_number() OVER (ORDER BY count(*) DESC, tag) - 1 AS id FROM seq GROUP BY tag)
SELECT 'same' AS model, label, CAST(id AS INTEGER) AS label_id, true AS adopted FROM by_count
UNION ALL SELECT 'fewer', label, label_id, false FROM label_table""")
def label_reorder(spark, d):
    seqs = v.sequences(spark, d)
    dataset = lb.label_table(seqs, "tags").select("label", "label_id")
    counts = explode_rows(seqs, [], "tags", "label").groupBy("label").agg(F.count("*").alias("n"))
    ordered = counts.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "label"))).alias("o"))
    model = ordered.select(F.posexplode("o.label").alias("label_id", "label"))
    fewer = model.where(F.col("label_id") > 0)
    return lb.adopt_order(dataset, model).withColumn("model", F.lit("same")).unionByName(
        lb.adopt_order(dataset, fewer).withColumn("model", F.lit("fewer"))
    )


@query("q_label_align", f"""WITH {LABELS_SQL},
pieces AS (SELECT src, doc_id, pos, idx, tag, (length(w) + 3) // 4 AS n FROM seq),
exploded AS (SELECT src, doc_id, pos, idx, tag, unnest(range(n)) AS j FROM pieces),
placed AS (SELECT *, row_number() OVER (PARTITION BY src, doc_id, pos ORDER BY idx, j) AS spot FROM exploded),
named AS (SELECT p.*, first_value(spot) OVER (PARTITION BY src, doc_id, pos, idx ORDER BY j) AS first_at,
  label_id, inside_id FROM placed p JOIN label_table ON tag = label),
cut AS (SELECT * FROM named WHERE spot <= 62)
SELECT src, doc_id, pos, '-100 ' || string_agg(CASE WHEN j = 0 THEN label_id ELSE -100 END, ' ' ORDER BY spot) || ' -100' AS label_ids,
  '-100 ' || string_agg(CASE WHEN j = 0 THEN label_id ELSE inside_id END, ' ' ORDER BY spot) || ' -100' AS all_label_ids,
  '0 ' || string_agg(first_at, ' ' ORDER BY spot) || ' ' || (max(spot) + 1) AS first_piece FROM cut GROUP BY ALL""")
def label_align(spark, d):
    seqs = v.sequences(spark, d).select("src", "doc_id", "pos", "tokens", "tags")
    # Read for both kinds of labels.
    labels = checkpointed(lb.label_array(seqs, "tags"))
    counts = F.transform("tokens", lambda w: F.ceil(F.length(w) / 4).cast("int"))
    rows = seqs.select("src", "doc_id", "pos", "tags", counts.alias("n_pieces"))
    plain = lb.align_labels(rows, "tags", "n_pieces", labels, 64)
    both = lb.align_labels(plain.withColumnsRenamed({"label_ids": "plain", "first_piece": "first"}), "tags", "n_pieces", labels, 64, True)
    return both.select(
        "src", "doc_id", "pos", joined("plain").alias("label_ids"), joined("label_ids").alias("all_label_ids"), joined("first").alias("first_piece")
    )


SCORES_SQL = """scores AS (SELECT vec_id, label, embedding::DOUBLE[] AS s FROM embeddings),
preds AS (SELECT vec_id, label, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS pred FROM scores)"""


def predictions(spark, d):
    rows = v.embeddings(spark, d)
    return rows.select("vec_id", "label", argmax(F.col("embedding")).alias("pred"))


@query("q_argmax", f"WITH {SCORES_SQL} SELECT * FROM preds")
def argmax_scores(spark, d):
    return predictions(spark, d)


@query("q_accuracy", f"""WITH {SCORES_SQL}, cut AS (SELECT label, pred FROM preds WHERE label <> 0)
SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM cut""")
def accuracy(spark, d):
    rows = predictions(spark, d)
    # Label 0 plays padding: its positions carry the ignored label.
    hidden = F.when(F.col("label") == 0, F.lit(sc.IGNORED)).otherwise(F.col("label"))
    seqs = rows.select(F.array(hidden).alias("y"), F.array("pred").alias("p"))
    kept = explode_rows(seqs, [], sc.scored_positions(F.col("y"), F.col("p")), "s").select("s.label", "s.pred")
    return sc.accuracy(kept, "label", "pred").select(F.round("accuracy", 6).alias("accuracy"))


@query("q_entities_f1", f"""WITH {v.SEQUENCES_SQL},
both_kinds AS (SELECT doc_id, pos, idx, 'gold' AS kind, tag AS t FROM seq UNION ALL SELECT doc_id, pos, idx, 'pred', pred FROM seq),
prev AS (SELECT *, lag(t, 1, 'O') OVER (PARTITION BY kind, doc_id, pos ORDER BY idx) AS pt FROM both_kinds),
flagged AS (SELECT *, CASE WHEN t = 'O' THEN 0 WHEN t LIKE 'B-%' OR pt = 'O' OR substr(pt, 3) <> substr(t, 3) THEN 1 ELSE 0 END AS begins FROM prev),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY kind, doc_id, pos ORDER BY idx) AS ent FROM flagged),
ents AS (SELECT kind, doc_id, pos, substr(t, 3) AS type, min(idx) AS a, max(idx) AS b FROM numbered WHERE t <> 'O' GROUP BY kind, doc_id, pos, ent, substr(t, 3)),
m AS (SELECT type, count(*) FILTER (WHERE g) AS support, count(*) FILTER (WHERE p) AS n_pred, count(*) FILTER (WHERE g AND p) AS tp FROM (
  SELECT doc_id, pos, type, a, b, bool_or(kind = 'gold') AS g, bool_or(kind = 'pred') AS p FROM ents GROUP BY ALL) GROUP BY type),
u AS (SELECT * FROM m UNION ALL SELECT 'overall', sum(support)::BIGINT, sum(n_pred)::BIGINT, sum(tp)::BIGINT FROM m)
SELECT type, support, round(tp / n_pred, 6) AS precision, round(tp / support, 6) AS recall, round(2 * tp / (n_pred + support), 6) AS f1,
  (SELECT round(avg(CASE WHEN tag = pred THEN 1.0 ELSE 0.0 END), 6) FROM seq) AS accuracy FROM u""")
def entities_f1(spark, d):
    scores = sc.entity_scores(v.sequences(spark, d), "tags", "preds")
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")]
    return scores.select("type", "support", *rounded)


CLASS_SQL = v.SEQUENCES_SQL + """,
per_class AS (
  SELECT class, support, tp, n_pred, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
    CASE WHEN tp > 0 THEN 2 * tp / (n_pred + support) ELSE 0 END AS f1
  FROM (SELECT class, count(*) FILTER (WHERE tag = class) AS support, count(*) FILTER (WHERE pred = class) AS n_pred,
          count(*) FILTER (WHERE tag = class AND pred = class) AS tp
        FROM seq JOIN (SELECT tag AS class FROM seq UNION SELECT pred FROM seq) ON tag = class OR pred = class GROUP BY class))"""


def tag_pairs(spark, d):
    seqs = v.sequences(spark, d)
    return explode_rows(seqs, [], F.arrays_zip("tags", "preds"), "z").select(F.col("z.tags").alias("tag"), F.col("z.preds").alias("pred"))


@query("q_macro_f1", f"""WITH {CLASS_SQL}
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
  round(sum(tp) / sum(support), 6) AS accuracy FROM per_class""")
def macro_f1(spark, d):
    out = sc.macro_scores(tag_pairs(spark, d), "tag", "pred")
    return out.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("q_class_metrics", f"""WITH {CLASS_SQL}
SELECT class || '_' || m AS metric, round(value, 6) AS value FROM (
  SELECT class, unnest(['precision', 'recall', 'f1', 'number']) AS m, unnest([precision, recall, f1, support::DOUBLE]) AS value FROM per_class)""")
def class_metrics(spark, d):
    out = sc.flatten_class_scores(sc.class_scores(tag_pairs(spark, d), "tag", "pred"))
    return out.select("metric", F.round("value", 6).alias("value"))


@query("q_perplexity", f"""WITH {v.LANG_COUNTS_SQL}, p AS (SELECT lang, cnt, cnt / sum(cnt) OVER (PARTITION BY lang) AS p FROM freq),
loss AS (SELECT lang, -sum(cnt * ln(p)) / sum(cnt) AS loss, -sum(cnt * ln(p)) AS total FROM p GROUP BY lang)
SELECT lang, round(exp(loss), 4) AS perplexity, total > 709.782712893384 AS total_overflows FROM loss""")
def perplexity(spark, d):
    from ..operators.counting import with_probability

    counts = with_probability(v.lang_counts(spark, d), ["lang"])
    nll = -F.sum(F.col("cnt") * F.ln("p"))
    loss = counts.groupBy("lang").agg((nll / F.sum("cnt")).alias("loss"), nll.alias("total"))
    overflow = sc.perplexity(F.col("total")) == F.lit(float("inf"))
    return loss.select("lang", F.round(sc.perplexity(F.col("loss")), 4).alias("perplexity"), overflow.alias("total_overflows"))


@query("q_capped_counts", f"WITH {v.LINES_SQL} SELECT src, least(count(*), 2000) AS n_samples FROM lines GROUP BY src")
def capped_counts(spark, d):
    return sc.capped_count(v.document_lines(spark, d), 2000, ["src"])


@query("q_predictions_text", f"WITH {v.SEQUENCES_SQL} SELECT doc_id, pos, string_agg(pred, ' ' ORDER BY idx) AS value FROM seq GROUP BY ALL")
def predictions_text(spark, d):
    return v.sequences(spark, d).select("doc_id", "pos", F.array_join("preds", " ").alias("value"))
