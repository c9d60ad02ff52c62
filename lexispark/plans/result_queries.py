"""Queries over the experiment grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import results as rs
from ..sources import tables as tb
from . import views as v
from .registry import plain_zero, query

REGIME_SQL = v.RESULTS_SQL + """,
start_lang AS (SELECT n_name AS en FROM nation WHERE n_nationkey = 0),
regimes AS (
  SELECT 'in' AS regime, results.* FROM results WHERE lang_src = lang_tgt
  UNION ALL SELECT 'en_all', results.* FROM results, start_lang WHERE lang_src = en
  UNION ALL SELECT 'en_other', results.* FROM results, start_lang WHERE lang_src = en AND lang_tgt <> en
  UNION ALL SELECT 'cross', results.* FROM results WHERE lang_src <> lang_tgt)"""


def by_regime(spark, d, *names):
    pivot = v.pivot_language(spark, d).scalar()
    return rs.with_regimes(v.results(spark, d), pivot, names or tuple(rs.REPLICATES))


def rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("q_results_mean", f"WITH {REGIME_SQL} SELECT regime, model, round(avg(value), 9) AS mean_value FROM regimes GROUP BY ALL")
def results_mean(spark, d):
    return rounded(rs.model_means(by_regime(spark, d)), "mean_value")


BOOT_SQL = REGIME_SQL + """,
reps AS (SELECT r.*, unnest(range(CASE regime WHEN 'in' THEN 100 WHEN 'cross' THEN 30 ELSE 300 END)) AS replicate FROM regimes r),
picks AS (
  SELECT regime, model, lang_src, lang_tgt, replicate,
    arg_min(value, md5(concat_ws(':', model, lang_src, lang_tgt, replicate, seed))) AS value
  FROM reps GROUP BY ALL),
boot AS (SELECT regime, model, replicate, avg(value) AS m FROM picks GROUP BY ALL)"""


@query("q_bootstrap", f"WITH {BOOT_SQL} SELECT regime, model, round(avg(m), 9) AS boot_mean, round(stddev_samp(m), 9) AS boot_sd FROM boot GROUP BY ALL")
def bootstrap(spark, d):
    return rounded(rs.replicate_spread(rs.bootstrap(by_regime(spark, d))), "boot_mean", "boot_sd")


@query("q_display_range", f"""WITH {REGIME_SQL}, means AS (SELECT regime, model, avg(value) AS m FROM regimes GROUP BY ALL)
SELECT regime, round(2 * min(m) - max(m), 9) AS y_min, round(2 * max(m) - min(m), 9) AS y_max FROM means GROUP BY regime""")
def display_range(spark, d):
    return rounded(rs.display_range(rs.model_means(by_regime(spark, d))), "y_min", "y_max")


TOK_SQL = f"{REGIME_SQL}, {v.TOK_STATS_SQL}, {v.CROSS_STATS_SQL}"


@query("q_tok_join", f"""WITH {TOK_SQL}
SELECT r.model, r.seed, r.lang_src, r.lang_tgt, round(r.value, 9) AS value_results, round(t.value, 9) AS value_tok, n_rows, data_amount_rank, round(overlap, 9) AS overlap
FROM results r LEFT JOIN tok_stats t ON r.model = t.model AND r.lang_tgt = t.lang
LEFT JOIN cross_stats c ON r.model = c.model AND r.lang_src = c.lang_src AND r.lang_tgt = c.lang_tgt""")
def tok_join(spark, d):
    joined = rs.with_language_stats(v.results(spark, d), v.tok_stats(spark, d))
    joined = rs.with_pair_stats(joined, v.cross_stats(spark, d))
    out = rounded(joined, "value_results", "value_tok", "overlap")
    return out.orderBy("data_amount_rank", "model")


@query("q_baseline_delta", plain_zero(f"""WITH {REGIME_SQL},
base AS (SELECT regime, CASE WHEN regime = 'cross' THEN lang_src END AS s, lang_tgt, avg(value) AS b FROM regimes WHERE model = '{v.BASELINE}' GROUP BY ALL)
SELECT r.regime, model, seed, lang_src, r.lang_tgt, round(value, 9) AS value, round(b, 9) AS value_baseline, round(value - b, 9) AS value_delta
FROM regimes r LEFT JOIN base ON r.regime = base.regime AND r.lang_tgt = base.lang_tgt AND (s IS NULL OR s = lang_src)""", "value_delta"))
def baseline_delta(spark, d):
    deltas = rs.delta_over_baseline(by_regime(spark, d), v.BASELINE, ["regime", "lang_src", "lang_tgt"])
    return rounded(deltas, "value", "value_baseline", "value_delta")


@query("q_family_delta", plain_zero(f"""WITH {REGIME_SQL}, named AS (SELECT regime, model || '_' || seed AS model, lang_src, lang_tgt, value FROM regimes),
base AS (SELECT regime, lang_src, lang_tgt, avg(value) AS b FROM named WHERE model = '{v.BASELINE}_2001' GROUP BY ALL),
deltas AS (SELECT n.*, value - b AS value_delta FROM named n LEFT JOIN base USING (regime, lang_src, lang_tgt))
SELECT family, regime, model, lang_src, lang_tgt, round(value, 9) AS value, round(value_delta, 9) AS value_delta
FROM deltas JOIN (VALUES ('1-'), ('2-'), ('HIGH'), ('LOW')) f(family) ON contains(model, family) OR contains(model, 'MEDIUM')
WHERE (SELECT count(DISTINCT model) FROM named) > 6""", "value_delta"))
def family_delta(spark, d):
    rows = by_regime(spark, d).withColumn("model", F.concat_ws("_", "model", "seed")).drop("seed")
    deltas = rs.delta_over_baseline(rows, f"{v.BASELINE}_2001", ["regime", "lang_src", "lang_tgt"])
    views = rs.family_views(deltas, ["1-", "2-", "HIGH", "LOW"], "MEDIUM")
    return rounded(views, "value", "value_delta").select("family", "regime", "model", "lang_src", "lang_tgt", "value", "value_delta")


ADJUSTED = ("in", "en_other", "cross")
ADJUSTED_SQL = TOK_SQL + """,
joined_stats AS (
  SELECT r.regime, r.model, r.seed, r.lang_src, r.lang_tgt, r.value AS y, t.value AS x,
    CASE regime WHEN 'in' THEN r.lang_src WHEN 'en_other' THEN r.lang_tgt ELSE r.lang_src || '|' || r.lang_tgt END AS g
  FROM regimes r LEFT JOIN tok_stats t ON r.model = t.model AND r.lang_tgt = t.lang WHERE regime <> 'en_all'),
adjusted AS (SELECT *, y - avg(y) OVER (PARTITION BY regime, g) AS yd, x - avg(x) OVER (PARTITION BY regime, g) AS xd FROM joined_stats)"""


def adjusted(spark, d):
    joined = rs.with_language_stats(by_regime(spark, d, *ADJUSTED), v.tok_stats(spark, d))
    rows = joined.withColumnsRenamed({"value_results": "y", "value_tok": "x"})
    out = rs.language_adjusted(rows, ["x", "y"], ["regime", "lang_src", "lang_tgt"])
    # Rounded, so that values which are equal but for the last bits share a rank.
    return rounded(out, "x_delta", "y_delta")


@query("q_lang_adjusted", plain_zero(f"WITH {ADJUSTED_SQL} SELECT regime, model, seed, lang_src, lang_tgt, round(xd, 9) AS x_delta, round(yd, 9) AS y_delta FROM adjusted", "x_delta", "y_delta"))
def lang_adjusted(spark, d):
    return adjusted(spark, d).select("regime", "model", "seed", "lang_src", "lang_tgt", "x_delta", "y_delta")


@query("q_corr", f"""WITH {ADJUSTED_SQL}, r AS (SELECT regime, round(xd, 9) AS xd, round(yd, 9) AS yd FROM adjusted WHERE xd IS NOT NULL AND yd IS NOT NULL),
ranks AS (SELECT regime, xd, yd, rank() OVER (PARTITION BY regime ORDER BY xd) + (count(*) OVER (PARTITION BY regime, xd) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY regime ORDER BY yd) + (count(*) OVER (PARTITION BY regime, yd) - 1) / 2 AS ry FROM r)
SELECT regime, count(*) AS n, round(corr(xd, yd), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM ranks GROUP BY regime""")
def corr(spark, d):
    return rounded(rs.correlations(adjusted(spark, d), "x_delta", "y_delta"), "pearson", "spearman", digits=6)


@query("q_corr_p_values")
def corr_p_values(spark, d):
    return rounded(rs.with_p_values(rs.correlations(adjusted(spark, d), "x_delta", "y_delta")), "pearson", "spearman", "pearson_p", "spearman_p", digits=6)


@query("q_series", f"WITH {REGIME_SQL} SELECT regime, lang_tgt, model, round(avg(value), 9) AS mean_value, count(*) AS n FROM regimes GROUP BY ALL")
def series(spark, d):
    return rounded(rs.series(by_regime(spark, d)), "mean_value")


def _weight_sql() -> str:
    cases = " ".join(f"WHEN substr(u, 1, 8) < '{b}' THEN {k}" for k, b in enumerate(rs.POISSON_BOUNDS))
    return f"CASE {cases} ELSE {len(rs.POISSON_BOUNDS)} END"


@query("q_series_band", f"""WITH {REGIME_SQL},
reps AS (SELECT r.*, unnest(range(100)) AS replicate FROM regimes r WHERE regime IN ({', '.join(repr(r) for r in rs.REPLICATES)})),
drawn AS (SELECT *, md5(concat_ws(':', model, lang_src, lang_tgt, seed, replicate)) AS u FROM reps),
means AS (SELECT regime, lang_tgt, model, replicate, sum(value * w) / nullif(sum(w), 0) AS m FROM (SELECT *, {_weight_sql()} AS w FROM drawn) GROUP BY ALL)
SELECT regime, lang_tgt, model, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM means GROUP BY ALL""")
def series_band(spark, d):
    parts = [rs.series_band(by_regime(spark, d, r), 100).withColumn("regime", F.lit(r)) for r in rs.REPLICATES]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts), "low", "high")


GRID_SQL = v.RESULTS_SQL + """,
grid AS (SELECT * FROM (SELECT DISTINCT model FROM results), (SELECT DISTINCT seed FROM results),
  (SELECT DISTINCT lang_src FROM results), (SELECT DISTINCT lang_tgt FROM results))"""
KEYS = ["model", "seed", "lang_src", "lang_tgt"]


@query("q_grid", f"WITH {GRID_SQL} SELECT model, seed, lang_src, lang_tgt FROM grid")
def grid(spark, d):
    return tb.experiment_grid(v.results(spark, d), KEYS)


@query("q_manifest", f"WITH {GRID_SQL} SELECT model, seed, lang_src, lang_tgt FROM grid ANTI JOIN results USING (model, seed, lang_src, lang_tgt)")
def manifest(spark, d):
    results = v.results(spark, d)
    return tb.missing_cells(tb.experiment_grid(results, KEYS), results, KEYS)
