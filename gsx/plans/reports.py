"""G: analytics over result tables computed from the order lines.

A run is a line number, a model a feature (or all of them), an analysis a training and
a test set of the transfer matrix.
"""

from pyspark.sql import functions as F

from gsx.operators import report as R
from gsx.operators.evaluate import metric_columns, summary, with_intervals
from gsx.operators.matrix import matrix_results
from gsx.plans.base import LINE_FEATURES, LINE_SQL, line_features, registry, rounded, sql_auc
from gsx.plans.evaluation import (
    DOC_CELLS,
    N_BOOT,
    SUBSET_SQL,
    _metrics_sql,
    doc_subsets,
    sql_cells,
    sql_intervals,
    sql_score,
)
from gsx.session import settle
from gsx.sources.scan import with_run_parts

QUERIES, query = registry()

MODELS = {"quantity": ["quantity"], "price": ["price"], "discount": ["discount"], "all": list(LINE_FEATURES)}
SELF, CROSS, POOLED = ("F", "O"), ("F -> O", "O -> F"), ("Combined",)

RESULTS_SQL = LINE_SQL + """,
ln AS (SELECT *, 'evaluation_features_lines_8k_2024_' || split_part(row_id, '-', 2) AS run FROM line), """ + sql_cells(
    "ln", LINE_FEATURES
) + ", sb AS (" + " UNION ALL ".join(
    f"SELECT run, CASE WHEN train = test THEN train ELSE train || ' -> ' || test END AS analysis, '{m}' AS model, label, {sql_score(fs)} AS score FROM cells"
    for m, fs in MODELS.items()
) + f"""), {_metrics_sql("sb", "run, analysis, model")}, am AS ({sql_auc("sb", "run, analysis, model")}),
res AS (SELECT run, analysis, model, round(am.auc, 9) AS auc, round(accuracy, 9) AS accuracy, round(f1, 9) AS f1, round(mcc, 9) AS mcc,
  CASE WHEN analysis IN ('F', 'O') THEN 'Self' WHEN analysis IN ('F -> O', 'O -> F') THEN 'Cross-Domain'
       WHEN analysis = 'Combined' THEN 'Combined' ELSE 'Other' END AS type
  FROM mt JOIN am USING (run, analysis, model))"""


def results(spark, sf):
    """Metrics of every (run, analysis, model) from the line matrix, settled once."""
    rows = line_features(spark, sf).withColumn(
        "run", F.concat(F.lit("evaluation_features_lines_8k_2024_"), F.split("row_id", "-")[1])
    )
    found = matrix_results(rows, LINE_FEATURES, MODELS, "label", "grp", "domain", ["F", "O"], ["run"])
    analysis = F.when(F.col("train") == F.col("test"), F.col("train")).otherwise(
        F.concat_ws(" -> ", "train", "test")
    )
    keys = ["run", "analysis", "model"]
    named = found.withColumns({"analysis": analysis, "model": F.col("subset")}).withColumns(metric_columns())
    fine = [F.round(c, 9).alias(c) for c in ("auc", "accuracy", "f1", "mcc")]
    return settle(named.select(*keys, *fine, R.scenario_type(F.col("analysis"), SELF, CROSS, POOLED).alias("type")))


shared = results

DOC_RUN = "evaluation_features_docs_8k_2024_"
INTERVAL_SQL = f"""{DOC_CELLS}, {SUBSET_SQL},
rb AS (SELECT '{DOC_RUN}' || (row_id % 3) AS run, CASE WHEN train = test THEN train ELSE train || ' -> ' || test END AS analysis,
         subset AS model, row_id, label, score FROM sb),
{_metrics_sql("rb", "run, analysis, model")}, am AS ({sql_auc("rb", "run, analysis, model")}), {sql_intervals("rb", "run, analysis, model")},
res AS (SELECT run, analysis, model, am.auc, accuracy, mcc, ci_lo, ci_hi,
  CASE WHEN analysis IN ('en', 'rest') THEN 'Self' WHEN analysis IN ('en -> rest', 'rest -> en') THEN 'Cross-Domain'
       WHEN analysis = 'Combined' THEN 'Combined' ELSE 'Other' END AS type
  FROM mt JOIN am USING (run, analysis, model) LEFT JOIN ci USING (run, analysis, model))"""


def interval_results(spark, sf):
    """Metrics and bootstrap intervals of every (run, analysis, model) of the document matrix.

    A run is a third of the documents by id, a model a feature subset.
    """
    analysis = F.when(F.col("train") == F.col("test"), F.col("train")).otherwise(F.concat_ws(" -> ", "train", "test"))
    run = F.concat(F.lit(DOC_RUN), (F.col("row_id") % 3).cast("string"))
    rows = settle(
        doc_subsets(spark, sf).select(
            run.alias("run"), analysis.alias("analysis"), F.col("subset").alias("model"), "row_id", "label", "score"
        )
    )
    keys = ["run", "analysis", "model"]
    out = with_intervals(summary(rows, keys, "label"), rows, keys, "label", "row_id", N_BOOT)
    kind = R.scenario_type(F.col("analysis"), ("en", "rest"), ("en -> rest", "rest -> en"), POOLED)
    return out.withColumn("type", kind)


@query("g1_scenario_type", f"WITH {RESULTS_SQL} SELECT run, analysis, model, type FROM res")
def g1(spark, sf):
    return shared(spark, sf).select("run", "analysis", "model", "type")


@query(
    "g2_overview",
    f"""WITH {INTERVAL_SQL}
SELECT run, type, count(auc) AS n, round(avg(auc), 6) AS mean_auc, round(stddev_samp(auc), 6) AS std_auc,
  round(median(auc), 6) AS median_auc, round(max(auc), 6) AS max_auc, round(min(auc), 6) AS min_auc, round(avg(ci_lo), 6) AS mean_ci_lo,
  round(avg(ci_hi), 6) AS mean_ci_hi, round(avg(accuracy), 6) AS mean_accuracy, round(avg(mcc), 6) AS mean_mcc,
  bool_or(mcc < 0) AS any_negative_mcc,
  CASE type WHEN 'Self' THEN 0 WHEN 'Cross-Domain' THEN 1 WHEN 'Combined' THEN 2 ELSE 3 END::INT AS type_order
FROM res GROUP BY 1, 2""",
)
def g2(spark, sf):
    out = R.overview(interval_results(spark, sf))
    return rounded(
        out, "mean_auc", "std_auc", "median_auc", "mean_ci_lo", "mean_ci_hi", "mean_accuracy", "mean_mcc",
        "max_auc", "min_auc",
    )


@query(
    "g3_ci_width",
    f"""WITH {INTERVAL_SQL}
SELECT run, analysis, model, round(ci_hi - ci_lo, 6) AS ci_width, ci_hi - ci_lo > 0.15 AS wide FROM res""",
)
def g3(spark, sf):
    return rounded(R.ci_widths(interval_results(spark, sf)), "ci_width")


@query(
    "g4_generalisation_gap",
    f"""WITH {RESULTS_SQL},
g AS (SELECT run, model, avg(auc) FILTER (type = 'Self') AS s, avg(auc) FILTER (type = 'Cross-Domain') AS c FROM res GROUP BY 1, 2)
SELECT run, model, round(s, 6) AS mean_self, round(c, 6) AS mean_cross, round(s - c, 6) AS gap,
  CASE WHEN s - c > 0.25 THEN 'severe' WHEN s - c > 0.12 THEN 'moderate' ELSE 'good' END AS verdict FROM g""",
)
def g4(spark, sf):
    return rounded(R.generalisation_gap(shared(spark, sf)), "mean_self", "mean_cross", "gap")


@query(
    "g5_metric_pivot",
    f"WITH {RESULTS_SQL} SELECT analysis, "
    + ", ".join(f"round(avg(auc) FILTER (model = '{m}'), 6) AS {m}_auc" for m in ("quantity", "price", "all"))
    + " FROM res GROUP BY 1",
)
def g5(spark, sf):
    models = ["quantity", "price", "all"]
    out = R.metric_pivot(shared(spark, sf), "auc", models)
    return rounded(out, *[f"{m}_auc" for m in models])


@query(
    "g6_best_per_scenario",
    f"""WITH {RESULTS_SQL} SELECT run, type, max_by(model, (auc, model)) AS best_model, round(max(auc), 6) AS auc FROM res GROUP BY 1, 2""",
)
def g6(spark, sf):
    return rounded(R.best_per(shared(spark, sf), ["run", "type"]), "auc")


@query(
    "g7_cross_means",
    f"""WITH {RESULTS_SQL}
SELECT 'lines' AS feature_set, '8k' AS sample_rate, analysis, model, round(avg(auc), 6) AS mean_auc, count(DISTINCT run) AS runs
FROM res WHERE type = 'Cross-Domain' GROUP BY 3, 4""",
)
def g7(spark, sf):
    return rounded(R.cross_means(with_run_parts(shared(spark, sf))), "mean_auc")


@query(
    "g7_model_averages",
    f"""WITH {RESULTS_SQL}
SELECT model, round(avg(accuracy), 6) AS mean_accuracy, round(avg(auc), 6) AS mean_auc, round(avg(mcc), 6) AS mean_mcc,
  count(DISTINCT run) AS runs FROM res GROUP BY 1""",
)
def g7_models(spark, sf):
    return rounded(R.model_averages(shared(spark, sf)), "mean_accuracy", "mean_auc", "mean_mcc")


@query(
    "g8_global_ranking",
    f"""WITH {RESULTS_SQL}
SELECT run, analysis, model, round(auc, 6) AS auc, row_number() OVER (ORDER BY auc DESC, run, analysis, model) AS rank,
  round(avg(auc) OVER (PARTITION BY run), 6) AS run_mean, round(stddev_samp(auc) OVER (PARTITION BY run), 6) AS run_std,
  round(min(auc) OVER (PARTITION BY run), 6) AS run_min, round(max(auc) OVER (PARTITION BY run), 6) AS run_max FROM res""",
)
def g8(spark, sf):
    out = R.global_ranking(shared(spark, sf).select("run", "analysis", "model", "auc"))
    return rounded(out, "auc", "run_mean", "run_std", "run_min", "run_max")


@query(
    "g9_key_findings",
    f"""WITH {RESULTS_SQL},
s AS (SELECT model, stddev_pop(auc) AS sd FROM res GROUP BY 1 HAVING count(auc) >= 2)
(SELECT 'best' AS finding, run, analysis, model, round(auc, 6) AS value FROM res ORDER BY auc DESC, run DESC, analysis DESC, model DESC LIMIT 1)
UNION ALL (SELECT 'best_transfer', run, analysis, model, round(auc, 6) FROM res WHERE type = 'Cross-Domain'
  ORDER BY auc DESC, run DESC, analysis DESC, model DESC LIMIT 1)
UNION ALL (SELECT 'worst_transfer', run, analysis, model, round(auc, 6) FROM res WHERE type = 'Cross-Domain' ORDER BY auc, run, analysis, model LIMIT 1)
UNION ALL SELECT 'linear_mean', NULL, NULL, NULL, round(avg(auc), 6) FROM res WHERE model IN ('all')
UNION ALL SELECT 'other_mean', NULL, NULL, NULL, round(avg(auc), 6) FROM res WHERE model NOT IN ('all')
UNION ALL (SELECT 'steadiest', NULL, NULL, model, round(sd, 6) FROM s ORDER BY sd, model LIMIT 1)""",
)
def g9(spark, sf):
    return rounded(R.key_findings(shared(spark, sf), linear=("all",)), "value")


@query(
    "g10_range_anomalies",
    f"""WITH {RESULTS_SQL},
u AS (UNPIVOT (SELECT run, analysis, model, accuracy - 0.5 AS accuracy, f1, auc, mcc FROM res)
      ON accuracy, f1, auc, mcc INTO NAME metric VALUE value)
SELECT run, analysis, model, metric, round(value, 6) AS value FROM u
WHERE (metric = 'mcc' AND NOT value BETWEEN -1 AND 1.01) OR (metric <> 'mcc' AND NOT value BETWEEN 0 AND 1.01)""",
)
def g10(spark, sf):
    """Accuracies moved down by one half, so that some leave their range."""
    shifted = shared(spark, sf).withColumn("accuracy", F.col("accuracy") - 0.5)
    return rounded(R.range_anomalies(shifted, ["run", "analysis", "model"]), "value")


@query(
    "g11_matrix_to_long",
    f"""WITH {RESULTS_SQL}
SELECT analysis, model || '_auc' AS test, round(avg(auc), 6) AS value FROM res WHERE model IN ('quantity', 'price', 'all') GROUP BY 1, 2""",
)
def g11(spark, sf):
    models = ["quantity", "price", "all"]
    wide = R.metric_pivot(shared(spark, sf), "auc", models)
    return rounded(R.matrix_long(wide, "analysis", [f"{m}_auc" for m in models]), "value")


@query(
    "g12_bands_and_flags",
    f"""WITH {RESULTS_SQL}
SELECT run, analysis, model, CASE WHEN auc < 0.6 THEN 'weak' WHEN auc < 0.7 THEN 'fair' WHEN auc < 0.999 THEN 'good'
    WHEN auc IS NOT NULL THEN 'suspicious' END AS band,
  CASE WHEN mcc = min(mcc) OVER w OR mcc < 0 THEN 'worst' WHEN mcc = max(mcc) OVER w THEN 'best' ELSE '' END AS flag
FROM res WINDOW w AS (PARTITION BY run)""",
)
def g12(spark, sf):
    flagged = R.extreme_flags(shared(spark, sf), ["run"], "mcc")
    return flagged.select("run", "analysis", "model", R.auc_band(F.col("auc")).alias("band"), "flag")

