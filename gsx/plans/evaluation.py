"""E: folds, within- and cross-domain evaluation, intervals, cascades, sweeps."""

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gsx.functions.hashing import hash_int
from gsx.operators.bootstrap import GOLDEN, MIX_A, MIX_B, auc_interval, poisson_limits
from gsx.operators.evaluate import (
    COMBINED,
    baseline_score,
    best_size,
    cascade,
    cascade_intervals,
    cascade_report,
    cell_scores,
    class_metrics,
    fold_f_stats,
    fold_masks,
    matrix_and_intervals,
    matrix_wide,
    own_cell_scores,
    roc_points,
    selected_scores,
    slice_metrics,
    squash,
    stratum_delta,
    subset_scores,
    summary,
    sweep_sizes,
    top_n_scores,
    transfer_matrix,
    with_cell_folds,
    with_intervals,
)
from gsx.operators import convex, trees
from gsx.operators.ensembles import score_many
from gsx.operators.matrix import matrix_results, matrix_with_overlap
from gsx.operators.models import fit_score, scale_table
from gsx.operators.ordered import auc, lookup_join
from gsx.operators.report import best_per
from gsx.operators.split import group_folds, row_folds
from gsx.operators.stats import consistency_ranking, group_means, signed_auc
from gsx.plans.base import (
    DOC_DOMAINS,
    DOC_FEATURES,
    DOC_SQL,
    LINE_DOMAINS,
    LINE_FEATURES,
    LINE_SQL,
    doc_features,
    line_features,
    r6,
    registry,
    rounded,
    sql_auc,
    sql_hash,
    vector_long,
)
from gsx.plans.stats import CONSIST_SQL
from gsx.session import settle, side_by_side

QUERIES, query = registry()

N_BOOT = 1000
SUBSETS = {
    "counts": ["n_chars", "n_words", "n_lines"],
    "shares": ["digit_share", "upper_share", "mean_word_len"],
    "all": list(DOC_FEATURES),
}


# --- SQL fragments -------------------------------------------------------------------


def sql_folds(src, part, name, k=5):
    """Group folds of a source with columns grp and label, inside ``part`` columns."""
    p = f"{part}, " if part else ""
    within = f"PARTITION BY {part}" if part else ""
    return f"""
{name} AS (
  SELECT {p}grp, CASE WHEN i % (2 * k) < k THEN i % (2 * k) ELSE 2 * k - 1 - i % (2 * k) END::INT AS fold, k::INT AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY {p}p >= n ORDER BY p + n DESC, {sql_hash(42, 'grp')}) - 1 AS i,
               least({k}, count(*) OVER ({within}) // 2) AS k
        FROM (SELECT {p}grp, sum(label) AS p, count(*) - sum(label) AS n FROM {src} GROUP BY {p}grp))
  WHERE k >= 2)"""


def sql_score(features, digits=9):
    parts = " + ".join(f"sign_{f} * ({f} - mean_{f}) / std_{f}" for f in features)
    return f"round(({parts}) / {len(features)}, {digits})"


def sql_cells(src, features, k=5):
    """Cell rows with fitted parameters: columns of the source, train, test, holdout."""
    fits = ", ".join(
        f"avg({f}) AS mean_{f}, CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END AS std_{f}, "
        f"CASE WHEN avg({f}) FILTER (label = 1) > avg({f}) FILTER (label = 0) THEN 1.0 ELSE -1.0 END AS sign_{f}"
        for f in features
    )
    return f"""{sql_folds(src, 'domain', 'fd', k)}, {sql_folds(src, '', 'fa', k)},
fx AS (SELECT s.*, fd.fold, fa.fold AS fold_all FROM {src} s JOIN fd ON s.domain = fd.domain AND s.grp = fd.grp
       JOIN fa ON s.grp = fa.grp),
hs AS (SELECT unnest(range(-1, {k})) AS h),
ts AS (SELECT domain AS train, h AS holdout, fx.* FROM fx, hs WHERE fold <> h
       UNION ALL SELECT 'Combined', h, fx.* FROM fx, hs WHERE fold_all <> h),
pm AS (SELECT train, holdout, {fits} FROM ts GROUP BY 1, 2),
trains AS (SELECT DISTINCT domain AS train FROM fx UNION ALL SELECT 'Combined'),
cx AS (SELECT fx.*, train, domain AS test, CASE WHEN train = domain THEN fold ELSE -1 END AS holdout FROM fx, trains
       UNION ALL SELECT fx.*, train, 'Combined', CASE WHEN train = 'Combined' THEN fold_all ELSE -1 END FROM fx, trains),
cp AS (SELECT * FROM cx JOIN pm USING (train, holdout)),
cells AS (SELECT *, {sql_score(features)} AS score,
  train <> test AND (train = domain OR train = 'Combined') AS seen FROM cp)"""


DOCX_SQL = DOC_SQL + """,
docx AS (SELECT doc_id AS row_id, doc.*, source AS grp FROM doc)"""
DOC_CELLS = DOCX_SQL + ", " + sql_cells("docx", DOC_FEATURES)
LINE_CELLS = LINE_SQL + ", " + sql_cells("line", LINE_FEATURES)


def sql_intervals(src, keys, n_boot=N_BOOT):
    """Bootstrap intervals by hashed Poisson weights, written out per row and replicate."""
    two64 = 2**64
    limits = poisson_limits()
    weight = "CASE " + " ".join(f"WHEN u < {t} THEN {i}" for i, t in enumerate(limits)) + f" ELSE {len(limits)} END"

    def mixed(x, shift, mult):
        return f"((xor({x}, {x} >> {shift})::UHUGEINT * {mult}::UHUGEINT) % {two64}::UHUGEINT)::UBIGINT"

    return f"""
bh AS (SELECT {keys}, score, label, ('0x' || substr({sql_hash(42, 'row_id')}, 1, 15))::UBIGINT AS h FROM {src}),
b0 AS (SELECT {keys}, score, label, rep,
         ((h::UHUGEINT + (rep // 4 + 1)::UHUGEINT * {GOLDEN}::UHUGEINT) % {two64}::UHUGEINT)::UBIGINT AS x
       FROM bh, range(0, {n_boot}) t(rep)),
b1 AS (SELECT * EXCLUDE x, {mixed('x', 30, MIX_A)} AS x FROM b0),
b2 AS (SELECT * EXCLUDE x, {mixed('x', 27, MIX_B)} AS x FROM b1),
b3 AS (SELECT * EXCLUDE x, (xor(x, x >> 31) >> (16 * (rep % 4))) & 65535::UBIGINT AS u FROM b2),
bw AS (SELECT {keys}, rep, score, sum(label * w)::DOUBLE AS p, sum((1 - label) * w)::DOUBLE AS n
       FROM (SELECT *, {weight} AS w FROM b3) GROUP BY {keys}, rep, score),
bu AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {keys}, rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM bw),
br AS (SELECT {keys}, rep, sum(p * (nb + n / 2)) / (sum(p) * sum(n)) AS auc FROM bu GROUP BY {keys}, rep
       HAVING sum(p) > 0 AND sum(n) > 0),
ci AS (SELECT {keys}, count(*) AS n_valid,
         CASE WHEN count(*) >= 10 THEN quantile_cont(auc, 0.025) END AS ci_lo,
         CASE WHEN count(*) >= 10 THEN quantile_cont(auc, 0.975) END AS ci_hi FROM br GROUP BY {keys})"""


# --- inputs ----------------------------------------------------------------------------


def docs(spark, sf):
    return doc_features(spark, sf).withColumnsRenamed({"doc_id": "row_id", "source": "grp"}).withColumn(
        "source", F.col("grp")
    )


def doc_cells(spark, sf):
    return cell_scores(docs(spark, sf), DOC_FEATURES, "label", "grp", "domain", DOC_DOMAINS)


def line_cells(spark, sf):
    """The line cells; rows are hashed before cells repeat them."""
    rows = line_features(spark, sf).withColumn("row_hash", hash_int(42, "row_id"))
    return cell_scores(rows, LINE_FEATURES, "label", "grp", "domain", LINE_DOMAINS)


def line_matrix(spark, sf, pairs):
    """Class sizes and AUC of these (train, test) cells of the lines."""
    found = matrix_results(
        line_features(spark, sf), LINE_FEATURES, {"all": LINE_FEATURES}, "label", "grp", "domain", LINE_DOMAINS, pairs=pairs
    )
    return rounded(found.select("train", "test", "n_pos", "n_neg", "auc"), "auc")


# --- queries ---------------------------------------------------------------------------


@query(
    "e1_group_folds",
    f"WITH {LINE_SQL}, {sql_folds('line', 'domain', 'fd')} SELECT domain, grp, fold, k FROM fd",
)
def e1(spark, sf):
    return group_folds(line_features(spark, sf), "grp", "label", part=("domain",))


@query(
    "e2_row_folds",
    f"""WITH {DOC_SQL}
SELECT doc_id, ((row_number() OVER (PARTITION BY label ORDER BY {sql_hash(42, 'doc_id')}) - 1) % 5)::INT AS fold FROM doc""",
)
def e2(spark, sf):
    rows = doc_features(spark, sf).select("doc_id", "label")
    return row_folds(rows, "label", "doc_id").select("doc_id", "fold")


@query(
    "e3_out_of_fold_scores",
    f"""WITH {DOC_CELLS} SELECT row_id, train, holdout, round(score, 6) AS score FROM cells WHERE train = test""",
)
def e3(spark, sf):
    diagonal = doc_cells(spark, sf).filter("train = test")
    return diagonal.select("row_id", "train", "holdout", r6("score").alias("score"))


def _matrix_sql(cells, where):
    return f"""WITH {cells}, m AS ({sql_auc(f"(SELECT * FROM cells WHERE {where})", "train, test")})
SELECT train, test, n_pos, n_neg, round(auc, 6) AS auc FROM m"""


@query("e4_within_domain", _matrix_sql(LINE_CELLS, "train = test"))
def e4(spark, sf):
    return line_matrix(spark, sf, [(d, d) for d in (*LINE_DOMAINS, COMBINED)])


CROSS = "train <> test AND train <> 'Combined' AND test <> 'Combined'"


@query("e5_cross_domain", _matrix_sql(LINE_CELLS, CROSS))
def e5(spark, sf):
    return line_matrix(spark, sf, [LINE_DOMAINS, LINE_DOMAINS[::-1]])


MATRIX_SQL = f"""m AS ({sql_auc("cells", "train, test")}),
ov AS (SELECT train, test, count(*) FILTER (seen) AS overlap_rows FROM cells GROUP BY 1, 2)"""


@query(
    "e6_transfer_matrix",
    f"""WITH {DOC_CELLS}, {MATRIX_SQL}
SELECT train, test, n_pos, n_neg, round(auc, 6) AS auc, overlap_rows FROM m JOIN ov USING (train, test)""",
)
def e6(spark, sf):
    return rounded(transfer_matrix(doc_cells(spark, sf), "label"), "auc")


@query(
    "e6_transfer_matrix_lines",
    f"""WITH {LINE_CELLS}, {MATRIX_SQL}
SELECT train, test, n_pos, n_neg, round(auc, 6) AS auc, overlap_rows FROM m JOIN ov USING (train, test)""",
)
def e6_lines(spark, sf):
    found = matrix_with_overlap(line_features(spark, sf), LINE_FEATURES, "label", "grp", "domain", LINE_DOMAINS)
    return rounded(found, "auc")


@query(
    "e6_matrix_wide",
    f"""WITH {DOC_CELLS}, {MATRIX_SQL}
SELECT train, round(max(auc) FILTER (test = 'en'), 6) AS test_en, round(max(auc) FILTER (test = 'rest'), 6) AS test_rest,
  round(max(auc) FILTER (test = 'Combined'), 6) AS "test_Combined" FROM m GROUP BY 1""",
)
def e6_wide(spark, sf):
    wide = matrix_wide(transfer_matrix(doc_cells(spark, sf), "label"), [*DOC_DOMAINS, COMBINED])
    return rounded(wide, "test_en", "test_rest", "test_Combined")


@query(
    "l6_superset_artifacts",
    f"""WITH {DOC_CELLS}, {MATRIX_SQL}
SELECT train, test, overlap_rows, overlap_rows > 0 AS overlaps, auc >= 0.999 AND overlap_rows > 0 AS artifact
FROM m JOIN ov USING (train, test)""",
)
def l6_artifacts(spark, sf):
    m = transfer_matrix(doc_cells(spark, sf), "label")
    overlaps = F.col("overlap_rows") > 0
    return m.select(
        "train", "test", "overlap_rows", overlaps.alias("overlaps"),
        ((F.col("auc") >= 0.999) & overlaps).alias("artifact"),
    )


@query(
    "e7_auc",
    f"""WITH {LINE_SQL}, m AS ({sql_auc("line", "domain", "price")})
SELECT domain, n_pos, n_neg, round(auc, 6) AS auc FROM m""",
)
def e7(spark, sf):
    return rounded(auc(line_features(spark, sf), "domain", "price", "label"), "auc")


def _metrics_sql(src, keys):
    return f"""
cm AS (SELECT {keys}, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
         count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 1 AND pred = 0) AS fn
       FROM (SELECT *, (score >= 0)::INT AS pred FROM {src}) GROUP BY {keys}),
pr AS (SELECT *, (tp + fn)::DOUBLE AS pos, (tn + fp)::DOUBLE AS neg,
         CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall,
         CASE WHEN tn + fn > 0 THEN tn::DOUBLE / (tn + fn) ELSE 0 END AS nprec,
         CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END AS nrec FROM cm),
mt AS (SELECT *, (tp + tn)::DOUBLE / (pos + neg) AS accuracy,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
         CASE WHEN 2 * tn + fp + fn > 0 THEN 2.0 * tn / (2 * tn + fp + fn) ELSE 0 END AS nf1,
         CASE WHEN (tp + fp) > 0 AND pos > 0 AND neg > 0 AND (tn + fn) > 0 THEN
           (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * pos * neg * (tn + fn)) ELSE 0 END AS mcc FROM pr)"""


@query(
    "e8_class_metrics",
    f"""WITH {DOC_CELLS}, {_metrics_sql("cells", "train, test")}
SELECT train, test, tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(mcc, 6) AS mcc,
  round((precision * pos + nprec * neg) / (pos + neg), 6) AS weighted_precision,
  round((recall * pos + nrec * neg) / (pos + neg), 6) AS weighted_recall,
  round((f1 * pos + nf1 * neg) / (pos + neg), 6) AS weighted_f1,
  round(100 * recall, 6) AS true_pos_pct, round(100 * nrec, 6) AS true_neg_pct FROM mt""",
)
def e8(spark, sf):
    rows = doc_cells(spark, sf).withColumn("pred", (F.col("score") >= 0).cast("int"))
    out = class_metrics(rows, ["train", "test"], "pred", "label")
    return rounded(out, *out.columns[6:])


@query(
    "e9_roc_points",
    f"""WITH {LINE_SQL}
SELECT domain, price AS threshold,
  round(sum(count(*) FILTER (label = 0)) OVER w / (SELECT count(*) FROM line b WHERE b.domain = line.domain AND b.label = 0)::DOUBLE, 6) AS fpr,
  round(sum(count(*) FILTER (label = 1)) OVER w / (SELECT count(*) FROM line b WHERE b.domain = line.domain AND b.label = 1)::DOUBLE, 6) AS tpr
FROM line GROUP BY domain, price WINDOW w AS (PARTITION BY domain ORDER BY price DESC)""",
)
def e9(spark, sf):
    return rounded(roc_points(line_features(spark, sf), "domain", "price", "label"), "fpr", "tpr")


@query(
    "e10_bootstrap_interval",
    f"""WITH {DOC_CELLS}, {sql_intervals("cells", "train, test")}
SELECT train, test, n_valid, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM ci""",
)
def e10(spark, sf):
    out = auc_interval(doc_cells(spark, sf), ["train", "test"], "score", "label", "row_id", N_BOOT)
    return rounded(out, "ci_lo", "ci_hi")


@query("e10_matrix_with_intervals_lines")
def e10_lines(spark, sf):
    """The line matrix with intervals from a thousand resamples of whole tables."""
    cells = settle(line_cells(spark, sf).select("train", "test", "row_hash", "label", "score", "seen_in_training"))
    return rounded(matrix_and_intervals(cells, "label", "row_hash", N_BOOT), "auc", "ci_lo", "ci_hi")


MODEL_OPTIONS = {
    "logistic": {},
    "l1_logistic": {},
    "decision_tree": {},
    "forest_small": {},
    "linear_svm": {},
}


@query("e11_models_by_direction")
def e11(spark, sf):
    """Every model on both true transfers."""
    rows = settle(docs(spark, sf))

    def scored(name, a, b):
        part = fit_score(
            rows.filter(F.col("domain") == a), rows.filter(F.col("domain") == b),
            DOC_FEATURES, "label", name, **MODEL_OPTIONS[name],
        )
        return part.select("row_id", "label", "score").withColumns(
            {"train": F.lit(a), "test": F.lit(b), "model": F.lit(name)}
        )

    fits = [partial(scored, name, *pair) for name in MODEL_OPTIONS for pair in (DOC_DOMAINS, DOC_DOMAINS[::-1])]
    out = reduce(DataFrame.unionByName, side_by_side(spark, fits))
    return rounded(auc(out, ["train", "test", "model"], "score", "label"), "auc")


STAGES = (["n_chars", "n_words"], ["digit_share", "upper_share"], list(DOC_FEATURES))


@query(
    "e12_confidence_cascade",
    f"""WITH {DOC_CELLS},
ps AS (SELECT train, test, row_id, label, """
    + ", ".join(
        f"1 / (1 + exp(-(3.0 * {sql_score(fs)}))) AS p{i}" for i, fs in enumerate(STAGES, 1)
    )
    + f""" FROM cells WHERE {CROSS}),
st AS (SELECT *, CASE WHEN greatest(p1, 1 - p1) >= 0.7 THEN 1 WHEN greatest(p2, 1 - p2) >= 0.65 THEN 2 ELSE 3 END AS stage,
         CASE WHEN greatest(p1, 1 - p1) >= 0.7 THEN p1 WHEN greatest(p2, 1 - p2) >= 0.65 THEN p2 ELSE p3 END AS final FROM ps),
b AS (SELECT train, test, stage AS stage_num, label, final FROM st UNION ALL SELECT train, test, 0, label, final FROM st),
m AS ({sql_auc("b", "train, test, stage_num", "final")}),
n AS (SELECT train, test, stage_num, count(*) AS n_handled FROM b GROUP BY 1, 2, 3)
SELECT train, test, stage_num::INT AS stage_num, n_handled, round(auc, 6) AS auc,
  round(100.0 * n_handled / max(n_handled) OVER (PARTITION BY train, test), 6) AS pct_handled
FROM n JOIN m USING (train, test, stage_num)""",
)
def e12(spark, sf):
    rows = doc_cells(spark, sf).filter(CROSS)
    probs = {f"p{i}": squash(3.0 * baseline_score(fs, DOC_FEATURES)) for i, fs in enumerate(STAGES, 1)}
    answered = cascade(rows.withColumns(probs), list(probs))
    return rounded(cascade_report(answered, ["train", "test"], "label"), "auc", "pct_handled")


FITTED_STAGES = ("logistic", "forest_500", "boosting")


def fitted_transfers(rows):
    """Both true transfers scored by logistic regression, the whole forest and the whole boosting."""
    keep = ["row_id", "label", "domain", *DOC_FEATURES]
    rows = settle(rows.select(*keep))
    linear, *grown = FITTED_STAGES
    models = convex.fit_linear(
        convex.training_rows(rows, DOC_FEATURES, "label", F.array("domain")), DOC_FEATURES,
        {linear: convex.MODELS[linear]},
    )
    a, b = DOC_DOMAINS
    asked = rows.withColumn("train", F.when(F.col("domain") == a, b).otherwise(a)).withColumn("test", F.col("domain"))
    specs = {n: trees.SPECS[n] for n in grown}
    return trees.fit_and_score(
        rows, score_many(asked, DOC_FEATURES, "train", models), DOC_FEATURES, "label", "row_id", "domain", specs, "train"
    )


@query("e12_fitted_cascade")
def e12_fitted(spark, sf):
    """Rows handed on from logistic regression to the forest and to boosting, with intervals per stage."""
    answered = cascade(fitted_transfers(docs(spark, sf)), FITTED_STAGES)
    out = cascade_intervals(answered, ["train", "test"], "label", "row_id", N_BOOT)
    return rounded(out, "pct_handled", "auc", "ci_lo", "ci_hi")


CASCADE_SQL = f"""{DOC_CELLS},
ps AS (SELECT train, test, row_id, label, """ + ", ".join(
    f"1 / (1 + exp(-(3.0 * {sql_score(fs)}))) AS p{i}" for i, fs in enumerate(STAGES, 1)
) + f""" FROM cells WHERE {CROSS}),
st AS (SELECT *, CASE WHEN greatest(p1, 1 - p1) >= 0.7 THEN 1 WHEN greatest(p2, 1 - p2) >= 0.65 THEN 2 ELSE 3 END AS stage,
         CASE WHEN greatest(p1, 1 - p1) >= 0.7 THEN p1 WHEN greatest(p2, 1 - p2) >= 0.65 THEN p2 ELSE p3 END AS score FROM ps),
b AS (SELECT train, test, stage AS stage_num, row_id, label, score FROM st UNION ALL SELECT train, test, 0, row_id, label, score FROM st),
m AS ({sql_auc("b", "train, test, stage_num")}), {sql_intervals("b", "train, test, stage_num")},
n AS (SELECT train, test, stage_num, count(*) AS n FROM b GROUP BY 1, 2, 3),
grid AS (SELECT train, test, s AS stage_num, whole FROM
         (SELECT train, test, max(stage_num) AS last, sum(n) FILTER (stage_num = 0) AS whole FROM n GROUP BY 1, 2), range(0, 4) t(s) WHERE s <= last)"""


@query(
    "e12_cascade_intervals",
    f"""WITH {CASCADE_SQL}
SELECT train, test, stage_num::INT AS stage_num, coalesce(n, 0)::BIGINT AS n_handled, round(100.0 * coalesce(n, 0) / whole, 6) AS pct_handled,
  round(auc, 6) AS auc, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi
FROM grid LEFT JOIN n USING (train, test, stage_num) LEFT JOIN m USING (train, test, stage_num) LEFT JOIN ci USING (train, test, stage_num)""",
)
def e12_intervals(spark, sf):
    """The cascade of the baseline scorer with intervals, which SQL can follow."""
    rows = doc_cells(spark, sf).filter(CROSS)
    probs = {f"p{i}": squash(3.0 * baseline_score(fs, DOC_FEATURES)) for i, fs in enumerate(STAGES, 1)}
    answered = cascade(rows.withColumns(probs), list(probs))
    out = cascade_intervals(answered, ["train", "test"], "label", "row_id", N_BOOT)
    return rounded(out, "pct_handled", "auc", "ci_lo", "ci_hi")


@query("e13_fitted_subsets")
def e13_fitted(spark, sf):
    """The whole forest on every feature subset and both true transfers, with intervals."""
    rows = settle(docs(spark, sf).select("row_id", "label", "domain", *DOC_FEATURES))
    out = None
    for name, fs in SUBSETS.items():
        part = trees.transfer_scores(rows, fs, "label", "row_id", "domain", ("forest_500",))
        part = part.withColumns({"subset": F.lit(name), "n_feats": F.lit(len(fs))})
        out = part if out is None else out.unionByName(part)
    out = settle(out.drop("model"))
    keys = ["subset", "n_feats", "train", "test"]
    table_ = auc(out, keys, "score", "label")
    return rounded(with_intervals(table_, out, keys, "label", "row_id", N_BOOT), "auc", "ci_lo", "ci_hi")


K_BEST = 3
SELECT_SQL = f"""{DOC_CELLS},
tl AS (SELECT train, holdout, label, feature, value FROM ts UNPIVOT (value FOR feature IN ({", ".join(DOC_FEATURES)}))),
pc AS (SELECT train, holdout, feature, label, count(*)::DOUBLE AS c, avg(value) AS m, var_pop(value) AS v FROM tl GROUP BY 1, 2, 3, 4),
ft AS (SELECT train, holdout, feature,
         CASE WHEN sum(c * v) > 1e-12 * sum(c * (v + m * m)) THEN
           (sum(c * m * m) - sum(c) * pow(sum(c * m) / sum(c), 2)) / (count(*) - 1) / (sum(c * v) / (sum(c) - count(*))) END AS f_stat
       FROM pc GROUP BY 1, 2, 3),
fr AS (SELECT *, row_number() OVER (PARTITION BY train, holdout ORDER BY f_stat DESC NULLS LAST, list_position([{", ".join(f"'{f}'" for f in DOC_FEATURES)}], feature)) <= {K_BEST} AS chosen FROM ft)"""


@query(
    "a17_selection_in_folds",
    f"WITH {SELECT_SQL} SELECT train, holdout::INT AS holdout, feature, round(f_stat, 4) AS f_stat, chosen FROM fr",
)
def a17_folds(spark, sf):
    """F of every feature in every training fold, and the features each fold keeps."""
    folded = settle(with_cell_folds(docs(spark, sf), "label", "grp", "domain"))
    stats = settle(fold_f_stats(folded, DOC_FEATURES, "label", "domain"))
    chosen = stats.join(fold_masks(stats, K_BEST), ["train", "holdout"])
    return chosen.select(
        "train", "holdout", "feature", F.round("f_stat", 4).alias("f_stat"), F.get("mask", F.col("position")).alias("chosen")
    )


@query(
    "a17_selected_matrix",
    f"""WITH {SELECT_SQL},
ms AS (SELECT train, holdout, {", ".join(f"bool_or(chosen) FILTER (feature = '{f}') AS use_{f}" for f in DOC_FEATURES)} FROM fr GROUP BY 1, 2),
sl AS (SELECT train, test, label, round(({" + ".join(f"CASE WHEN use_{f} THEN sign_{f} * ({f} - mean_{f}) / std_{f} ELSE 0 END" for f in DOC_FEATURES)}) / {K_BEST}, 9) AS score
       FROM cells JOIN ms USING (train, holdout)),
m AS ({sql_auc("sl", "train, test")})
SELECT train, test, n_pos, n_neg, round(auc, 6) AS auc FROM m""",
)
def a17_matrix(spark, sf):
    """The transfer matrix with features chosen inside every training fold."""
    scores = selected_scores(docs(spark, sf), DOC_FEATURES, "label", "grp", "domain", DOC_DOMAINS, K_BEST)
    return rounded(auc(scores, ["train", "test"], "score", "label"), "auc")


SUBSET_SQL = "sb AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS subset, {len(fs)} AS n_feats, train, test, row_id, domain, label, {sql_score(fs)} AS score FROM cells"
    for n, fs in SUBSETS.items()
) + ")"


def doc_subsets(spark, sf):
    scored = subset_scores(doc_cells(spark, sf), SUBSETS, DOC_FEATURES)
    return scored.withColumn("score", F.col("subset_score"))


@query(
    "e13_subset_analysis",
    f"""WITH {DOC_CELLS}, {SUBSET_SQL},
m AS ({sql_auc(f"(SELECT * FROM sb WHERE {CROSS})", "subset, n_feats, train, test")})
SELECT subset, n_feats::INT AS n_feats, train, test, n_pos, n_neg, round(auc, 6) AS auc FROM m""",
)
def e13(spark, sf):
    rows = doc_subsets(spark, sf).filter(CROSS)
    return rounded(auc(rows, ["subset", "n_feats", "train", "test"], "score", "label"), "auc")


@query(
    "e14_slice_metrics",
    f"""WITH {DOC_CELLS},
s AS (SELECT 'baseline' AS model, 'domain' AS slice, source AS slice_value, label, score FROM cells WHERE train = 'Combined' AND test = 'Combined'
      UNION ALL SELECT 'baseline', 'language', lang, label, score FROM cells WHERE train = 'Combined' AND test = 'Combined'),
{_metrics_sql("s", "model, slice, slice_value")}, a AS ({sql_auc("s", "model, slice, slice_value")})
SELECT model, slice, slice_value, tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(mcc, 6) AS mcc,
  round(a.auc, 6) AS auc FROM mt JOIN a USING (model, slice, slice_value) WHERE tp + fn >= 5 AND tn + fp >= 5""",
)
def e14(spark, sf):
    rows = doc_cells(spark, sf).filter("train = 'Combined' AND test = 'Combined'")
    rows = rows.withColumns(
        {"model": F.lit("baseline"), "pred": (F.col("score") >= 0).cast("int")}
    )
    out = slice_metrics(rows, "model", "source", "lang", "pred", "score", "label")
    return rounded(out, "accuracy", "f1", "mcc", "auc")


STRATA_SQL = LINE_SQL + """,
strat AS (SELECT * REPLACE (CASE WHEN tax > 0.04 THEN 'high' ELSE 'low' END AS domain) FROM line), """ + sql_cells(
    "strat", LINE_FEATURES
)


@query(
    "e15_stratum_delta",
    f"""WITH {STRATA_SQL},
s AS (SELECT CASE WHEN train = 'Combined' THEN 'pooled' ELSE 'stratified' END AS mode, label, score FROM cells WHERE train = test),
m AS ({sql_auc("s", "mode")})
SELECT round(max(auc) FILTER (mode = 'stratified'), 6) AS auc_stratified, round(max(auc) FILTER (mode = 'pooled'), 6) AS auc_pooled,
  round(max(auc) FILTER (mode = 'stratified') - max(auc) FILTER (mode = 'pooled'), 6) AS delta FROM m""",
)
def e15(spark, sf):
    """Models fitted inside each tax stratum against one fitted on all rows."""
    rows = line_features(spark, sf).withColumn(
        "domain", F.when(F.col("tax") > 0.04, "high").otherwise("low")
    )
    cells = cell_scores(rows, LINE_FEATURES, "label", "grp", "domain", ["high", "low"])
    mode = F.when(F.col("train") == COMBINED, "pooled").otherwise("stratified")
    out = stratum_delta(cells.filter("train = test").withColumn("mode", mode), "label")
    return rounded(out, "auc_stratified", "auc_pooled", "delta")


SWEEP_SIZES = sweep_sizes(64)
SWEEP_SQL = f"""{CONSIST_SQL},
pv AS (SELECT CASE domain WHEN '0' THEN '1' ELSE '0' END AS test, domain AS train, feature, avg(value) AS mean, stddev_pop(value) AS std,
         CASE WHEN avg(value) FILTER (label = 1) > avg(value) FILTER (label = 0) THEN 1.0 ELSE -1.0 END AS sg FROM vlong GROUP BY 1, 2, 3),
z AS (SELECT row_id, v.label, train, test, rank, sg * (value - mean) / std AS z FROM vlong v JOIN pv ON v.domain = pv.test AND v.feature = pv.feature
      JOIN cr ON cr.feature = v.feature),
ns AS (SELECT unnest([{", ".join(map(str, SWEEP_SIZES))}]) AS top_n),
sc AS (SELECT train, test, top_n, row_id, label, round(sum(z) / top_n, 9) AS score FROM z JOIN ns ON rank <= top_n GROUP BY 1, 2, 3, 4, 5),
sa AS ({sql_auc("sc", "train, test, top_n")})"""


def _sweep(spark, sf):
    long = vector_long(spark, sf)
    order = consistency_ranking(signed_auc(long, ["domain", "feature"]), 2)
    sides = F.explode(F.array(F.lit("0"), F.lit("1"))).alias("train")
    ranking = order.select("feature", "rank", sides)
    means = long.groupBy("domain", "feature").agg(
        F.avg(F.when(F.col("label") == 1, F.col("value"))).alias("pm"),
        F.avg(F.when(F.col("label") == 0, F.col("value"))).alias("nm"),
    )
    params = scale_table(long, ["domain", "feature"]).join(means, ["domain", "feature"])
    params = params.withColumnRenamed("domain", "train")
    rows = long.withColumn("train", F.when(F.col("domain") == "0", "1").otherwise("0"))
    sign = F.when(F.col("pm") > F.col("nm"), 1.0).otherwise(-1.0)
    z = lookup_join(rows, params, ["train", "feature"]).withColumn(
        "z", sign * (F.col("value") - F.col("mean")) / F.col("std")
    )
    z = z.withColumnRenamed("domain", "test").select("row_id", "label", "test", "train", "feature", "z")
    scores = top_n_scores(z, ranking, SWEEP_SIZES, ["row_id", "label", "test"])
    return auc(scores, ["train", "test", "top_n"], "score", "label")


@query(
    "e16_top_n_sweep",
    f"""WITH {SWEEP_SQL} SELECT train, test, top_n::INT AS top_n, n_pos, n_neg, round(auc, 6) AS auc FROM sa""",
)
def e16(spark, sf):
    return rounded(_sweep(spark, sf), "auc")


@query(
    "e16_best_size",
    f"""WITH {SWEEP_SQL}, m AS (SELECT top_n, avg(auc) AS a FROM sa GROUP BY 1)
SELECT top_n::INT AS top_n, round(a, 6) AS mean_auc, row_number() OVER (ORDER BY a DESC, top_n) = 1 AS best FROM m""",
)
def e16_best(spark, sf):
    return rounded(best_size(settle(_sweep(spark, sf))), "mean_auc")


E17_SQL = DOC_SQL + """,
docr AS (SELECT doc_id AS row_id, doc.*, doc_id AS grp FROM doc), """ + sql_cells("docr", DOC_FEATURES)


@query(
    "e17_category_table",
    f"""WITH {E17_SQL}, {SUBSET_SQL}, m AS ({sql_auc("sb", "subset, train, test")})
SELECT subset, round(max(auc) FILTER (train = 'en' AND test = 'en'), 6) AS within_en,
  round(max(auc) FILTER (train = 'rest' AND test = 'rest'), 6) AS within_rest,
  round(max(auc) FILTER (train = 'en' AND test = 'rest'), 6) AS en_to_rest,
  round(max(auc) FILTER (train = 'rest' AND test = 'en'), 6) AS rest_to_en FROM m GROUP BY 1""",
)
def e17(spark, sf):
    """Row folds inside a domain, whole domains across; parameters from training rows only."""
    rows = docs(spark, sf).withColumn("grp", F.col("row_id"))
    cells = cell_scores(rows, DOC_FEATURES, "label", "grp", "domain", DOC_DOMAINS)
    scored = subset_scores(cells, SUBSETS, DOC_FEATURES)
    m = auc(scored, ["subset", "train", "test"], "subset_score", "label")
    names = {"within_en": ("en", "en"), "within_rest": ("rest", "rest"),
             "en_to_rest": ("en", "rest"), "rest_to_en": ("rest", "en")}
    return m.groupBy("subset").agg(
        *[
            r6(F.max(F.when((F.col("train") == a) & (F.col("test") == b), F.col("auc")))).alias(n)
            for n, (a, b) in names.items()
        ]
    )


GROUP_SQL = """
og AS (SELECT l_orderkey AS row_id, l_orderkey AS grp, min(l_linestatus) AS domain, min((l_returnflag = 'R')::INT) AS label,
         avg(l_quantity) AS quantity, avg(l_extendedprice) AS price, avg(l_discount) AS discount, avg(l_tax) AS tax
       FROM lineitem GROUP BY l_orderkey), """ + sql_cells("og", LINE_FEATURES)


@query(
    "e18_group_level",
    f"""WITH {GROUP_SQL}, m AS ({sql_auc("(SELECT * FROM cells WHERE train = test)", "train, test")})
SELECT train, test, n_pos, n_neg, round(auc, 6) AS auc FROM m""",
)
def e18(spark, sf):
    """Orders as groups of lines: means per order, then within-domain folds."""
    rows = line_features(spark, sf, [F.col("l_orderkey").alias("order_id")])
    # folds, parameters and scores read the orders, so their lines are added up once
    groups = settle(group_means(rows, "order_id", "label", LINE_FEATURES, carry=["domain"]).drop("label_consistent"))
    groups = groups.withColumn("grp", F.col("order_id"))
    cells = own_cell_scores(groups, LINE_FEATURES, "label", "grp", "domain", LINE_DOMAINS)
    return rounded(auc(cells, ["train", "test"], "score", "label"), "auc")


SUMMARY_SQL = f"""{SUBSET_SQL}, {sql_intervals("sb", "subset, train, test")},
{_metrics_sql("sb", "subset, train, test")}, m AS ({sql_auc("sb", "subset, train, test")})"""


@query(
    "e19_scenario_summary",
    f"""WITH {DOC_CELLS}, {SUMMARY_SQL}
SELECT CASE WHEN train = test THEN train ELSE train || ' -> ' || test END AS analysis, subset AS model,
  m.n_pos, m.n_neg, round(m.auc, 6) AS auc, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(mcc, 6) AS mcc,
  round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi
FROM mt JOIN m USING (subset, train, test) JOIN ci USING (subset, train, test)""",
)
def e19(spark, sf):
    rows = settle(doc_subsets(spark, sf).select("subset", "train", "test", "row_id", "label", "score"))
    keys = ["subset", "train", "test"]
    table_ = summary(rows, keys, "label")
    ci = auc_interval(rows, keys, "score", "label", "row_id", N_BOOT)
    analysis = F.when(F.col("train") == F.col("test"), F.col("train")).otherwise(
        F.concat_ws(" -> ", "train", "test")
    )
    out = table_.join(ci, keys).select(
        analysis.alias("analysis"), F.col("subset").alias("model"), "n_pos", "n_neg", "auc",
        "accuracy", "f1", "mcc", "ci_lo", "ci_hi",
    )
    return rounded(out, "auc", "accuracy", "f1", "mcc", "ci_lo", "ci_hi")


@query(
    "e20_best_per_direction",
    f"""WITH {DOC_CELLS}, {SUBSET_SQL}, m AS ({sql_auc(f"(SELECT * FROM sb WHERE {CROSS})", "subset, train, test")})
SELECT train, test, max_by(subset, (auc, subset)) AS best_model, round(max(auc), 6) AS auc FROM m GROUP BY 1, 2""",
)
def e20(spark, sf):
    rows = doc_subsets(spark, sf).filter(CROSS)
    m = auc(rows, ["subset", "train", "test"], "score", "label").withColumnRenamed("subset", "model")
    return rounded(best_per(m, ["train", "test"]), "auc")


