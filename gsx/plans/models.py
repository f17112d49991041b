"""M: train-side transforms and classifiers, scored across domains."""

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gsx.operators import ensembles as EN
from gsx.operators import models as M
from gsx.operators import trees as TR
from gsx.operators.evaluate import squash, with_intervals
from gsx.operators.ordered import auc, lookup_join
from gsx.operators.split import with_group_folds
from gsx.plans.base import (
    DOC_DOMAINS,
    DOC_FEATURES,
    DOC_SQL,
    LINE_SQL,
    doc_features,
    doc_long,
    line_features,
    line_long,
    r6,
    registry,
    rounded,
    table,
)
from gsx.plans.evaluation import (
    CROSS,
    DOC_CELLS,
    N_BOOT,
    SUBSET_SQL,
    doc_cells,
    doc_subsets,
    docs,
)
from gsx.session import scratch_path, settle, side_by_side

QUERIES, query = registry()


@query(
    "m1_median_imputer",
    f"""WITH {LINE_SQL}, m AS (SELECT domain, median(nullif(discount, 0.04)) AS d FROM line GROUP BY 1)
SELECT row_id, quantity, coalesce(nullif(discount, 0.04), d) AS discount FROM line JOIN m USING (domain)""",
)
def m1(spark, sf):
    """Missing discounts take the median of their domain."""
    rows = line_features(spark, sf).withColumn("discount", F.nullif("discount", F.lit(0.04)))
    med = M.median_table(rows.select("domain", F.col("discount").alias("value")), ["domain"])
    filled = lookup_join(rows, med, "domain")
    return filled.select(
        "row_id", "quantity", F.coalesce("discount", "median").alias("discount")
    )


@query(
    "m1_median_table",
    f"""WITH {DOC_SQL} SELECT domain, feature, round(median(value), 6) AS median FROM doc_long GROUP BY 1, 2""",
)
def m1_table(spark, sf):
    return rounded(M.median_table(doc_long(spark, sf), ["domain", "feature"]), "median")


@query(
    "m2_standard_scaler",
    f"""WITH {LINE_SQL}
SELECT domain, feature, round(avg(value), 6) AS mean,
  round(CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END, 6) AS std FROM line_long GROUP BY 1, 2""",
)
def m2(spark, sf):
    return rounded(M.scale_table(line_long(spark, sf), ["domain", "feature"]), "mean", "std")


@query(
    "m3_robust_scaler",
    f"""WITH {LINE_SQL}
SELECT domain, feature, round(median(value), 6) AS median,
  round(CASE WHEN quantile_cont(value, 0.75) > quantile_cont(value, 0.25)
        THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE 1 END, 6) AS iqr FROM line_long GROUP BY 1, 2""",
)
def m3(spark, sf):
    return rounded(M.robust_table(line_long(spark, sf), ["domain", "feature"]), "median", "iqr")


@query(
    "m4_class_weights",
    f"""WITH {DOC_SQL}, c AS (SELECT lang, sum(label) AS p, count(*) - sum(label) AS n FROM doc GROUP BY 1)
SELECT lang, p::BIGINT AS n_pos, n::BIGINT AS n_neg, round(CASE WHEN p > 0 THEN (p + n) / (2.0 * p) END, 6) AS weight_pos,
  round(CASE WHEN n > 0 THEN (p + n) / (2.0 * n) END, 6) AS weight_neg, round(n / (p + 1e-6), 6) AS scale_pos FROM c""",
)
def m4(spark, sf):
    out = M.class_weights(doc_features(spark, sf), "label", ["lang"])
    return rounded(out, "weight_pos", "weight_neg", "scale_pos")


NB_FEATURES = ("n_chars", "digit_share", "mean_word_len")


def _nb_sql():
    stats = ", ".join(
        f"var_pop({f}) AS v_{f}, "
        + ", ".join(
            f"avg({f}) FILTER (label = {c}) AS mu{c}_{f}, var_pop({f}) FILTER (label = {c}) AS var{c}_{f}"
            for c in (0, 1)
        )
        for f in NB_FEATURES
    )
    eps = "1e-9 * greatest(" + ", ".join(f"v_{f}" for f in NB_FEATURES) + ")"

    def loglik(c):
        prior = "ln(p / (p + n))" if c else "ln(n / (p + n))"
        return prior + "".join(
            f" - 0.5 * ln(2 * pi() * (var{c}_{f} + {eps})) - ({f} - mu{c}_{f}) * ({f} - mu{c}_{f}) / (2 * (var{c}_{f} + {eps}))"
            for f in NB_FEATURES
        )

    return f"""WITH {DOC_SQL},
p AS (SELECT domain AS train, sum(label)::DOUBLE AS p, (count(*) - sum(label))::DOUBLE AS n, {stats} FROM doc GROUP BY 1)
SELECT doc_id, train, domain AS test, round({loglik(1)} - ({loglik(0)}), 6) AS log_odds FROM doc JOIN p ON train <> domain"""


@query("m9_gaussian_naive_bayes", _nb_sql())
def m9(spark, sf):
    rows = doc_features(spark, sf)
    params = M.gaussian_tables(rows, NB_FEATURES, "label", ["domain"])
    params = params.withColumnRenamed("domain", "train")
    other = F.when(F.col("domain") == "en", "rest").otherwise("en")
    scored = lookup_join(rows.withColumn("train", other), params, "train")
    odds = r6(M.gaussian_log_odds(NB_FEATURES)).alias("log_odds")
    return scored.select("doc_id", "train", F.col("domain").alias("test"), odds)


@query(
    "m10_nearest_neighbours",
    """
WITH a AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 2 = 1),
b AS (SELECT vec_id AS tid, embedding::DOUBLE[] AS x, (label >= 5)::INT AS y FROM embeddings WHERE vec_id % 2 = 0),
d AS (SELECT row_id, tid, y, list_distance(a.x, b.x) AS d FROM a, b),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, tid) AS r FROM d)
SELECT row_id, sum(y)::INT AS votes, round(avg(y), 6) AS score FROM k WHERE r <= 5 GROUP BY 1""",
)
def m10(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        (F.col("label") >= 5).cast("int").alias("y"),
    )
    odd = F.col("row_id") % 2 == 1
    return rounded(M.knn_votes(rows.filter(odd), rows.filter(~odd)), "score")


@query(
    "m16_soft_voting",
    f"""WITH {DOC_CELLS}, {SUBSET_SQL}
SELECT row_id, train, test, count(*) AS n_models, round(avg(1 / (1 + exp(-score))), 6) AS score FROM sb WHERE {CROSS} GROUP BY 1, 2, 3""",
)
def m16(spark, sf):
    rows = doc_subsets(spark, sf).filter(CROSS).withColumn("score", squash(F.col("score")))
    return rounded(M.soft_vote(rows, ["row_id", "train", "test"]), "score")


@query(
    "m21_baseline_scorer",
    f"""WITH {DOC_CELLS} SELECT row_id, train, test, round(score, 6) AS score FROM cells WHERE {CROSS}""",
)
def m21(spark, sf):
    rows = doc_cells(spark, sf).filter(CROSS)
    return rows.select("row_id", "train", "test", r6("score").alias("score"))


# --- Spark ML ---------------------------------------------------------------------------------


def transfer(spark, sf, scorers) -> object:
    """AUC of scorers (name -> function of train and test) on both true transfers."""
    rows = settle(docs(spark, sf))

    def scored(name, scorer, a, b):
        part = scorer(rows.filter(F.col("domain") == a), rows.filter(F.col("domain") == b))
        return part.select("label", "score").withColumns(
            {"train": F.lit(a), "test": F.lit(b), "model": F.lit(name)}
        )

    fits = [partial(scored, n, s, *pair) for n, s in scorers.items() for pair in (DOC_DOMAINS, DOC_DOMAINS[::-1])]
    out = reduce(DataFrame.unionByName, side_by_side(spark, fits))
    return rounded(auc(out, ["train", "test", "model"], "score", "label"), "auc")


def plain(name, **options):
    return lambda tr, te: M.fit_score(tr, te, DOC_FEATURES, "label", name, **options)


@query("m5_logistic")
def m5(spark, sf):
    return transfer(spark, sf, {"logistic": plain("logistic")})


@query("m6_penalised_logistic")
def m6(spark, sf):
    names = ("l1_logistic", "elastic_net", "sgd_elastic")
    return transfer(spark, sf, {n: plain(n) for n in names})


def calibrated(name):
    return lambda tr, te: M.calibrated(tr, te, DOC_FEATURES, "label", name, "row_id", k=5)


@query("m7_ridge_calibrated")
def m7(spark, sf):
    return transfer(spark, sf, {"ridge": calibrated("ridge")})


@query("m8_shrinkage_lda")
def m8(spark, sf):
    return transfer(
        spark, sf, {"lda": lambda tr, te: M.lda_scores(tr, te, DOC_FEATURES, "label")}
    )


@query("m11_linear_svm_calibrated")
def m11(spark, sf):
    return transfer(spark, sf, {"linear_svm": calibrated("linear_svm")})


@query("m12_rff_svm")
def m12(spark, sf):
    return transfer(
        spark, sf, {"rff_svm": lambda tr, te: M.rff_svm_calibrated(tr, te, DOC_FEATURES, "label", "row_id")}
    )


def tree_transfer(spark, sf, names):
    """AUC of tree models on both true transfers; both directions are grown together."""
    rows = settle(docs(spark, sf).select("row_id", "label", "domain", *DOC_FEATURES))
    scores = TR.transfer_scores(rows, DOC_FEATURES, "label", "row_id", "domain", names)
    return rounded(auc(scores, ["train", "test", "model"], "score", "label"), "auc")


@query("m13_decision_tree")
def m13(spark, sf):
    return tree_transfer(spark, sf, ("decision_tree", "shallow_tree"))


@query("m14_random_forest")
def m14(spark, sf):
    """Every published forest, whole."""
    return tree_transfer(spark, sf, ("forest_small", "forest_100", "forest_300", "random_forest", "forest_500"))


@query("m15_gradient_boosting")
def m15(spark, sf):
    """Every published boosting, whole."""
    return tree_transfer(spark, sf, ("boosting", "boosting_150", "boosting_300"))


SPLIT_FEATURES = ("quantity", "discount", "tax")


def _split_sql(a: str, b: str, pure: str, left: str) -> str:
    """Best root split per part: sums over values up to each threshold, best gain in millionths."""

    def of(text, side):
        return text.format(a=f"{side}a", b=f"{side}b")

    order = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(SPLIT_FEATURES))
    return f"""WITH {LINE_SQL},
src AS (SELECT split_part(row_id, '-', 2)::BIGINT % 2 AS part, label, quantity, discount, tax FROM line),
n AS (SELECT part, sum(label)::DOUBLE AS p, (count(*) - sum(label))::DOUBLE AS q FROM src GROUP BY 1),
v AS (SELECT part, label, feature, value FROM src UNPIVOT (value FOR feature IN ({", ".join(SPLIT_FEATURES)}))),
s AS (SELECT part, feature, value, sum({a}) AS a, sum({b}) AS b, count(*) AS c FROM v JOIN n USING (part) GROUP BY 1, 2, 3),
c AS (SELECT *, sum(a) OVER u AS la, sum(b) OVER u AS lb, sum(c) OVER u AS lc,
        sum(a) OVER w AS ta, sum(b) OVER w AS tb, sum(c) OVER w AS tc FROM s
      WINDOW w AS (PARTITION BY part, feature), u AS (PARTITION BY part, feature ORDER BY value)),
r AS (SELECT *, ta - la AS ra, tb - lb AS rb FROM c WHERE lc < tc),
g AS (SELECT *, round(1e6 * ({of(pure, "l")} + {of(pure, "r")} - {of(pure, "t")})) AS gain FROM r)
SELECT part, feature, round(value, 6) AS threshold, gain / 1e6 AS gain, lc::BIGINT AS left_rows,
  round({of(left, "l")}, 6) AS left_value, round({of(left, "r")}, 6) AS right_value
FROM g QUALIFY row_number() OVER (PARTITION BY part ORDER BY gain DESC, CASE feature {order} END, value) = 1"""


def _root_splits(spark, sf, spec):
    rows = line_features(spark, sf).withColumn("part", F.split("row_id", "-")[1].cast("bigint") % 2)
    out = TR.root_splits(rows, SPLIT_FEATURES, "label", "row_id", "part", spec)
    return rounded(out, "threshold", "left_value", "right_value")


@query(
    "m13_root_splits",
    _split_sql(
        "CASE WHEN label = 0 THEN (p + q) / (2 * q) ELSE 0 END", "CASE WHEN label = 1 THEN (p + q) / (2 * p) ELSE 0 END",
        "({a} * {a} + {b} * {b}) / ({a} + {b})", "{b} / ({a} + {b})",
    ),
)
def m13_splits(spark, sf):
    """Root of a balanced Gini tree on features of few values, odd and even lines apart."""
    return _root_splits(spark, sf, TR.SPECS["decision_tree"])


@query(
    "m15_root_splits",
    _split_sql(
        "CASE WHEN label = 1 THEN -0.5 * q / (p + 1e-6) ELSE 0.5 END",
        "CASE WHEN label = 1 THEN 0.25 * q / (p + 1e-6) ELSE 0.25 END",
        "{a} * {a} / ({b} + 1)", "-0.05 * {a} / ({b} + 1)",
    ),
)
def m15_splits(spark, sf):
    """Root of the first boosted tree with second-order gain and positive weight."""
    return _root_splits(spark, sf, TR.SPECS["boosting_150"])


def base_models(spark, sf):
    """Held-out scores of all base models for both true transfers, five inner folds of whole groups."""
    rows = settle(docs(spark, sf).select("row_id", "label", "grp", "domain", *DOC_FEATURES))
    folded = with_group_folds(rows, "grp", "label", 5, part=("domain",))
    a, b = DOC_DOMAINS
    tests = F.array(F.when(F.col("domain") == a, b).otherwise(a))
    return EN.base_scores(folded, DOC_FEATURES, "label", "row_id", F.array("domain"), tests, "fold")


def _by_direction(scored):
    a, b = DOC_DOMAINS
    test = F.when(F.col("set") == a, b).otherwise(a)
    named = scored.withColumn("test", test).withColumnRenamed("set", "train")
    return rounded(auc(named, ["train", "test"], "score", "label"), "auc")


@query("m16_fitted_voting")
def m16_fitted(spark, sf):
    """Mean probability of the five fitted base models on both true transfers."""
    return _by_direction(EN.vote(base_models(spark, sf).filter("role = 'test'")))


@query("m17_stacking")
def m17(spark, sf):
    """Stacking inside each domain: five outer folds of groups, five inner folds for the base scores."""
    rows = settle(docs(spark, sf).select("row_id", "label", "grp", "domain", *DOC_FEATURES))
    outer = with_group_folds(rows, "grp", "label", 5, part=("domain",)).withColumnRenamed("fold", "outer_fold")
    both = with_group_folds(outer, "grp", "label", 5, seed=43, part=("domain",))
    sets = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda o: F.concat_ws("~", "domain", o.cast("string")))
    own = F.concat_ws("~", "domain", F.col("outer_fold").cast("string"))
    cells = F.filter(sets, lambda t: t != own)
    scored = EN.base_scores(settle(both), DOC_FEATURES, "label", "row_id", cells, F.array(own), "fold")
    out = EN.stack(scored, "label").withColumn("domain", F.split("set", "~")[0])
    return rounded(auc(out, ["domain"], "score", "label"), "auc")


@query("m18_cross_domain_stacking")
def m18(spark, sf):
    return _by_direction(EN.stack(base_models(spark, sf), "label"))


@query("m19_target_stacking")
def m19(spark, sf):
    """Base models of one domain, second model from three tenths of the other."""
    return _by_direction(EN.stack_on_part(base_models(spark, sf), "label", "row_id"))


@query("e11_seven_models")
def e11_seven(spark, sf):
    """The five base models, their vote and their stacking on both true transfers, with intervals."""
    scored = settle(base_models(spark, sf))
    tested = scored.filter("role = 'test'")
    keep = ["row_id", "label", "set"]
    rows = tested.unpivot(keep, list(EN.BASE), "model", "score")
    for name, one in (("vote", EN.vote(tested)), ("stacking", EN.stack(scored, "label"))):
        rows = rows.unionByName(one.select(*keep, F.lit(name).alias("model"), "score"))
    a, b = DOC_DOMAINS
    rows = settle(rows.withColumn("test", F.when(F.col("set") == a, b).otherwise(a)).withColumnRenamed("set", "train"))
    keys = ["train", "test", "model"]
    out = with_intervals(auc(rows, keys, "score", "label"), rows, keys, "label", "row_id", N_BOOT)
    return rounded(out, "auc", "ci_lo", "ci_hi")


@query("m20_refit_and_persist")
def m20(spark, sf):
    """Refit on all rows, save, load again and score with the loaded model."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    rows = settle(docs(spark, sf))
    path = scratch_path(spark, "model")
    M.refit_and_save(rows, DOC_FEATURES, "label", "logistic", path)
    scored = PipelineModel.load(path).transform(rows)
    scored = scored.withColumn("score", vector_to_array("probability")[1])
    return rounded(auc(scored, ["domain"], "score", "label"), "auc")
