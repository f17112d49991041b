"""Within- and cross-domain evaluation of scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gsx.operators.bootstrap import auc_interval, auc_with_interval
from gsx.operators.ordered import auc, counted, lookup_join, running_counts
from gsx.operators.split import deal_folds, group_table
from gsx.session import settle

COMBINED = "Combined"
FULL = -1
SCORE_DIGITS = 9
CASCADE_LIMITS = (0.70, 0.65)
MIN_SLICE = 5
TOP_N = (3, 5, 7, 9, 12, 15, 20, 25, 30, 40, 50, 77)


# --- metrics -----------------------------------------------------------------------


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion(df: DataFrame, keys, pred: str, label: str) -> DataFrame:
    """tp, fp, tn, fn per key in one aggregate."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    known = F.col(label).isNotNull() & F.col(pred).isNotNull()
    return (
        df.filter(known)
        .groupBy(*keys)
        .agg(
            F.count_if(y & p).alias("tp"),
            F.count_if(~y & p).alias("fp"),
            F.count_if(~y & ~p).alias("tn"),
            F.count_if(y & ~p).alias("fn"),
        )
    )


def confusion_of(counts: DataFrame, keys, score: str) -> DataFrame:
    """tp, fp, tn, fn per key of a table of ``value_counts``; a score of 0 or more predicts class 1."""
    yes = F.col(score) >= 0

    def total(cond, name):
        return F.sum(F.when(cond, F.col(name)).otherwise(0))

    return counts.groupBy(*keys).agg(
        total(yes, "_p").alias("tp"), total(yes, "_n").alias("fp"),
        total(~yes, "_n").alias("tn"), total(~yes, "_p").alias("fn"),
    )


def metric_columns() -> dict[str, Column]:
    """Accuracy, precision, recall, F1, MCC and weighted forms from tp, fp, tn, fn.

    A zero denominator gives 0.
    """
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n, pos, neg = tp + fp + tn + fn, tp + fn, tn + fp
    prec, rec = _zero(F.try_divide(tp, tp + fp)), _zero(F.try_divide(tp, pos))
    nprec, nrec = _zero(F.try_divide(tn, tn + fn)), _zero(F.try_divide(tn, neg))
    f1 = _zero(F.try_divide(2 * tp, 2 * tp + fp + fn))
    nf1 = _zero(F.try_divide(2 * tn, 2 * tn + fp + fn))
    mcc = F.try_divide(
        tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(pos) * F.sqrt(neg) * F.sqrt(tn + fn)
    )

    def weighted(a, b):
        return _zero(F.try_divide(a * pos + b * neg, n))

    return {
        "accuracy": _zero(F.try_divide(tp + tn, n)),
        "precision": prec,
        "recall": rec,
        "f1": f1,
        "mcc": _zero(mcc),
        "weighted_precision": weighted(prec, nprec),
        "weighted_recall": weighted(rec, nrec),
        "weighted_f1": weighted(f1, nf1),
        "true_pos_pct": _zero(F.try_divide(100.0 * tp, pos)),
        "true_neg_pct": _zero(F.try_divide(100.0 * tn, neg)),
    }


def class_metrics(df: DataFrame, keys, pred: str, label: str) -> DataFrame:
    return confusion(df, keys, pred, label).withColumns(metric_columns())


def roc_points(df: DataFrame, keys, score: str, label: str) -> DataFrame:
    """Threshold, false and true positive rate at every distinct score."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    totals = df.groupBy(*keys).agg(
        F.count_if((F.col(label) == 1) & F.col(score).isNotNull()).alias("_P"),
        F.count_if((F.col(label) == 0) & F.col(score).isNotNull()).alias("_N"),
    )
    points = running_counts(df, keys, score, label, descending=True)
    joined = lookup_join(points, totals, keys)
    return joined.select(
        *keys,
        F.col(score).alias("threshold"),
        F.try_divide((F.col("neg_before") + F.col("neg")).cast("double"), F.col("_N")).alias("fpr"),
        F.try_divide((F.col("pos_before") + F.col("pos")).cast("double"), F.col("_P")).alias("tpr"),
    )


def on_grid(score: Column, digits: int = SCORE_DIGITS) -> Column:
    """Nearest multiple of 10^-digits; cheaper than decimal rounding."""
    return F.rint(score * 10.0**digits) / 10.0**digits


# --- fitted parameters ---------------------------------------------------------------


def with_cell_folds(df: DataFrame, label, group, domain, k=5, seed=42) -> DataFrame:
    """Group folds inside each domain (``fold``) and over all rows (``fold_all``).

    Both are dealt from one table of groups.  Rows of a domain with too few groups, and
    rows without a group, stay with a NULL fold.
    """
    groups = settle(group_table(df, group, label, [domain]))
    inner = deal_folds(groups, group, k, seed, [domain]).select(domain, group, "fold")
    merged = groups.groupBy(group).agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg")
    )
    pooled = deal_folds(merged, group, k, seed).select(group, F.col("fold").alias("fold_all"))
    # one row per (domain, group), so no group is hot here
    folds = groups.select(domain, group).join(inner, [domain, group], "left").join(pooled, group, "left")
    return lookup_join(df, folds.filter(F.col(group).isNotNull()), [domain, group], "left")


def equal_rows(folded: DataFrame, features, label, domain, more=()) -> DataFrame:
    """Rows that are equal in ``more``, domain, folds, label and features as one with ``n_rows``, settled.

    The variants of one tuple of features lie together, so that later counts per score
    combine before their shuffle.
    """
    told = [*more, domain, *features]
    tuples = folded.groupBy(*told, "fold", "fold_all", label).agg(F.count(F.lit(1)).alias("n_rows"))
    return settle(tuples.repartition(*told))


def class_sums(df: DataFrame, features, label, by, weight: str | None = None) -> DataFrame:
    """(by, label, feature position, count, sum, sum of squares), one pass over the rows.

    Training sets are unions of these cells, so the pass serves every fold, domain and
    pooled training set.  The long form has a few rows per feature and fold.
    """
    x = [F.col(f).cast("double") for f in features]
    w = F.lit(1) if weight is None else F.col(weight)
    wide = df.groupBy(*by, label).agg(
        F.array(*[counted(v.isNotNull(), weight) for v in x]).alias("_c"),
        F.array(*[F.sum(v * w) for v in x]).alias("_s"),
        F.array(*[F.sum(v * v * w) for v in x]).alias("_q"),
    )
    return wide.select(*by, label, F.posexplode(F.arrays_zip("_c", "_s", "_q")).alias("_f", "_z")).select(
        *by, label, "_f", "_z.*"
    )


def _training_sets(domain: str, k: int, combined: str = COMBINED) -> Column:
    """(train, holdout) pairs a cell of rows belongs to: all but its own fold."""

    def sets(name: Column, fold: str):
        every = F.sequence(F.lit(FULL), F.lit(k - 1))
        others = F.filter(every, lambda h: ~h.eqNullSafe(F.col(fold)))
        return F.transform(others, lambda h: F.struct(name.alias("train"), h.alias("holdout")))

    return F.concat(sets(F.col(domain), "fold"), sets(F.lit(combined), "fold_all"))


def fit_moments(df: DataFrame, features, label, domain, k=5, weight: str | None = None) -> DataFrame:
    """Mean, population deviation and class direction of every feature for each
    (train, holdout) set (M2, M21); ``holdout`` -1 is the whole training set.

    The parameters are arrays ``mean``, ``std`` and ``sign`` in feature order.
    """
    sums = class_sums(df, features, label, [domain, "fold", "fold_all"], weight)
    sets = sums.withColumn("_t", F.explode(_training_sets(domain, k))).select("*", "_t.*")
    c, s = F.col("_c").cast("double"), F.col("_s")

    def class_mean(value):
        mine = F.col(label) == value
        return F.try_divide(F.sum(F.when(mine, s)), F.sum(F.when(mine, c)))

    per = sets.groupBy("train", "holdout", "_f").agg(
        F.try_divide(F.sum(s), F.sum(c)).alias("_m"),
        F.try_divide(F.sum("_q"), F.sum(c)).alias("_q"),
        (class_mean(1) > class_mean(0)).alias("_up"),
    )
    std = F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    entry = F.struct(
        "_f",
        F.col("_m").alias("m"),
        F.when(std > 0, std).otherwise(1.0).alias("s"),
        F.when(F.col("_up"), 1.0).when(~F.col("_up"), -1.0).alias("g"),
    )
    rows = per.groupBy("train", "holdout").agg(F.sort_array(F.collect_list(entry)).alias("_p"))
    return rows.select(
        "train",
        "holdout",
        F.col("_p.m").alias("mean"),
        F.col("_p.s").alias("std"),
        F.col("_p.g").alias("sign"),
    )


def baseline_score(features, fitted=None) -> Column:
    """Mean signed z-score (M21) of ``features`` with parameters of the ``fitted`` ones.

    A missing value counts as the training mean, and so does a feature that one class of
    the training rows has no value of; with one class only there is no score.  Rounded to
    nine digits, so equal scores stay equal whatever the order of sums.
    """
    at = {f: i for i, f in enumerate(fitted or features)}
    total = F.lit(0.0)
    for f in features:
        i = at[f]
        z = F.col("sign")[i] * (F.col(f).cast("double") - F.col("mean")[i]) / F.col("std")[i]
        total = total + F.coalesce(z, F.lit(0.0))
    directed = F.coalesce(*[F.col("sign")[at[f]] for f in features]).isNotNull()
    return F.when(directed, on_grid(total / len(features)))


# --- cells ------------------------------------------------------------------------------


def cell_rows(df: DataFrame, domain: str, domains, combined: str = COMBINED) -> DataFrame:
    """Rows repeated for every (train, test) cell they are tested in.

    The diagonal uses the parameters fitted without the row's fold and leaves out rows
    without one; other cells use the whole training set.  A row meets its own domain's tests and the pooled one only.
    """
    def cells(test: Column, fold: str):
        return [
            F.struct(
                F.lit(t).alias("train"), test.alias("test"), F.when(test == t, F.col(fold)).otherwise(FULL).alias("holdout")
            )
            for t in [*domains, combined]
        ]

    # written out, so that generated code repeats the rows
    every = F.array(*cells(F.col(domain), "fold"), *cells(F.lit(combined), "fold_all"))
    seen = ((F.col("train") == F.col(domain)) | (F.col("train") == combined)) & (
        F.col("train") != F.col("test")
    )
    return (
        df.filter(F.col(domain).isin(*domains))
        .withColumn("_cell", F.explode(every))
        .select("*", "_cell.*")
        .drop("_cell")
        .filter("holdout IS NOT NULL")
        .withColumn("seen_in_training", seen)
    )


def cell_scores(df, features, label, group, domain, domains, k=5, seed=42) -> DataFrame:
    """Every test row of every cell with its baseline score."""
    df = df.filter(F.col(domain).isin(*domains))
    folded = with_cell_folds(df, label, group, domain, k, seed)
    params = fit_moments(folded, features, label, domain, k)
    scored = lookup_join(cell_rows(folded, domain, domains), params, ["train", "holdout"])
    return scored.withColumn("score", baseline_score(features))


def own_cell_scores(df, features, label, group, domain, domains, k=5, seed=42) -> DataFrame:
    """The rows of ``cell_scores`` whose training set is their test set.

    Folded rows are settled, and no other cell repeats them; for data of as many groups as rows.
    """
    df = df.filter(F.col(domain).isin(*domains))
    folded = settle(with_cell_folds(df, label, group, domain, k, seed))
    params = fit_moments(folded, features, label, domain, k)
    cells = None
    for name, fold in ((F.col(domain), "fold"), (F.lit(COMBINED), "fold_all")):
        held = folded.filter(F.col(fold).isNotNull()).select(
            "*", name.alias("train"), name.alias("test"), F.col(fold).cast("int").alias("holdout")
        )
        cells = held if cells is None else cells.unionByName(held)
    scored = lookup_join(cells.withColumn("seen_in_training", F.lit(False)), params, ["train", "holdout"])
    return scored.withColumn("score", baseline_score(features))


def equal_cell_scores(df, features, label, group, domain, domains, more=(), k=5, seed=42) -> DataFrame:
    """``cell_scores`` of equal rows, each with its number ``n_rows``; other columns than ``more`` are gone.

    Folds matter on the diagonal only, so rows that differ in nothing else meet before any
    cell repeats them.
    """
    df = df.filter(F.col(domain).isin(*domains))
    rows = equal_rows(with_cell_folds(df, label, group, domain, k, seed), features, label, domain, more)
    params = fit_moments(rows, features, label, domain, k, "n_rows")
    told, n = [*more, domain, *features, label], F.sum("n_rows").alias("n_rows")
    own, pooled = F.col(domain), F.lit(COMBINED)
    trains = [*domains, COMBINED]
    pairs = F.array(*[F.struct(F.lit(r).alias("train"), t.alias("test")) for t in (own, pooled) for r in trains])
    others = (
        rows.groupBy(*told).agg(n).withColumn("_cell", F.explode(pairs)).select(*told, "n_rows", "_cell.*")
        .filter("train <> test")
        .withColumn("holdout", F.lit(FULL))
    )
    cells = others
    for name, fold in ((own, "fold"), (pooled, "fold_all")):
        held = rows.filter(F.col(fold).isNotNull()).groupBy(*told, fold).agg(n)
        cells = cells.unionByName(
            held.select(*told, "n_rows", name.alias("train"), name.alias("test"), F.col(fold).cast("int").alias("holdout"))
        )
    seen = ((F.col("train") == own) | (F.col("train") == COMBINED)) & (F.col("train") != F.col("test"))
    scored = lookup_join(cells.withColumn("seen_in_training", seen), params, ["train", "holdout"])
    return scored.withColumn("score", baseline_score(features))


def transfer_matrix(scores: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """AUC, row counts and training overlap of every (train, test) cell."""
    base = auc(scores, ["train", "test"], "score", label, weight)
    overlap = scores.groupBy("train", "test").agg(
        counted(F.col("seen_in_training"), weight).alias("overlap_rows")
    )
    return base.join(overlap, ["train", "test"])


def with_intervals(matrix, scores, keys, label, row_id, n_boot=1000, seed=42) -> DataFrame:
    """Matrix rows with their bootstrap interval."""
    ci = auc_interval(scores, keys, "score", label, row_id, n_boot, seed)
    return matrix.join(ci, list(keys), "left")


def matrix_and_intervals(scores, label, hashed, n_boot=1000) -> DataFrame:
    """``with_intervals`` of ``transfer_matrix`` from one sort of the rows; ``hashed`` is their row hash."""
    keys = ["train", "test"]
    overlap = scores.groupBy(*keys).agg(counted(F.col("seen_in_training")).alias("overlap_rows"))
    both = auc_with_interval(scores, keys, "score", label, hashed, n_boot).join(overlap, keys)
    return both.select(*keys, "n_pos", "n_neg", "auc", "overlap_rows", "n_valid", "ci_lo", "ci_hi")


def matrix_wide(matrix: DataFrame, names, value="auc") -> DataFrame:
    """One row per training set, one column per test set."""
    return matrix.groupBy("train").agg(
        *[F.max(F.when(F.col("test") == n, F.col(value))).alias(f"test_{n}") for n in names]
    )


# --- cascade -----------------------------------------------------------------------------


def squash(score: Column) -> Column:
    """Score to a probability with a logistic curve."""
    return 1.0 / (1.0 + F.exp(-score))


def cascade(df: DataFrame, probs, limits=CASCADE_LIMITS) -> DataFrame:
    """Stage that answers each row and the answer's probability.

    A stage answers when its confidence ``max(p, 1-p)`` reaches the limit; the last one
    answers always.
    """
    stage, final = F.lit(len(probs)), F.col(probs[-1])
    for i in range(len(probs) - 2, -1, -1):
        p = F.col(probs[i])
        sure = F.greatest(p, 1 - p) >= limits[i]
        stage = F.when(sure, i + 1).otherwise(stage)
        final = F.when(sure, p).otherwise(final)
    return df.withColumn("stage", stage).withColumn("final", final)


def cascade_report(df: DataFrame, keys, label: str) -> DataFrame:
    """Rows handled, share and AUC per stage and for the whole cascade (stage 0)."""
    keys = list(keys)
    both = df.withColumn("stage_num", F.explode(F.array("stage", F.lit(0))))
    per = auc(both, [*keys, "stage_num"], "final", label)
    sizes = both.groupBy(*keys, "stage_num").agg(F.count(F.lit(1)).alias("n_handled"))
    whole = sizes.filter("stage_num = 0").select(*keys, F.col("n_handled").alias("_all"))
    return (
        sizes.join(per.select(*keys, "stage_num", "auc"), [*keys, "stage_num"], "left")
        .join(whole, keys)
        .withColumn("pct_handled", 100.0 * F.col("n_handled") / F.col("_all"))
        .drop("_all")
    )


def cascade_intervals(df: DataFrame, keys, label: str, row_id: str, n_boot=1000, seed=42) -> DataFrame:
    """Rows handled, share, AUC and bootstrap interval per stage reached and for the whole cascade (stage 0).

    A stage is reached while rows are left for it.  One that answers no row, or rows of one class only,
    has NULL for its AUC and interval (E12).
    """
    keys = list(keys)
    both = df.select(*keys, label, row_id, "final", F.explode(F.array("stage", F.lit(0))).alias("stage_num"))
    both = settle(both)
    reached = both.groupBy(*keys).agg(F.max("stage_num").alias("_last"), F.count_if(F.col("stage_num") == 0).alias("_all"))
    grid = reached.withColumn("stage_num", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    at = [*keys, "stage_num"]
    sizes = both.groupBy(*at).agg(F.count(F.lit(1)).alias("n_handled"))
    scored = auc(both, at, "final", label).select(*at, "auc")
    ci = auc_interval(both, at, "final", label, row_id, n_boot, seed).select(*at, "ci_lo", "ci_hi")
    handled = F.coalesce("n_handled", F.lit(0).cast("bigint"))
    return (
        grid.join(sizes, at, "left").join(scored, at, "left").join(ci, at, "left")
        .select(*at, handled.alias("n_handled"), (100.0 * handled / F.col("_all")).alias("pct_handled"), "auc", "ci_lo", "ci_hi")
    )


# --- feature selection inside folds --------------------------------------------------------


def fold_f_stats(df: DataFrame, features, label, domain, k=5) -> DataFrame:
    """(train, holdout, feature, position, f_stat): one-way F of every training set.

    All sets come from one table of class sums by (domain, fold): a set is a union of its cells, so no
    row of the held-out fold enters and the rows are read once.  A feature that does not vary, or a
    set of one class, has no F.
    """
    sums = class_sums(df, features, label, [domain, "fold", "fold_all"])
    sets = sums.withColumn("_t", F.explode(_training_sets(domain, k))).select("*", "_t.*")
    per = sets.filter(F.col(label).isNotNull()).groupBy("train", "holdout", "_f", label).agg(
        F.sum("_c").cast("double").alias("c"), F.sum("_s").alias("s"), F.sum("_q").alias("q")
    ).filter("c > 0")
    table = per.groupBy("train", "holdout", "_f").agg(
        F.sum(F.col("s") * F.col("s") / F.col("c")).alias("_b"), F.sum("s").alias("_s"), F.sum("c").alias("_c"),
        F.sum("q").alias("_q"), F.count(F.lit(1)).cast("double").alias("_k"),
    )
    between = F.col("_b") - F.col("_s") * F.col("_s") / F.col("_c")
    within = F.col("_q") - F.col("_b")
    f = F.try_divide(F.try_divide(between, F.col("_k") - 1), F.try_divide(within, F.col("_c") - F.col("_k")))
    names = F.array(*[F.lit(n) for n in features])
    # sums of squares leave rounding where nothing varies inside the classes
    solid = within > 1e-12 * F.col("_q")
    return table.select(
        "train", "holdout", names[F.col("_f")].alias("feature"), F.col("_f").alias("position"),
        F.when(solid, f).alias("f_stat"),
    )


def fold_masks(stats: DataFrame, k_best: int) -> DataFrame:
    """(train, holdout, mask): the ``k_best`` features of largest F of each training set, ties by position.

    ``mask`` is an array of booleans in feature order; a feature without F comes last.
    """
    order = F.struct((-F.coalesce(F.col("f_stat"), F.lit(-1.0))).alias("o"), "position")
    rows = stats.groupBy("train", "holdout").agg(F.sort_array(F.collect_list(order)).alias("_o"))
    best = F.slice(F.col("_o.position"), 1, k_best)
    every = F.sequence(F.lit(0), F.size("_o") - 1)
    return rows.select("train", "holdout", F.transform(every, lambda i: F.array_contains(best, i)).alias("mask"))


def masked_baseline(features) -> Column:
    """Mean signed z-score over the features that the row's ``mask`` keeps (see ``baseline_score``)."""
    total, used = F.lit(0.0), F.lit(0)
    for i, f in enumerate(features):
        z = F.col("sign")[i] * (F.col(f).cast("double") - F.col("mean")[i]) / F.col("std")[i]
        total = total + F.when(F.col("mask")[i], F.coalesce(z, F.lit(0.0))).otherwise(0.0)
        used = used + F.col("mask")[i].cast("int")
    directed = F.coalesce(*[F.when(F.col("mask")[i], F.col("sign")[i]) for i in range(len(features))]).isNotNull()
    return F.when(directed, on_grid(F.try_divide(total, used)))


def selected_scores(df, features, label, group, domain, domains, k_best: int, k=5, seed=42) -> DataFrame:
    """Cells as in ``cell_scores`` with features chosen anew inside every training set."""
    df = df.filter(F.col(domain).isin(*domains))
    folded = with_cell_folds(df, label, group, domain, k, seed)
    params = fit_moments(folded, features, label, domain, k)
    masks = fold_masks(fold_f_stats(folded, features, label, domain, k), k_best)
    scored = lookup_join(cell_rows(folded, domain, domains), params.join(masks, ["train", "holdout"]), ["train", "holdout"])
    return scored.withColumn("score", masked_baseline(features))


# --- slices, subsets, sweeps -----------------------------------------------------------


def slice_metrics(df, model, domain, language, pred, score, label) -> DataFrame:
    """Metrics per domain and per language; needs five rows of each class."""
    kinds = F.array(
        F.struct(F.lit("domain").alias("slice"), F.col(domain).alias("slice_value")),
        F.struct(F.lit("language").alias("slice"), F.col(language).alias("slice_value")),
    )
    cut = df.withColumn("_s", F.explode(kinds)).select(model, pred, score, label, "_s.*")
    keys = [model, "slice", "slice_value"]
    m = class_metrics(cut, keys, pred, label).filter(
        (F.col("tp") + F.col("fn") >= MIN_SLICE) & (F.col("tn") + F.col("fp") >= MIN_SLICE)
    )
    a = auc(cut, keys, score, label).select(*keys, "auc")
    return m.select(*keys, "tp", "fp", "tn", "fn", "accuracy", "f1", "mcc").join(a, keys)


def subset_scores(scored: DataFrame, subsets: dict, fitted) -> DataFrame:
    """Rows scored once per feature subset (E13); needs the fitted parameters of all."""
    options = F.array(
        *[
            F.struct(
                F.lit(name).alias("subset"),
                F.lit(len(fs)).alias("n_feats"),
                baseline_score(fs, fitted).alias("subset_score"),
            )
            for name, fs in subsets.items()
        ]
    )
    return scored.withColumn("_o", F.explode(options)).select("*", "_o.*").drop("_o")


def sweep_sizes(n_features: int, sizes=TOP_N) -> list[int]:
    """Distinct sweep sizes after capping at the number of features."""
    return sorted({min(n, n_features) for n in sizes})


def top_n_scores(long: DataFrame, ranking: DataFrame, sizes, row_keys) -> DataFrame:
    """Mean signed z over the best N features for each N.

    ``long`` holds one row per (row keys, train, feature) with ``z``; every N is a
    conditional sum in the same aggregate, so rows are not repeated per N.
    """
    ranked = lookup_join(long, ranking.select("train", "feature", "rank"), ["train", "feature"])
    keys = [*row_keys, "train"]
    sums = ranked.groupBy(*keys).agg(
        *[
            on_grid(F.sum(F.when(F.col("rank") <= n, F.col("z"))) / n).alias(f"n{n}")
            for n in sizes
        ]
    )
    return sums.unpivot(keys, [f"n{n}" for n in sizes], "size_name", "score").withColumn(
        "top_n", F.substring("size_name", 2, 9).cast("int")
    ).drop("size_name")


def best_size(sweep: DataFrame) -> DataFrame:
    """Mean AUC over directions per size, and whether it is the best one."""
    mean = sweep.groupBy("top_n").agg(F.avg("auc").alias("mean_auc"))
    best = mean.agg(F.max_by("top_n", F.struct("mean_auc", -F.col("top_n"))).alias("n"))
    value = best.first()[0]
    return mean.withColumn("best", F.col("top_n") == F.lit(value))


def stratum_delta(scores: DataFrame, label: str, keys=()) -> DataFrame:
    """Merged stratum-wise AUC against the unstratified one.

    ``scores`` has ``mode`` (``stratified`` or ``pooled``) and one score per row.
    """
    keys = list(keys)
    a = auc(scores, [*keys, "mode"], "score", label)
    wide = a.groupBy(*keys) if keys else a.groupBy()
    out = wide.agg(
        F.max(F.when(F.col("mode") == "stratified", F.col("auc"))).alias("auc_stratified"),
        F.max(F.when(F.col("mode") == "pooled", F.col("auc"))).alias("auc_pooled"),
    )
    return out.withColumn("delta", F.col("auc_stratified") - F.col("auc_pooled"))


def summary(scores: DataFrame, keys, label: str, score="score") -> DataFrame:
    """Accuracy, F1, AUC and MCC per key for scores cut at zero."""
    keys = list(keys)
    cut = scores.withColumn("_pred", (F.col(score) >= 0).cast("int"))
    m = class_metrics(cut, keys, "_pred", label).select(*keys, "accuracy", "f1", "mcc")
    a = auc(scores, keys, score, label)
    return a.join(m, keys)
