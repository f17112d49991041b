"""Train-side transforms and classifiers.

Transforms are fitted parameter tables, so they can be read and checked.  Classifiers
are Spark ML estimators; their regularisation and tree splits are Spark's.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gsx.operators.ordered import HOT_ROWS, percentiles
from gsx.operators.split import row_folds
from gsx.session import settle, ship

SEED = 42
ROWS_PER_TASK = 50_000


# --- transforms ---------------------------------------------------------------------------


def median_table(long: DataFrame, keys, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact median per key (M1)."""
    return percentiles(long, keys, "value", (0.5,), hot_rows).withColumnRenamed("q0", "median")


def scale_table(long: DataFrame, keys) -> DataFrame:
    """Mean and population deviation per key; a zero deviation becomes 1 (M2)."""
    t = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return t.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def robust_table(long: DataFrame, keys, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Median and quartile range per key; a zero range becomes 1 (M3)."""
    q = percentiles(long, keys, "value", (0.25, 0.5, 0.75), hot_rows)
    iqr = F.col("q2") - F.col("q0")
    return q.select(
        *keys, F.col("q1").alias("median"), F.when(iqr > 0, iqr).otherwise(1.0).alias("iqr")
    )


def class_weights(df: DataFrame, label: str, keys=()) -> DataFrame:
    """Balanced weight n/(2 n_c) per class and the positive weight neg/(pos+1e-6) (M4)."""
    counts = df.groupBy(*keys).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    )
    n = (F.col("n_pos") + F.col("n_neg")).cast("double")
    return counts.select(
        *keys,
        "n_pos",
        "n_neg",
        F.try_divide(n, 2 * F.col("n_pos")).alias("weight_pos"),
        F.try_divide(n, 2 * F.col("n_neg")).alias("weight_neg"),
        (F.col("n_neg") / (F.col("n_pos") + 1e-6)).alias("scale_pos"),
    )


# --- Gaussian naive Bayes (M9) ---------------------------------------------------------------


def gaussian_tables(df: DataFrame, features, label: str, keys=()) -> DataFrame:
    """Prior, class means and variances per key in one row; variances gain 1e-9 of the
    largest feature variance."""
    y = F.col(label)
    per = []
    for f in features:
        x = F.col(f).cast("double")
        per.append(F.var_pop(x).alias(f"_v_{f}"))
        for c in (0, 1):
            xc = F.when(y == c, x)
            per += [F.avg(xc).alias(f"mu{c}_{f}"), F.var_pop(xc).alias(f"var{c}_{f}")]
    t = df.groupBy(*keys).agg(
        F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_n"), *per
    )
    tops = [F.col(f"_v_{f}") for f in features]
    eps = 1e-9 * (F.greatest(*tops) if len(tops) > 1 else tops[0])
    n = (F.col("_p") + F.col("_n")).cast("double")
    return t.select(
        *keys,
        (F.col("_p") / n).alias("prior1"),
        (F.col("_n") / n).alias("prior0"),
        *[F.col(f"mu{c}_{f}") for f in features for c in (0, 1)],
        *[(F.col(f"var{c}_{f}") + eps).alias(f"var{c}_{f}") for f in features for c in (0, 1)],
    )


def gaussian_log_odds(features) -> Column:
    """Log posterior odds of class 1 from a joined parameter row."""

    def loglik(c):
        total = F.log(f"prior{c}")
        for f in features:
            d = F.col(f).cast("double") - F.col(f"mu{c}_{f}")
            v = F.col(f"var{c}_{f}")
            total = total - 0.5 * F.log(2 * F.pi() * v) - d * d / (2 * v)
        return total

    return loglik(1) - loglik(0)


# --- k nearest neighbours (M10) -----------------------------------------------------------------

#: Training rows of a block, and test rows that visit one together.
KNN_BLOCK = 4_096
#: Training rows that part the others into cells; the driver holds so many vectors.
KNN_PIVOTS = 64


def _nearest(k, train_ids, train_x, train_y):
    """Candidates of one batch of test rows against one block of training rows.

    A matrix product rules rows out; those within its rounding of the ``k`` nearest are compared exactly.
    """
    squares = (train_x**2).sum(axis=1)
    rounding = 4 * (train_x.shape[1] + 8) * np.finfo(float).eps

    def near(x):
        every = np.ones((len(x), len(train_x)), bool)
        if len(train_x) <= k:
            return every
        own = (x**2).sum(axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            d = own[:, None] + squares - 2 * (x @ train_x.T)
        if not np.isfinite(d).all():
            return every
        limit = np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * rounding * (own + squares.max())
        return d <= limit[:, None]

    def top(ids, x):
        rows, cols = np.nonzero(near(x))
        d = ((x[rows] - train_x[cols]) ** 2).sum(axis=1)
        order = np.lexsort((train_ids[cols], d, rows))
        rows, cols, d = rows[order], cols[order], d[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        rows, cols = rows[first], cols[first]
        return pd.DataFrame(
            {
                "row_id": np.asarray(ids)[rows],
                "train_id": train_ids[cols],
                "distance": d[first],
                "y": train_y[cols],
            }
        )

    return top


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


KNN_SCHEMA = "row_id bigint, train_id bigint, distance double, y int"


def _gaps(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` to every pivot."""
    parts = [
        np.sqrt(((x[i : i + 256, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)) for i in range(0, len(x), 256)
    ]
    return np.concatenate(parts)


class _Cells:
    """Training rows by their nearest pivot, and which cells a test row must visit.

    A cell is left out only where its nearest possible row is farther than ``k`` rows that are
    known to lie nearer; equal distances are visited, and NaN leaves nothing out.
    """

    def __init__(self, train: DataFrame, k: int, block: int, pivots: int):
        picked = train.orderBy(F.xxhash64("row_id"), "row_id").limit(pivots).select("x").collect()
        self.n_cells, self.n_train = len(picked), 0
        if not picked:
            return
        centres = _matrix([r[0] for r in picked])

        def place(batches):
            for pdf in batches:
                if len(pdf):
                    gaps = _gaps(_matrix(pdf["x"]), centres)
                    cell = gaps.argmin(axis=1)
                    gap = gaps[np.arange(len(pdf)), cell]
                    # a row that holds NaN is as far as can be
                    gap = np.where(np.isnan(gap), np.inf, gap)
                    yield pdf.assign(cell=cell.astype(np.int32), gap=gap)

        placed = settle(train.mapInPandas(place, "row_id bigint, x array<double>, y int, cell int, gap double"))
        blocks = F.ceil(F.col("n") / block).cast("int").alias("blocks")
        # at most one row per pivot
        sizes = placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high")
        )
        self.sizes = settle(sizes.select("cell", "n", "low", "high", blocks))
        part = F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int").alias("block")
        self.rows = placed.join(F.broadcast(self.sizes.select("cell", "blocks")), "cell").select(
            "cell", part, "row_id", "x", "y", "gap"
        )
        near = self.rows.select("cell", "block", "gap")
        for keys in (("cell", "block"), ("cell",)):
            nth = F.row_number().over(Window.partitionBy(*keys).orderBy("gap"))
            near = near.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")
        firsts = {r[0]: r[1] for r in near.groupBy("cell").agg(F.collect_list("gap")).collect()}
        found = sorted(self.sizes.select("cell", "low", "high", "n").collect())
        self.n_train = sum(r[3] for r in found)
        cells = np.array([r[0] for r in found])
        low, high = np.array([r[1] for r in found]), np.array([r[2] for r in found])
        owner = np.repeat(np.arange(len(cells)), [len(firsts[c]) for c in cells])
        known = np.concatenate([firsts[c] for c in cells])

        def visit(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                gaps = _gaps(_matrix(pdf["x"]), centres)
                own = gaps[:, cells]
                if len(known) >= k:
                    limit = np.partition(own[:, owner] + known, k - 1, axis=1)[:, k - 1 : k]
                else:
                    limit = np.full((len(pdf), 1), np.inf)
                least = np.maximum(np.maximum(own - high, low - own), (own - gaps.min(axis=1, keepdims=True)) / 2)
                goes = ~(least > limit * (1 + 1e-9) + 1e-12 * (1 + own))
                yield pdf.assign(cells=[cells[g].tolist() for g in goes])

        self.visit = visit

    def visits(self, test: DataFrame) -> DataFrame:
        """(row_id, x, cell): one row per cell that a test row visits, from a settled row per test row."""
        told = settle(test.mapInPandas(self.visit, "row_id bigint, x array<double>, cells array<int>"))
        return told.select("row_id", "x", F.explode("cells").alias("cell"))


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("x").cast("array<double>").alias("x"))


def _train_cells(train: DataFrame, k: int, block: int, pivots: int) -> _Cells:
    ship(train.sparkSession)
    y = F.col("y").cast("int").alias("y")
    return _Cells(settle(train.select(*_rows(train).columns, y)), k, block, pivots)


def knn_candidates(
    test: DataFrame, train: DataFrame, k: int = 5, block: int = KNN_BLOCK, pivots: int = KNN_PIVOTS
) -> DataFrame:
    """Nearest training rows of every test row (row_id, train_id, distance, y).

    Both frames have ``row_id bigint``, ``x array<double>`` and ``y``.  A test row visits the
    cells that may hold one of its ``k`` nearest rows, block by block, through an equi-join, and
    leaves ``k`` candidates in each block, so the result is exact; no row pairs are written.
    """
    cells = _train_cells(train, k, block, pivots)
    if not cells.n_cells:
        return train.sparkSession.createDataFrame([], KNN_SCHEMA)
    visits = cells.visits(_rows(test))
    groups = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("groups"))
    table = settle(groups.join(cells.sizes.select("cell", "blocks"), "cell"))
    left = visits.join(F.broadcast(table), "cell").select(
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("row_id"), F.col("groups")).cast("int").alias("group"),
        "row_id",
        "x",
    )
    right = cells.rows.join(F.broadcast(table.select("cell", "groups")), "cell").select(
        "cell",
        "block",
        F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"),
        F.col("row_id").alias("tid"),
        F.col("x").alias("tx"),
        "y",
    )

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["row_id", "train_id", "distance", "y"])
        top = _nearest(k, b["tid"].to_numpy(), _matrix(b["tx"]), b["y"].to_numpy())
        parts = [
            top(a["row_id"].iloc[i : i + 64].to_numpy(), _matrix(a["x"].iloc[i : i + 64]))
            for i in range(0, len(a), 64)
        ]
        return pd.concat(parts, ignore_index=True)

    keys = ("cell", "block", "group")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(both, KNN_SCHEMA)


def knn_visited_share(
    test: DataFrame, train: DataFrame, k: int = 5, block: int = KNN_BLOCK, pivots: int = KNN_PIVOTS
) -> DataFrame:
    """(n_test, n_train, compared, share): row pairs that :func:`knn_candidates` compares, of all."""
    cells = _train_cells(train, k, block, pivots)
    if cells.n_cells:
        met = cells.visits(_rows(test)).join(F.broadcast(cells.sizes), "cell")
        pairs = met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
    else:
        pairs = test.agg(F.lit(0).cast("long").alias("compared"))
    every = F.lit(test.count()), F.lit(cells.n_train)
    share = F.try_divide(F.col("compared").cast("double"), every[0].cast("double") * every[1])
    return pairs.select(every[0].alias("n_test"), every[1].alias("n_train"), "compared", share.alias("share"))


def knn_votes(
    test: DataFrame, train: DataFrame, k: int = 5, block: int = KNN_BLOCK, pivots: int = KNN_PIVOTS
) -> DataFrame:
    """(row_id, votes, score): share of positives among the ``k`` nearest.

    At most ``k`` candidates per visited block reach the final choice.
    """
    near = knn_candidates(test, train, k, block, pivots)
    best = near.groupBy("row_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("distance", "train_id", "y"))), 1, k).alias("n")
    )
    votes = F.aggregate("n", F.lit(0), lambda a, v: a + v["y"])
    return best.select("row_id", votes.alias("votes"), (votes / F.size("n")).alias("score"))


# --- Spark ML estimators ---------------------------------------------------------------------


def fit_scaling(df: DataFrame, features) -> list[tuple[float, float, float]]:
    """(median, mean, deviation) of every feature, mean and deviation after imputing.

    One row per feature is read by the driver, as a Spark ML fit does.
    """
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [], list(features), "feature", "value"
    )
    med = {r["feature"]: r["median"] for r in median_table(long, ["feature"]).collect()}
    fill = {f: float(med.get(f) or 0.0) for f in features}
    one = df.agg(
        *[
            fn(F.coalesce(F.col(f).cast("double"), F.lit(fill[f])))
            for f in features
            for fn in (F.avg, F.stddev_pop)
        ]
    ).first()
    return [
        (fill[f], float(one[2 * i] or 0.0), float(one[2 * i + 1] or 1.0))
        for i, f in enumerate(features)
    ]


def prepared(df: DataFrame, features, label: str, scaling=None) -> DataFrame:
    """Rows with a scaled vector ``features_v``; the scaling comes from training rows."""
    scaling = scaling or fit_scaling(df, features)
    cells = [
        (F.coalesce(F.col(f).cast("double"), F.lit(m)) - mean) / std
        for f, (m, mean, std) in zip(features, scaling)
    ]
    return df.withColumn("features_v", array_to_vector(F.array(*cells))).withColumn(
        "label_v", F.col(label).cast("double")
    )


def prepared_pair(train: DataFrame, test: DataFrame, features, label: str):
    """Both frames scaled by the training rows."""
    scaling = fit_scaling(train, features)
    return prepared(train, features, label, scaling), prepared(test, features, label, scaling)


def weighted(df: DataFrame) -> DataFrame:
    """Balanced class weight in ``weight_v``; two counts are read."""
    c = df.agg(F.count_if(F.col("label_v") == 1), F.count_if(F.col("label_v") == 0)).first()
    n = c[0] + c[1]
    return df.withColumn(
        "weight_v",
        F.when(F.col("label_v") == 1, n / (2.0 * max(c[0], 1))).otherwise(n / (2.0 * max(c[1], 1))),
    )


def estimator(name: str, n_rows: int, seed: int = SEED):
    """Named classifiers on ``features_v`` / ``label_v`` / ``weight_v``.

    ``C`` turns into ``regParam = 1 / (C n)`` because Spark averages the loss; with
    balanced weights their sum is ``n``.
    """
    cols = dict(featuresCol="features_v", labelCol="label_v")
    w = dict(weightCol="weight_v", **cols)
    n = max(n_rows, 1)
    logistic = dict(standardization=False, maxIter=100, **w)
    table = {
        "logistic": lambda: LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, **logistic),
        "l1_logistic": lambda: LogisticRegression(
            regParam=1.0 / (0.1 * n), elasticNetParam=1.0, **logistic
        ),
        "elastic_net": lambda: LogisticRegression(
            regParam=1.0 / n, elasticNetParam=0.5, **logistic
        ),
        "sgd_elastic": lambda: LogisticRegression(regParam=0.001, elasticNetParam=0.5, **logistic),
        "linear_svm": lambda: LinearSVC(
            regParam=1.0 / (0.05 * n), standardization=False, maxIter=50, tol=1e-4, **w
        ),
        "decision_tree": lambda: DecisionTreeClassifier(
            maxDepth=15, minInstancesPerNode=2, seed=seed, **w
        ),
        "shallow_tree": lambda: DecisionTreeClassifier(
            maxDepth=8, minInstancesPerNode=2, seed=seed, **w
        ),
        "random_forest": lambda: RandomForestClassifier(numTrees=150, maxDepth=20, seed=seed, **w),
        "forest_500": lambda: RandomForestClassifier(numTrees=500, maxDepth=30, seed=seed, **w),
        "forest_300": lambda: RandomForestClassifier(numTrees=300, maxDepth=15, seed=seed, **w),
        "forest_100": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed, **w),
        "forest_small": lambda: RandomForestClassifier(
            numTrees=100, maxDepth=3, minInstancesPerNode=10, seed=seed, **w
        ),
        "boosting": lambda: GBTClassifier(
            maxIter=300, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, seed=seed, **w
        ),
        "boosting_150": lambda: GBTClassifier(
            maxIter=150, maxDepth=7, stepSize=0.05, subsamplingRate=0.8, seed=seed, **w
        ),
        "naive_bayes": lambda: NaiveBayes(modelType="gaussian", **w),
    }
    return table[name]()


def _score(df: DataFrame) -> DataFrame:
    """Probability of class 1, or the margin where a model has none, as ``score``."""
    source = "probability" if "probability" in df.columns else "rawPrediction"
    out = df.withColumn("score", vector_to_array(F.col(source))[1])
    drop = [c for c in ("rawPrediction", "probability", "prediction") if c in df.columns]
    return out.drop(*drop)


def sized(train: DataFrame, n_rows: int) -> DataFrame:
    """Training rows in tasks of about ``ROWS_PER_TASK``: an iterative fit starts one job
    per step, and near-empty tasks would dominate a small one.  Never adds partitions."""
    return train.coalesce(max(1, math.ceil(n_rows / ROWS_PER_TASK)))


def fit(train: DataFrame, name: str, seed: int = SEED, **overrides):
    """Fit a named classifier on a prepared frame; ``overrides`` set Spark ML params."""
    n = train.count()
    train = sized(weighted(train), n)
    est = estimator(name, n, seed)
    for key, value in overrides.items():
        est = est.copy({est.getParam(key): value})
    return est.fit(train)


def fit_score(train, test, features, label, name, seed=SEED, **overrides) -> DataFrame:
    """Test rows with ``score`` from a model fitted on ``train`` only."""
    tr, te = prepared_pair(train, test, features, label)
    return _score(fit(tr, name, seed, **overrides).transform(te)).drop("features_v", "label_v")


def oof_scores(df, features, label, name, fold="fold", k=5, seed=SEED, **overrides) -> DataFrame:
    """Every row scored by the model that did not see its fold.

    ``df`` is settled by the caller: each fold reads it again.
    """
    out = None
    for f in range(k):
        part = fit_score(
            df.filter(F.col(fold) != f), df.filter(F.col(fold) == f), features, label, name, seed,
            **overrides,
        )
        out = part if out is None else out.unionByName(part)
    return out


def platt(train_scores: DataFrame, test_scores: DataFrame, label: str, score="score") -> DataFrame:
    """Sigmoid calibration: one-feature logistic fit on held-out scores."""
    asm = VectorAssembler(inputCols=[score], outputCol="_s")
    lr = LogisticRegression(featuresCol="_s", labelCol="_y", maxIter=100)
    tr = settle(train_scores.withColumn("_y", F.col(label).cast("double")))
    tr = sized(tr, tr.count())
    model = Pipeline(stages=[asm, lr]).fit(tr)
    out = model.transform(test_scores)
    return out.withColumn("score", vector_to_array("probability")[1]).drop(
        "_s", "rawPrediction", "probability", "prediction"
    )


def calibrated(train, test, features, label, name, row_id, k=5, seed=SEED, **kw) -> DataFrame:
    """Model scores turned into probabilities with out-of-fold calibration."""
    folded = settle(row_folds(train, label, row_id, k, seed))
    held_out = (ridge_oof if name == "ridge" else oof_scores)(folded, features, label, name, k=k, **kw)
    raw = (ridge_scores if name == "ridge" else fit_score)(train, test, features, label, name, **kw)
    return platt(held_out.select(label, "score"), raw, label)


def rff_svm_calibrated(train, test, features, label, row_id, k=5, seed=SEED, **kw) -> DataFrame:
    """Probabilities of the approximated Gaussian-kernel SVM, calibrated out of fold."""
    folded = settle(row_folds(train, label, row_id, k, seed))
    held_out = None
    for f in range(k):
        part = rff_svm_scores(
            folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f), features, label, **kw
        ).select(label, "score")
        held_out = part if held_out is None else held_out.unionByName(part)
    return platt(held_out, rff_svm_scores(train, test, features, label, **kw), label)


def ridge_scores(train, test, features, label, name="ridge", alpha: float = 1.0) -> DataFrame:
    """Weighted least squares on -1/+1 targets with an L2 penalty (M7)."""
    tr, te = prepared_pair(train, test, features, label)
    tr = weighted(tr).withColumn("_t", 2 * F.col("label_v") - 1)
    n = train.count()
    tr = sized(tr, n)
    lr = LinearRegression(
        featuresCol="features_v", labelCol="_t", weightCol="weight_v",
        regParam=alpha / max(n, 1), elasticNetParam=0.0, standardization=False,
    )
    return (
        lr.fit(tr).transform(te).withColumnRenamed("prediction", "score")
        .drop("features_v", "label_v")
    )


def ridge_oof(df, features, label, name="ridge", fold="fold", k=5, alpha=1.0) -> DataFrame:
    out = None
    for f in range(k):
        part = ridge_scores(
            df.filter(F.col(fold) != f), df.filter(F.col(fold) == f), features, label, name, alpha
        )
        out = part if out is None else out.unionByName(part)
    return out


def lda_scores(train, test, features, label) -> DataFrame:
    """Linear discriminant with Ledoit-Wolf shrinkage of the pooled covariance (M8).

    Class means, the covariance and the fourth-moment sum are distributed aggregates;
    only their d and d-by-d results reach the driver for the solve.
    """
    tr, te = prepared_pair(train, test, features, label)
    d = len(features)
    means = {
        int(r["label_v"]): (r["n"], np.array(r["m"].toArray()))
        for r in tr.groupBy("label_v")
        .agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("features_v")).alias("m"))
        .collect()
    }
    n = sum(v[0] for v in means.values())
    lits = {c: F.array(*[F.lit(float(v)) for v in m[1]]) for c, m in means.items()}
    centre = F.when(F.col("label_v") == 1, lits[1]).otherwise(lits[0])
    residual = F.zip_with(vector_to_array("features_v"), centre, lambda a, b: a - b)
    z = tr.select(residual.alias("z")).select(
        array_to_vector("z").alias("zv"), F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v).alias("q")
    )
    stats = z.agg(
        Summarizer.std(F.col("zv")).alias("s"), F.sum(F.col("q") * F.col("q")).alias("fourth")
    ).first()
    std = np.array(stats["s"].toArray()) * math.sqrt((n - 1) / n)
    corr = Correlation.corr(z, "zv").first()[0].toArray()
    cov = np.nan_to_num(corr) * np.outer(std, std)
    np.fill_diagonal(cov, std * std)
    mu = np.trace(cov) / d
    spread = (cov**2).sum()
    delta = (spread - 2 * mu * np.trace(cov) + d * mu * mu) / d
    beta = min((stats["fourth"] / n - spread) / (d * n), delta)
    shrink = 0.0 if delta <= 0 or beta <= 0 else beta / delta
    sigma = (1 - shrink) * cov + shrink * mu * np.eye(d)
    m0, m1 = means[0][1], means[1][1]
    coef = np.linalg.lstsq(sigma, m1 - m0, rcond=None)[0]
    offset = -0.5 * (m0 + m1) @ coef + math.log(means[1][0] / means[0][0])
    x = vector_to_array("features_v")
    dot = F.lit(float(offset))
    for i, c in enumerate(coef):
        dot = dot + x[i] * F.lit(float(c))
    return te.withColumn("score", 1.0 / (1.0 + F.exp(-dot))).drop("features_v", "label_v")


def rff_columns(n_features: int, n_terms: int, gamma: float, seed: int = SEED):
    """Frequencies and phases of random Fourier features for a Gaussian kernel."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), size=(n_features, n_terms))
    b = rng.uniform(0.0, 2 * math.pi, size=n_terms)
    return w, b


def rff_svm_scores(train, test, features, label, n_terms=128, c=10.0, seed=SEED) -> DataFrame:
    """Gaussian-kernel SVM by random Fourier features and a linear SVM.

    An approximation of the kernel machine; ``gamma`` is 1/(features * variance), which
    is 1/features on scaled data.
    """
    w, b = rff_columns(len(features), n_terms, 1.0 / len(features), seed)
    scale = math.sqrt(2.0 / n_terms)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(x: pd.Series) -> pd.Series:
        if x.empty:
            return x
        return pd.Series(list(scale * np.cos(_matrix(x) @ w + b)))

    def mapped(df):
        return df.withColumn("features_v", array_to_vector(project(vector_to_array("features_v"))))

    n = train.count()
    tr, te = prepared_pair(train, test, features, label)
    tr, te = sized(weighted(mapped(tr)), n), mapped(te)
    svm = LinearSVC(
        featuresCol="features_v", labelCol="label_v", weightCol="weight_v",
        regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=50, tol=1e-4,
    )
    return _score(svm.fit(tr).transform(te)).drop("features_v", "label_v")


def soft_vote(scores: DataFrame, row_keys, min_models: int = 3) -> DataFrame:
    """Mean probability over models; rows scored by fewer models are NULL."""
    return (
        scores.groupBy(*row_keys)
        .agg(F.count("score").alias("n_models"), F.avg("score").alias("_m"))
        .withColumn("score", F.when(F.col("n_models") >= min_models, F.col("_m")))
        .drop("_m")
    )


def by_model(scores: DataFrame, row_id: str, label: str, names) -> DataFrame:
    """One row per id with one score column per model."""
    return scores.groupBy(row_id, label).agg(
        *[F.max(F.when(F.col("model") == n, F.col("score"))).alias(n) for n in names]
    )


def stacked(
    train, test, features, label, row_id, names, fold="fold", k=5, overrides=None
) -> DataFrame:
    """Stacking: out-of-fold base scores train a balanced logistic model.

    ``train`` carries group-safe folds.  The base models are refitted on all of
    ``train`` before they score ``test``.
    """
    overrides = overrides or {}
    inner = outer = None
    for n in names:
        kw = overrides.get(n, {})
        a = oof_scores(train, features, label, n, fold, k, **kw).select(row_id, label, "score")
        b = fit_score(train, test, features, label, n, **kw).select(row_id, label, "score")
        a, b = a.withColumn("model", F.lit(n)), b.withColumn("model", F.lit(n))
        inner = a if inner is None else inner.unionByName(a)
        outer = b if outer is None else outer.unionByName(b)
    meta_train = settle(by_model(inner, row_id, label, names))
    meta_test = by_model(outer, row_id, label, names)
    return fit_score(meta_train, meta_test, names, label, "logistic")


def stacked_on_target(
    source, target, features, label, row_id, names, share=0.3, seed=SEED, overrides=None
) -> DataFrame:
    """Base models from the source, meta model from part of the target."""
    from gsx.operators.split import stratified_split

    overrides = overrides or {}
    outer = None
    for n in names:
        b = fit_score(source, target, features, label, n, **overrides.get(n, {}))
        b = b.select(row_id, label, "score").withColumn("model", F.lit(n))
        outer = b if outer is None else outer.unionByName(b)
    wide = settle(stratified_split(by_model(outer, row_id, label, names), label, row_id, share, seed))
    return fit_score(
        wide.filter("part = 'fit'"), wide.filter("part = 'test'"), names, label, "logistic"
    )


def refit_and_save(df: DataFrame, features, label, name: str, path: str, **kw):
    """Fit on all rows and persist as a Spark ML pipeline that imputes medians first."""
    names = [f"_in_{f}" for f in features]
    rows = df.withColumn("label_v", F.col(label).cast("double"))
    n = rows.count()
    clean = sized(weighted(rows), n)
    cast = SQLTransformer(
        statement="SELECT *, " + ", ".join(f"CAST(`{f}` AS DOUBLE) AS `_in_{f}`" for f in features) + " FROM __THIS__"
    )
    fill = Imputer(strategy="median", inputCols=names, outputCols=[f"_full_{f}" for f in features])
    asm = VectorAssembler(inputCols=[f"_full_{f}" for f in features], outputCol="_raw")
    scale = StandardScaler(withMean=True, inputCol="_raw", outputCol="features_v")
    est = estimator(name, n)
    for key, value in kw.items():
        est = est.copy({est.getParam(key): value})
    model = Pipeline(stages=[cast, fill, asm, scale, est]).fit(clean)
    model.write().overwrite().save(path)
    return model


