"""Base models on every inner fold at once, soft votes and stacking over all of them.

A training set T has a name.  ``cells`` lists the sets a row trains in and ``tests`` the sets whose
models it is tested with.  For every T there is one problem per inner fold (T without the fold) and
one for all of T; linear models of all problems share the passes of one Newton fit and trees the
jobs of one forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gsx.operators import convex, trees
from gsx.operators.ordered import lookup_join
from gsx.session import settle, ship

#: The published base models: linear ones, then trees.
LINEAR = ("logistic", "rbf_svm")
TREES = ("random_forest", "decision_tree", "boosting_150")
BASE = LINEAR + TREES
WHOLE = -1


def problem(name: Column, fold: Column) -> Column:
    return F.concat_ws("|", name, fold.cast("string"))


def score_many(rows: DataFrame, features, cell: str, models: dict) -> DataFrame:
    """``rows`` with one column per model name, each row scored by the model of its ``cell``.

    ``models`` is {(cell, name): fitted}; a row whose cell has no model gets NULL.
    """
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(models)
    names = sorted({n for _, n in models})
    d = len(features)
    nan = F.lit(float("nan"))
    x = F.array(*[F.coalesce(F.col(f).cast("double"), nan) for f in features])
    sent = rows.select(x.alias("x__"), F.col(cell).alias("cell__"), *rows.columns)
    schema = rows.select(*rows.columns, *[F.lit(0.0).alias(n) for n in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            cells = np.array(batch.column(1).to_pylist(), dtype=object)
            out = {n: np.full(len(v), np.nan) for n in names}
            for c in set(cells.tolist()):
                mine = cells == c
                for n in names:
                    model = found.get((c, n))
                    if isinstance(model, trees.Ensemble):
                        out[n][mine] = model.score(v[mine])
                    elif model is not None:
                        m = model.margin(v[mine])
                        out[n][mine] = convex._sigmoid(m) if model.model.loss == "logistic" else m
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], *[pa.array(out[n], pa.float64(), from_pandas=True) for n in names]],
                names=[*batch.schema.names[2:], *names],
            )

    return sent.mapInArrow(run, schema)


def base_scores(
    df: DataFrame, features, label: str, row_id: str, cells: Column, tests: Column, inner: str, k: int = 5,
    linear=LINEAR, grown=TREES, seed: int = 42,
) -> DataFrame:
    """(row_id, label, set, role, model...): held-out probabilities of every base model, settled.

    ``role`` is ``oof`` (a row of the set, scored without its inner fold) or ``test``.  Margins of
    the support vector models become probabilities by Platt's sigmoid on the held-out margins of
    their set.  Rows without an inner fold train only the whole model.
    """
    df = settle(df.select(row_id, label, F.col(inner).alias("inner"), *features, cells.alias("cells"), tests.alias("tests")))
    folds = F.sequence(F.lit(WHOLE), F.lit(k - 1))
    mine = F.flatten(
        F.transform(
            "cells",
            lambda t: F.transform(F.filter(folds, lambda h: ~h.eqNullSafe(F.col("inner"))), lambda h: problem(t, h)),
        )
    )
    own = F.transform("cells", lambda t: F.struct(t.alias("set"), F.lit("oof").alias("role"), problem(t, F.col("inner")).alias("cell")))
    other = F.transform("tests", lambda t: F.struct(t.alias("set"), F.lit("test").alias("role"), problem(t, F.lit(WHOLE)).alias("cell")))
    held = F.when(F.col("inner").isNotNull(), own).otherwise(F.slice(own, 1, 0))
    scored = df.withColumn("a", F.explode(F.concat(held, other))).select(row_id, label, *features, "a.*")
    if linear:
        rows = convex.training_rows(df, features, label, mine)
        models = convex.fit_linear(rows, features, {n: convex.MODELS[n] for n in linear})
        scored = score_many(scored, features, "cell", models)
        # where every set has one class
        scored = scored.withColumns({n: F.lit(None).cast("double") for n in linear if n not in scored.columns})
    if grown:
        dealt = df.select(row_id, label, *features, F.explode(mine).alias("set"))
        specs = {n: trees.SPECS[n] for n in grown}
        scored = trees.fit_and_score(dealt, scored, features, label, row_id, "set", specs, "cell")
    scored = settle(scored.select(row_id, label, "set", "role", *sorted([*linear, *grown])))
    for n in linear:
        if convex.MODELS[n].loss != "logistic":
            scored = with_sigmoid(scored, n, label)
    return scored


def with_sigmoid(scored: DataFrame, name: str, label: str) -> DataFrame:
    """Margins of column ``name`` as probabilities, fitted on the held-out rows of each set."""
    curves = convex.fit_platt(scored.filter(F.col("role") == "oof"), name, label, "set")
    rows = [(s, *c) for s, c in curves.items()] or [(None, 0.0, 0.0)]
    table = scored.sparkSession.createDataFrame(rows, "set string, slope_ double, shift_ double")
    joined = scored.join(F.broadcast(table), "set", "left")  # one row per training set
    p = 1.0 / (1.0 + F.exp(-(F.col("slope_") * F.col(name) + F.col("shift_"))))
    return joined.withColumn(name, p).select(scored.columns)


def vote(scored: DataFrame, names=BASE, least: int = 3) -> DataFrame:
    """``scored`` with ``score``, the mean probability of the models; NULL with fewer than ``least``."""
    known = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in names])
    total = reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0.0)) for n in names])
    return scored.withColumn("score", F.when(known >= least, total / known))


def stack(scored: DataFrame, label: str, names=BASE) -> DataFrame:
    """Test rows of every set with ``score`` of a balanced logistic model on held-out base scores."""
    meta = {"stack": convex.Linear(scaled=False)}
    rows = convex.training_rows(scored.filter("role = 'oof'"), names, label, F.array("set"))
    models = convex.fit_linear(rows, names, meta)
    tested = score_many(scored.filter("role = 'test'"), names, "set", models)
    return tested.withColumnRenamed("stack", "score")


def stack_on_part(scored: DataFrame, label: str, row_id: str, names=BASE, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Test rows of every set outside the ``share`` of them that trains the second model."""
    from gsx.operators.split import hash_rank

    tested = scored.filter("role = 'test'")
    counts = tested.groupBy("set", label).agg(F.count(F.lit(1)).alias("all_"))
    ranked = lookup_join(hash_rank(tested, ["set", label], row_id, seed, "rank_"), counts, ["set", label])
    rows = settle(ranked.withColumn("fit_", F.col("rank_") <= F.floor(F.col("all_") * share)).drop("rank_", "all_"))
    train = convex.training_rows(rows.filter("fit_"), names, label, F.array("set"))
    models = convex.fit_linear(train, names, {"stack": convex.Linear(scaled=False)})
    out = score_many(rows.filter("NOT fit_").drop("fit_"), names, "set", models)
    return out.withColumnRenamed("stack", "score")
