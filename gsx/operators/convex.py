"""Many linear models at once by Newton's method.

A problem is a named training set.  One aggregation per step carries loss, gradient and Hessian of
every (problem, model) pair, so that the folds and directions of an evaluation cost the passes of
one fit.  The driver solves the systems, whose size is the number of features, never of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gsx.operators.ordered import percentiles
from gsx.session import settle, ship

MAX_STEPS = 60
TOLERANCE = 1e-9
ROWS = 4096


@dataclass(frozen=True)
class Linear:
    """What a linear model minimises.

    ``loss`` is ``logistic``, ``squared`` (targets -1 and 1) or ``squared_hinge``; the penalty is
    ``alpha`` / 2 times the squared coefficients without the intercept.  ``terms`` > 0 maps the scaled
    features to that many random Fourier features of a Gaussian kernel of width ``gamma``
    (1 / features if None).  ``platt`` replaces targets by Platt's smoothed shares.
    """

    loss: str = "logistic"
    alpha: float = 1.0
    balanced: bool = True
    terms: int = 0
    gamma: float | None = None
    platt: bool = False
    scaled: bool = True
    seed: int = 42

    def mapped(self, z: np.ndarray) -> np.ndarray:
        """Scaled features, or their Fourier terms, with a column of ones in front."""
        if self.terms:
            d = z.shape[1]
            rng = np.random.default_rng(self.seed)
            w = rng.normal(0.0, np.sqrt(2 * (self.gamma or 1.0 / d)), (d, self.terms))
            z = np.sqrt(2.0 / self.terms) * np.cos(z @ w + rng.uniform(0.0, 2 * np.pi, self.terms))
        return np.hstack([np.ones((len(z), 1)), z])

    def size(self, d: int) -> int:
        return 1 + (self.terms or d)


# Published regularisation, as alpha = 1 / C.
MODELS = {
    "logistic": Linear(),
    "ridge": Linear("squared"),
    "linear_svm": Linear("squared_hinge", 1 / 0.05),
    "rbf_svm": Linear("squared_hinge", 1 / 10, terms=128),
}


@dataclass
class Fitted:
    """Scaling of a training set and the coefficients of one model, intercept first."""

    model: Linear
    features: tuple
    median: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    beta: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (np.where(np.isnan(x), self.median, x) - self.mean) / self.std
        return self.model.mapped(z) @ self.beta


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(m, -500, 500)))


def _targets(model: Linear, y: np.ndarray, counts) -> tuple[np.ndarray, np.ndarray]:
    """Target and weight of every row; ``counts`` is (positives, negatives)."""
    p, n = counts
    if model.platt:
        t = np.where(y == 1, (p + 1.0) / (p + 2.0), 1.0 / (n + 2.0))
    else:
        t = y.astype(float) if model.loss == "logistic" else 2.0 * y - 1.0
    if not model.balanced:
        return t, np.ones(len(y))
    return t, np.where(y == 1, (p + n) / (2.0 * max(p, 1)), (p + n) / (2.0 * max(n, 1)))


def derivatives(model: Linear, z: np.ndarray, t: np.ndarray, w: np.ndarray, beta: np.ndarray):
    """Loss, gradient and Hessian of some rows without the penalty."""
    m = z @ beta
    if model.loss == "logistic":
        p = _sigmoid(m)
        loss = (w * (np.logaddexp(0.0, m) - t * m)).sum()
        slope, curve = w * (p - t), w * p * (1 - p)
    elif model.loss == "squared":
        loss, slope, curve = 0.5 * (w * (m - t) ** 2).sum(), w * (m - t), w
    else:
        short = np.maximum(1 - t * m, 0.0)
        loss, slope, curve = (w * short**2).sum(), -2 * w * t * short, 2 * w * (short > 0)
    return loss, z.T @ slope, (z * curve[:, None]).T @ z


def _sums(pairs: dict, d: int):
    """Partial sums of every pair over the rows of a task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                y = batch.column(1).to_numpy()
                cells = batch.column(2)
                row = np.repeat(np.arange(len(y)), np.diff(cells.offsets.to_numpy()))
                name = cells.flatten().dictionary_encode()
                code, codes = name.indices.to_numpy(), name.dictionary.to_pylist()
                members = {c: row[code == k] for k, c in enumerate(codes)}
                for number, (problem, fitted, counts) in pairs.items():
                    mine = members.get(problem, ())
                    if not len(mine):
                        continue
                    z = (np.where(np.isnan(x[mine]), fitted.median, x[mine]) - fitted.mean) / fitted.std
                    t, w = _targets(fitted.model, y[mine], counts)
                    loss, slope, curve = derivatives(fitted.model, fitted.model.mapped(z), t, w, fitted.beta)
                    found = np.concatenate([[loss], slope, curve.ravel()])
                    total[number] = total[number] + found if number in total else found
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                names=["pair", "v"],
            )

    return sums


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum per pair from those of the tasks."""
    total: dict = {}
    for batch in batches:
        for pair, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(v.as_py())
            total[pair] = total[pair] + part if pair in total else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
        names=["pair", "v"],
    )


def _scaling(rows: DataFrame, features, scaled) -> dict:
    """{problem: (counts, median, mean, deviation)} of every training set."""
    d = len(features)
    each = rows.select(F.explode("cells").alias("cell"), "y", F.posexplode("x").alias("f", "v"))
    each = each.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    med = {(r["cell"], r["f"]): r["q0"] for r in percentiles(each, ["cell", "f"], "v", (0.5,)).collect()}
    known = rows.select(F.explode("cells").alias("cell"), "y", "x")
    fill = F.create_map(*[F.lit(v) for (c, f), m in med.items() for v in (f"{c}\t{f}", float(m))]) if med else None

    def full(i):
        v = F.col("x")[i]
        if fill is None:
            return F.when(~F.isnan(v), v).otherwise(0.0)
        at = fill[F.concat_ws("\t", "cell", F.lit(str(i)))]
        return F.when(F.isnan(v), F.coalesce(at, F.lit(0.0))).otherwise(v)

    stats = known.groupBy("cell").agg(
        F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"),
        *[fn(full(i)).alias(f"{k}{i}") for i in range(d) for k, fn in (("m", F.avg), ("s", F.stddev_pop))],
    )
    out = {}
    for r in stats.collect():  # one row per problem
        median = np.array([float(med.get((r["cell"], i)) or 0.0) for i in range(d)])
        mean = np.array([r[f"m{i}"] for i in range(d)], float)
        std = np.array([r[f"s{i}"] if r[f"s{i}"] and r[f"s{i}"] > 0 else 1.0 for i in range(d)], float)
        if not scaled:
            mean, std = np.zeros(d), np.ones(d)
        out[r["cell"]] = (r["p"], r["n"]), median, mean, std
    return out


def training_rows(df: DataFrame, features, label: str, cells) -> DataFrame:
    """(x, y, cells), settled: rows that belong to a training set, ``cells`` an array of their names."""
    nan = F.lit(float("nan"))
    x = F.array(*[F.coalesce(F.col(f).cast("double"), nan) for f in features])
    rows = df.filter(F.col(label).isin(0, 1)).select(x.alias("x"), F.col(label).cast("int").alias("y"), cells.alias("cells"))
    return settle(rows.filter(F.size("cells") > 0))


def fit_linear(rows: DataFrame, features, models: dict, max_steps: int = MAX_STEPS) -> dict:
    """{(problem, name): Fitted} of every model on every training set of ``rows`` (see ``training_rows``).

    A missing value is the median of the training set.  A set of one class gets no model.  A step that
    raises the loss is halved.
    """
    ship(rows.sparkSession)
    d = len(features)
    scaled = {m.scaled for m in models.values()}
    base = {s: _scaling(rows, features, s) for s in scaled}
    state = {}
    for name, model in models.items():
        for problem, (counts, median, mean, std) in base[model.scaled].items():
            if min(counts) > 0:
                fitted = Fitted(model, tuple(features), median, mean, std, np.zeros(model.size(d)))
                state[len(state)] = [problem, fitted, counts, name, None, None]
    active = set(state)
    for _ in range(max_steps):
        if not active:
            break
        pairs = {k: tuple(state[k][:3]) for k in active}
        parts = rows.mapInArrow(_sums(pairs, d), "pair int, v binary")
        found = parts.repartition("pair").mapInArrow(_added, "pair int, v binary").collect()
        for r in found:  # the square of the number of features per pair
            _, fitted, _, _, before, step = state[r["pair"]]
            size, v = len(fitted.beta), np.frombuffer(r["v"])
            penalty = np.full(size, fitted.model.alpha)
            penalty[0] = 0.0
            loss = v[0] + 0.5 * (penalty * fitted.beta**2).sum()
            if before is not None and loss > before + 1e-9 * abs(before):
                step = step / 2
                fitted.beta = fitted.beta - step
                state[r["pair"]][5] = step
                if np.abs(step).max() < TOLERANCE:
                    active.discard(r["pair"])
                continue
            slope = v[1 : 1 + size] + penalty * fitted.beta
            curve = v[1 + size :].reshape(size, size) + np.diag(penalty)
            move = -np.linalg.lstsq(curve, slope, rcond=None)[0]
            state[r["pair"]][4:] = [loss, move]
            fitted.beta = fitted.beta + move
            if np.abs(move).max() < TOLERANCE or fitted.model.loss == "squared":
                active.discard(r["pair"])
    return {(s[0], s[3]): s[1] for s in state.values()}


def score_linear(rows: DataFrame, fitted: Fitted, name: str = "score", probability: bool = True) -> DataFrame:
    """``rows`` with the probability of a logistic model, or the margin."""
    ship(rows.sparkSession)
    nan = F.lit(float("nan"))
    x = F.array(*[F.coalesce(F.col(f).cast("double"), nan) for f in fitted.features])
    d = len(fitted.features)

    @F.pandas_udf("double")
    def scored(v: pd.Series) -> pd.Series:
        if v.empty:
            return pd.Series([], dtype=float)
        m = fitted.margin(np.stack(v.to_numpy()).reshape(len(v), d).astype(float))
        return pd.Series(_sigmoid(m) if probability and fitted.model.loss == "logistic" else m)

    return rows.withColumn(name, scored(x))


def fit_platt(scores: DataFrame, score: str, label: str, part: str) -> dict:
    """{part: (slope, intercept)}: sigmoid on held-out scores with Platt's smoothed targets."""
    model = {"platt": Linear(alpha=0.0, balanced=False, platt=True, scaled=False)}
    rows = training_rows(scores, [score], label, F.array(F.col(part).cast("string")))
    return {k[0]: (float(f.beta[1]), float(f.beta[0])) for k, f in fit_linear(rows, [score], model).items()}
