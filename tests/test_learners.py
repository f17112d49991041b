"""Trees, batched linear models, stacking, cascades and feature choice inside folds against plain code."""

import threading
from dataclasses import replace
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gsx.operators import convex, ensembles, trees
from gsx.operators.evaluate import cascade, cascade_intervals, fold_f_stats, fold_masks
from gsx.session import settle, side_by_side

FEATURES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 400
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 6, n), rng.integers(0, 30, n)]).astype(float)
    y = (x[:, 0] + 2 * (x[:, 1] % 2) + rng.normal(size=n) * 3 > 7).astype(int)
    rows = [(i, "a" if i % 2 else "b", i % 40, i % 5, int(y[i]), *x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(
        rows, "row_id long, dom string, grp long, fold int, label int, f0 double, f1 double, f2 double"
    )
    return df.cache(), x, y


def plain_gini(x, y, w, spec, depth=0):
    """Nested splits of a balanced Gini tree: (feature, limit, left, right) or a share."""
    total = np.array([w[y == 0].sum(), w[y == 1].sum()])
    leaf = total[1] / total.sum()
    if depth == spec.depth or len(y) < spec.min_split or (total == 0).any():
        return leaf

    def pure(t):
        return (t**2).sum() / t.sum()

    best, where = 0, None
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            if min(left.sum(), (~left).sum()) < spec.min_leaf:
                continue
            lt = np.array([w[left & (y == 0)].sum(), w[left & (y == 1)].sum()])
            gain = np.rint((pure(lt) + pure(total - lt) - pure(total)) * 1e6)
            if gain > best:
                best, where = gain, (f, v, left)
    if where is None:
        return leaf
    f, v, left = where
    sides = [plain_gini(x[m], y[m], w[m], spec, depth + 1) for m in (left, ~left)]
    return f, v, *sides


def nested(model, tree, node=0):
    if tree.left[node] < 0:
        return tree.value[node]
    f, child = tree.feature[node], tree.left[node]
    limit = model.edges[f][tree.bin[node]]
    return f, limit, nested(model, tree, child), nested(model, tree, child + 1)


def same(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return a == pytest.approx(b)


@pytest.mark.parametrize("local_rows", [0, 1000])
def test_tree_is_the_plain_tree(data, local_rows):
    df, x, y = data
    spec = trees.TreeSpec(depth=3, min_split=5)
    models = trees.fit_trees(df, FEATURES, "label", "row_id", "dom", {"t": spec}, local_rows=local_rows)
    for part, odd in (("a", 1), ("b", 0)):
        mine = np.arange(len(y)) % 2 == odd
        xs, ys = x[mine], y[mine]
        w = np.where(ys == 1, len(ys) / (2 * ys.sum()), len(ys) / (2 * (len(ys) - ys.sum())))
        model = models[part, "t"]
        assert same(plain_gini(xs, ys, w, spec), nested(model, model.trees[0]))


def test_growth_in_a_task_equals_growth_by_levels(data):
    df, x, _ = data
    specs = {
        "forest": replace(trees.SPECS["random_forest"], trees=3, depth=4),
        "boosting": replace(trees.SPECS["boosting"], trees=2, depth=3),
        "second_order": replace(trees.SPECS["boosting_150"], trees=11, depth=1),
    }
    local = trees.fit_trees(df, FEATURES, "label", "row_id", "dom", specs)
    levels = trees.fit_trees(df, FEATURES, "label", "row_id", "dom", specs, local_rows=0)
    for key, model in local.items():
        assert [t.left for t in model.trees] == [t.left for t in levels[key].trees]
        assert np.allclose(model.score(x), levels[key].score(x))


@pytest.mark.parametrize("local_rows", [0, 1000])
def test_importances_are_gains_of_the_trees_by_feature(data, local_rows):
    df, x, y = data
    spec = trees.TreeSpec(depth=3, min_split=5)
    found = trees.importances(df, FEATURES, "label", "row_id", "dom", spec, local_rows).collect()
    for part, odd in (("a", 1), ("b", 0)):
        mine = np.arange(len(y)) % 2 == odd
        xs, ys = x[mine], y[mine]
        w = np.where(ys == 1, len(ys) / (2 * ys.sum()), len(ys) / (2 * (len(ys) - ys.sum())))
        gains = np.zeros(3)

        def walk(node, held):
            if not isinstance(node, tuple):
                return
            f, v, *sides = node

            def pure(m):
                t = np.array([w[m & (ys == 0)].sum(), w[m & (ys == 1)].sum()])
                return (t**2).sum() / t.sum()

            left, right = held & (xs[:, f] <= v), held & (xs[:, f] > v)
            gains[f] += pure(left) + pure(right) - pure(held)
            walk(sides[0], left)
            walk(sides[1], right)

        walk(plain_gini(xs, ys, w, spec), np.ones(len(ys), bool))
        rows = sorted((r for r in found if r.part == part), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3]
        assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)
        told = {r.feature: r.importance for r in rows}
        assert np.allclose([told[f] for f in FEATURES], gains / gains.sum(), atol=1e-6)


def test_missing_values_one_class_and_scores(data):
    df, _, _ = data
    holes = df.withColumn("f0", F.when(F.col("row_id") % 7 > 0, F.col("f0")))
    one = holes.withColumn("dom", F.when(F.col("label") == 1, "pos").otherwise(F.col("dom")))
    spec = {"t": trees.TreeSpec(depth=2)}
    assert trees.fit_trees(one.filter("dom = 'pos'"), FEATURES, "label", "row_id", "dom", spec) == {}
    rows = trees.transfer_scores(holes, FEATURES, "label", "row_id", "dom", spec).collect()
    assert len(rows) == 400 and all(0 <= r.score <= 1 and r.train != r.test for r in rows)


@pytest.mark.parametrize("local_rows", [0, 190, 1000])
def test_scores_of_growing_tasks_are_those_of_fitted_models(data, local_rows):
    """Parts of 200, 133 and 67 rows, so that 190 grows one of the three by levels."""
    df, _, _ = data
    df = df.withColumn("part", F.when(F.col("dom") == "a", 1).when(F.col("row_id") % 3 == 0, 3).otherwise(2))
    df = df.withColumn("f0", F.when(F.col("row_id") % 7 > 0, F.col("f0")))
    specs = {
        "forest": replace(trees.SPECS["random_forest"], trees=5, depth=4),
        "boosting": replace(trees.SPECS["boosting"], trees=2, depth=2),
    }
    asked = df.select("row_id", *FEATURES, F.explode(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(9), F.lit(None).cast("int"))).alias("cell"))
    got = trees.fit_and_score(df, asked, FEATURES, "label", "row_id", "part", specs, "cell", local_rows=local_rows).collect()
    models = trees.fit_trees(df, FEATURES, "label", "row_id", "part", specs)
    assert len(got) == 5 * 400 and set(models) == {(p, n) for p in (1, 2, 3) for n in specs}
    for cell in (1, 2, 3):
        mine = sorted((r for r in got if r.cell == cell), key=lambda r: r.row_id)
        x = np.array([[np.nan if r[f] is None else r[f] for f in FEATURES] for r in mine])
        for n in specs:
            assert np.allclose([r[n] for r in mine], models[cell, n].score(x), rtol=0, atol=1e-12)
    assert all(r.forest is None and r.boosting is None for r in got if r.cell in (9, None))


def test_no_tree_of_a_small_set_reaches_the_driver(data, monkeypatch):
    df, _, _ = data
    held = []
    monkeypatch.setattr(trees, "compact", lambda *v: held.append(v))
    other = F.array(F.when(F.col("dom") == "a", "b").otherwise("a"))
    out = ensembles.base_scores(
        df, FEATURES, "label", "row_id", F.array("dom"), other, "fold", linear=(), grown=("decision_tree",)
    )
    assert out.filter("decision_tree IS NOT NULL").count() == 800
    moved = trees.transfer_scores(df, FEATURES, "label", "row_id", "dom", {"t": trees.TreeSpec(depth=2)})
    assert moved.count() == 400 and not held


def test_linear_models_are_the_plain_optimum(data):
    df, x, y = data
    cells = F.transform(F.filter(F.array(F.lit(0), F.lit(9)), lambda k: k != F.col("fold")), lambda k: k.cast("string"))
    rows = convex.training_rows(df, FEATURES, "label", cells)
    names = ("logistic", "ridge", "linear_svm")
    models = convex.fit_linear(rows, FEATURES, {n: convex.MODELS[n] for n in names})
    for cell, mine in (("9", np.ones(len(y), bool)), ("0", np.arange(len(y)) % 5 != 0)):
        xs, ys = x[mine], y[mine]
        z = np.hstack([np.ones((len(ys), 1)), (xs - xs.mean(0)) / xs.std(0)])
        w = np.where(ys == 1, len(ys) / (2 * ys.sum()), len(ys) / (2 * (len(ys) - ys.sum())))
        t = 2.0 * ys - 1
        free = np.diag([0.0, 1, 1, 1])
        ridge = np.linalg.solve((z * w[:, None]).T @ z + free, z.T @ (w * t))
        assert np.allclose(models[cell, "ridge"].beta, ridge)
        b = models[cell, "logistic"].beta
        slope = z.T @ (w * (1 / (1 + np.exp(-z @ b)) - ys)) + free @ b
        assert np.abs(slope).max() < 1e-6
        b = models[cell, "linear_svm"].beta
        slope = z.T @ (-2 * w * t * np.maximum(1 - t * (z @ b), 0)) + 20 * free @ b
        assert np.abs(slope).max() < 1e-5


def test_held_out_scores_never_see_their_fold(data):
    """Turning the labels of one fold does not change that fold's held-out scores."""
    df, _, _ = data
    other = F.array(F.when(F.col("dom") == "a", "b").otherwise("a"))

    def scores(frame):
        out = ensembles.base_scores(
            frame, FEATURES, "label", "row_id", F.array("dom"), other, "fold",
            linear=("logistic",), grown=("decision_tree",),
        )
        return {(r.row_id, r.role): (r.logistic, r.decision_tree) for r in out.collect()}, out

    first, out = scores(df)
    turned = F.when(F.col("fold") == 2, 1 - F.col("label")).otherwise(F.col("label"))
    second, _ = scores(df.withColumn("label", turned))
    assert len(first) == 800
    held = [k for k in first if k[1] == "oof" and k[0] % 5 == 2]
    assert held and all(first[k] == pytest.approx(second[k]) for k in held)
    assert any(first[k] != pytest.approx(second[k]) for k in first if k[1] == "test")
    names = ("logistic", "decision_tree")
    stacked = ensembles.stack(out, "label", names).collect()
    assert len(stacked) == 400 and all(0 < r.score < 1 for r in stacked)
    votes = {r.row_id: r.score for r in ensembles.vote(out.filter("role = 'test'"), names, 2).collect()}
    assert all(votes[i] == pytest.approx(sum(first[i, "test"]) / 2) for i in votes)
    assert all(r.score is None for r in ensembles.vote(out, names, 3).collect())
    part = ensembles.stack_on_part(out, "label", "row_id", names).collect()
    assert 275 <= len(part) <= 285


def test_cascade_reports_empty_and_one_class_stages(spark):
    rows = [("k", i, i % 2, 0.95 if i % 2 else 0.05, 0.5, 0.4 + i / 100) for i in range(12)]
    rows += [("m", i, 1, 0.6, 0.5, 0.5) for i in range(3)] + [("m", 9, 0, 0.9, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "key string, row_id long, label int, p1 double, p2 double, p3 double")
    out = cascade_intervals(cascade(df, ["p1", "p2", "p3"]), ["key"], "label", "row_id", 50).collect()
    found = {(r.key, r.stage_num): r for r in out}
    assert set(found) == {("k", 0), ("k", 1), ("m", 0), ("m", 1), ("m", 2), ("m", 3)}
    assert found["k", 1].auc == 1.0 and found["k", 1].ci_lo == 1.0 and found["k", 1].pct_handled == 100.0
    assert found["m", 2].n_handled == 0 and found["m", 2].auc is None and found["m", 2].ci_hi is None
    assert found["m", 1].n_handled == 1 and found["m", 1].auc is None
    assert found["m", 3].n_handled == 3 and found["m", 3].ci_lo is None and found["m", 0].auc == 0.0


def test_fold_f_stats_leave_the_fold_out(data):
    df, x, y = data
    folded = df.withColumn("fold_all", (F.col("row_id") % 3).cast("int"))
    stats = fold_f_stats(folded, FEATURES, "label", "dom")
    found = {(r.train, r.holdout, r.feature): r.f_stat for r in stats.collect()}
    i = np.arange(len(y))
    for key, mine in ((("a", 2), (i % 2 == 1) & (i % 5 != 2)), (("Combined", 1), i % 3 != 1), (("b", -1), i % 2 == 0)):
        for f in range(3):
            a, b = x[mine & (y == 0), f], x[mine & (y == 1), f]
            both = np.append(a, b).mean()
            between = len(a) * (a.mean() - both) ** 2 + len(b) * (b.mean() - both) ** 2
            within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
            assert found[*key, f"f{f}"] == pytest.approx(between / (within / (len(a) + len(b) - 2)))
    for r in fold_masks(stats, 1).collect():
        best = max(range(3), key=lambda f: found[r.train, r.holdout, f"f{f}"])
        assert r.mask == [f == best for f in range(3)]


def test_sets_above_one_chunk_grow_in_tasks(spark, monkeypatch):
    def levels(*_):
        raise AssertionError("a job per level")

    monkeypatch.setattr(trees, "_fit_levels", levels)
    n = 70_000
    rows = spark.range(n).selectExpr("id AS row_id", "'a' AS dom", "int(id % 7 < 3) AS label", "double(id % 7) AS f0", "double(id % 5) AS f1")
    spec = {"b": replace(trees.SPECS["boosting_150"], trees=2, depth=2), "f": replace(trees.SPECS["forest_small"], trees=2)}
    models = trees.fit_trees(rows, ["f0", "f1"], "label", "row_id", "dom", spec)
    for name in spec:
        assert (models["a", name].score(np.array([[1.0, 0.0], [5.0, 0.0]])) > 0.5).tolist() == [True, False]


def test_newton_sums_of_tasks_meet_as_one_row_per_pair():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(50, 3)), rng.integers(0, 2, 50)
    cells = [["s"] if i % 3 else ["s", "t"] for i in range(50)]
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(x[a : a + 25].tolist()), pa.array(y[a : a + 25]), pa.array(cells[a : a + 25])], names=["x", "y", "cells"]
        )
        for a in (0, 25)
    ]
    one = convex.Fitted(convex.Linear(), ("a", "b", "c"), np.zeros(3), np.zeros(3), np.ones(3), np.array([0.1, 0.2, 0.3, 0.4]))
    pairs = {7: ("s", one, (20, 30)), 8: ("t", one, (8, 9))}
    parts = [b for batch in batches for b in convex._sums(pairs, 3)(iter([batch]))]
    (out,) = convex._added(iter(parts))
    got = {p: np.frombuffer(v) for p, v in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    for pair, mine in ((7, np.ones(50, bool)), (8, np.arange(50) % 3 == 0)):
        t, w = convex._targets(one.model, y[mine], pairs[pair][2])
        loss, slope, curve = convex.derivatives(one.model, one.model.mapped(x[mine]), t, w, one.beta)
        assert np.allclose(got[pair], np.concatenate([[loss], slope, curve.ravel()]))


def test_equal_rows_meet_before_cells_repeat_them(spark):
    from gsx.operators.evaluate import cell_scores, equal_cell_scores, transfer_matrix

    rows = spark.range(600).selectExpr(
        "id AS row_id", "if(id % 2 = 0, 'a', 'b') AS dom", "id % 20 AS grp", "int(id % 3 = 0) AS label", "double(id % 4) AS x"
    )
    plain = cell_scores(rows, ["x"], "label", "grp", "dom", ["a", "b"])
    equal = equal_cell_scores(rows, ["x"], "label", "grp", "dom", ["a", "b"])
    assert equal.count() * 4 < plain.count()
    want = sorted(transfer_matrix(plain, "label").collect())
    assert sorted(transfer_matrix(equal, "label", "n_rows").collect()) == want


def test_matrix_of_ranges_equals_the_matrix_of_rows(spark, monkeypatch):
    from gsx.operators import matrix
    from gsx.operators.evaluate import cell_scores, confusion_of, subset_scores
    from gsx.operators.ordered import auc_of, value_counts

    monkeypatch.setattr(matrix, "CHUNK", 500)
    rows = spark.range(4000).selectExpr(
        "id AS row_id", "if(id % 2 = 0, 'a', 'b') AS dom", "if(id % 11 = 0, null, string(id % 2 + id % 3)) AS run", "id % 23 AS grp",
        "if(id % 13 = 0, null, int(id % 3 = 0)) AS label", "if(id % 7 = 0, null, double(id % 4)) AS x",
        "if(id % 500 = 0, double('inf'), sin(id)) AS u", "if(id % 3 = 0, null, double(id)) AS v", "round(cos(id) + id % 3, 2) AS w",
    )
    features, subsets = ["x", "u", "v", "w"], {"x": ["x"], "v": ["v"], "w": ["w"], "xw": ["w", "x"], "all": ["x", "u", "v", "w"]}
    keys = ["run", "train", "test", "subset"]
    scored = subset_scores(cell_scores(rows, features, "label", "grp", "dom", ["a", "b"]), subsets, features)
    counts = value_counts(scored.withColumn("run", F.coalesce("run", F.lit("none"))), keys, "subset_score", "label")
    want = auc_of(counts, keys, "subset_score").join(confusion_of(counts, keys, "subset_score"), keys)
    for range_rows in (90, 1 << 20):
        got = matrix.matrix_results(rows, features, subsets, "label", "grp", "dom", ["a", "b"], ["run"], range_rows=range_rows)
        got = got.withColumn("run", F.coalesce("run", F.lit("none"))).select(*want.columns)
        near = [[tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in sorted(d.collect())] for d in (got, want)]
        assert near[0] == near[1] and len(near[0]) > 100


def test_matrix_with_overlap_equals_the_transfer_matrix(spark):
    from gsx.operators import matrix
    from gsx.operators.evaluate import cell_scores, transfer_matrix

    rows = spark.range(3000).selectExpr(
        "id AS row_id", "if(id % 5 < 2, 'a', if(id % 5 = 4, 'other', 'b')) AS dom", "if(id % 17 = 0, null, id % 23) AS grp",
        "if(id % 13 = 0, null, int(id % 3 = 0)) AS label", "if(id % 7 = 0, null, double(id % 4)) AS x", "sin(id) AS y",
    )
    few = rows.withColumn("grp", F.expr("if(dom = 'a', 1, grp)"))  # no folds inside a
    for df in (few, rows.filter("dom = 'a'")):
        args = (df, ["x", "y"], "label", "grp", "dom", ["a", "b"])
        want = sorted(transfer_matrix(cell_scores(*args), "label").collect())
        got = sorted(matrix.matrix_with_overlap(*args, range_rows=100).collect())
        near = [[tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in told] for told in (got, want)]
        assert near[0] == near[1] and len(want) > 3
    part = matrix.matrix_results(*args[:2], {"all": args[1]}, *args[2:], pairs=[("a", "Combined")])
    assert [(r.train, r.test) for r in part.collect()] == [("a", "Combined")]


def test_line_matrix_settles_no_row_per_score(spark, monkeypatch):
    from gsx.operators import matrix
    from gsx.plans import reports

    sizes = []

    def counted(df):
        out = settle(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(reports, "settle", counted)
    monkeypatch.setattr(matrix, "settle", counted)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert reports.results(spark, "/root/testdata/sf0.001").count() > 100
    assert max(sizes) <= lines


def test_cells_are_repeated_by_generated_code(spark):
    from gsx.operators.evaluate import cell_rows

    rows = cell_rows(spark.createDataFrame([("a", 0, None), ("b", None, 1)], "dom string, fold int, fold_all int"), "dom", ["a", "b"])
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["dom"], r["train"], r["test"], r["holdout"]) for r in rows.collect()}
    a = {("a", "a", "a", 0), ("a", "b", "a", -1), ("a", "Combined", "a", -1), ("a", "a", "Combined", -1), ("a", "b", "Combined", -1)}
    b = {("b", "a", "b", -1), ("b", "Combined", "b", -1), ("b", "a", "Combined", -1), ("b", "b", "Combined", -1), ("b", "Combined", "Combined", 1)}
    assert got == a | b


def test_fits_run_side_by_side(spark):
    meet = threading.Barrier(3, timeout=20)

    def fit(i):
        n = spark.range(i).count()
        meet.wait()
        return n

    assert side_by_side(spark, [partial(fit, i) for i in (3, 1, 2)]) == [3, 1, 2]


def test_own_cells_are_the_diagonal_of_the_matrix(data):
    from gsx.operators.evaluate import cell_scores, own_cell_scores

    args = (["f0", "f1"], "label", "grp", "dom", ["a", "b"])
    df = data[0].drop("fold")
    plain = cell_scores(df, *args).filter("train = test").collect()
    own = own_cell_scores(df, *args).collect()
    told = [sorted((r.train, r.row_id, r.holdout, r.score) for r in rows) for rows in (plain, own)]
    assert told[0] == told[1] and len(own) == 800 and not any(r.seen_in_training for r in own)
