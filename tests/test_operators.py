"""Small hand-made cases and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gsx.functions import names
from gsx.functions.stat_math import student_two_sided_p
from gsx.operators import columns, dedup, evaluate, joins, models, report, series, split, stats
from gsx.operators.bootstrap import auc_interval
from gsx.operators.ordered import auc
from gsx.schema import FeatureSchema, nan_to_null, to_long
from gsx.sources.scan import promote_header, read_csv, scan_files, scan_runs, with_run_parts


def test_nan_becomes_null_and_roles_are_numeric(spark):
    df = spark.createDataFrame(
        [("a", float("nan"), 1, "x"), ("b", 2.0, 0, "y")], "id string, f double, label int, d string"
    )
    assert nan_to_null(df).filter("f IS NULL").count() == 1
    roles = FeatureSchema.infer(df, "id", "label", "id", "d")
    assert roles.features == ("f",)
    with pytest.raises(ValueError):
        roles.check(df.drop("f"))


def test_unknown_and_empty_prefix_groups(spark):
    names = spark.createDataFrame([("MFCC_1",), ("zcr",)], "feature string")
    with pytest.raises(KeyError):
        columns.prefix_groups(names, {"a": ["mfcc"]}, ["b"])
    assert columns.prefix_groups(names, {"a": ["mfcc"]}).count() == 1
    with pytest.raises(Exception, match="no feature matches group b"):
        columns.prefix_groups(names, {"a": ["mfcc"], "b": ["f0"]}).collect()


def test_exact_and_vector_dedup_are_idempotent_and_see_null_vectors(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.00001, None), (2, "a", 1.00002, None), (3, "b", 1.00001, None), (4, "a", -0.00001, 1.0),
         (5, "a", 0.00001, 1.0)],
        "id int, d string, x double, y double",
    )
    once = dedup.drop_copies_in_domain(df, "d", "a", ["x", "y"], "id")
    assert sorted(r["id"] for r in once.collect()) == [1, 3, 4]
    twice = dedup.drop_copies_in_domain(once, "d", "a", ["x", "y"], "id")
    assert twice.count() == once.count()
    checks = {r["check"]: r["value"] for r in dedup.leakage_checks(once, "d", "b", dedup.vector_md5(["x", "y"])).collect()}
    assert checks == {"leaky_ids": 1, "duplicate_vectors": 1}  # domains may share a vector


def test_hot_group_of_copies(spark):
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("t"),
        F.lit("d").alias("dom"), F.lit(1).alias("label"),
    )
    kept = dedup.drop_copies(df, dedup.content_md5("t"), "id")
    assert kept.count() == 2001
    rep = dedup.copy_report(df, dedup.content_md5("t"), "id", "dom", "label")
    assert rep.count() == 999 and rep.filter("kept_id <> 0").count() == 0


def test_neutral_ids_do_not_keep_the_label_order(spark):
    ids = [(f"low_{i}",) for i in range(50)] + [(f"up_{i}",) for i in range(50)]
    out = dedup.neutral_ids(spark.createDataFrame(ids, "id string"), "id", "vd_").collect()
    ranks = {r["id"]: int(r["neutral_id"][3:]) for r in out}
    assert sorted(ranks.values()) == list(range(1, 101))
    assert sum(ranks[f"low_{i}"] <= 50 for i in range(50)) < 45


def test_group_folds_keep_groups_whole_and_cover_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(0, 23)) if i % 3 else 99, int(rng.random() < 0.4), "d" if i % 2 else "e") for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, g int, y int, d string")
    out = split.with_group_folds(df, "g", "y", 5, 42, ("d",))
    assert out.count() == len(rows)
    assert out.groupBy("d", "g").agg(F.count_distinct("fold").alias("c")).filter("c > 1").count() == 0
    assert {r["fold"] for r in out.select("fold").distinct().collect()} == set(range(5))
    few = df.filter("g < 3")
    assert split.group_folds(few, "g", "y").count() == 0  # fewer than four groups


def test_balancing_is_exact(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 37).alias("g"))
    counts = {r["y"]: r["count"] for r in split.undersample(df, "y", "id").groupBy("y").count().collect()}
    assert counts == {0: 250, 1: 250}
    kept = split.balanced_groups(df, "g", "y", "id", 3)
    assert kept.groupBy("g").count().filter("count <> 3").count() == 0
    per_class = kept.groupBy("g").agg(F.min("y").alias("c")).groupBy("c").count().collect()
    assert len({r["count"] for r in per_class}) == 1
    parts = {(r["y"], r["part"]): r["count"] for r in split.stratified_split(df, "y", "id", 0.3).groupBy("y", "part").count().collect()}
    assert parts[(1, "fit")] == 75 and parts[(0, "fit")] == 225


def series_frame(spark, data):
    rows = [(s, i, float(v)) for s, vs in data.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series string, seq int, value double")


def test_level_silent_and_clipping_series(spark):
    df = series_frame(spark, {"silent": [0.0] * 5, "spiky": [0.0] * 999 + [1.0], "plain": [0.1, -0.1] * 10})
    t = {r["series"]: r for r in series.level_table(df).collect()}
    assert t["silent"]["gain"] == 1.0 and not t["silent"]["clipped"]
    assert t["spiky"]["clipped"] and t["spiky"]["gain"] == pytest.approx(0.99)
    assert t["plain"]["rms_after"] == pytest.approx(0.04)


def test_contour_and_spread_guards(spark):
    df = series_frame(spark, {"five": [1, 2, 3, 4, 5], "six": [1, 2, 3, 4, 5, 6], "none": [-1.0],
                              "nineteen": range(1, 20), "twenty": range(1, 21)})
    c = {r["series"]: r for r in series.contour(df).collect()}
    assert c["five"]["mean"] is None and c["six"]["median"] == 3.5
    assert c["none"]["n"] == 0
    s = {r["series"]: r for r in series.spread(df).collect()}
    assert s["nineteen"]["iqr"] is None and s["twenty"]["iqr"] == pytest.approx(9.5)


@pytest.mark.parametrize("hot_rows", [4, 10**6])
def test_functionals_and_derivatives_do_not_depend_on_the_path(spark, hot_rows):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=120), "b": rng.normal(size=40)}
    df = series_frame(spark, data).withColumn("channel", F.lit("c"))
    for r in series.functionals(df, hot_rows=hot_rows).collect():
        v = data[r["series"]]
        d = v - v.mean()
        assert r["stddev"] == pytest.approx(v.std())
        assert r["skewness"] == pytest.approx((d**3).mean() / v.std() ** 3)
        assert r["kurtosis"] == pytest.approx((d**4).mean() / v.std() ** 4 - 3)
        assert r["iqr"] == pytest.approx(np.subtract(*np.percentile(v, [75, 25])))
    k = np.arange(-4, 5)
    for r in series.derivatives(df, hot_rows=hot_rows).collect():
        v = data[r["series"]]
        fits = [np.polyfit(k, v[i - 4 : i + 5], 2) for i in range(4, len(v) - 4)]
        assert r["n_inner"] == len(fits)
        assert r["delta_mean"] == pytest.approx(np.mean([f[1] for f in fits]))
        assert r["delta2_mean"] == pytest.approx(np.mean([2 * f[0] for f in fits]))


def test_entropy_of_a_constant_series(spark):
    df = series_frame(spark, {"flat": [3.0] * 25, "short": [1.0, 2.0]})
    out = {r["series"]: r for r in series.histogram_entropy(df, "series", "value").collect()}
    assert out["flat"]["entropy"] == pytest.approx(-20 * np.log2(20 + 1e-10) / np.log2(20))
    assert out["short"]["entropy"] is None


def test_difference_entropy_counts_values_on_a_bin_limit_exactly(spark):
    rng = np.random.default_rng(3)
    steps = {f"s{k:02d}": np.r_[0, 20 * (k + 3), rng.integers(0, 20 * (k + 3) + 1, 60)] for k in range(40)}
    df = series_frame(spark, {k: [float(x) for x in np.r_[0, np.cumsum(d)]] for k, d in steps.items()})
    out = {r["series"]: r["entropy"] for r in series.difference_entropy(df).collect()}
    for k, d in steps.items():
        span = int(d.max())
        counts = np.bincount(np.minimum(d * 20 // span, 19))
        share = counts[counts > 0] * 20 / (len(d) * span / (d.mean() + 1e-10))
        assert out[k] == pytest.approx(-(share * np.log2(share + 1e-10)).sum() / np.log2(20), abs=1e-9)


def test_means_on_a_half_keep_their_order_whatever_the_order_of_sums(spark, tmp_path):
    from gsx.plans.windows import w6

    # 1024 taxes whose sum in hundredths leaves 8 modulo 16: twelve means end in a half at the seventh decimal
    taxes = [0.07, 0.03, 0.05, 0.01, 0.06, 0.02, 0.08, 0.07] * 127 + [0.08] * 4 + [0.06, 0.02, 0.03, 0.04]
    assert round(sum(taxes) * 100) % 16 == 8
    rows = []
    for run in range(1, 41):  # names of one length, in order
        order = np.random.default_rng(run).permutation(len(taxes))
        rows += [(1024 + 24 * run, "F", "R", taxes[i], 0.0, 1.0) for i in order]
    schema = "l_suppkey bigint, l_linestatus string, l_returnflag string, l_tax double, l_discount double, l_quantity double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [r["run"] for r in w6(spark, str(tmp_path)).orderBy("position").collect()]
    assert got == sorted(got)


def test_variance_filter_is_strict_and_constant_is_dropped(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0)], "a double, b double")
    keep = {r["feature"]: r["keep"] for r in stats.variance_filter(df, ["a", "b"]).collect()}
    assert keep == {"a": False, "b": True}


def test_signed_auc_needs_five_of_each_class(spark):
    rows = [("d", "f", float(i), int(i % 2)) for i in range(8)]
    df = spark.createDataFrame(rows, "domain string, feature string, value double, label int")
    assert stats.signed_auc(df, ["domain", "feature"]).count() == 0


def test_metrics_of_degenerate_predictions(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 1)], "y int, pred int").withColumn("k", F.lit("a"))
    m = evaluate.class_metrics(df, ["k"], "pred", "y").first()
    assert (m["mcc"], m["recall"]) == (0.0, 1.0)
    none = evaluate.class_metrics(df.withColumn("pred", F.lit(0)), ["k"], "pred", "y").first()
    assert none["f1"] == 0.0 and none["precision"] == 0.0


def test_cascade_limits_are_inclusive_and_empty_stage_is_absent(spark):
    df = spark.createDataFrame([(1, 0.70, 0.5, 0.1), (0, 0.5, 0.65, 0.9), (1, 0.31, 0.36, 0.8)], "y int, a double, b double, c double")
    out = evaluate.cascade(df, ["a", "b", "c"]).orderBy("c")
    assert [(r["stage"], r["final"]) for r in out.collect()] == [(1, 0.7), (3, 0.8), (2, 0.65)]
    sure = evaluate.cascade(df.withColumn("a", F.lit(0.9)), ["a", "b", "c"]).withColumn("k", F.lit(1))
    rep = evaluate.cascade_report(sure, ["k"], "y").collect()
    assert {r["stage_num"] for r in rep} == {0, 1}


def test_every_row_is_scored_once_per_cell_without_its_own_group(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"g{i % 17}", "A" if i % 2 else "B", int(rng.random() < 0.4), float(rng.normal()), float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, d string, y int, f1 double, f2 double")
    cells = evaluate.cell_scores(df, ["f1", "f2"], "y", "g", "d", ["A", "B"])
    per = cells.groupBy("train", "test").agg(F.count("*").alias("n"), F.count_distinct("id").alias("u")).collect()
    assert len(per) == 9 and all(r["n"] == r["u"] for r in per)
    m = {(r["train"], r["test"]): r["overlap_rows"] for r in evaluate.transfer_matrix(cells, "y").collect()}
    assert m[("A", "B")] == 0 and m[("A", "A")] == 0 and m[("Combined", "A")] == 200
    held = cells.filter("train = test").filter("holdout < 0")
    assert held.count() == 0


def test_knn_block_compares_few_rows_exactly_and_keeps_ties(monkeypatch):
    rng = np.random.default_rng(3)
    train = np.vstack([rng.normal(size=(300, 16)), np.repeat(rng.normal(size=(1, 16)), 9, axis=0) + 1e4])
    ids, y = rng.permutation(len(train)), np.arange(len(train)) % 2
    compared, plain = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, *a, **kw: compared.append(np.size(keys[0])) or plain(keys, *a, **kw))
    holes = train.copy()
    holes[4, 2] = np.nan
    for known in (train, holes, train[:3]):
        x = np.vstack([known[:3] + 0.01, train[-2:]])
        d = ((x[:, None, :] - known[None, :, :]) ** 2).sum(axis=2)
        want = [sorted((np.inf if np.isnan(v) else v, i) for v, i in zip(row, ids))[:5] for row in d]
        got = models._nearest(5, ids[: len(known)], known, y[: len(known)])(np.arange(len(x)), x)
        assert [list(g["train_id"]) for _, g in got.groupby("row_id")] == [[i for _, i in w] for w in want]
    # of 5 x 309 distances the product leaves a few, among them the nine equal rows
    assert compared[0] < 60


def test_knn_cells_equal_brute_force_with_ties(spark):
    rng = np.random.default_rng(2)
    far = [[float(v) for v in 20 * (i % 9) + rng.normal(size=3)] for i in range(400)]
    grid = [[float(v) for v in rng.integers(0, 3, 3)] for _ in range(200)]
    rows = [(i, v, int(rng.random() < 0.5)) for i, v in enumerate(far + grid)]
    df = spark.createDataFrame(rows, "row_id bigint, x array<double>, y int")
    test, train = df.filter("row_id % 5 = 0"), df.filter("row_id % 5 > 0")
    x = {r[0]: np.array(r[1]) for r in rows}
    y = {r[0]: r[2] for r in rows}
    known = [i for i in x if i % 5]
    near = {
        i: sorted(known, key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:5] for i in x if i % 5 == 0
    }
    for options in ({}, {"block": 30, "pivots": 12}, {"pivots": 1, "block": 50}):
        got = {r["row_id"]: r["votes"] for r in models.knn_votes(test, train, **options).collect()}
        assert got == {i: sum(y[j] for j in n) for i, n in near.items()}
    seen = models.knn_visited_share(test, train, pivots=32).first()
    assert (seen["n_test"], seen["n_train"]) == (120, 480) and 0 < seen["share"] < 0.4
    few = models.knn_votes(test, train.limit(2)).collect()
    assert len(few) == 120 and models.knn_votes(test, train.limit(0)).count() == 0
    assert models.knn_visited_share(test, train.limit(0)).first()["share"] is None
    odd = spark.createDataFrame([(1, [float("nan")] * 3, 1), (2, [0.0] * 3, 0)], "row_id bigint, x array<double>, y int")
    assert {r["row_id"] for r in models.knn_votes(odd, odd.union(train)).collect()} == {1, 2}


def test_copy_report_lists_rows_that_repeat_the_kept_key(spark, monkeypatch):
    monkeypatch.setattr(dedup, "REPEATS", 2)
    rows = [(1, "x", "a", 0), (1, "x", "b", 1), (None, "x", "a", 0), (1, "x", "a", 0), (3, "y", "a", 1)]
    rows += [(4, "z", "a", 0)] * 8 + [(5, None, "a", 0), (6, None, "b", 0)]
    df = spark.createDataFrame(rows, "id int, t string, dom string, label int")
    kept = {(r["t"], r["id"], r["dom"]) for r in dedup.drop_copies(df, dedup.content_md5("t"), "id").collect()}
    rep = dedup.copy_report(df, dedup.content_md5("t"), "id", "dom", "label").collect()
    assert len(rep) == len(rows) - len(kept) and len(kept) == 4
    left = {(r["kept_id"], r["kept_domain"]) for r in rep}
    assert left == {(i, d) for t, i, d in kept if t != "y"}
    assert sum(r["removed_id"] is None for r in rep) == 1 and sum(r["kept_id"] == 4 for r in rep) == 7
    again = dedup.drop_copies(df.repartition(5), dedup.content_md5("t"), "id").collect()
    assert {(r["t"], r["id"], r["dom"]) for r in again} == kept


def test_transfer_cells_of_many_domains(spark):
    df = spark.range(600).select(F.when(F.col("id") > 0, F.col("id") % 300).alias("d"))
    assert joins.transfer_cells(df, "d").count() == 301 * 301
    assert joins.transfer_cells(df.limit(0), "d", "").count() == 0


def test_student_p_against_tables(spark):
    # two-sided quantiles of public tables, to nine digits of p where closed forms exist
    cases = [(1.0, 1, 0.5), (12.706204736, 1, 0.05), (2.0 ** 0.5, 2, 1 - (2 / 4) ** 0.5), (4.302652730, 2, 0.05),
             (2.228138852, 10, 0.05), (3.169272673, 10, 0.01), (-2.042272456, 30, 0.05), (0.0, 7, 1.0),
             (1.983971519, 100, 0.05), (1.962339081, 1000, 0.05)]
    df = spark.createDataFrame([(float(t), n, p) for t, n, p in cases], "t double, n int, p double")
    for r in df.select("p", student_two_sided_p(F.col("t"), F.col("n")).alias("got")).collect():
        assert abs(r["got"] - r["p"]) < 1e-9
    none = df.limit(1).select(student_two_sided_p(F.col("t"), F.lit(0)).alias("p")).first()
    assert none["p"] is None


def test_logistic_model_separates_and_survives_saving(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 2), float(i % 2 + rng.normal() / 3), float(rng.normal()) if i % 9 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, y int, f1 double, f2 double")
    out = models.fit_score(df.filter("row_id < 100"), df.filter("row_id >= 100"), ["f1", "f2"], "y", "logistic")
    assert auc(out.withColumn("k", F.lit(1)), "k", "score", "y").first()["auc"] > 0.95
    lda = models.lda_scores(df.filter("row_id < 100"), df.filter("row_id >= 100"), ["f1", "f2"], "y")
    assert auc(lda.withColumn("k", F.lit(1)), "k", "score", "y").first()["auc"] > 0.95
    models.refit_and_save(df, ["f1", "f2"], "y", "logistic", str(tmp_path / "m"))
    assert (tmp_path / "m" / "metadata").exists()


def test_soft_vote_needs_three_models(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4), (2, 0.1), (2, 0.2), (2, 0.6)], "id int, score double")
    out = {r["id"]: r["score"] for r in models.soft_vote(df, ["id"]).collect()}
    assert out[1] is None and out[2] == pytest.approx(0.3)


def test_file_and_run_scans(spark, tmp_path):
    (tmp_path / "wav" / "x").mkdir(parents=True)
    (tmp_path / "wav" / "x" / "a.wav").write_bytes(b"one")
    (tmp_path / "wav" / "b.WAV").write_bytes(b"one")
    (tmp_path / "wav" / "c.txt").write_bytes(b"two")
    files = scan_files(spark, str(tmp_path / "wav")).collect()
    assert len(files) == 2 and len({f["file_md5"] for f in files}) == 1
    for run in ("evaluation_features_full_8k_2024", "other"):
        folder = tmp_path / "runs" / run / "csv_results"
        folder.mkdir(parents=True)
        (folder / "other.csv").write_text("analysis,model\nB,x\n")
        (folder / "analysis_summary.csv").write_text("analysis,model,accuracy,f1,auc,mcc\nA,lr,0.5,0.4,0.6,0.1\nA,rf,bad,0.4,0.6,0.1\n")
    rows = with_run_parts(scan_runs(spark, str(tmp_path / "runs")))
    got = {(r["run"], r["feature_set"], r["sample_rate"]) for r in rows.collect()}
    assert got == {("evaluation_features_full_8k_2024", "full", "8k"), ("other", None, None)}
    assert sum(r["_corrupt"] is not None for r in rows.collect()) == 2
    assert read_csv(spark, str(tmp_path / "runs" / "*" / "*" / "analysis_summary.csv"), "analysis string").count() == 4


def test_duplicate_runs_and_anomalies(spark):
    rows = [(r, "A", m, a, a, 0.1) for r, m, a in [("r1", "x", 0.5), ("r1", "y", 0.6), ("r2", "x", 0.5), ("r2", "y", 0.6),
                                                  ("r3", "x", 0.5), ("r3", "y", 0.9)]]
    df = spark.createDataFrame(rows, "run string, analysis string, model string, accuracy double, auc double, mcc double")
    out = dedup.duplicate_runs(df, "run", ["analysis", "model"], ["accuracy", "auc", "mcc"]).collect()
    assert [(r["run_a"], r["run_b"], r["verdict"]) for r in out] == [("r1", "r2", "IDENTICAL")]
    bad = df.withColumn("mcc", F.lit(-0.5)).withColumn("f1", F.lit(1.5))
    kinds = {r["metric"] for r in report.range_anomalies(bad, ["run"]).collect()}
    assert kinds == {"f1"}


def test_union_differs_from_each_source_and_cells_are_complete(spark):
    a = spark.createDataFrame([("A", 1)], "d string, x int")
    b = spark.createDataFrame([("B",)], "d string")
    both = joins.union_domains([a, b], by_name_missing=True)
    assert both.count() == 2 and both.filter("x IS NULL").count() == 1
    assert joins.transfer_cells(both, "d").count() == 9
    assert to_long(a, ["d"], ["x"]).first()["value"] == 1.0


def test_rows_without_a_domain_or_first_value_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, d string")
    assert sorted(r["id"] for r in columns.exclude_domains(df, "d", ["a"]).collect()) == [2, 3]
    report = {r["d"]: r["excluded"] for r in columns.exclusion_report(df, "d", ["a"]).collect()}
    assert report == {"a": True, None: False, "b": False}
    text = spark.createDataFrame([("head", "x"), (None, "1"), ("k", "2")], "a string, b string")
    assert promote_header(text, "head", ["code", "score"], ["score"]).count() == 2


def test_copies_with_a_repeated_order_key(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "x"), (1, "z")], "id int, t string")
    kept = dedup.drop_copies(df, dedup.content_md5("t"), "id").collect()
    assert sorted((r["id"], r["t"]) for r in kept) == [(1, "x"), (1, "y"), (1, "z")]


def test_vectors_beyond_whole_numbers_differ(spark):
    df = spark.createDataFrame([(1, 1e16), (2, 2e16), (3, 1e300), (4, 2e300)], "id int, x double")
    assert df.select(dedup.vector_md5(["x"]).alias("h")).distinct().count() == 4


def test_run_pairs_with_missing_values(spark):
    rows = [("r1", "k", None, 0.5), ("r2", "k", None, 0.5), ("r3", "k", 0.5, 0.5), ("r4", "k", 0.5 + 5e-7, 0.5)]
    df = spark.createDataFrame(rows, "run string, key string, a double, b double")
    got = {(r["run_a"], r["run_b"]) for r in dedup.run_pair_matches(df, "run", ["key"], ["a", "b"]).collect()}
    assert got == {("r1", "r2"), ("r3", "r4")}


def test_labels_by_prefix_and_stems(spark):
    df = spark.createDataFrame([("x/PD_01/a",), ("x/pd/a",), ("x/pdx/a",), ("hc_3/pd/a",)], "p string")
    got = [r["v"] for r in df.select(names.first_part_in(F.col("p"), {"pd": 1, "hc": 0}).alias("v")).collect()]
    assert got == [1, 1, None, 0]
    stems = spark.createDataFrame([("a_iqr",), ("a_iqr1-3",), ("a_percentile95.0",), ("a_percentile9-5",)], "p string")
    got = [r["v"] for r in stems.select(names.name_stem(F.col("p")).alias("v")).collect()]
    assert got == ["a_iqr", "a", "a", "a_percentile9-5"]


def test_small_domains_and_one_class_training(spark):
    rows = [(i, f"g{i % 20}", "A", i % 2, float(i % 7)) for i in range(200)]
    rows += [(1000 + i, f"h{i % 3}", "B", i % 2, float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, grp string, d string, label int, x double")
    cells = evaluate.cell_scores(df, ["x"], "label", "grp", "d", ["A", "B"])
    n = {(r["train"], r["test"]): r["count"] for r in cells.groupBy("train", "test").count().collect()}
    assert n["A", "B"] == n["Combined", "B"] == 60 and n["B", "A"] == 200 and ("B", "B") not in n
    one = df.withColumn("label", F.when(F.col("d") == "A", 1).otherwise(F.col("label")))
    cells = evaluate.cell_scores(one, ["x"], "label", "grp", "d", ["A", "B"])
    got = {(r["train"], r["test"]): r["auc"] for r in evaluate.transfer_matrix(cells, "label").collect()}
    assert got.get(("A", "B")) is None and got["B", "A"] is None


def test_invalid_cycles_separate_their_neighbours(spark):
    df = spark.createDataFrame([("s", k, p, 1.0) for k, p in enumerate([0.005, 0.5, 0.006])], "series string, seq int, period double, amplitude double")
    row = series.perturbation(df).first()
    assert row["n_cycles"] == 2 and row["jitter_local"] is None


def test_missing_keys_have_intervals_of_their_own(spark):
    rows = [(i, None if i % 2 else "", i % 3, i % 4 > 1, float(i % 11)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, j int, y boolean, s double").withColumn("y", F.col("y").cast("int"))
    ci = auc_interval(df, ["k", "j"], "s", "y", "id", 40).collect()
    assert {(r["k"], r["j"]) for r in ci} == {(k, j) for k in (None, "") for j in range(3)}


def test_refit_keeps_rows_with_missing_values(spark, tmp_path):
    rows = [(float(i % 9) if i % 3 else None, float(i % 5), i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    model = models.refit_and_save(df, ["a", "b"], "label", "logistic", str(tmp_path / "m"))
    assert model.transform(df.drop("label")).count() == 90


def test_lines_are_added_up_once_for_the_copied_runs(spark):
    from gsx.plans.dedup import copied_runs

    assert all("settled" in f for f in copied_runs(spark, "/root/testdata/sf0.001").inputFiles())
