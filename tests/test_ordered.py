"""Order-dependent building blocks against brute force, on hot and cold paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gsx.operators.bootstrap import auc_interval, auc_with_interval, replicate_auc, replicate_weights
from gsx.operators.ordered import (
    auc,
    global_positions,
    hash_rank,
    lookup_join,
    percentiles,
    rank_sums,
    running_counts,
    with_neighbours,
)
from gsx.functions.hashing import hash_int, hash_key


def brute_auc(y, s, w=None):
    y, s = np.asarray(y), np.asarray(s, dtype=float)
    w = np.ones(len(y)) if w is None else np.asarray(w, dtype=float)
    p, n = y == 1, y == 0
    if w[p].sum() == 0 or w[n].sum() == 0:
        return None
    gt = (s[p][:, None] > s[n][None, :]) + 0.5 * (s[p][:, None] == s[n][None, :])
    return float((gt * w[p][:, None] * w[n][None, :]).sum() / (w[p].sum() * w[n].sum()))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{i % 7}"
        score = float(np.round(rng.normal(), 1)) if i % 5 else 0.25  # a hot tie
        rows.append((i, key, int(rng.random() < 0.3), score))
    return spark.createDataFrame(rows, "id bigint, k string, y int, s double"), rows


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_auc_matches_brute_force_for_any_partitioning(spark, scored, parts):
    df, rows = scored
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["k"]: r["auc"] for r in auc(df.repartition(parts), "k", "s", "y").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for k, g in grouped(rows).items():
        assert got[k] == pytest.approx(brute_auc([r[2] for r in g], [r[3] for r in g]), abs=1e-12)


def test_auc_reversal_ties_and_one_class(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 0, 1.0), ("a", 1, 1.0), ("b", 1, 2.0), ("b", 1, 3.0)],
        "k string, y int, s double",
    )
    got = {r["k"]: r["auc"] for r in auc(df, "k", "s", "y").collect()}
    assert got == {"a": 0.5, "b": None}
    both = spark.createDataFrame([(1, 1.0), (0, 2.0), (1, 3.0), (0, 0.5)], "y int, s double")
    a = auc(both.withColumn("k", F.lit(1)), "k", "s", "y").first()["auc"]
    b = auc(both.withColumn("k", F.lit(1)).withColumn("s", -F.col("s")), "k", "s", "y").first()["auc"]
    assert a == pytest.approx(1 - b)


def test_rank_sums_tie_term(spark, scored):
    df, rows = scored
    got = {r["k"]: r["ties"] for r in rank_sums(df, "k", "s", "y").collect()}
    for k, g in grouped(rows).items():
        _, c = np.unique([r[3] for r in g], return_counts=True)
        assert got[k] == float((c.astype(float) ** 3 - c).sum())


def test_running_counts_over_ranges(spark, scored):
    df, rows = scored
    got = running_counts(df, "k", "s", "y").collect()
    groups = grouped(rows)
    for r in got:
        below = [x for x in groups[r["k"]] if x[3] < r["s"]]
        assert r["pos_before"] == sum(x[2] for x in below)
        assert r["neg_before"] == sum(1 - x[2] for x in below)


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_percentiles_are_exact_on_both_paths(spark, scored, hot_rows):
    df, rows = scored
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {r["k"]: r for r in percentiles(df, "k", "s", probs, hot_rows).collect()}
    groups = grouped(rows)
    assert set(got) == set(groups)
    for k, g in groups.items():
        want = np.percentile([r[3] for r in g], [100 * p for p in probs])
        assert [got[k][f"q{i}"] for i in range(len(probs))] == pytest.approx(list(want))


def test_percentiles_of_many_distinct_values(spark):
    df = spark.range(60000).select(
        F.lit("a").alias("k"), F.sqrt(F.pmod(F.col("id") * 7919, F.lit(60013))).alias("v")
    )
    values = np.sort([r["v"] for r in df.collect()])
    got = percentiles(df, "k", "v", (0.25, 0.5, 0.975), hot_rows=100).first()
    want = np.percentile(values, [25, 50, 97.5])
    assert [got["q0"], got["q1"], got["q2"]] == pytest.approx(list(want), abs=1e-12)


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_neighbour_windows_agree_across_cuts(spark, hot_rows):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"s{i % 11}", i, float(rng.normal())) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, seq int, v double")

    def exprs(w):
        return {
            "d": F.col("v") - F.lag("v").over(w),
            "m5": F.sum("v").over(w.rowsBetween(-2, 2)),
            "n": F.lead("v", 2).over(w),
        }

    got = {
        (r["k"], r["seq"]): r
        for r in with_neighbours(df, "k", "seq", 2, exprs, hot_rows).collect()
    }
    assert len(got) == len(rows)
    series = {}
    for k, s, v in sorted(rows, key=lambda r: r[1]):
        series.setdefault(k, []).append((s, v))
    for k, sv in series.items():
        for i, (s, v) in enumerate(sv):
            r = got[(k, s)]
            assert r["d"] == (pytest.approx(v - sv[i - 1][1]) if i else None)
            assert r["m5"] == pytest.approx(sum(x[1] for x in sv[max(0, i - 2) : i + 3]))
            assert r["n"] == (sv[i + 2][1] if i + 2 < len(sv) else None)


@pytest.mark.parametrize("max_rows", [0, 1000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_is_the_same_beyond_the_broadcast_limit(spark, scored, max_rows, how):
    df, rows = scored
    table = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, z int")
    got = sorted((r["id"], r["z"]) for r in lookup_join(df, table, "k", how, max_rows).collect() if r["z"])
    known = {"hot": 1, "k0": 2, "k3": 3}
    assert got == sorted((r[0], known[r[1]]) for r in rows if r[1] in known)
    total = lookup_join(df, table, "k", how, max_rows).count()
    assert total == (len(rows) if how == "left" else len(got))


def test_hash_rank_numbers_each_part_in_hash_order(spark, scored):
    df, rows = scored
    got = hash_rank(df, "k", "id", 42, "r").withColumn("h", hash_key(42, "id")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["k"], []).append((r["h"], r["r"]))
    for members in parts.values():
        assert [r for _, r in sorted(members)] == list(range(1, len(members) + 1))


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_bootstrap_equals_brute_force_with_ties_across_ranges(spark, scored, parts):
    df, rows = scored
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {
            (r["k"], r["rep"]): r["auc"] for r in replicate_auc(df, "k", "s", "y", "id", 13).collect()
        }
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    h = {r["id"]: r["h"] for r in df.select("id", hash_int(42, "id").alias("h")).collect()}
    for k, g in grouped(rows).items():
        w = replicate_weights(np.array([h[r[0]] for r in g], dtype=np.int64), 13)
        for rep in range(13):
            want = brute_auc([r[2] for r in g], [r[3] for r in g], w[:, rep])
            assert got.get((k, rep)) == (None if want is None else pytest.approx(want, abs=1e-12))


def test_bootstrap_weights_look_like_poisson():
    w = replicate_weights(np.arange(20000, dtype=np.int64) * 2654435761, 50)
    assert w.mean() == pytest.approx(1.0, abs=0.01)
    assert w.var() == pytest.approx(1.0, abs=0.02)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03


def test_interval_brackets_and_needs_ten_resamples(spark, scored):
    df, _ = scored
    out = {r["k"]: r for r in auc_interval(df, "k", "s", "y", "id", 200).collect()}
    for r in out.values():
        assert r["ci_lo"] <= r["ci_hi"]
    few = auc_interval(df, "k", "s", "y", "id", 5).first()
    assert few["n_valid"] <= 5 and few["ci_lo"] is None


def test_global_positions_follow_a_mixed_order(spark, scored):
    df, rows = scored
    got = {r["id"]: r["p"] for r in global_positions(df, [F.col("s").desc(), "k", "id"], "p").collect()}
    want = sorted(rows, key=lambda r: (-r[3], r[1], r[0]))
    assert [got[r[0]] for r in want] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("parts", [1, 7])
def test_one_sort_gives_auc_and_interval_of_large_blocks_of_ties(spark, parts):
    rng = np.random.default_rng(3)
    n = 1500
    s = np.where(np.arange(n) < 700, 2, rng.integers(0, 40, n)).astype(float).tolist()
    rows = [(i, ("a", None)[i % 5 == 0], int(rng.random() < 0.4), s[i]) for i in range(n)]
    rows.append((n, "one class", 1, 1.0))
    df = spark.createDataFrame(rows, "id long, k string, y int, s double").withColumn("h", hash_int(42, "id"))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["k"]: r for r in auc_with_interval(df, "k", "s", "y", "h", 60).collect()}
        old = {r["k"]: r for r in auc_interval(df, "k", "s", "y", "id", 60).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for k in ("a", None):
        g = [r for r in rows if r[1] == k]
        assert (got[k]["n_pos"], got[k]["n_neg"]) == (sum(r[2] for r in g), sum(1 - r[2] for r in g))
        assert got[k]["auc"] == pytest.approx(brute_auc([r[2] for r in g], [r[3] for r in g], np.ones(len(g))), abs=1e-12)
        w = replicate_weights(np.array([r["h"] for r in df.filter(F.col("k").eqNullSafe(k)).orderBy("id").collect()]), 60)
        aucs = [brute_auc([r[2] for r in g], [r[3] for r in g], w[:, rep]) for rep in range(60)]
        assert got[k]["ci_lo"] == pytest.approx(np.percentile(aucs, 2.5), abs=1e-12)
        assert [got[k][c] for c in ("n_valid", "ci_lo", "ci_hi")] == [old[k][c] for c in ("n_valid", "ci_lo", "ci_hi")]
    assert got["one class"]["auc"] is None and got["one class"]["n_valid"] is None and "one class" not in old
