"""Analytics over experiment-result tables.

A result row has ``run``, ``analysis`` (``A``, ``A -> B`` or ``Combined``), ``model`` and
metric columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gsx.operators.ordered import global_positions

WIDE_CI = 0.15
SEVERE_GAP, MODERATE_GAP = 0.25, 0.12
TYPE_ORDER = ("Self", "Cross-Domain", "Combined", "Other")
# Valid range of each metric.
METRIC_RANGES = {"accuracy": (0.0, 1.01), "f1": (0.0, 1.01), "auc": (0.0, 1.01), "mcc": (-1.0, 1.01)}
LINEAR_MODELS = ("logistic", "ridge", "lda", "linear_svm")


def scenario_type(analysis: Column, self_labels, cross_labels, combined_labels) -> Column:
    """Self, Cross-Domain or Combined by exact label; anything else is Other (G1)."""
    return (
        F.when(analysis.isin(*self_labels), "Self")
        .when(analysis.isin(*cross_labels), "Cross-Domain")
        .when(analysis.isin(*combined_labels), "Combined")
        .otherwise("Other")
    )


def type_position(kind: Column) -> Column:
    out = F.lit(len(TYPE_ORDER))
    for i, t in enumerate(TYPE_ORDER):
        out = F.when(kind == t, i).otherwise(out)
    return out


def overview(df: DataFrame) -> DataFrame:
    """Summary statistics per run and scenario type, with a fixed order key."""
    return (
        df.groupBy("run", "type")
        .agg(
            F.count("auc").alias("n"),
            F.avg("auc").alias("mean_auc"),
            F.stddev_samp("auc").alias("std_auc"),
            F.percentile("auc", F.lit(0.5)).alias("median_auc"),
            F.max("auc").alias("max_auc"),
            F.min("auc").alias("min_auc"),
            F.avg("ci_lo").alias("mean_ci_lo"),
            F.avg("ci_hi").alias("mean_ci_hi"),
            F.avg("accuracy").alias("mean_accuracy"),
            F.avg("mcc").alias("mean_mcc"),
            F.coalesce(F.bool_or(F.col("mcc") < 0), F.lit(False)).alias("any_negative_mcc"),
        )
        .withColumn("type_order", type_position(F.col("type")))
    )


def ci_widths(df: DataFrame) -> DataFrame:
    """Interval width and a flag for wide ones."""
    width = F.col("ci_hi") - F.col("ci_lo")
    return df.select(
        "run", "analysis", "model", width.alias("ci_width"), (width > WIDE_CI).alias("wide")
    )


def generalisation_gap(df: DataFrame) -> DataFrame:
    """Mean self AUC minus mean cross AUC per run and model, with a verdict."""
    t = df.groupBy("run", "model").agg(
        F.avg(F.when(F.col("type") == "Self", F.col("auc"))).alias("mean_self"),
        F.avg(F.when(F.col("type") == "Cross-Domain", F.col("auc"))).alias("mean_cross"),
    )
    gap = F.col("mean_self") - F.col("mean_cross")
    return t.withColumn("gap", gap).withColumn(
        "verdict",
        F.when(F.col("gap") > SEVERE_GAP, "severe")
        .when(F.col("gap") > MODERATE_GAP, "moderate")
        .when(F.col("gap").isNotNull(), "good"),
    )


def metric_pivot(df: DataFrame, metric: str, models, row="analysis") -> DataFrame:
    """Mean of a metric per scenario, one column per model."""
    return df.groupBy(row).agg(
        *[F.avg(F.when(F.col("model") == m, F.col(metric))).alias(f"{m}_{metric}") for m in models]
    )


def best_per(df: DataFrame, keys, metric="auc") -> DataFrame:
    """The best row of every key, ties by model name."""
    order = F.struct(F.coalesce(F.col(metric), F.lit(-1.0)), F.col("model"))
    picked = df.groupBy(*keys).agg(F.max_by(F.struct("model", metric), order).alias("_b"))
    return picked.select(*keys, F.col("_b.model").alias("best_model"), F.col(f"_b.{metric}").alias(metric))


def cross_means(df: DataFrame) -> DataFrame:
    """Mean AUC per feature set, rate, scenario and model over cross-domain rows."""
    return (
        df.filter(F.col("type") == "Cross-Domain")
        .groupBy("feature_set", "sample_rate", "analysis", "model")
        .agg(F.avg("auc").alias("mean_auc"), F.count_distinct("run").alias("runs"))
    )


def model_averages(df: DataFrame) -> DataFrame:
    """Mean metrics per model and the number of distinct runs."""
    return df.groupBy("model").agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.avg("auc").alias("mean_auc"),
        F.avg("mcc").alias("mean_mcc"),
        F.count_distinct("run").alias("runs"),
    )


def global_ranking(df: DataFrame) -> DataFrame:
    """Rank of every result by AUC inside the whole table and its run's statistics."""
    per = df.groupBy("run").agg(
        F.avg("auc").alias("run_mean"),
        F.stddev_samp("auc").alias("run_std"),
        F.min("auc").alias("run_min"),
        F.max("auc").alias("run_max"),
    )
    order = [F.col("auc").desc_nulls_last(), "run", "analysis", "model"]
    return global_positions(df, order, "rank").join(per, "run")


def key_findings(df: DataFrame, linear=LINEAR_MODELS) -> DataFrame:
    """(finding, run, analysis, model, value): best and worst rows and steadiest model."""
    row = F.struct("run", "analysis", "model", F.col("auc").alias("value"))
    tie = [F.col(c) for c in ("run", "analysis", "model")]
    known = df.filter(F.col("auc").isNotNull())
    cross = F.col("type") == "Cross-Domain"
    one = known.agg(
        F.max_by(row, F.struct("auc", *tie)).alias("best"),
        F.max_by(F.when(cross, row), F.when(cross, F.struct("auc", *tie))).alias("best_transfer"),
        F.min_by(F.when(cross, row), F.when(cross, F.struct("auc", *tie))).alias("worst_transfer"),
        F.avg(F.when(F.col("model").isin(*linear), F.col("auc"))).alias("linear_mean"),
        F.avg(F.when(~F.col("model").isin(*linear), F.col("auc"))).alias("other_mean"),
    )
    steady = (
        known.groupBy("model")
        .agg(F.count("auc").alias("n"), F.stddev_pop("auc").alias("sd"))
        .filter("n >= 2")
        .agg(F.min_by(F.struct("model", "sd"), F.struct("sd", "model")).alias("s"))
    )
    null = F.lit(None).cast("string")

    def named(name, source, run, analysis, model, value):
        return source.select(
            F.lit(name).alias("finding"), run.alias("run"), analysis.alias("analysis"),
            model.alias("model"), value.alias("value"),
        )

    picks = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("finding"), F.col(f"{n}.run"), F.col(f"{n}.analysis"),
                         F.col(f"{n}.model"), F.col(f"{n}.value"))
                for n in ("best", "best_transfer", "worst_transfer")
            ],
            *[
                F.struct(F.lit(n).alias("finding"), null.alias("run"), null.alias("analysis"),
                         null.alias("model"), F.col(n).alias("value"))
                for n in ("linear_mean", "other_mean")
            ],
        )
    )
    rows = one.select(picks.alias("p")).select("p.*")
    return rows.unionByName(
        named("steadiest", steady, null, null, F.col("s.model"), F.col("s.sd"))
    )


def range_anomalies(df: DataFrame, keys, ranges=None) -> DataFrame:
    """Metric values outside their valid range."""
    ranges = ranges or METRIC_RANGES
    long = df.unpivot(list(keys), list(ranges), "metric", "value")
    bad = F.lit(False)
    for m, (lo, hi) in ranges.items():
        bad = bad | ((F.col("metric") == m) & ~F.col("value").between(lo, hi))
    return long.filter(bad)


def matrix_long(wide: DataFrame, row: str, columns) -> DataFrame:
    """(train, test, value) from a matrix."""
    return wide.unpivot([row], list(columns), "test", "value")


def auc_band(auc: Column, mid: float = 0.70) -> Column:
    """Weak, fair, good or suspicious by AUC."""
    return (
        F.when(auc < 0.60, "weak").when(auc < mid, "fair").when(auc < 0.999, "good")
        .when(auc.isNotNull(), "suspicious")
    )


def extreme_flags(df: DataFrame, keys, metric: str) -> DataFrame:
    """Best and worst value of a metric per key; a negative MCC is always worst."""
    limits = df.groupBy(*keys).agg(F.max(metric).alias("_hi"), F.min(metric).alias("_lo"))
    v = F.col(metric)
    worst = (v == F.col("_lo")) | ((v < 0) if metric == "mcc" else F.lit(False))
    return (
        df.join(limits, list(keys))
        .withColumn("flag", F.when(worst, "worst").when(v == F.col("_hi"), "best").otherwise(""))
        .drop("_hi", "_lo")
    )
