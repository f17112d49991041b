"""Aggregations, class statistics, feature ranking and consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gsx.functions.stat_math import cohen_d, mann_whitney_p, stars, student_two_sided_p
from gsx.operators.ordered import auc_from, lookup_join, percentiles, rank_sums

MIN_PER_CLASS = 5
MIN_ROWS = 10
VARIANCE_FLOOR = 0.001
MIN_CONSISTENT = 20


def domain_summary(df: DataFrame, domain: str, label: str, group: str, language: str) -> DataFrame:
    """Rows, class counts, distinct groups and rows per group of each domain (A1).

    Groups are counted from a first aggregate by (domain, group), which splits a hot
    domain over its groups.
    """
    per_group = df.groupBy(domain, group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.min(language).alias("language"),
    )
    return per_group.groupBy(domain).agg(
        F.sum("rows").alias("rows"),
        F.sum("positives").alias("positives"),
        F.sum("negatives").alias("negatives"),
        F.count(group).alias("groups"),
        F.try_divide(F.sum("rows").cast("double"), F.count(group)).alias("rows_per_group"),
        F.min("language").alias("language"),
    )


def class_crosstab(df: DataFrame, domain: str, label: str, values) -> DataFrame:
    """Counts per domain and class, total and share of all rows, with a grand total (A2)."""
    counts = df.groupBy(domain, label).agg(F.count(F.lit(1)).alias("_c"))
    table = counts.rollup(domain).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(label) == v, F.col("_c"))), F.lit(0)).alias(f"class_{v}")
            for v in values
        ],
        F.sum("_c").alias("total"),
        F.grouping(domain).alias("_all"),
    )
    whole = Window.partitionBy()  # one row per domain is left here
    return table.select(
        F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(domain)).alias(domain),
        *[f"class_{v}" for v in values],
        "total",
        (100.0 * F.col("total") / F.max(F.when(F.col("_all") == 1, F.col("total"))).over(whole)).alias(
            "percent"
        ),
    )


def null_audit(df: DataFrame, features) -> DataFrame:
    """(feature, nulls, rows, share) from one aggregate over all columns (A3)."""
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f).isNull()).alias(f) for f in features]
    )
    return one.unpivot(["_rows"], list(features), "feature", "nulls").select(
        "feature",
        "nulls",
        F.col("_rows").alias("rows"),
        F.try_divide(F.col("nulls").cast("double"), F.col("_rows")).alias("share"),
    )


def variances(df: DataFrame, features) -> DataFrame:
    """(feature, variance): population variance in one pass (A4)."""
    one = df.agg(*[F.var_pop(f).alias(f) for f in features])
    return one.unpivot([], list(features), "feature", "variance")


def variance_filter(df: DataFrame, features, floor: float = VARIANCE_FLOOR) -> DataFrame:
    """Variance per feature and whether it stays (strictly above the floor)."""
    return variances(df, features).withColumn(
        "keep", F.coalesce(F.col("variance") > floor, F.lit(False))
    )


def class_scores(long: DataFrame, keys, value="value", label="label") -> DataFrame:
    """Class sizes and means, U, p-value, raw AUC and direction per key (A6, A7 core)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    r = rank_sums(long, keys, value, label)
    pos_mean = F.try_divide(F.col("pos_sum"), F.col("n_pos").cast("double"))
    neg_mean = F.try_divide(F.col("neg_sum"), F.col("n_neg").cast("double"))
    scored = r.select(
        *keys,
        "n_pos",
        "n_neg",
        "u",
        pos_mean.alias("pos_mean"),
        neg_mean.alias("neg_mean"),
        auc_from().alias("raw_auc"),
        mann_whitney_p(F.col("u"), F.col("n_pos"), F.col("n_neg"), F.col("ties")).alias("p_value"),
    )
    # means of a feature that does not separate at all may differ in the last bit only
    higher = F.col("pos_mean") > F.col("neg_mean")
    return scored.withColumn("direction", F.when(higher, "pos>neg").otherwise("pos<neg"))


def signed_auc(long: DataFrame, keys, value="value", label="label") -> DataFrame:
    """AUC oriented by the class means; it may lie below one half."""
    s = class_scores(long, keys, value, label).filter(
        (F.col("n_pos") >= MIN_PER_CLASS) & (F.col("n_neg") >= MIN_PER_CLASS)
    )
    up = F.col("direction") == "pos>neg"
    return s.withColumn("auc", F.when(up, F.col("raw_auc")).otherwise(1 - F.col("raw_auc")))


def rank_by_auc(scores: DataFrame, domain="domain", feature="feature") -> DataFrame:
    """1-based rank per domain, ties broken by name (A9); one row per feature arrives."""
    w = Window.partitionBy(domain).orderBy(F.col("auc").desc(), F.col(feature))
    return scores.withColumn("rank", F.row_number().over(w))


def folded_auc(long: DataFrame, feature="feature", domain="domain") -> DataFrame:
    """max(a, 1-a) per feature, for each domain and for all together.

    Every row enters its domain's cell and the combined one; a cell with fewer than
    ten rows or one class is NULL.
    """
    both = long.withColumn("_cell", F.explode(F.array(F.col(domain), F.lit("combined"))))
    r = rank_sums(both, [feature, "_cell"], "value", "label")
    enough = F.col("n_pos") + F.col("n_neg") >= MIN_ROWS
    return r.select(
        feature,
        F.col("_cell").alias(domain),
        F.when(enough, F.greatest(auc_from(), 1 - auc_from())).alias("auc"),
    )


def pivot_auc(scores: DataFrame, domains, feature="feature", domain="domain", suffix="_auc"):
    """One row per feature, one AUC column per domain."""
    return scores.groupBy(feature).agg(
        *[F.max(F.when(F.col(domain) == d, F.col("auc"))).alias(f"{d}{suffix}") for d in domains]
    )


def direction_check(long: DataFrame, expected, feature="feature") -> DataFrame:
    """Class means against the expected direction, with p, stars and effect size (A5).

    ``expected`` maps feature to ``pos>neg`` or ``pos<neg``.
    """
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    rows = long.filter(F.col(feature).isin(*expected))
    dev = rows.groupBy(feature).agg(
        F.stddev_samp(F.when(F.col("label") == 1, F.col("value"))).alias("_sp"),
        F.stddev_samp(F.when(F.col("label") == 0, F.col("value"))).alias("_sn"),
    )
    s = class_scores(rows, feature).join(dev, feature)
    return s.select(
        feature,
        "pos_mean",
        "neg_mean",
        F.when(F.col("direction") == want[F.col(feature)], "OK").otherwise("INVERTED").alias("check"),
        "p_value",
        stars(F.col("p_value")).alias("stars"),
        cohen_d(
            F.col("n_pos"), F.col("n_neg"), F.col("pos_mean"), F.col("neg_mean"),
            F.col("_sp"), F.col("_sn"),
        ).alias("cohen_d"),
    )


def consensus(ranking: DataFrame, domains, top_n: int) -> DataFrame:
    """Union of the domains' top lists with membership, ranks and mean AUC."""
    top = F.col("rank") <= top_n
    per = ranking.groupBy("feature").agg(
        F.count_if(top).alias("dataset_count"),
        F.array_join(F.sort_array(F.collect_set(F.when(top, F.col("domain")))), " | ").alias(
            "in_datasets"
        ),
        *[
            c
            for d in domains
            for c in (
                F.max(F.when(F.col("domain") == d, F.col("rank"))).alias(f"{d}_rank"),
                F.max(F.when(F.col("domain") == d, F.col("auc"))).alias(f"{d}_auc"),
            )
        ],
        F.avg(F.when(top, F.col("auc"))).alias("mean_auc_in_top"),
    )
    return per.filter("dataset_count > 0").withColumn(
        "is_common_all", F.col("dataset_count") == len(domains)
    )


def union_and_stable(cons: DataFrame) -> DataFrame:
    """(set_name, feature): all consensus features and those of two domains or more."""
    names = F.when(F.col("dataset_count") >= 2, F.array(F.lit("UNION"), F.lit("STABLE")))
    return cons.select(
        F.explode(names.otherwise(F.array(F.lit("UNION")))).alias("set_name"), "feature"
    )


def consistency_ranking(
    scores: DataFrame, n_domains: int, floor_count: int = MIN_CONSISTENT
) -> DataFrame:
    """Mean and minimum signed AUC over domains, ranked by the minimum.

    Features whose direction differs between domains are left out, unless fewer than
    ``floor_count`` consistent ones exist.
    """
    per = scores.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_domains"),
        F.avg("auc").alias("mean_auc"),
        F.min("auc").alias("min_auc"),
        (F.min("direction") == F.max("direction")).alias("same_direction"),
    )
    per = per.filter(F.col("n_domains") == n_domains)
    whole = Window.partitionBy()  # one row per feature
    kept = per.withColumn("_ok", F.count_if(F.col("same_direction")).over(whole)).filter(
        F.col("same_direction") | (F.col("_ok") < floor_count)
    )
    order = Window.orderBy(F.col("min_auc").desc(), F.col("feature"))
    return kept.drop("_ok").withColumn("rank", F.row_number().over(order))


def direction_table(long: DataFrame, domains, feature="feature", domain="domain") -> DataFrame:
    """Direction of the class difference per domain and whether all agree."""
    means = long.groupBy(feature, domain).agg(
        F.avg(F.when(F.col("label") == 1, F.col("value"))).alias("_p"),
        F.avg(F.when(F.col("label") == 0, F.col("value"))).alias("_n"),
    )
    side = F.when(F.col("_p") > F.col("_n"), "pos>neg").when(F.col("_p") <= F.col("_n"), "pos<neg")
    return means.withColumn("_d", side).groupBy(feature).agg(
        *[F.max(F.when(F.col(domain) == d, F.col("_d"))).alias(f"{d}_direction") for d in domains],
        F.coalesce(F.min("_d") == F.max("_d"), F.lit(False)).alias("compatible"),
    )


def group_means(df: DataFrame, group: str, label: str, features, carry=()) -> DataFrame:
    """Mean of every feature per group, its label and whether the label is unique."""
    return df.groupBy(group).agg(
        *[F.avg(f).alias(f) for f in features],
        *[F.min(c).alias(c) for c in carry],
        F.min(label).alias(label),
        (F.min(label) == F.max(label)).alias("label_consistent"),
    )


def spearman(ranking: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two domains' rankings, its t statistic and two-sided p.

    The p value is NULL below three features; rankings that agree or oppose each other in full have p 0.
    """
    wide = ranking.groupBy("feature").agg(
        F.max(F.when(F.col("domain") == a, F.col("auc"))).alias("va"),
        F.max(F.when(F.col("domain") == b, F.col("auc"))).alias("vb"),
    ).filter("va IS NOT NULL AND vb IS NOT NULL")

    def average_rank(c):
        return F.rank().over(Window.orderBy(c)) + (
            F.count(F.lit(1)).over(Window.partitionBy(c)) - 1
        ) / 2.0

    ranks = wide.select(average_rank("va").alias("ra"), average_rank("vb").alias("rb"))
    one = ranks.agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    settled = one.select(F.lit(a).alias("domain_a"), F.lit(b).alias("domain_b"), "n", "rho", t.alias("t"))
    p = F.when(F.abs("rho") < 1, student_two_sided_p(F.col("t"), F.col("n") - 2)).when(F.abs("rho") >= 1, 0.0)
    return settled.withColumn("p_value", F.when(F.col("n") > 2, p))


def fuse_ranks(wide: DataFrame, rank_cols, feature="feature") -> DataFrame:
    """Row mean of ranks and the overall rank by it."""
    total = sum((F.col(c) for c in rank_cols[1:]), F.col(rank_cols[0]))
    mean = (total / len(rank_cols)).alias("mean_rank")
    order = Window.orderBy("mean_rank", feature)
    return wide.select("*", mean).withColumn("overall_rank", F.row_number().over(order))


def anova_f(long: DataFrame, keys=("feature",), value="value", label="label") -> DataFrame:
    """One-way F statistic per key from class counts, means and variances."""
    keys = list(keys)
    per = long.groupBy(*keys, label).agg(
        F.count(value).alias("c"), F.avg(value).alias("m"), F.var_pop(value).alias("v")
    ).filter("c > 0")
    n, k = F.sum("c").cast("double"), F.count(F.lit(1)).cast("double")
    mean = F.sum(F.col("c") * F.col("m")) / F.sum("c")
    between = F.sum(F.col("c") * F.col("m") * F.col("m")) - F.sum("c") * mean * mean
    within = F.sum(F.col("c") * F.col("v"))
    table = per.groupBy(*keys).agg(between.alias("_b"), within.alias("_w"), n.alias("_n"), k.alias("_k"))
    return table.select(
        *keys,
        F.try_divide(
            F.try_divide(F.col("_b"), F.col("_k") - 1), F.try_divide(F.col("_w"), F.col("_n") - F.col("_k"))
        ).alias("f_stat"),
    )


def top_by(df: DataFrame, score: str, name: str, k: int, part=()) -> DataFrame:
    """First ``k`` rows by descending score inside ``part``; one row per feature arrives."""
    w = Window.partitionBy(*part).orderBy(F.col(score).desc_nulls_last(), F.col(name))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def density_curves(long: DataFrame, keys, points: int = 200, value="value") -> DataFrame:
    """Gaussian kernel density per key on an even grid.

    The bandwidth is ``n^(-1/5)`` sample deviations.  Equal values are counted first,
    so the work is distinct values times grid points, and partial sums combine per
    (key, grid point) on the map side.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = long.filter(F.col(value).isNotNull())
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.stddev_samp(value).alias("_sd"),
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
    ).filter("_n > 1 AND _sd > 0")
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    h = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    spaced = lookup_join(counts, stats, keys).withColumn("_h", h)
    grid = spaced.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    z = (x - F.col(value)) / F.col("_h")
    bump = F.col("_c") * F.exp(-z * z / 2) / (F.col("_n") * F.col("_h") * F.sqrt(2 * F.pi()))
    return grid.groupBy(*keys, "point").agg(F.max(x).alias("x"), F.sum(bump).alias("density"))


def fold_spread(df: DataFrame, keys, metrics) -> DataFrame:
    """Mean and population deviation of metrics over folds."""
    return df.groupBy(*keys).agg(
        *[
            c
            for m in metrics
            for c in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))
        ]
    )


def overlap_counts(ranking: DataFrame, a: str, b: str, cutoffs) -> DataFrame:
    """How many features two domains share in their top N, for each cutoff N (U4)."""
    wide = ranking.groupBy("feature").agg(
        F.max(F.when(F.col("domain") == a, F.col("rank"))).alias("ra"),
        F.max(F.when(F.col("domain") == b, F.col("rank"))).alias("rb"),
    )
    return (
        wide.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
        .groupBy("cutoff")
        .agg(
            F.count_if((F.col("ra") <= F.col("cutoff")) & (F.col("rb") <= F.col("cutoff"))).alias(
                "shared"
            )
        )
    )


def max_row(df: DataFrame, keys, by: Column) -> DataFrame:
    """The whole row with the largest ``by`` per key, combined on the map side."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), by).alias("_r"))
    return picked.select("_r.*")
