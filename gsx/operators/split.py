"""Fold assignment and sampling in seeded hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gsx.operators.ordered import hash_rank, lookup_join
from gsx.session import settle


def row_folds(df: DataFrame, label: str, row_id: str, k: int = 5, seed=42, part=()) -> DataFrame:
    """Stratified k-fold by row: ranks in hash order inside each label, modulo k."""
    ranked = hash_rank(df, [*part, label], row_id, seed, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def group_table(df: DataFrame, group: str, label: str, part=()) -> DataFrame:
    """One row per group with its class counts."""
    return df.groupBy(*part, group).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
    )


def fold_count(n_groups: int, k: int = 5) -> int:
    """min(k, groups // 2); below 2 the domain is skipped."""
    return min(k, n_groups // 2)


def group_folds(
    df: DataFrame, group: str, label: str, k: int = 5, seed=42, part=()
) -> DataFrame:
    """(part, group, fold, k): stratified folds that keep every group whole.

    Groups of one majority class are dealt in order of size, largest first, forwards
    and backwards in turn.  Sizes are ranked through (size, hash) counts so that the
    groups themselves are never sorted in one task.
    """
    return deal_folds(settle(group_table(df, group, label, part)), group, k, seed, part)


def deal_folds(groups: DataFrame, group: str, k: int = 5, seed=42, part=()) -> DataFrame:
    """Folds of a settled group table; see :func:`group_folds`."""
    part = list(part)
    groups = groups.withColumns(
        {
            "majority": (F.col("n_pos") >= F.col("n_neg")).cast("int"),
            "size": F.col("n_pos") + F.col("n_neg"),
        }
    )
    strata = [*part, "majority"]
    sizes = groups.groupBy(*strata, "size").agg(F.count(F.lit(1)).alias("_c"))
    larger = (
        Window.partitionBy(*strata)
        .orderBy(F.col("size").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = sizes.select(*strata, "size", F.coalesce(F.sum("_c").over(larger), F.lit(0)).alias("_o"))
    ranked = hash_rank(groups, [*strata, "size"], group, seed, "_r")
    dealt = ranked.join(sizes, [*strata, "size"]).withColumn(
        "_i", F.col("_o") + F.col("_r") - 1
    )
    if part:
        totals = groups.groupBy(*part).agg(F.count(F.lit(1)).alias("_g"))
        dealt = lookup_join(dealt, totals, part)
    else:
        dealt = dealt.withColumn("_g", F.lit(groups.count()))
    folds = F.least(F.lit(k), F.floor(F.col("_g") / 2)).cast("int")
    step = (F.col("_i") % (2 * F.col("k"))).cast("int")
    return (
        dealt.withColumn("k", folds)
        .filter("k >= 2")
        .withColumn("fold", F.when(step < F.col("k"), step).otherwise(2 * F.col("k") - 1 - step))
        .select(*part, group, F.col("fold").cast("int"), "k")
    )


def with_group_folds(df, group, label, k=5, seed=42, part=()) -> DataFrame:
    """Rows with their fold; a group holding many rows is joined without a hot shuffle key."""
    table = group_folds(df, group, label, k, seed, part).drop("k")
    return lookup_join(df, table, [*part, group])


def seeded_order(df: DataFrame, row_id: str, seed=42, name="position") -> DataFrame:
    """Position of each row in a seeded shuffle (U5); rows stay distributed."""
    return hash_rank(df, [], row_id, seed, name)


def undersample(df: DataFrame, label: str, row_id: str, seed=42) -> DataFrame:
    """All classes cut to the size of the smallest one."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    smallest = counts.agg(F.min("_c")).first()[0] or 0
    ranked = hash_rank(df, label, row_id, seed, "_rank")
    return ranked.filter(F.col("_rank") <= smallest).select(*df.columns)


def first_k_per_group(df: DataFrame, group: str, row_id: str, k: int, seed=42) -> DataFrame:
    """Groups with at least ``k`` rows, each cut to its first ``k`` in hash order."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= k)
    ranked = hash_rank(df, group, row_id, seed, "_rank").filter(F.col("_rank") <= k)
    # at most k rows of a group are left here, so the join has no hot key
    return ranked.join(big.select(group), group, "left_semi").select(*df.columns)


def balanced_groups(
    df: DataFrame, group: str, label: str, row_id: str, k: int, seed=42
) -> DataFrame:
    """Equal numbers of groups per class, ``k`` rows each.

    A group's class is the smallest label of its kept rows.
    """
    kept = first_k_per_group(df, group, row_id, k, seed)
    groups = kept.groupBy(group).agg(F.min(label).alias("_class"))
    chosen = undersample(groups, "_class", group, seed)
    return kept.join(chosen.select(group), group, "left_semi")


def stratified_split(df: DataFrame, label: str, row_id: str, share: float, seed=42) -> DataFrame:
    """Exact-size stratified split: ``part`` is ``fit`` for ``share`` of each label (U8)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    ranked = lookup_join(hash_rank(df, label, row_id, seed, "_rank"), counts, label)
    take = F.floor(F.col("_c") * share)
    return ranked.withColumn(
        "part", F.when(F.col("_rank") <= take, "fit").otherwise("test")
    ).select(*df.columns, "part")
