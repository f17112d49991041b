"""Column roles, feature dictionaries and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gsx.functions.names import (
    PROSODY_TOKENS,
    SPECTRAL_TOKENS,
    contains_any,
    name_class,
    name_stem,
)
from gsx.operators.ordered import lookup_join

MIN_FEATURES = 3


def exclusion_report(df: DataFrame, domain: str, excluded) -> DataFrame:
    """Rows per domain with whether the domain is left out."""
    return (
        df.groupBy(domain)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("excluded", F.coalesce(F.col(domain).isin(*excluded), F.lit(False)))
    )


def exclude_domains(df: DataFrame, domain: str, excluded) -> DataFrame:
    """Rows of all other domains; a row without a domain stays."""
    return df.filter(~F.coalesce(F.col(domain).isin(*excluded), F.lit(False)))


def domain_presence(df: DataFrame, domain: str, names) -> DataFrame:
    """Row count of every expected domain, zero when it is empty."""
    spark = df.sparkSession
    expected = spark.createDataFrame([(n,) for n in names], f"{domain} string")
    seen = df.filter(F.col(domain).isin(*names)).groupBy(domain).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return expected.join(seen, domain, "left").select(
        domain,
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.col("rows").isNotNull().alias("present"),
    )


def keep_columns(df: DataFrame, meta, wanted) -> tuple[DataFrame, list[str]]:
    """Meta plus the available wanted columns, and the names that are missing (P5)."""
    have = [c for c in wanted if c in df.columns]
    return df.select(*meta, *have), [c for c in wanted if c not in df.columns]


def drop_columns(df: DataFrame, names) -> tuple[DataFrame, list[str]]:
    """Frame without the names, and the names it never had."""
    return df.drop(*names), [n for n in names if n not in df.columns]


def column_audit(df: DataFrame, dropped, wanted) -> DataFrame:
    """(column, action) of a keep list and a drop list against the schema."""
    rows = [(c, "dropped" if c in df.columns else "absent") for c in dropped]
    rows += [(c, "kept" if c in df.columns else "missing") for c in wanted]
    return df.sparkSession.createDataFrame(rows, "column string, action string")


def substring_groups(names: DataFrame, groups=None, name="feature") -> DataFrame:
    """(group, feature): names containing any token of a group."""
    groups = groups or {"prosody": PROSODY_TOKENS, "spectral": SPECTRAL_TOKENS}
    hits = [F.when(contains_any(F.col(name), t), F.lit(g)) for g, t in groups.items()]
    return names.select(
        F.explode(F.array_compact(F.array(*hits))).alias("group_name"), F.col(name)
    )


def prefix_groups(names: DataFrame, groups: dict, wanted=None, name="feature") -> DataFrame:
    """(group, feature): names starting with any prefix of a group.

    Case is ignored.  An unknown wanted group raises; so does, when the result is read, a
    group that matches no name.
    """
    wanted = list(groups) if wanted is None else list(wanted)
    unknown = [g for g in wanted if g not in groups]
    if unknown:
        raise KeyError(f"unknown feature groups: {unknown}")

    def hit(prefixes) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | F.lower(F.col(name)).startswith(p.lower())
        return out

    hits = [F.when(hit(groups[g]), F.lit(g)) for g in wanted]
    found = names.select(
        F.explode(F.array_compact(F.array(*hits))).alias("group_name"), F.col(name)
    ).distinct()
    # one row per wanted group
    asked = F.broadcast(names.sparkSession.createDataFrame([(g,) for g in wanted], "_group string"))
    checked = found.join(asked, F.col("group_name") == F.col("_group"), "right")
    stop = F.raise_error(F.concat(F.lit("no feature matches group "), F.col("_group"))).cast("string")
    return checked.select(F.coalesce(F.col("group_name"), stop).alias("group_name"), name)


def classified(names: DataFrame, name="feature") -> DataFrame:
    """Name class and stem of every feature name."""
    return names.select(
        name, name_class(F.col(name)).alias("class"), name_stem(F.col(name)).alias("stem")
    )


def class_summary(names: DataFrame, name="feature") -> DataFrame:
    """Features and distinct stems per name class (P10)."""
    return (
        classified(names, name)
        .groupBy("class")
        .agg(
            F.count(F.lit(1)).alias("n_features"),
            F.count_distinct("stem").alias("n_stems"),
        )
    )


def equal_thirds(names: DataFrame, position: str = "pos", total: str = "n") -> DataFrame:
    """Three runs of n//3, n//3 and the rest by position."""
    third = F.floor(F.col(total) / 3)
    two = F.floor(2 * F.col(total) / 3)
    return names.withColumn(
        "part",
        F.when(F.col(position) < third, "first").when(F.col(position) < two, "second").otherwise(
            "third"
        ),
    )


def usable_features(long: DataFrame, domain: str, domains) -> DataFrame:
    """Features with a value in every one of the domains."""
    return (
        long.filter(F.col("value").isNotNull() & F.col(domain).isin(*domains))
        .groupBy("feature", domain)
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("_d"), F.min("rows").alias("min_rows"))
        .filter(F.col("_d") == len(domains))
        .drop("_d")
    )


def category_sets(usable: DataFrame, categories: dict) -> DataFrame:
    """Usable features per category; a category with fewer than three is skipped."""
    sets = prefix_groups(usable, categories)
    sizes = sets.groupBy("group_name").agg(F.count(F.lit(1)).alias("n_features"))
    return sets.join(
        sizes.filter(F.col("n_features") >= MIN_FEATURES), "group_name"
    )


def knowledge_sets(names: DataFrame, ranking: DataFrame, family: str, fixed, extra, k: int):
    """(set_name, feature) for fixed lists, a family exclusion and a top list."""
    union = list(dict.fromkeys([*fixed, *extra]))
    member = F.array_compact(
        F.array(
            F.when(F.col("feature").isin(*fixed), F.lit("fixed")),
            F.when(F.col("feature").isin(*union), F.lit("fixed_and_extra")),
            F.when(~F.col("feature").startswith(family), F.lit("without_family")),
        )
    )
    listed = names.select(F.explode(member).alias("set_name"), "feature")
    top = ranking.filter(F.col("rank") <= k).select(
        F.concat(F.lit("top_"), F.col("domain")).alias("set_name"), "feature"
    )
    return listed.unionByName(top)


def coerce_numeric(df: DataFrame, columns, required=()) -> DataFrame:
    """Numbers or NULL from text; rows lacking a required column are dropped."""
    cast = df.withColumns({c: F.col(c).try_cast("double") for c in columns})
    return cast.dropna(subset=list(required)) if required else cast


def filter_report(df: DataFrame, kind: str, kept) -> DataFrame:
    """Rows kept and dropped per value of a type column."""
    return (
        df.groupBy(kind)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("kept", F.col(kind).isin(*kept))
    )


def split_errors(df: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """(good, failed) rows by a nullable error column."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def complete_columns(df: DataFrame, features) -> list[str]:
    """Features without any NULL; one aggregate row is read."""
    row = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    return [f for f in features if row[f] == 0]


def drop_incomplete_columns(df: DataFrame, features) -> DataFrame:
    keep = set(complete_columns(df, features))
    return df.drop(*[f for f in features if f not in keep])


def drop_incomplete_rows(df: DataFrame, features) -> DataFrame:
    return df.dropna("any", subset=list(features))


def numbered(names: DataFrame, name="feature") -> DataFrame:
    """Dictionary positions from 0 in name order and the dictionary size.

    A dictionary holds one row per column name, so one ordered pass is enough.
    """
    return names.select(
        name,
        (F.row_number().over(Window.orderBy(name)) - 1).alias("pos"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"),
    )
