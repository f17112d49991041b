"""Joins of metadata, rankings and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gsx.operators.ordered import global_positions, lookup_join


def with_features(meta: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Metadata and features of the same recording."""
    return meta.join(features, key)


def with_subject_metadata(df: DataFrame, subjects: DataFrame, key: str, probe: str) -> DataFrame:
    """Left join of one-row-per-subject metadata; ``known`` tells a match."""
    return lookup_join(df, subjects, key, "left").withColumn("known", F.col(probe).isNotNull())


def join_rankings(rankings: dict[str, DataFrame], key="feature", value="rank") -> DataFrame:
    """Inner join of several rankings on the feature name."""
    out = None
    for name, r in rankings.items():
        one = r.select(key, F.col(value).alias(f"{name}_{value}"))
        out = one if out is None else out.join(one, key)
    return out


def map_values(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Dictionary lookup, NULL for unknown keys."""
    return lookup_join(df, table, key, "left")


def member_flag(df: DataFrame, members: DataFrame, key: str, name: str = "member") -> DataFrame:
    """``Y`` for keys in the member table, else NULL."""
    table = members.select(key).distinct().withColumn(name, F.lit("Y"))
    return lookup_join(df, table, key, "left")


def transfer_cells(df: DataFrame, domain: str, combined: str = "Combined") -> DataFrame:
    """(train, test) for every ordered pair of domains and the pooled one.

    The distinct names, however many, meet in one row that is unfolded twice; NULL is no domain.
    """
    names = df.select(F.col(domain).cast("string").alias("name")).dropna().distinct()
    every = F.array_sort(F.collect_list("name"))
    if combined:
        every = F.concat(every, F.array(F.lit(combined)))
    row = names.agg(every.alias("every"))
    return row.select("every", F.explode("every").alias("train")).select("train", F.explode("every").alias("test"))


def cells_of(spark, names, combined="Combined") -> DataFrame:
    every = sorted(names) + ([combined] if combined else [])
    pairs = [(a, b) for a in every for b in every]
    return spark.createDataFrame(pairs, "train string, test string")


def side_by_side(ranking: DataFrame, domains, n: int) -> DataFrame:
    """Top lists of the domains next to each other by rank."""
    top = ranking.filter(F.col("rank") <= n)
    return top.groupBy("rank").agg(
        *[
            c
            for d in domains
            for c in (
                F.max(F.when(F.col("domain") == d, F.col("feature"))).alias(f"{d}_feature"),
                F.max(F.when(F.col("domain") == d, F.col("auc"))).alias(f"{d}_auc"),
            )
        ]
    )


def union_domains(frames, by_name_missing: bool = False) -> DataFrame:
    """Rows of several frames; absent columns become NULL when asked."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=by_name_missing)
    return out


def latest_per_key(df: DataFrame, key, path: str) -> DataFrame:
    """Largest path per key."""
    return df.groupBy(key).agg(F.max(path).alias(path), F.count(F.lit(1)).alias("versions"))


def ordered_rows(df: DataFrame, name: str, order) -> DataFrame:
    """Position in an explicit mixed order."""
    return global_positions(df, order, name)
