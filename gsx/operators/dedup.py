"""Copies, label-bearing identifiers and leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gsx.functions.hashing import hash_int
from gsx.operators.ordered import hash_rank, lookup_join, null_safe_join
from gsx.session import settle

#: Equal removed rows that are unfolded at once.
REPEATS = 65_536


def content_md5(content: str) -> Column:
    """MD5 of a string or binary column as hex."""
    return F.md5(F.col(content))


def vector_md5(features, digits: int = 4) -> Column:
    """Hash of a feature vector rounded to ``digits``; missing values hash alike (L2).

    Rounded values are compared as whole numbers of 10^-digits, so -0.0 and 0.0 agree.
    """
    return F.md5(F.concat_ws(",", *[_whole(F.col(f), digits) for f in features]))


def _whole(value: Column, digits: int) -> Column:
    """A number in units of 10^-digits as text; one too large for 38 digits as it prints."""
    scaled = F.round(value.cast("double") * 10.0**digits)
    return F.coalesce(scaled.try_cast("decimal(38,0)").cast("string"), scaled.cast("string"), F.lit("null"))


def row_digest(df: DataFrame) -> Column:
    """MD5 of all columns of a row, NULL fields included."""
    cells = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return F.md5(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}))


def first_copies(df: DataFrame, fingerprint: Column, order_key: str) -> DataFrame:
    """(fingerprint, kept, copies): the smallest ``order_key`` of every group of copies.

    Only fingerprints and keys are shuffled, after a map-side minimum.
    """
    return (
        df.select(fingerprint.alias("fingerprint"), F.col(order_key))
        .groupBy("fingerprint")
        .agg(F.min(order_key).alias("kept"), F.count(F.lit(1)).alias("copies"))
    )


def drop_copies(df: DataFrame, fingerprint: Column, order_key: str) -> DataFrame:
    """Keep the first row of every group of copies (L1).

    NULL order keys come last; NULL contents are copies of each other.  Rows that repeat both
    content and key are counted first, so only of them the smallest row digest decides.
    """
    per_key = (
        df.select(fingerprint.alias("_fp"), F.col(order_key).alias("_key"))
        .groupBy("_fp", "_key")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    first = F.min(F.struct(F.col("_key").isNull(), "_key", "_n"))
    kept = per_key.groupBy("_fp").agg(first.alias("_first")).select("_fp", "_first._key", "_first._n")
    winners = df.withColumns({"_own": fingerprint, "_whole": row_digest(df)}).join(
        kept, F.col("_own").eqNullSafe(F.col("_fp")) & F.col(order_key).eqNullSafe(F.col("_key"))
    )
    single = winners.filter("_n = 1").select(*df.columns)
    row = F.min_by(F.struct(*df.columns), "_whole").alias("_row")
    repeated = winners.filter("_n > 1").groupBy("_own").agg(row).select("_row.*")
    return single.unionByName(repeated)


def copy_report(
    df: DataFrame, fingerprint: Column, order_key: str, domain: str, label: str
) -> DataFrame:
    """One row per removed copy with the row kept in its place.

    The kept row is that of :func:`drop_copies`; rows that repeat its key, or have none, are
    reported like any other.
    """
    id_, kept_domain = F.col("removed_id"), F.col("removed_domain")
    rows = settle(
        df.select(
            fingerprint.alias("fingerprint"),
            F.col(order_key).alias("removed_id"),
            F.col(domain).alias("removed_domain"),
            F.col(label).alias("label"),
            row_digest(df).alias("_whole"),
        )
        .groupBy("fingerprint", "removed_id", "removed_domain", "label", "_whole")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    order = F.struct(id_.isNull(), id_.alias("id"), F.col("_whole").alias("whole"), kept_domain.alias("domain"))
    groups = (
        rows.groupBy("fingerprint")
        .agg(F.min(order).alias("kept"), F.sum("_n").alias("copies"))
        .filter("copies > 1")
        .select("fingerprint", "kept")
    )
    own = F.col("removed_id").eqNullSafe(F.col("kept.id")) & (F.col("_whole") == F.col("kept.whole"))
    gone = null_safe_join(rows, groups, ["fingerprint"], "inner").withColumn("_n", F.col("_n") - own.cast("long"))
    # equal rows are unfolded in parts, so no long list of them is built
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / REPEATS)))
    part = gone.filter("_n > 0").withColumn("_part", parts)
    times = F.least(F.lit(REPEATS), F.col("_n") - F.col("_part") * REPEATS)
    return part.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(
        "fingerprint",
        F.col("kept.id").alias("kept_id"),
        F.col("kept.domain").alias("kept_domain"),
        "removed_id",
        "removed_domain",
        "label",
    )


def drop_copies_in_domain(
    df: DataFrame, domain: str, value: str, features, order_key: str, digits: int = 4
) -> DataFrame:
    """Vector dedup inside one domain; other domains pass unchanged (L2)."""
    inside = drop_copies(df.filter(F.col(domain) == value), vector_md5(features, digits), order_key)
    outside = df.filter((F.col(domain) != value) | F.col(domain).isNull())
    return outside.unionByName(inside)


def neutral_ids(df: DataFrame, id_col: str, prefix: str, seed=42, width: int = 4) -> DataFrame:
    """(id, neutral_id): distinct identifiers renumbered in salted hash order (L3).

    A sort by the raw name would keep a label written into the name.
    """
    ids = df.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    ranked = hash_rank(ids, [], id_col, seed, "_rank")
    digits = F.col("_rank").cast("string")
    padded = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return ranked.select(id_col, F.concat(F.lit(prefix), padded).alias("neutral_id"))


def replace_ids(df: DataFrame, id_col: str, prefix: str, seed=42) -> DataFrame:
    """Replace ``id_col`` by its neutral form in every row."""
    table = neutral_ids(df, id_col, prefix, seed)
    joined = lookup_join(df, table, id_col, "left")
    return joined.select(
        *[F.col("neutral_id").alias(c) if c == id_col else F.col(c) for c in df.columns]
    )


def removal_counts(report: DataFrame, labels) -> DataFrame:
    """Removed copies per domain, one column per label value (L4)."""
    return report.groupBy("removed_domain").agg(
        *[F.count_if(F.col("label") == v).alias(f"label_{v}") for v in labels],
        F.count(F.lit(1)).alias("removed"),
    )


def leakage_checks(df: DataFrame, id_col: str, token: str, fingerprint: Column) -> DataFrame:
    """(check, value, passed): no token left in an id and no repeated vector."""
    per_vector = (
        df.select(
            fingerprint.alias("fp"),
            F.coalesce(F.col(id_col).rlike(token), F.lit(False)).cast("bigint").alias("leaky"),
        )
        .groupBy("fp")
        .agg(F.count(F.lit(1)).alias("c"), F.sum("leaky").alias("leaky"))
    )
    one = per_vector.agg(
        F.coalesce(F.sum("leaky"), F.lit(0)).cast("bigint").alias("leaky_ids"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("duplicate_vectors"),
    )
    return one.unpivot([], ["leaky_ids", "duplicate_vectors"], "check", "value").withColumn(
        "passed", F.col("value") == 0
    )


def split_overlap(train: DataFrame, test: DataFrame, keys) -> DataFrame:
    """Distinct keys of ``test`` that also occur in ``train``, one row per key column."""
    out = None
    for k in keys:
        left = test.select(F.col(k).cast("string").alias("v")).distinct()
        right = train.select(F.col(k).cast("string").alias("v")).distinct()
        one = left.join(right, "v", "left_semi").agg(F.count(F.lit(1)).alias("shared"))
        one = one.select(F.lit(k).alias("key"), "shared")
        out = one if out is None else out.unionByName(one)
    return out


def run_pair_matches(results: DataFrame, run: str, keys, metrics, tolerance=1e-6) -> DataFrame:
    """(run_a, run_b, n_match): common keys on which all metrics agree within tolerance.

    A row meets only rows whose first three metrics lie in its own or a neighbouring cell of
    width ``tolerance``, so a value that many runs share does not pair them up.  Two missing
    values agree.
    """
    cells = [f"cell_{i}" for i in range(min(len(metrics), 3))]
    # a missing value has a cell of its own, far from all others
    at = [F.coalesce(F.floor(F.col(m) / tolerance), F.lit(-(2**62))) for m in metrics[: len(cells)]]
    values = [F.col(m) for m in metrics]
    base = results.select(
        F.col(run).alias("run"), *keys, *values, *[a.alias(c) for a, c in zip(at, cells)]
    )
    left = base.withColumnsRenamed({"run": "run_a", **{m: f"{m}_a" for m in metrics}})
    for c in cells:
        left = left.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    right = base.withColumnsRenamed({"run": "run_b", **{m: f"{m}_b" for m in metrics}})
    near = F.lit(True)
    for m in metrics:
        gap = F.abs(F.col(f"{m}_a") - F.col(f"{m}_b"))
        near = near & (
            (gap <= tolerance) | (F.col(f"{m}_a").isNull() & F.col(f"{m}_b").isNull())
        )
    return (
        left.join(right, [*keys, *cells])
        .filter((F.col("run_a") < F.col("run_b")) & near)
        .groupBy("run_a", "run_b")
        .agg(F.count(F.lit(1)).alias("n_match"))
    )


def run_fingerprints(results: DataFrame, run: str, keys, metrics, digits: int = 9) -> DataFrame:
    """(run, fingerprint): an order-free hash of a run's rows, merged from partial sums."""
    cells = [_whole(F.col(m), digits) for m in metrics]
    row = hash_int("run", F.concat_ws("|", *[F.col(k) for k in keys], *cells))
    return (
        results.select(F.col(run).alias("run"), row.alias("h"))
        .groupBy("run")
        .agg(
            F.count(F.lit(1)).cast("string").alias("c"),
            F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s"),
            F.bit_xor("h").cast("string").alias("x"),
        )
        .select("run", F.sha2(F.concat_ws("|", "c", "s", "x"), 256).alias("fingerprint"))
    )


def duplicate_runs(results: DataFrame, run: str, keys, metrics, share=0.95) -> DataFrame:
    """Runs that repeat another run.

    Runs with equal fingerprints are reported once each against the smallest run
    name as IDENTICAL.  Only those representatives are compared pairwise: NEAR needs
    ``share`` of the common keys to agree.
    """
    prints = run_fingerprints(results, run, keys, metrics)
    groups = prints.groupBy("fingerprint").agg(F.min("run").alias("run_a"))
    same = (
        lookup_join(prints, groups, "fingerprint")
        .filter("run <> run_a")
        .select(
            "run_a",
            F.col("run").alias("run_b"),
            F.lit(1.0).alias("match_share"),
            F.lit("IDENTICAL").alias("verdict"),
        )
    )
    heads = results.join(groups.select(F.col("run_a").alias(run)), run, "left_semi")
    pairs = run_pair_matches(heads, run, keys, metrics)
    slots = heads.select(F.col(run).alias("run"), *keys)
    common = (
        pairs.join(slots.withColumnRenamed("run", "run_a"), "run_a")
        .join(slots.withColumnRenamed("run", "run_b"), ["run_b", *keys])
        .groupBy("run_a", "run_b", "n_match")
        .agg(F.count(F.lit(1)).alias("n_common"))
    )
    near = (
        common.withColumn("match_share", F.col("n_match") / F.col("n_common"))
        .filter(F.col("match_share") >= share)
        .select("run_a", "run_b", "match_share", F.lit("NEAR").alias("verdict"))
    )
    return same.unionByName(near)
