"""Order-dependent building blocks that stay balanced when one key is hot.

A window partitioned by a key sorts that whole key in one task.  Here the sort is
spread first: by a hash prefix when the wanted order is a hash, by value ranges
when it is a value, and the pieces are put together from small per-piece totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gsx.functions.hashing import hash_key
from gsx.session import settle

HOT_ROWS = 2_000_000
BROADCAST_ROWS = 200_000
HASH_PREFIX = 3
SKETCH_ACCURACY = 10_000


def _renamed(df: DataFrame, keys) -> tuple[DataFrame, list[str]]:
    names = [f"_k_{k}" for k in keys]
    return df.withColumnsRenamed(dict(zip(keys, names))), names


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str) -> DataFrame:
    """Equi-join in which NULL keys match each other; the left keys are kept."""
    right, names = _renamed(right, keys)
    cond = F.lit(True)
    for k, n in zip(keys, names):
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    return left.join(right, cond, how).drop(*names)


def lookup_join(
    rows: DataFrame, table: DataFrame, keys, how: str = "inner", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Attach per-key values to rows; ``table`` has one row per key.

    The table is computed once and counted.  Up to ``max_rows`` it is broadcast.
    Beyond that the keys holding over 0.1 % of the rows (at most a thousand exist)
    are broadcast and all other keys go through a shuffle join, so no task
    receives a hot key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    table = settle(table)
    if table.count() <= max_rows:
        return rows.join(F.broadcast(table), keys, how)
    counts = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.filter(F.col("_n") * 1000 > total).select(*keys)
    flagged = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    hot_table = table.join(F.broadcast(hot), keys, "left_semi")
    warm = flagged.filter("_hot").drop("_hot").join(F.broadcast(hot_table), keys, how)
    cold = flagged.filter("_hot IS NULL").drop("_hot").join(table, keys, how)
    return warm.unionByName(cold)


def hash_rank(
    df: DataFrame, part, ids, seed, name: str = "rank", prefix: int = HASH_PREFIX
) -> DataFrame:
    """1-based row number in seeded hash order inside ``part``.

    The rank is the number of rows in smaller hash buckets plus the row number in
    the row's own bucket.  A bucket holds about 1/4096 of its part, whatever the
    part's size.
    """
    part = [part] if isinstance(part, str) else list(part)
    ids = [ids] if isinstance(ids, str) else list(ids)
    keyed = df.withColumn("_h", hash_key(seed, *ids)).withColumn(
        "_b", F.substring("_h", 1, prefix)
    )
    counts = keyed.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *part, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*part, "_b").orderBy("_h", *ids)
    ranked = keyed.withColumn("_r", F.row_number().over(inside))
    joined = null_safe_join(ranked, offsets, [*part, "_b"], "left")
    return joined.select(*df.columns, (F.col("_before") + F.col("_r")).cast("bigint").alias(name))


def counted(cond: Column, weight: str | None = None) -> Column:
    """Rows that meet ``cond``; a row stands for ``weight`` equal ones."""
    return F.count_if(cond) if weight is None else F.sum(F.when(cond, F.col(weight)).otherwise(0))


def value_counts(df: DataFrame, keys, value: str, label: str, weight: str | None = None) -> DataFrame:
    """Positives ``_p`` and negatives ``_n`` per distinct value; the map side combines first."""
    return (
        df.filter(F.col(value).isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, value)
        .agg(
            counted(F.col(label) == 1, weight).alias("_p"),
            counted(F.col(label) == 0, weight).alias("_n"),
        )
    )


def rank_sums(df: DataFrame, keys, value: str, label: str) -> DataFrame:
    """Mann-Whitney U (ties half), class sizes, tie term and class sums per key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return rank_sums_of(value_counts(df, keys, value, label), keys, value)


def rank_sums_of(counts: DataFrame, keys, value: str) -> DataFrame:
    """``rank_sums`` from the table of ``value_counts``.

    Distinct values are range-partitioned by (keys, value).  Every range yields its
    own U, P and N; the U of a whole key adds ``P(range) * N(ranges before)``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranged = counts.repartitionByRange(*keys, value).withColumn("_pid", F.spark_partition_id())
    below = (
        Window.partitionBy("_pid", *keys)
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")
    t = p + n
    pieces = (
        ranged.withColumn("_nb", F.coalesce(F.sum("_n").over(below), F.lit(0)))
        .groupBy("_pid", *keys)
        .agg(
            F.min(value).alias("_lo"),
            F.sum(p * (F.col("_nb") + n / 2)).alias("_u"),
            F.sum("_p").alias("_p"),
            F.sum("_n").alias("_n"),
            F.sum(t * t * t - t).alias("_ties"),
            F.sum(F.col(value) * p).alias("_ps"),
            F.sum(F.col(value) * n).alias("_ns"),
        )
    )
    earlier = Window.partitionBy(*keys).orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .groupBy(*keys)
        .agg(
            F.sum("_p").alias("n_pos"),
            F.sum("_n").alias("n_neg"),
            F.sum(F.col("_u") + F.col("_p").cast("double") * F.col("_off")).alias("u"),
            F.sum("_ties").alias("ties"),
            F.sum("_ps").alias("pos_sum"),
            F.sum("_ns").alias("neg_sum"),
        )
    )


def auc_from(u="u", n_pos="n_pos", n_neg="n_neg") -> Column:
    """U / (P*N); NULL when one class is missing."""
    return F.try_divide(
        F.col(u).cast("double"), F.col(n_pos).cast("double") * F.col(n_neg).cast("double")
    )


def auc(df: DataFrame, keys, score: str, label: str, weight: str | None = None) -> DataFrame:
    """ROC AUC per key with ties counted half (E7); a row may stand for ``weight`` equal ones."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return auc_of(value_counts(df, keys, score, label, weight), keys, score)


def auc_of(counts: DataFrame, keys, score: str) -> DataFrame:
    """``auc`` from the table of ``value_counts``."""
    return rank_sums_of(counts, keys, score).select(
        *keys, "n_pos", "n_neg", auc_from().alias("auc")
    )


def running_counts(df: DataFrame, keys, value: str, label: str, descending=False) -> DataFrame:
    """Distinct values with the positives and negatives strictly before each of them.

    The ranged value counts feed both the totals and the rows, and range limits
    must agree in both, so they are settled in between.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = F.col(value).desc() if descending else F.col(value).asc()
    counts = value_counts(df, keys, value, label)
    ranged = settle(
        counts.repartitionByRange(*keys, order).withColumn("_pid", F.spark_partition_id())
    )
    pieces = ranged.groupBy("_pid", *keys).agg(F.sum("_p").alias("_pp"), F.sum("_n").alias("_pn"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        "_pid",
        *keys,
        F.coalesce(F.sum("_pp").over(earlier), F.lit(0)).alias("_op"),
        F.coalesce(F.sum("_pn").over(earlier), F.lit(0)).alias("_on"),
    ).filter("_op + _on > 0")
    # at most one key continues into each range, so there are no more offsets than ranges
    inside = (
        Window.partitionBy("_pid", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.join(F.broadcast(offsets), ["_pid", *keys], "left")
        .withColumn("pos_before", F.coalesce(F.sum("_p").over(inside), F.lit(0)))
        .withColumn("neg_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .select(
            *keys,
            value,
            F.col("_p").alias("pos"),
            F.col("_n").alias("neg"),
            (F.col("pos_before") + F.coalesce("_op", F.lit(0))).alias("pos_before"),
            (F.col("neg_before") + F.coalesce("_on", F.lit(0))).alias("neg_before"),
        )
    )


def global_positions(df: DataFrame, order, name: str = "position") -> DataFrame:
    """1-based position of every row in one order over the whole table.

    Rows are cut into ranges of the order, settled, and numbered inside each range
    after the sizes of the ranges before it.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = settle(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    offsets = sizes.select("_pid", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_pid").orderBy(*order)
    return (
        ranged.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_o") + F.row_number().over(inside)).cast("bigint"))
        .select(*df.columns, name)
    )


def hot_keys(df: DataFrame, keys, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows (a column-pruned count)."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    )


def percentiles(df: DataFrame, keys, value: str, probs, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact linear-interpolated percentiles per key as columns ``q0``, ``q1`` …

    Keys of at most ``hot_rows`` rows use the built-in aggregate, whose buffer holds
    the key's distinct values.  Larger keys are narrowed with an approximate sketch:
    everything outside a bracket that must hold the wanted ranks collapses to counts
    before the shuffle, and only the bracket is sorted.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    probs = list(probs)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    exact = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]))

    def spread(frame, column="_q"):
        return frame.select(*keys, *[F.col(column)[i].alias(f"q{i}") for i in range(len(probs))])

    hot = hot_keys(rows, keys, hot_rows)
    if hot.isEmpty():
        return spread(rows.groupBy(*keys).agg(exact.alias("_q")))
    hot = settle(hot)
    cold = null_safe_join(rows, hot.select(*keys), keys, "left_anti")
    small = spread(cold.groupBy(*keys).agg(exact.alias("_q")))
    large = _bracketed_percentiles(rows, hot, keys, probs)
    return small.unionByName(large)


def _bracketed_percentiles(rows, hot, keys, probs) -> DataFrame:
    slack = 3.0 / SKETCH_ACCURACY
    rows = lookup_join(rows, hot.select(*keys), keys)
    marks = [(max(p - slack, 0.0), min(p + slack, 1.0)) for p in probs]
    flat = [m for pair in marks for m in pair]
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", flat, SKETCH_ACCURACY).alias("_marks")
    )
    marked = lookup_join(rows, sketch, keys)
    inside = F.lit(False)
    for i in range(len(probs)):
        inside = inside | F.col("_v").between(F.col("_marks")[2 * i], F.col("_marks")[2 * i + 1])
    # a row outside every bracket only counts towards the gap it lies in
    gap = F.lit(0)
    for i in range(len(flat)):
        gap = gap + (F.col("_v") > F.col("_marks")[i]).cast("int")
    squeezed = (
        marked.withColumn("_in", F.when(inside, F.col("_v")))
        .withColumn("_gap", F.when(inside, -1).otherwise(gap))
        .groupBy(*keys, "_gap", "_in")
        .agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
    )
    upto = Window.partitionBy(*keys).orderBy("_lo").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = squeezed.withColumn("_end", F.sum("_c").over(upto)).withColumn(
        "_total", F.sum("_c").over(whole)
    )
    first, last = F.col("_end") - F.col("_c"), F.col("_end") - 1

    def at(rank):
        # the first and last value of a collapsed gap are known, its inner ranks are not
        return F.max(
            F.when((rank == first) | (F.col("_lo") == F.col("_hi")) & rank.between(first, last), F.col("_lo"))
            .when(rank == last, F.col("_hi"))
        )

    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        out += [at(low).alias(f"_l{i}"), at(high).alias(f"_h{i}"), F.max(pos - low).alias(f"_f{i}")]
    picked = ranked.groupBy(*keys).agg(*out)
    missing = F.lit(False)
    for i in range(len(probs)):
        missing = missing | F.col(f"_l{i}").isNull() | F.col(f"_h{i}").isNull()
    value = [
        F.when(missing, F.raise_error(F.lit("percentile rank outside its bracket")).cast("double"))
        .otherwise(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}"))
        .alias(f"q{i}")
        for i in range(len(probs))
    ]
    return picked.select(*keys, *value)


def with_neighbours(
    df: DataFrame, keys, order, reach: int, exprs, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Window expressions that look at most ``reach`` rows around each row.

    ``exprs`` maps a window specification (ordered, without frame) to
    ``{name: Column}``.  With no hot key this is one plain window.  Otherwise the
    series are cut into ranges; a second window over only the edge rows of the cuts
    (``4 * reach`` per range) supplies the values next to a cut.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    if hot_keys(df, keys, hot_rows).isEmpty():
        return df.withColumns(exprs(Window.partitionBy(*keys).orderBy(*order)))
    cut = df.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id())
    piece = Window.partitionBy("_pid", *keys)
    near = piece.orderBy(*order)
    first = exprs(near)
    cut = cut.withColumns(first).withColumns(
        {"_i": F.row_number().over(near), "_m": F.count(F.lit(1)).over(piece)}
    )
    from_end = F.col("_m") - F.col("_i") + 1
    cut = cut.withColumns(
        {
            "_seam": (F.col("_i") <= reach) | (from_end <= reach),
            "_zone": F.when(
                (F.col("_i") <= 2 * reach) | (from_end <= 2 * reach), F.lit(-1)
            ).otherwise(F.col("_pid")),
        }
    )
    seams = exprs(Window.partitionBy("_zone", *keys).orderBy(*order))
    cut = cut.withColumns({f"_s_{k}": v for k, v in seams.items()})
    return cut.select(
        *df.columns,
        *[
            F.when(F.col("_seam"), F.col(f"_s_{k}")).otherwise(F.col(k)).alias(k)
            for k in first
        ],
    )
