"""Bootstrap intervals for the AUC.

Each replicate gives every row a Poisson(1) weight derived from a hash of the row id
and the replicate number, so no row is copied.  Rows are range-partitioned by
(cell, score, id hash); a task turns its range into sums per replicate, and ranges are
joined from those sums.  A score shared by many rows may span ranges: the first and the
last score of a range are kept apart and equal scores are added up afterwards.  Inside a range, blocks
of rows meet by a small matrix product and carry only their sums to the next block.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gsx.functions.hashing import hash_int
from gsx.session import ship

MIN_VALID = 10
LEVELS = (0.025, 0.975)
# The SplitMix64 increment and multipliers.
GOLDEN = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
#: Rows of a block; up to 256 keep its float32 sums exact.
BLOCK = 128


def poisson_limits() -> list[int]:
    """Poisson(1) distribution function in steps of 2^-16."""
    total, limits = 0.0, []
    for j in range(13):
        total += math.exp(-1.0) / math.factorial(j)
        limits.append(int(total * 2**16))
    return limits


def _weight_table() -> np.ndarray:
    return np.searchsorted(poisson_limits(), np.arange(2**16), side="right").astype(np.uint8)


WEIGHTS = _weight_table()


#: Steps of the weight table, each with the amount the weight grows there.
WEIGHT_STEPS = [(limit, np.uint8(n)) for limit, n in sorted(Counter(poisson_limits()).items())]


def replicate_weights(h: np.ndarray, n_boot: int) -> np.ndarray:
    """(rows, replicates) weights from 64-bit row hashes.

    One mixed word serves four replicates, sixteen bits each, lowest bits first.  A weight is the
    number of limits it reaches, counted in whole vectors because a table lookup per weight is slower.
    """
    blocks = (n_boot + 3) // 4
    steps = np.arange(1, blocks + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    x = h.astype(np.uint64)[:, None] + steps[None, :]
    spare = np.empty_like(x)
    for shift, factor in ((30, MIX_A), (27, MIX_B), (31, None)):
        x ^= np.right_shift(x, np.uint64(shift), out=spare)
        if factor is not None:
            x *= np.uint64(factor)
    word = x.astype("<u8", copy=False).view("<u2")[:, :n_boot]
    weights = np.zeros(word.shape, np.uint8)
    for limit, n in WEIGHT_STEPS:
        reached = (word >= limit).view(np.uint8)
        weights += reached if n == 1 else reached * n
    return weights


class _CellSums:
    """Sums of one cell within one sorted range.

    ``first`` and ``last`` hold the smallest and the largest score with their sums; ``u``, ``p``
    and ``n`` are the sums of all rows above ``first``.
    """

    def __init__(self, n_boot: int):
        self.first = self.last = None
        self.lo = None
        self.u, self.p, self.n = (np.zeros(n_boot) for _ in range(3))

    def add(self, score, y, w):
        """The next rows in order, at most BLOCK."""
        group = np.concatenate([[0], np.cumsum(score[1:] != score[:-1])])
        yes = y == 1
        p, n = w[yes].astype(np.float32), w[~yes].astype(np.float32)
        gp, gn = group[yes], group[~yes]
        if self.first is None:
            self.first = (score[0], np.zeros(w.shape[1]), np.zeros(w.shape[1]))
        if self.last is None and score[0] == self.first[0]:
            kp, kn = np.count_nonzero(gp == 0), np.count_nonzero(gn == 0)
            self.first[1][:] += p[:kp].sum(axis=0)
            self.first[2][:] += n[:kn].sum(axis=0)
            p, n, gp, gn, score, group = p[kp:], n[kn:], gp[kp:], gn[kn:], score[kp + kn :], group[kp + kn :]
        if not len(score):
            return
        ps, ns = p.sum(axis=0), n.sum(axis=0)
        below = (gn < gp[:, None]) + np.float32(0.5) * (gn == gp[:, None])
        self.u += np.einsum("ij,ij->j", below @ n, p) + self.n * ps
        goes_on = self.last is not None and self.last[0] == score[0]
        if goes_on:
            # rows of one score in different blocks count half, whichever came first
            tp, tn = p[gp == group[0]].sum(axis=0), n[gn == group[0]].sum(axis=0)
            self.u += (self.last[1] * tn - self.last[2] * tp) / 2
        lp, ln = (v[g == group[-1]].sum(axis=0).astype(float) for v, g in ((p, gp), (n, gn)))
        if goes_on and group[0] == group[-1]:
            lp, ln = lp + self.last[1], ln + self.last[2]
        self.last = (score[-1], lp, ln)
        self.lo = score[0] if self.lo is None else self.lo
        self.p += ps
        self.n += ns

    def rows(self, key):
        for tie in (self.first, self.last):
            if tie is not None:
                yield (*key, "tie", float(tie[0]), np.zeros(len(tie[1])), tie[1], tie[2])
        if self.lo is not None and self.lo != self.last[0]:
            _, lp, ln = self.last
            p, n = self.p - lp, self.n - ln
            yield (*key, "mid", float(self.lo), self.u - lp * (n + ln / 2), p, n)


def _range_sums(keys, n_boot):
    names = [*keys, "kind", "lo", "u", "p", "n"]
    kinds = [*[pa.string()] * len(keys), pa.string(), pa.float64(), *[pa.list_(pa.float64())] * 3]

    def table(rows):
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    def run(batches):
        key, sums = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = [batch.column(k) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for c in cells:
                change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            bounds = [*np.flatnonzero(change), batch.num_rows]
            score, y, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("score", "y", "h"))
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                now = tuple(c[a].as_py() for c in cells)
                if now != key:
                    if sums is not None:
                        out += list(sums.rows(key))
                    key, sums = now, _CellSums(n_boot + 1)
                for i in range(a, b, BLOCK):
                    j = min(i + BLOCK, b)
                    w = np.ones((j - i, n_boot + 1), np.uint8)
                    w[:, :n_boot] = replicate_weights(h[i:j], n_boot)
                    sums.add(score[i:j], y[i:j], w)
            if out:
                yield table(out)
        if sums is not None:
            yield table(list(sums.rows(key)))

    return run


def _replicate_sums(df: DataFrame, keys, score: str, label: str, hashed: Column, n_boot: int) -> DataFrame:
    """(keys, rep, u, p, n) of every resample; ``rep`` n_boot is the table itself, each row once."""
    spark = df.sparkSession
    ship(spark)
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    rows = (
        df.filter(F.col(score).isNotNull() & F.col(label).isin(0, 1))
        .select(
            # a missing key differs from an empty one
            *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")).alias(k) for k in keys],
            F.col(score).cast("double").alias("score"),
            F.col(label).cast("int").alias("y"),
            hashed.alias("h"),
        )
        .repartitionByRange(parts, *keys, "score", "h")
        .sortWithinPartitions(*keys, "score")
    )
    schema = T.StructType(
        [T.StructField(k, T.StringType()) for k in keys]
        + [
            T.StructField("kind", T.StringType()),
            T.StructField("lo", T.DoubleType()),
            T.StructField("u", T.ArrayType(T.DoubleType())),
            T.StructField("p", T.ArrayType(T.DoubleType())),
            T.StructField("n", T.ArrayType(T.DoubleType())),
        ]
    )
    sums = rows.mapInArrow(_range_sums(keys, n_boot), schema)
    flat = sums.select(*keys, "kind", "lo", F.posexplode(F.arrays_zip("u", "p", "n")).alias("rep", "z"))
    pieces = flat.groupBy(*keys, "rep", "kind", "lo").agg(
        F.sum("z.u").alias("u"), F.sum("z.p").alias("p"), F.sum("z.n").alias("n")
    )
    p, n = F.col("p"), F.col("n")
    before = (
        Window.partitionBy(*keys, "rep").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    )
    own = F.when(F.col("kind") == "tie", p * n / 2).otherwise(F.col("u"))
    total = (
        pieces.withColumn("_u", own + p * F.coalesce(F.sum("n").over(before), F.lit(0.0)))
        .groupBy(*keys, "rep")
        .agg(F.sum("_u").alias("u"), F.sum(p).alias("p"), F.sum(n).alias("n"))
    )
    kind = {f.name: f.dataType for f in df.schema.fields}
    own = [F.when(F.col(k) != "", F.substring(k, 2, 2**31 - 1)).cast(kind[k]).alias(k) for k in keys]
    return total.select(*own, "rep", "u", "p", "n")


def _names(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def replicate_auc(
    df: DataFrame, keys, score: str, label: str, row_id, n_boot: int = 1000, seed=42
) -> DataFrame:
    """(keys, rep, auc) of every resample; one-class resamples are left out."""
    keys = _names(keys)
    sums = _replicate_sums(df, keys, score, label, hash_int(seed, *_names(row_id)), n_boot)
    auc = F.try_divide(F.col("u"), F.col("p") * F.col("n")).alias("auc")
    return sums.filter(F.col("rep") < n_boot).select(*keys, "rep", auc).filter("auc IS NOT NULL")


def _interval_columns() -> list[Column]:
    enough = F.col("n_valid") >= MIN_VALID
    return [
        F.when(enough, F.col("_q")[0]).alias("ci_lo"),
        F.when(enough, F.col("_q")[1]).alias("ci_hi"),
    ]


def auc_interval(
    df: DataFrame, keys, score: str, label: str, row_id, n_boot: int = 1000, seed=42
) -> DataFrame:
    """(keys, n_valid, ci_lo, ci_hi): 95 % percentile interval, NULL below ten resamples."""
    keys = _names(keys)
    reps = replicate_auc(df, keys, score, label, row_id, n_boot, seed)
    q = F.percentile("auc", F.array(*[F.lit(v) for v in LEVELS]))  # at most n_boot values
    return (
        reps.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_valid"), q.alias("_q"))
        .select(*keys, "n_valid", *_interval_columns())
    )


def auc_with_interval(df: DataFrame, keys, score: str, label: str, hashed: str, n_boot: int = 1000) -> DataFrame:
    """(keys, n_pos, n_neg, auc, n_valid, ci_lo, ci_hi) from one sort of the rows.

    ``hashed`` is the column of row hashes, ``hash_int(seed, row id)``, made before rows are repeated
    for cells.  Without a resample of both classes n_valid and the interval are NULL.
    """
    keys = _names(keys)
    sums = _replicate_sums(df, keys, score, label, F.col(hashed), n_boot)
    each = F.try_divide(F.col("u"), F.col("p") * F.col("n"))
    whole, resample = F.col("rep") == n_boot, F.col("rep") < n_boot
    drawn = F.when(resample, F.col("_auc"))
    return (
        sums.withColumn("_auc", each)
        .groupBy(*keys)
        .agg(
            F.max(F.when(whole, F.col("p"))).cast("bigint").alias("n_pos"),
            F.max(F.when(whole, F.col("n"))).cast("bigint").alias("n_neg"),
            F.max(F.when(whole, F.col("_auc"))).alias("auc"),
            F.nullif(F.count(drawn), F.lit(0)).alias("n_valid"),
            F.percentile(drawn, F.array(*[F.lit(v) for v in LEVELS])).alias("_q"),
        )
        .select(*keys, "n_pos", "n_neg", "auc", "n_valid", *_interval_columns())
    )
