"""Statistics of ordered series held as long tables.

A series table has the columns ``series`` (key), ``seq`` (order) and ``value``; some
operators add ``channel``.  All series are handled in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gsx.operators.ordered import HOT_ROWS, lookup_join, percentiles, with_neighbours

# Level normalisation and series limits.
TARGET_RMS = 0.04
SILENCE_RMS = 1e-9
PEAK_LIMIT = 0.99
TRIM_DB = -25.0
MIN_CONTOUR = 5
MIN_SPREAD = 20
ENTROPY_BINS = 20
PERIOD_FLOOR, PERIOD_CEILING = 1.0 / 300.0, 1.0 / 80.0
MAX_PERIOD_FACTOR, MAX_AMPLITUDE_FACTOR = 1.3, 1.6


def level_table(df: DataFrame, series="series", value="value", target=TARGET_RMS) -> DataFrame:
    """Per-series gain with rms before and after and whether the peak limit applied."""
    v = F.col(value)
    t = df.groupBy(series).agg(
        F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak")
    )
    silent = F.col("rms") < SILENCE_RMS
    clips = ~silent & (F.col("peak") * F.lit(target) / F.col("rms") > 1.0)
    gain = (
        F.when(silent, F.lit(1.0))
        .when(clips, F.lit(PEAK_LIMIT) / F.col("peak"))
        .otherwise(F.lit(target) / F.col("rms"))
    )
    return t.select(
        series,
        F.col("rms").alias("rms_before"),
        gain.alias("gain"),
        (F.col("rms") * gain).alias("rms_after"),
        clips.alias("clipped"),
    )


def level_normalise(df: DataFrame, series="series", value="value") -> DataFrame:
    """Every value times its series' gain."""
    gains = level_table(df, series, value).select(series, "gain")
    return lookup_join(df, gains, series).withColumn(value, F.col(value) * F.col("gain")).drop("gain")


def trim_bounds(
    df: DataFrame, min_len, series="series", seq="seq", value="value", db: float = TRIM_DB
) -> DataFrame:
    """First and last position within ``db`` of the series' peak.

    ``min_len`` is in units of ``seq``.  A series shorter than it is an error row; a
    trim that leaves less is not applied.
    """
    size = F.abs(F.col(value))
    whole = df.groupBy(series).agg(
        F.max(size).alias("peak"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq")
    )
    floor = F.lit(10.0 ** (db / 20.0))
    loud = (
        lookup_join(df, whole.select(series, "peak"), series)
        .filter(size >= F.col("peak") * floor)
        .groupBy(series)
        .agg(F.min(seq).alias("lo"), F.max(seq).alias("hi"))
    )
    long_enough = F.col("hi") - F.col("lo") + 1 >= min_len
    too_short = F.col("last_seq") - F.col("first_seq") + 1 < min_len
    return whole.join(loud, series, "left").select(
        series,
        F.when(long_enough, F.col("lo")).otherwise(F.col("first_seq")).alias("start_seq"),
        F.when(long_enough, F.col("hi")).otherwise(F.col("last_seq")).alias("end_seq"),
        F.when(too_short, "too short").alias("error"),
    )


def trim(df: DataFrame, min_len, series="series", seq="seq", value="value") -> DataFrame:
    """Rows between the trim bounds of their series; rejected series are left out."""
    bounds = trim_bounds(df, min_len, series, seq, value).filter("error IS NULL").drop("error")
    return (
        lookup_join(df, bounds, series)
        .filter(F.col(seq).between(F.col("start_seq"), F.col("end_seq")))
        .drop("start_seq", "end_seq")
    )


def resample(df: DataFrame, source_rate, target_rate, keys=("series",), seq="seq", value="value"):
    """Bucket means at a lower fixed rate; ``seq`` counts samples from 0."""
    bucket = F.floor(F.col(seq) * F.lit(target_rate) / F.lit(source_rate)).cast("bigint")
    return df.groupBy(*keys, bucket.alias("bucket")).agg(F.avg(value).alias("value"))


def centre(df: DataFrame, keys=("series", "channel"), value="value") -> DataFrame:
    """Value minus the mean of its series and channel; the variance is kept (T4)."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return (
        lookup_join(df, means, list(keys)).withColumn("centred", F.col(value) - F.col("_mean"))
        .drop("_mean")
    )


def functionals(
    df: DataFrame, keys=("series", "channel"), value="value", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Population deviation, skewness, excess kurtosis and quartile range (T5).

    A constant series has no skewness or kurtosis (NULL).  Each key's moments combine
    on the map side; the quartiles come from :func:`gsx.operators.ordered.percentiles`.
    """
    keys = list(keys)
    v = F.col(value)
    moments = df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.stddev_pop(v).alias("stddev"),
        F.skewness(v).alias("skewness"),
        F.kurtosis(v).alias("kurtosis"),
    )
    quart = percentiles(df, keys, value, (0.25, 0.75), hot_rows)
    quart = quart.select(*keys, (F.col("q1") - F.col("q0")).alias("iqr"))
    return moments.join(quart, keys, "left")


def spread_channels(stats: DataFrame, channels, names, series="series") -> DataFrame:
    """One wide row per series with ``<channel>_<functional>`` columns."""
    return stats.groupBy(series).agg(
        *[
            F.max(F.when(F.col("channel") == c, F.col(n))).alias(f"{c}_{n}")
            for c in channels
            for n in names
        ]
    )


def contour(df: DataFrame, series="series", value="value", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean, deviation, extremes, range and median of the positive values.

    All NULL with five values or fewer.
    """
    pos = df.filter(F.col(value) > 0)
    v = F.col(value)
    moments = pos.groupBy(series).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    moments = moments.join(percentiles(pos, series, value, (0.5,), hot_rows), series, "left")
    enough = F.col("n") > MIN_CONTOUR

    def guard(c):
        return F.when(enough, c)

    kept = moments.select(
        series,
        "n",
        *[guard(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")],
        guard(F.col("max") - F.col("min")).alias("range"),
        guard(F.col("q0")).alias("median"),
    )
    everyone = df.select(series).distinct()
    return everyone.join(kept, series, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def spread(df: DataFrame, series="series", value="value", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Quartile range and coefficient of variation; NULL below twenty values."""
    v = F.col(value)
    moments = df.groupBy(series).agg(
        F.count(v).alias("n"), F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s")
    )
    moments = moments.join(percentiles(df, series, value, (0.25, 0.75), hot_rows), series, "left")
    enough = F.col("n") >= MIN_SPREAD
    return moments.select(
        series,
        "n",
        F.when(enough, F.col("q1") - F.col("q0")).alias("iqr"),
        F.when(enough, F.col("_s") / (F.col("_m") + 1e-10)).alias("cv"),
    )


def _moving(w, column, reach):
    """Centred mean over ``2 * reach + 1`` rows; NULL near the ends and beside a missing value."""
    framed = w.rowsBetween(-reach, reach)
    full = F.count(column).over(framed) == 2 * reach + 1
    return F.when(full, F.avg(column).over(framed))


def perturbation(
    df: DataFrame,
    series="series",
    order=("seq",),
    period="period",
    amplitude="amplitude",
    floor=PERIOD_FLOOR,
    ceiling=PERIOD_CEILING,
    period_factor=MAX_PERIOD_FACTOR,
    amplitude_factor=MAX_AMPLITUDE_FACTOR,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Cycle-to-cycle irregularity of periods and amplitudes.

    Relative mean deviations from the previous cycle (local) and from centred means
    over 3, 5 and 11 cycles.  A neighbour pair counts only when both periods are within
    limits and their ratio stays below the factor; a mean only when all its periods are.
    A cycle outside the limits stays in its place, so its neighbours never meet.
    """
    p, a = F.col(period), F.col(amplitude)
    valid = p.between(floor, ceiling)
    cycles = df.withColumns({period: F.when(valid, p), amplitude: F.when(valid, a)})

    def around(w):
        return {
            "_pp": F.lag(p).over(w),
            "_pa": F.lag(a).over(w),
            "_p3": _moving(w, p, 1),
            "_p5": _moving(w, p, 2),
            "_a3": _moving(w, a, 1),
            "_a5": _moving(w, a, 2),
            "_a11": _moving(w, a, 5),
        }

    near = with_neighbours(cycles, series, order, 5, around, hot_rows)

    def ratio(x, y):
        return F.try_divide(F.greatest(x, y), F.least(x, y))

    steady = ratio(p, F.col("_pp")) <= period_factor
    loud = steady & (ratio(a, F.col("_pa")) <= amplitude_factor)

    def relative(diff, base):
        return F.try_divide(F.avg(diff), F.avg(base))

    out = near.groupBy(series).agg(
        F.count(period).alias("n_cycles"),
        relative(F.when(steady, F.abs(p - F.col("_pp"))), p).alias("jitter_local"),
        relative(F.when(steady, F.abs(p - F.col("_p3"))), p).alias("jitter_rap"),
        relative(F.when(steady, F.abs(p - F.col("_p5"))), p).alias("jitter_ppq5"),
        relative(F.when(loud, F.abs(a - F.col("_pa"))), a).alias("shimmer_local"),
        relative(F.when(loud, F.abs(a - F.col("_a3"))), a).alias("shimmer_apq3"),
        relative(F.when(loud, F.abs(a - F.col("_a5"))), a).alias("shimmer_apq5"),
        relative(F.when(loud, F.abs(a - F.col("_a11"))), a).alias("shimmer_apq11"),
    )
    return out.withColumns(
        {
            "jitter_ddp": 3 * F.col("jitter_rap"),
            "shimmer_dda": 3 * F.col("shimmer_apq3"),
        }
    )


def noise_ratio(hnr: Column) -> Column:
    """Noise-to-harmonics ratio from its inverse."""
    return 1.0 / (hnr + 1e-6)


def histogram_entropy(
    df: DataFrame, keys, value: str, n_min: int = MIN_SPREAD, bins: int = ENTROPY_BINS, scale=None
) -> DataFrame:
    """Normalised entropy of a density histogram over equal-width bins.

    Densities, not shares, enter the logarithm, so the result may be negative.  A
    constant series is given a range of one around its value.  ``scale``, an aggregate of a
    series, divides its values: it changes the densities, not the bin of a value.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = df.filter(F.col(value).isNotNull())
    limits = rows.groupBy(*keys).agg(
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
        F.count(F.lit(1)).alias("n"),
        (F.lit(1.0) if scale is None else scale).alias("_scale"),
    )
    flat = F.col("_lo") == F.col("_hi")
    limits = limits.select(
        *keys,
        "n",
        F.when(flat, F.lit(1.0)).otherwise(F.col("_scale")).alias("_scale"),
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")).alias("_span"),
    )
    slot = F.least(
        F.floor((F.col(value) - F.col("_lo")) * bins / F.col("_span")), F.lit(bins - 1)
    ).cast("int")
    counts = (
        lookup_join(rows.select(*keys, value), limits, keys)
        .groupBy(*keys, "n", "_span", "_scale", slot.alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    density = F.col("_c") * bins / (F.col("n") * (F.col("_span") / F.col("_scale")))
    return (
        counts.groupBy(*keys, "n")
        .agg((-F.sum(density * F.log2(density + 1e-10)) / F.log2(F.lit(float(bins)))).alias("_e"))
        .select(*keys, "n", F.when(F.col("n") >= n_min, F.col("_e")).alias("entropy"))
    )


def difference_entropy(df, series="series", order=("seq",), value="value", hot_rows=HOT_ROWS):
    """Histogram entropy of successive differences over their mean size (T10 a).

    ``n`` counts the values, one more than the differences.
    """
    steps = with_neighbours(
        df, series, order, 1, lambda w: {"_d": F.col(value) - F.lag(value).over(w)}, hot_rows
    ).filter("_d IS NOT NULL")
    # bins of the differences are bins of the scaled ones, without the rounding of a mean at their edges
    out = histogram_entropy(
        steps.select(series, "_d"), series, "_d", n_min=MIN_SPREAD - 1, scale=F.avg(F.abs("_d")) + 1e-10
    )
    return out.withColumn("n", F.col("n") + 1)


def period_entropy(df, series="series", value="value"):
    """Histogram entropy of the z-scored reciprocals (T10 b)."""
    inverse = df.filter(F.col(value) > 0).select(series, (1.0 / (F.col(value) + 1e-10)).alias("_r"))
    stats = inverse.groupBy(series).agg(F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"))
    z = lookup_join(inverse, stats, series).select(
        series, ((F.col("_r") - F.col("_m")) / (F.col("_s") + 1e-10)).alias("_x")
    )
    return histogram_entropy(z, series, "_x")


def frame_stats(
    df: DataFrame, frame=256, hop=128, series="series", seq="seq", value="value", hot_rows=HOT_ROWS
) -> DataFrame:
    """Log energy and zero-crossing rate over overlapping frames.

    ``seq`` counts from 0.  Only full frames count; they are not padded at the ends.
    A row joins at most ``ceil(frame / hop)`` frames.
    """
    flagged = with_neighbours(
        df,
        series,
        seq,
        1,
        lambda w: {"_cross": ((F.col(value) < 0) != (F.lag(value).over(w) < 0)).cast("int")},
        hot_rows,
    )
    s = F.col(seq)
    first = F.greatest(F.ceil((s - frame + 1) / hop), F.lit(0)).cast("bigint")
    last = F.floor(s / hop).cast("bigint")
    framed = flagged.withColumn("_f", F.explode(F.sequence(first, last)))
    inner = F.col("_f") * hop < s
    per = (
        framed.groupBy(series, "_f")
        .agg(
            F.count(F.lit(1)).alias("_c"),
            F.sqrt(F.avg(F.col(value) * F.col(value))).alias("_rms"),
            (F.sum(F.when(inner, F.coalesce("_cross", F.lit(0))).otherwise(0)) / frame).alias("_zcr"),
        )
        .filter(F.col("_c") == frame)
    )
    energy = F.log(F.col("_rms") + 1e-10)
    return per.groupBy(series).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.avg(energy).alias("log_energy_mean"),
        F.stddev_pop(energy).alias("log_energy_std"),
        F.avg("_zcr").alias("zcr_mean"),
        F.stddev_pop("_zcr").alias("zcr_std"),
    )


def derivatives(
    df: DataFrame, keys=("series",), order=("seq",), value="value", reach=4, hot_rows=HOT_ROWS
) -> DataFrame:
    """Mean first and second local derivative from quadratic fits over nine rows.

    Rows closer than ``reach`` to an end have no fit and do not count.
    """
    ks = list(range(-reach, reach + 1))
    n = len(ks)
    s2 = sum(k * k for k in ks)
    s4 = sum(k**4 for k in ks) - s2 * s2 / n
    slope = [k / s2 for k in ks]
    bend = [2 * (k * k - s2 / n) / s4 for k in ks]

    def fit(w):
        def dot(weights):
            total = F.lit(0.0)
            for k, wt in zip(ks, weights):
                total = total + F.lead(value, k).over(w) * F.lit(wt)
            return total

        return {"_d1": dot(slope), "_d2": dot(bend)}

    return (
        with_neighbours(df, list(keys), list(order), reach, fit, hot_rows)
        .groupBy(*keys)
        .agg(
            F.count("_d1").alias("n_inner"),
            F.avg("_d1").alias("delta_mean"),
            F.avg("_d2").alias("delta2_mean"),
        )
    )


def channel_moments(df: DataFrame, keys=("series", "channel"), value="value") -> DataFrame:
    """Mean and population deviation per series and channel."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def duration_report(df: DataFrame, duration: str, short) -> DataFrame:
    """Extremes and mean of series durations and how many are short."""
    return df.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.min(duration).alias("min_duration"),
        F.avg(duration).alias("mean_duration"),
        F.max(duration).alias("max_duration"),
        F.count_if(F.col(duration) < short).alias("n_short"),
    )
