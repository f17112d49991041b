"""T: statistics of ordered series."""

from pyspark.sql import functions as F

from gsx.operators.series import (
    centre,
    channel_moments,
    contour,
    derivatives,
    difference_entropy,
    duration_report,
    frame_stats,
    functionals,
    level_normalise,
    level_table,
    noise_ratio,
    period_entropy,
    perturbation,
    resample,
    spread,
    spread_channels,
    trim,
    trim_bounds,
)
from gsx.plans.base import (
    CHANNELS,
    EVENT_SQL,
    VEC_SQL,
    event_series,
    r6,
    registry,
    rounded,
    table,
    vector_series,
)

QUERIES, query = registry()

LEVEL_SQL = """
g AS (SELECT series, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak FROM vec GROUP BY 1),
lv AS (SELECT series, rms AS rms_before,
         CASE WHEN rms < 1e-9 THEN 1.0 WHEN peak * 0.04 / rms > 1 THEN 0.99 / peak ELSE 0.04 / rms END AS gain,
         rms >= 1e-9 AND peak * 0.04 / rms > 1 AS clipped FROM g)"""


@query(
    "t1_level_table",
    f"""WITH {VEC_SQL}, {LEVEL_SQL}
SELECT series, round(rms_before, 6) AS rms_before, round(gain, 6) AS gain, round(rms_before * gain, 6) AS rms_after, clipped
FROM lv""",
)
def t1(spark, sf):
    return rounded(level_table(vector_series(spark, sf)), "rms_before", "gain", "rms_after")


@query(
    "t1_level_normalise",
    f"""WITH {VEC_SQL}, {LEVEL_SQL}
SELECT series, seq, round(value * gain, 6) AS value FROM vec JOIN lv USING (series)""",
)
def t1_rows(spark, sf):
    out = level_normalise(vector_series(spark, sf).drop("cls"))
    return rounded(out, "value")


TRIM_SQL = """
pk AS (SELECT series, max(abs(value)) AS peak, min(seq) AS f, max(seq) AS l FROM vec GROUP BY 1),
ld AS (SELECT v.series, min(seq) AS lo, max(seq) AS hi FROM vec v JOIN pk USING (series)
       WHERE abs(value) >= peak * 0.05623413251903491 GROUP BY 1),
tb AS (SELECT series, CASE WHEN hi - lo + 1 >= 62 THEN lo ELSE f END AS start_seq,
              CASE WHEN hi - lo + 1 >= 62 THEN hi ELSE l END AS end_seq,
              CASE WHEN l - f + 1 < 62 THEN 'too short' END AS error
       FROM pk LEFT JOIN ld USING (series))"""


@query("t2_trim_bounds", f"WITH {VEC_SQL}, {TRIM_SQL} SELECT * FROM tb")
def t2(spark, sf):
    return trim_bounds(vector_series(spark, sf), 62)


@query(
    "t2_trim",
    f"""WITH {VEC_SQL}, {TRIM_SQL}
SELECT series, count(*) AS kept FROM vec JOIN tb USING (series)
WHERE error IS NULL AND seq BETWEEN start_seq AND end_seq GROUP BY 1""",
)
def t2_rows(spark, sf):
    kept = trim(vector_series(spark, sf), 62)
    return kept.groupBy("series").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "t3_resample",
    f"""WITH {VEC_SQL}
SELECT series, floor(seq * 8000 / 44100)::BIGINT AS bucket, round(avg(value), 6) AS value FROM vec GROUP BY 1, 2""",
)
def t3(spark, sf):
    return rounded(resample(vector_series(spark, sf), 44100, 8000), "value")


@query(
    "t4_mean_normalise",
    f"""WITH {EVENT_SQL}
SELECT event_id, round(value - avg(value) OVER (PARTITION BY series, channel), 6) AS centred FROM ev""",
)
def t4(spark, sf):
    return centre(event_series(spark, sf)).select("event_id", r6("centred").alias("centred"))


# skewness and kurtosis from centred moments, so the result does not depend on the mean
FUNC_SQL = """
mu AS (SELECT *, value - avg(value) OVER (PARTITION BY series, channel) AS d FROM ev),
fn AS (
  SELECT series, channel, count(*) AS n, stddev_pop(value) AS stddev,
    CASE WHEN max(value) > min(value) THEN avg(d*d*d) / pow(avg(d*d), 1.5) END AS skewness,
    CASE WHEN max(value) > min(value) THEN avg(d*d*d*d) / pow(avg(d*d), 2) - 3 END AS kurtosis,
    quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
  FROM mu GROUP BY 1, 2)"""


@query(
    "t5_functionals",
    f"""WITH {EVENT_SQL}, {FUNC_SQL}
SELECT series, channel, n, round(stddev, 6) AS stddev, round(skewness, 6) AS skewness,
       round(kurtosis, 6) AS kurtosis, round(iqr, 6) AS iqr FROM fn""",
)
def t5(spark, sf):
    out = functionals(event_series(spark, sf))
    return rounded(out, "stddev", "skewness", "kurtosis", "iqr")


NAMES = ("stddev", "skewness", "kurtosis", "iqr")


@query(
    "t5_functionals_wide",
    f"""WITH {EVENT_SQL}, {FUNC_SQL}
SELECT series, """
    + ", ".join(
        f"round(max({n}) FILTER (channel = '{c}'), 6) AS {c}_{n}" for c in CHANNELS for n in NAMES
    )
    + " FROM fn GROUP BY 1",
)
def t5_wide(spark, sf):
    wide = spread_channels(functionals(event_series(spark, sf)), CHANNELS, NAMES)
    return rounded(wide, *[f"{c}_{n}" for c in CHANNELS for n in NAMES])


@query(
    "t6_contour",
    f"""WITH {EVENT_SQL}, s AS (SELECT series, channel, value - 20 AS v FROM ev),
t AS (SELECT series, channel, count(*) FILTER (v > 0) AS n, avg(v) FILTER (v > 0) AS mean,
        stddev_pop(v) FILTER (v > 0) AS std, min(v) FILTER (v > 0) AS min, max(v) FILTER (v > 0) AS max,
        quantile_cont(v, 0.5) FILTER (v > 0) AS median FROM s GROUP BY 1, 2)
SELECT series || '-' || channel AS series, n,
  CASE WHEN n > 5 THEN round(mean, 6) END AS mean, CASE WHEN n > 5 THEN round(std, 6) END AS std,
  CASE WHEN n > 5 THEN round(min, 6) END AS min, CASE WHEN n > 5 THEN round(max, 6) END AS max,
  CASE WHEN n > 5 THEN round(max - min, 6) END AS range, CASE WHEN n > 5 THEN round(median, 6) END AS median
FROM t""",
)
def t6(spark, sf):
    rows = event_series(spark, sf).select(
        F.concat_ws("-", "series", "channel").alias("series"), (F.col("value") - 20).alias("value")
    )
    return rounded(contour(rows), "mean", "std", "min", "max", "range", "median")


@query(
    "t7_spread",
    f"""WITH {EVENT_SQL}, t AS (SELECT series || '-' || channel AS series, count(*) AS n,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
  stddev_pop(value) / (avg(value) + 1e-10) AS cv FROM ev GROUP BY 1)
SELECT series, n, CASE WHEN n >= 20 THEN round(iqr, 6) END AS iqr, CASE WHEN n >= 20 THEN round(cv, 6) END AS cv FROM t""",
)
def t7(spark, sf):
    rows = event_series(spark, sf).select(
        F.concat_ws("-", "series", "channel").alias("series"), "value"
    )
    return rounded(spread(rows), "iqr", "cv")


CYCLE_SQL = f"""{EVENT_SQL},
cy AS (
  SELECT series, event_id, ts, value AS a,
         (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS p
  FROM ev WINDOW w AS (PARTITION BY series ORDER BY ts, event_id)),
c1 AS (SELECT series, event_id, ts, CASE WHEN p BETWEEN 60.0 AND 90000.0 THEN p END AS p,
              CASE WHEN p BETWEEN 60.0 AND 90000.0 THEN a END AS a FROM cy)"""


def _mov(col, k):
    return (
        f"CASE WHEN count({col}) OVER (PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
        f" = {2 * k + 1} THEN avg({col}) OVER (PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) END"
    )


PERT_SQL = f"""
nb AS (SELECT *, lag(p) OVER w AS pp, lag(a) OVER w AS pa, {_mov('p', 1)} AS p3, {_mov('p', 2)} AS p5,
         {_mov('a', 1)} AS a3, {_mov('a', 2)} AS a5, {_mov('a', 5)} AS a11
       FROM c1 WINDOW w AS (PARTITION BY series ORDER BY ts, event_id)),
fl AS (SELECT *, greatest(p, pp) / least(p, pp) <= 1.3 AND pp IS NOT NULL AS st FROM nb),
gl AS (SELECT *, st AND greatest(a, pa) / least(a, pa) <= 1.6 AS ld FROM fl),
pt AS (
  SELECT series, count(p) AS n_cycles,
    avg(abs(p - pp)) FILTER (st) / avg(p) AS jitter_local, avg(abs(p - p3)) FILTER (st) / avg(p) AS jitter_rap,
    avg(abs(p - p5)) FILTER (st) / avg(p) AS jitter_ppq5, avg(abs(a - pa)) FILTER (ld) / avg(a) AS shimmer_local,
    avg(abs(a - a3)) FILTER (ld) / avg(a) AS shimmer_apq3, avg(abs(a - a5)) FILTER (ld) / avg(a) AS shimmer_apq5,
    avg(abs(a - a11)) FILTER (ld) / avg(a) AS shimmer_apq11
  FROM gl GROUP BY 1)"""

PERT = (
    "jitter_local", "jitter_rap", "jitter_ppq5", "shimmer_local", "shimmer_apq3", "shimmer_apq5",
    "shimmer_apq11",
)


def cycles(spark, sf):
    """Seconds to the user's next event as periods, event values as amplitudes."""
    from gsx.operators.ordered import with_neighbours

    rows = event_series(spark, sf)
    step = with_neighbours(
        rows, "series", ["ts", "event_id"], 1, lambda w: {"next_ts": F.lead("ts").over(w)}
    )

    def micros(c):
        return F.unix_micros(F.col(c).cast("timestamp"))

    return step.select(
        "series",
        "ts",
        "event_id",
        F.col("value").alias("amplitude"),
        ((micros("next_ts") - micros("ts")) / 1e6).alias("period"),
    )


@query(
    "t8_perturbation",
    f"WITH {CYCLE_SQL}, {PERT_SQL} SELECT series, n_cycles, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in PERT)
    + " FROM pt",
)
def t8(spark, sf):
    out = perturbation(
        cycles(spark, sf), order=["ts", "event_id"], floor=60.0, ceiling=90000.0
    )
    return rounded(out.drop("jitter_ddp", "shimmer_dda"), *PERT)


@query(
    "t9_derived_identities",
    f"""WITH {CYCLE_SQL}, {PERT_SQL}
SELECT series, round(3 * jitter_rap, 6) AS jitter_ddp, round(3 * shimmer_apq3, 6) AS shimmer_dda,
       round(1 / (n_cycles + 1e-6), 6) AS nhr FROM pt""",
)
def t9(spark, sf):
    out = perturbation(
        cycles(spark, sf), order=["ts", "event_id"], floor=60.0, ceiling=90000.0
    )
    nhr = noise_ratio(F.col("n_cycles").cast("double")).alias("nhr")
    return rounded(out.select("series", "jitter_ddp", "shimmer_dda", nhr), "jitter_ddp", "shimmer_dda", "nhr")


def _entropy_sql(src, n_min, extra, scales=None):
    """``scales`` has what the values of a series are divided by after their bins are known."""
    scaled, join = ("span / scale", f" JOIN {scales} USING (series)") if scales else ("span", "")
    return f"""
lim AS (SELECT series, count(*) AS n, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
          CASE WHEN min(x) = max(x) THEN 1.0 ELSE max(x) - min(x) END AS span FROM {src} GROUP BY 1),
bn AS (SELECT series, n, {scaled} AS span, least(floor((x - lo) * 20 / span), 19) AS b, count(*) AS c
       FROM {src} JOIN lim USING (series){join} GROUP BY 1, 2, 3, 4)
SELECT series, (n + {extra})::BIGINT AS n,
  CASE WHEN n >= {n_min} THEN round(-sum(c * 20 / (n * span) * log2(c * 20 / (n * span) + 1e-10)) / log2(20.0), 6) END AS entropy
FROM bn GROUP BY series, n"""


@query(
    "t10_difference_entropy",
    f"""WITH {EVENT_SQL},
df AS (SELECT series, value - lag(value) OVER (PARTITION BY series ORDER BY ts, event_id) AS d FROM ev),
xs AS (SELECT series, d AS x FROM df WHERE d IS NOT NULL),
sc AS (SELECT series, CASE WHEN min(x) = max(x) THEN 1.0 ELSE avg(abs(x)) + 1e-10 END AS scale FROM xs GROUP BY 1),
{_entropy_sql('xs', 19, 1, 'sc')}""",
)
def t10a(spark, sf):
    out = difference_entropy(event_series(spark, sf), order=["ts", "event_id"])
    return rounded(out, "entropy")


@query(
    "t10_period_entropy",
    f"""WITH {EVENT_SQL},
iv AS (SELECT series, 1 / (value + 1e-10) AS r FROM ev WHERE value > 0),
xs AS (SELECT series, (r - avg(r) OVER (PARTITION BY series)) / (stddev_pop(r) OVER (PARTITION BY series) + 1e-10) AS x FROM iv),
{_entropy_sql('xs', 20, 0)}""",
)
def t10b(spark, sf):
    return rounded(period_entropy(event_series(spark, sf)), "entropy")


@query(
    "t11_frame_stats",
    f"""WITH {VEC_SQL},
cr AS (SELECT *, (value < 0) <> (lag(value) OVER (PARTITION BY series ORDER BY seq) < 0) AS c FROM vec),
fr AS (SELECT series, f, count(*) AS n, sqrt(avg(value * value)) AS rms,
         count(*) FILTER (c AND seq > f * 8) / 16.0 AS zcr
       FROM cr, range(0, 8) t(f) WHERE seq >= f * 8 AND seq < f * 8 + 16 GROUP BY 1, 2 HAVING count(*) = 16)
SELECT series, count(*) AS n_frames, round(avg(ln(rms + 1e-10)), 6) AS log_energy_mean,
  round(stddev_pop(ln(rms + 1e-10)), 6) AS log_energy_std, round(avg(zcr), 6) AS zcr_mean,
  round(stddev_pop(zcr), 6) AS zcr_std FROM fr GROUP BY 1""",
)
def t11(spark, sf):
    out = frame_stats(vector_series(spark, sf), frame=16, hop=8)
    return rounded(out, "log_energy_mean", "log_energy_std", "zcr_mean", "zcr_std")


def _dot(weights):
    return " + ".join(
        f"lead(value, {k}) OVER w * ({w})" if k >= 0 else f"lag(value, {-k}) OVER w * ({w})"
        for k, w in weights
    )


@query(
    "t12_derivatives",
    f"""WITH {VEC_SQL},
d AS (SELECT series, {_dot([(k, f'{k}/60.0') for k in range(-4, 5)])} AS d1,
             {_dot([(k, f'2*({k}*{k}-60.0/9)/308.0') for k in range(-4, 5)])} AS d2
      FROM vec WINDOW w AS (PARTITION BY series ORDER BY seq))
SELECT series, count(d1) AS n_inner, round(avg(d1), 6) AS delta_mean, round(avg(d2), 6) AS delta2_mean
FROM d GROUP BY 1""",
)
def t12(spark, sf):
    return rounded(derivatives(vector_series(spark, sf)), "delta_mean", "delta2_mean")


@query(
    "t13_channel_moments",
    f"""WITH {EVENT_SQL}
SELECT series, channel, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM ev GROUP BY 1, 2""",
)
def t13(spark, sf):
    return rounded(channel_moments(event_series(spark, sf)), "mean", "std")


@query(
    "t13_channel_moments_wide",
    f"""WITH {EVENT_SQL},
m AS (SELECT series, channel, avg(value) AS mean, stddev_pop(value) AS std FROM ev GROUP BY 1, 2)
SELECT series, """
    + ", ".join(
        f"round(max({n}) FILTER (channel = '{c}'), 6) AS {c}_{n}"
        for c in CHANNELS
        for n in ("mean", "std")
    )
    + " FROM m GROUP BY 1",
)
def t13_wide(spark, sf):
    wide = spread_channels(channel_moments(event_series(spark, sf)), CHANNELS, ("mean", "std"))
    return rounded(wide, *[f"{c}_{n}" for c in CHANNELS for n in ("mean", "std")])


@query(
    "t14_series_durations",
    """
SELECT count(*) AS n_series, min(d) AS min_duration, round(avg(d), 6) AS mean_duration, max(d) AS max_duration,
       count(*) FILTER (d < 60) AS n_short
FROM (SELECT user_id, count(*) AS d FROM events GROUP BY 1)""",
)
def t14(spark, sf):
    sizes = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("d"))
    return rounded(duration_report(sizes, "d", 60), "mean_duration")


@query(
    "t15_failure_policy",
    f"""WITH {EVENT_SQL}
SELECT series, channel, round(avg(value) / nullif(stddev_pop(value), 0), 6) AS ratio,
  CASE WHEN count(*) > 10 THEN round(avg(value), 6) END AS mean_long FROM ev GROUP BY 1, 2""",
)
def t15(spark, sf):
    """A failing family is NULL for the series; the series stays."""
    rows = event_series(spark, sf).groupBy("series", "channel")
    return rows.agg(
        r6(F.try_divide(F.avg("value"), F.stddev_pop("value"))).alias("ratio"),
        F.when(F.count(F.lit(1)) > 10, r6(F.avg("value"))).alias("mean_long"),
    )
