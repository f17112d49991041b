"""Scalar statistics written as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun, formula 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal, absolute error below 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-(x * x))


def mann_whitney_p(u: Column, n_pos: Column, n_neg: Column, ties: Column) -> Column:
    """Two-sided asymptotic p with tie and continuity correction."""
    n = (n_pos + n_neg).cast("double")
    pn = n_pos.cast("double") * n_neg.cast("double")
    sd = F.sqrt(pn / 12.0 * ((n + 1.0) - F.try_divide(ties, n * (n - 1.0))))
    z = F.greatest(F.abs(u - pn / 2.0) - 0.5, F.lit(0.0))
    return F.when(sd > 0, F.least(normal_two_sided_p(z / sd), F.lit(1.0)))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series ten above it."""
    z = x + 10.0
    shift = x
    for k in range(1, 10):
        shift = shift * (x + float(k))
    series = 1 / (12.0 * z) - 1 / (360.0 * z**3) + 1 / (1260.0 * z**5) - 1 / (1680.0 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.5 * F.log(2 * F.pi()) + series - F.log(shift)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, from the front (Lentz)."""
    tiny = 1e-300

    def nonzero(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def term(acc: Column, value: Column) -> Column:
        d = 1.0 / nonzero(1.0 + value * acc["d"])
        c = nonzero(1.0 + value / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    def both(acc: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        # each step is bound to a name once, so the expression stays small
        half = F.transform(F.array(acc), lambda s: term(s, even))[0]
        return F.transform(F.array(half), lambda s: term(s, odd))[0]

    d = 1.0 / nonzero(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    steps = F.sequence(F.lit(1), (F.lit(100) + 5 * F.ceil(F.sqrt(a + b))).cast("int"))
    return F.aggregate(steps, start, both, lambda s: s["h"])


def student_two_sided_p(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|) by the incomplete beta function; NULL without degrees of freedom.

    An infinite ``t`` gives 0.
    """
    n = freedom.cast("double")
    a, b = n / 2.0, F.lit(0.5)
    x, rest = n / (n + t * t), t * t / (n + t * t)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(rest))
    low = front * _beta_fraction(a, b, x) / a
    high = 1.0 - front * _beta_fraction(b, a, rest) / b
    p = F.when(t == 0, 1.0).when(F.abs(t) == float("inf"), 0.0)
    p = p.when(x < (a + 1.0) / (a + b + 2.0), low).otherwise(high)
    return F.when((n > 0) & t.isNotNull(), p)


def stars(p: Column) -> Column:
    """Significance mark at .001, .01 and .05, ``ns`` above."""
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
        .when(p.isNotNull(), "ns")
    )


def cohen_d(n_a, n_b, mean_a, mean_b, sd_a, sd_b) -> Column:
    """Absolute difference of means over the pooled sample deviation (ddof 1)."""
    within = (n_a - 1) * sd_a * sd_a + (n_b - 1) * sd_b * sd_b
    return F.abs(mean_a - mean_b) / (F.sqrt(F.try_divide(within, n_a + n_b - 2)) + 1e-10)
