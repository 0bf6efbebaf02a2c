"""Tail probabilities of test statistics, in log space, as column expressions.

The tails of t, F, chi-square and the normal are one integral. In y = ln x the
density of F(d1, d2) is exp(g(y)) up to a constant, g is concave and largest at
x = 1, and t^2 is F(1, df), chi2 / k is F(k, inf), z^2 is F(1, inf). With

    g(y + u) - g(y) = d1 u / 2 - (d1 + d2) / 2 ln(1 + d1 x (e^u - 1) / (d2 + d1 x))

(for infinite d2: d1 (u - x (e^u - 1)) / 2) the upper tail from x >= 1 and the lower tail from x < 1
are integrals of a falling function over u > 0, and the constant is the sum of
both from x = 1. They are summed over the nodes of a double-exponential rule, whose
scale is the decay length at x. No term grows with the degrees of freedom, so
the same expression holds for 3 rows and for 10^12, and everything is done
with logarithms, so p-values far below 1e-300 keep their ``log10_p``.

The Kolmogorov tail uses the two series that converge fast on either side of
lambda = 1. The studentized range needs a double integral: see ``tukey``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tukey

# nodes u = s exp(t - exp(-t)), t = FIRST + STEP j, j = 0 .. NODES - 1
FIRST, STEP, NODES = -3.5, 0.0625, 137
LN10 = math.log(10.0)

KINDS = ("t", "f", "chi2", "z", "tukey", "ks")


def _sum_over_nodes(value) -> Column:
    """Sum of value(u, weight) over the nodes of scale 1."""

    def add(acc: Column, j: Column) -> Column:
        t = F.lit(FIRST) + F.lit(STEP) * j
        u = F.exp(t - F.exp(-t))
        return acc + value(u) * u * (F.lit(1.0) + F.exp(-t)) * F.lit(STEP)

    return F.aggregate(F.sequence(F.lit(0), F.lit(NODES - 1)), F.lit(0.0), add)


def _tail_columns(df: DataFrame, x: str, d1: str, rho: str, out: str) -> DataFrame:
    """``df`` with ``out`` = ln P(F > x); rho = 1 / d2 (0: infinite). Steps are columns of
    their own, so nothing is expanded twice inside the sums."""
    c = F.col
    total = c(d1) + F.lit(1.0) / F.nullif(c(rho), F.lit(0.0))  # d1 + d2; NULL for infinite d2
    share = lambda at: c(d1) * at * c(rho) / (F.lit(1.0) + c(d1) * at * c(rho))

    def integral(at: Column, sign: float, scale: str) -> Column:
        def height(u: Column) -> Column:
            v = F.lit(sign) * u * c(scale)
            rest = F.when(c(rho) == 0, c(d1) * at * F.expm1(v) / 2.0).otherwise(total / 2.0 * F.log1p(share(at) * F.expm1(v)))
            return F.exp(c(d1) / 2.0 * v - rest)

        return c(scale) * _sum_over_nodes(height)

    def scale_at(at: Column) -> Column:
        slope = F.when(c(rho) == 0, c(d1) / 2.0 * (1.0 - at)).otherwise(c(d1) / 2.0 - total / 2.0 * share(at))
        curve = F.when(c(rho) == 0, c(d1) * at / 2.0).otherwise(total / 2.0 * share(at) * (1.0 - share(at)))
        return F.lit(1.0) / (F.abs(slope) + F.sqrt(curve))

    one = F.lit(1.0)
    gap = c(d1) / 2.0 * F.log(c(x)) - F.when(c(rho) == 0, c(d1) / 2.0 * (c(x) - 1.0)).otherwise(
        total / 2.0 * F.log1p(c(d1) * (c(x) - 1.0) / total)
    )
    df = df.withColumn("_s", scale_at(c(x))).withColumn("_s1", scale_at(one)).withColumn("_gap", gap)
    df = df.withColumn("_norm", integral(one, 1.0, "_s1") + integral(one, -1.0, "_s1"))
    df = df.withColumn("_side", F.when(c(x) >= 1, integral(c(x), 1.0, "_s")).otherwise(integral(c(x), -1.0, "_s")))
    part = c("_gap") + F.log(c("_side")) - F.log(c("_norm"))
    tail = F.when(c(x) >= 1, F.least(part, F.lit(0.0))).when(c(x) > 0, F.log1p(-F.least(F.exp(part), F.lit(1.0)))).when(c(x) <= 0, F.lit(0.0))
    tail = F.when(c(d1).isNotNull() & c(rho).isNotNull(), tail)  # least and greatest pass over NULLs
    return df.withColumn(out, tail).drop("_s", "_s1", "_gap", "_norm", "_side")


def log_ks_upper(d: Column, n: Column) -> Column:
    """ln P(D > d) of the one-sample KS distance: asymptotic Kolmogorov
    distribution with the usual small-sample scaling of the argument."""
    root = F.sqrt(n)
    lam = (root + 0.12 + F.lit(0.11) / root) * d
    far = F.lit(math.log(2.0)) - 2.0 * lam * lam
    more = sum((F.lit((-1.0) ** (j - 1)) * F.exp(-2.0 * (j * j - 1) * lam * lam) for j in range(2, 8)), F.lit(0.0))
    below = sum((F.exp(F.lit(-((2 * j - 1) ** 2) * math.pi**2 / 8) / F.nullif(lam * lam, F.lit(0.0))) for j in range(1, 7)), F.lit(0.0))
    near = F.log1p(-F.least(F.coalesce(F.lit(math.sqrt(2 * math.pi)) / F.nullif(lam, F.lit(0.0)) * below, F.lit(0.0)), F.lit(1.0)))
    return F.when(lam >= 1, far + F.log1p(more)).otherwise(near)


def norm_cdf(z: Column) -> Column:
    """Standard normal cdf: Hart's rational form, a continued fraction far out."""
    x = F.abs(z)
    upper = F.exp(-x * x / 2.0) * tukey.tail_ratio(x)
    return F.when(z > 0, F.lit(1.0) - upper).otherwise(upper)


# --- one entry for the statistics frames -----------------------------------


def _as_double(df: DataFrame, x) -> Column:
    if x is None or isinstance(x, str) and x not in df.columns:
        return F.lit(None).cast("double")
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def with_p_value(stats: DataFrame, kind: str, stat: str = "statistic", df1="df1", df2="df2") -> DataFrame:
    """Add ``p_value`` and ``log10_p``; ``kind`` is a distribution or a column that
    names it (t, f, chi2 or z). Undefined ones are NULL."""
    cols = stats.columns
    s, a, b = _as_double(stats, stat), _as_double(stats, df1), _as_double(stats, df2)
    s = F.when(~F.isnan(s), s)
    if kind == "tukey":
        out = stats.withColumn("_x", s).withColumn("_d1", a).withColumn("_d2", b)
        keys = ["_x", "_d1", "_d2"]  # a tail for each different triple, joined back
        tails = tukey.log_upper(out.select(keys).distinct(), keys, *keys, name="_lp")
        tails = tails.select("_lp", *[F.col(c).alias(f"{c}_t") for c in keys])
        out = out.join(tails, [F.col(c).eqNullSafe(F.col(f"{c}_t")) for c in keys])
    elif kind == "ks":
        out = stats.withColumn("_lp", F.when(a > 0, log_ks_upper(s, a)))
    else:
        k = F.lit(kind) if kind in KINDS else F.col(kind)
        x = F.when(k.isin("t", "z"), s * s).when(k == "f", s).when(k == "chi2", s / F.nullif(a, F.lit(0.0)))
        d1 = F.when(k.isin("t", "z"), F.lit(1.0)).when(a > 0, a)
        rho = F.when(k.isin("z", "chi2"), F.lit(0.0)).when((k == "t") & (a > 0), F.lit(1.0) / F.nullif(a, F.lit(0.0))).when(
            (k == "f") & (b > 0), F.lit(1.0) / F.nullif(b, F.lit(0.0))
        )
        out = stats.withColumn("_x", x).withColumn("_d1", d1).withColumn("_rho", rho)
        out = _tail_columns(out, "_x", "_d1", "_rho", "_lp")
    return out.select(*cols, F.exp("_lp").alias("p_value"), (F.col("_lp") / F.lit(LN10)).alias("log10_p"))
