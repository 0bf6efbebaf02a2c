"""The studentized range (Tukey's q) as sums over node rows, in log space.

With w = q s the tail given s = sqrt(chi2_df / df) is that of the range of k normals,

    P(range > w) = k Int phi(z) Phi(z)^(k-1) [1 - (1 - Phi(z - w) / Phi(z))^(k-1)] dz,

and v = ln s has the weight exp(df (v - (e^2v - 1) / 2)). Both integrands are smooth and fall
off fast on both sides, so plain sums over evenly spaced nodes are as good as exact:
the inner one around w / 2, the outer one over all v between the peak of the weight and
that of a far tail. Every (row, v, z) is a row of a generator and the sums are
two aggregations, so the work is code-generated and spreads over tasks like any
other. Sums are relative to their largest term: tails far below 1e-300 keep their
logarithm, and nothing grows with the degrees of freedom.

The quantile looks at a grid of ln q, at a finer one between the two neighbours of the
target, and takes the parabola through the three nearest points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_ROOT_2PI = 0.5 * math.log(2 * math.pi)
# fixed values: coefficients of Hart's rational form of the normal tail, highest power first
TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
FAR = 7.07106781186547  # beyond it a continued fraction

FIRST, STEP, NODES = -8.5, 0.25, 73  # inner nodes, from w / 2
PER_WIDTH, LARGEST, SIDE = 0.5, 0.15, 18  # outer nodes: step in widths 1 / sqrt(2 df), but no larger; nodes on each side
BELOW, COARSE, FINE = 2.2, 26, 40  # grids of ln q: from so far below the start, steps of 0.1, then of 0.1 / FINE


def _poly(cs, x: Column) -> Column:
    out = F.lit(cs[0])
    for k in cs[1:]:
        out = out * x + F.lit(k)
    return out


def tail_ratio(x: Column) -> Column:
    """P(Z > x) e^(x^2 / 2) for x >= 0."""
    fraction = x + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = x + F.lit(k) / fraction
    return F.when(x < FAR, _poly(TOP, x) / _poly(BOTTOM, x)).otherwise(F.lit(1.0) / (fraction * math.sqrt(2 * math.pi)))


def _log_cdf(rows: DataFrame, z: str, name: str) -> DataFrame:
    """``rows`` with ``name`` = ln of the standard normal cdf at ``z``, far into both tails."""
    x = F.col(z)
    rows = rows.withColumn("_abs", F.abs(x)).withColumn("_ratio", tail_ratio(F.col("_abs")))
    out = F.when(x > 0, F.log1p(-F.exp(-x * x / 2.0) * F.col("_ratio"))).otherwise(F.log("_ratio") - x * x / 2.0)
    return rows.withColumn(name, out).drop("_abs", "_ratio")


def log_upper(rows: DataFrame, keys: Sequence[str], q: str, k: str, df: str, name: str = "_lp") -> DataFrame:
    """``keys`` and ``name`` = ln P(Q > q), for k groups and df degrees of freedom (NULL:
    infinitely many); NULL where undefined. Keys name one row each."""
    keys = list(keys)
    base = rows.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in ((q, "_q"), (k, "_k"), (df, "_df"))])
    base = base.withColumn("_q", F.when((F.col("_k") >= 2) & F.col("_q").isNotNull() & ~F.isnan("_q") & F.coalesce(F.col("_df") > 0, F.lit(True)), F.greatest("_q", F.lit(0.0))))
    base = base.withColumn("_df", F.when(F.col("_df") > 0, F.col("_df")))
    kk, dof = F.col("_k"), F.col("_df")
    width = F.lit(1.0) / F.sqrt(2.0 * dof)
    base = base.withColumn("_step", F.when(dof.isNotNull(), F.least(PER_WIDTH * width, F.lit(LARGEST))))
    # to the left the weight falls only like e^(df v), to the right like e^(-e^2v)
    side = lambda x: F.when(dof.isNull(), 0).otherwise(F.greatest(F.ceil(x / F.col("_step")), F.lit(SIDE))).cast("int")
    shift = F.coalesce(F.ceil(0.5 * F.log1p(F.col("_q") * F.col("_q") / (2.0 * dof)) / F.col("_step")), F.lit(0)).cast("int")
    # the weight stands for the norm up to -left, for the tail down to the shifted peak
    base = base.withColumn("_left", side(F.least(40.0 / dof, 20.0 * width + 10.0))).withColumn("_right", side(F.least(9.0 * width, F.lit(2.6)))).withColumn("_more", shift)
    outer = base.withColumn("_j", F.explode(F.sequence(-F.col("_left") - F.col("_more"), F.col("_right"))))
    v = F.coalesce(F.col("_step") * F.col("_j"), F.lit(0.0))
    outer = outer.withColumn("_v", v)
    outer = outer.withColumn("_lw", F.coalesce(dof * (F.col("_v") - F.expm1(2.0 * F.col("_v")) / 2.0), F.lit(0.0))).withColumn("_w", F.col("_q") * F.exp("_v"))
    inner = outer.select(*keys, "_j", "_k", "_lw", "_w", (F.col("_j") >= -F.col("_left")).alias("_norm"), F.explode(F.sequence(F.lit(0), F.lit(NODES - 1))).alias("_i"))
    inner = inner.withColumn("_z", F.col("_w") / 2.0 + FIRST + STEP * F.col("_i"))
    inner = inner.withColumn("_b", F.col("_z") - F.col("_w"))
    inner = _log_cdf(_log_cdf(inner, "_z", "_a"), "_b", "_r").withColumn("_r", F.col("_r") - F.col("_a"))
    near = F.greatest(-F.expm1((kk - 1.0) * F.log1p(-F.least(F.exp("_r"), F.lit(1.0 - 2e-16)))), F.lit(1e-320))
    hit = F.when(F.col("_r") < -30.0, F.log(kk - 1.0) + F.col("_r")).otherwise(F.log(near))  # ln of 1 - (1 - e^r)^(k-1)
    term = F.exp((kk - 1.0) * F.col("_a") + hit - F.col("_z") * F.col("_z") / 2.0 + F.col("_w") * F.col("_w") / 4.0)
    per = inner.withColumn("_t", term).groupBy(*keys, "_j", "_k", "_lw", "_w", "_norm").agg(F.sum("_t").alias("_t"))
    log_range = F.least(F.log(kk * STEP) - LOG_ROOT_2PI - F.col("_w") * F.col("_w") / 4.0 + F.log("_t"), F.lit(0.0))
    per = per.withColumn("_f", F.when(F.col("_w").isNotNull(), F.when(F.col("_w") > 0, log_range).otherwise(0.0) + F.col("_lw")))
    per = per.withColumn("_most", F.max("_f").over(Window.partitionBy(*keys)))
    done = per.groupBy(*keys, "_most").agg(F.sum(F.exp(F.col("_f") - F.col("_most"))).alias("_s"), F.sum(F.when(F.col("_norm"), F.exp("_lw"))).alias("_whole"))
    tail = F.least(F.col("_most") + F.log("_s") - F.log("_whole"), F.lit(0.0))
    return done.select(*keys, F.when(F.col("_most").isNotNull(), tail).alias(name))


def quantile(rows: DataFrame, keys: Sequence[str], p: float, k: str, df: str, name: str = "q_crit") -> DataFrame:
    """``keys`` and ``name`` = q with P(Q < q) = p. Keys name one row each."""
    keys = list(keys)
    target = math.log1p(-p)
    base = rows.select(*keys, F.col(k).cast("double").alias("_kk"), F.col(df).cast("double").alias("_dd"))
    base = base.withColumn("_kk", F.when((F.col("_kk") >= 2) & F.coalesce(F.col("_dd") > 0, F.lit(True)), F.col("_kk")))
    base = base.withColumn("_dd", F.when(F.col("_dd") > 0, F.col("_dd")))
    a = F.log("_kk") - target  # where a power of the tail's far form meets the target: above the quantile
    start = 0.5 * F.log(F.when(F.col("_dd").isNull(), 4.0 * a).otherwise(2.0 * F.col("_dd") * F.expm1(2.0 * a / F.col("_dd"))))
    base = base.withColumn("_u", start - BELOW)

    def look(at: DataFrame, step: float, steps: int) -> DataFrame:
        """``keys`` and the sorted points (u, f) of a grid from ``_u`` on."""
        grid = at.select(*keys, "_kk", "_dd", "_u", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_n"))
        grid = grid.withColumn("_u", F.col("_u") + step * F.col("_n")).withColumn("_qq", F.exp("_u"))
        f = log_upper(grid, [*keys, "_kk", "_dd", "_n", "_u"], "_qq", "_kk", "_dd", "_ff")
        return f.groupBy(*keys, "_kk", "_dd").agg(F.array_sort(F.collect_list(F.struct(F.col("_u").alias("u"), F.col("_ff").alias("f")))).alias("_p"))

    # the last point above the target, kept away from the ends of the grid
    above = lambda steps: F.least(F.greatest(F.size(F.filter("_p", lambda x: x["f"] >= target)), F.lit(1)), F.lit(steps))
    one = look(base, 0.1, COARSE)
    one = one.withColumn("_u", F.get("_p", above(COARSE) - 1)["u"]).drop("_p")
    two = look(one, 0.1 / FINE, FINE).withColumn("_i", above(FINE - 1))
    (ua, fa), (ub, fb), (uc, fc) = ((F.get("_p", F.col("_i") + d)["u"], F.get("_p", F.col("_i") + d)["f"] - target) for d in (-1, 0, 1))
    nz = lambda c: F.nullif(c, F.lit(0.0))
    u = ua * fb * fc / nz((fa - fb) * (fa - fc)) + ub * fa * fc / nz((fb - fa) * (fb - fc)) + uc * fa * fb / nz((fc - fa) * (fc - fb))
    return two.select(*keys, F.exp(u).alias(name))
