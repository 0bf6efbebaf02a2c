"""Comparative statistics reported in the papers (E1-E18) as aggregations.

Each function returns a small frame (one row per group, pair or test);
p-values, where they exist, are added with ``functions.tails``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import norm_cdf
from .ordinal import in_order, materialize
from .ranks import average_ranks, pair_ranks, value_counts
from .stats import _null, _num, _nz, lag_pairs, ttest_1samp


# E1
def intrinsic_fraction(
    df: DataFrame, y: str, by: str, domain: str, categories: dict[str, str],
    neutral: str = "neutral", semantic: str = "semantic",
) -> DataFrame:
    """Mean over neutral domains / mean over semantic domains, per ``by``."""
    cmap = F.create_map(*[x for kv in categories.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    cat = F.element_at(cmap, F.col(domain))
    g = df.groupBy(by).agg(
        F.avg(F.when(cat == neutral, _num(y))).alias("neutral_mean"),
        F.avg(F.when(cat == semantic, _num(y))).alias("semantic_mean"),
    )
    return g.withColumn("intrinsic_fraction", F.col("neutral_mean") / _nz(F.col("semantic_mean")))


# E2
def profile_similarity(df: DataFrame, y: str, unit: str, item: str, digits: int = 9, baseline=None) -> DataFrame:
    """Spearman correlation of item-level means between every pair of units, or with
    ``baseline`` between that unit and every other (linear in the units).

    Profiles are joined on the item, and the means are rounded before ranking
    so that equal means tie in any engine.
    """
    prof = materialize(df.groupBy(unit, item).agg(F.round(F.avg(_num(y)), digits).alias("m")).where(F.col("m").isNotNull()))
    a = prof.select(F.col(unit).alias("u1"), F.col(item).alias("item"), F.col("m").alias("x"))
    b = prof.select(F.col(unit).alias("u2"), F.col(item).alias("item"), F.col("m").alias("y"))
    if baseline is None:
        pairs = a.join(b, "item").where(F.col("u1") < F.col("u2"))
    else:
        pairs = a.where(F.col("u1") == F.lit(baseline)).join(b.where(F.col("u2") != F.lit(baseline)), "item")
    r = pair_ranks(materialize(pairs), "x", "y", ["u1", "u2"])
    m = r.groupBy("u1", "u2").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_items"),
        F.regr_sxy("ry", "rx").alias("sxy"),
        F.regr_sxx("ry", "rx").alias("sxx"),
        F.regr_syy("ry", "rx").alias("syy"),
    )
    rho = F.col("sxy") / _nz(F.sqrt(F.col("sxx") * F.col("syy")))
    return m.select(F.col("u1").alias("unit1"), F.col("u2").alias("unit2"), "n_items", rho.alias("rho"))


# E3
def cohens_d(df: DataFrame, y: str, by: str, baseline: str) -> DataFrame:
    """(mean_g - mean_baseline) / pooled sd, pooled with n - 1 weights."""
    g = (
        df.select(F.col(by).alias("group"), _num(y).alias("y"))
        .where(F.col("group").isNotNull() & F.col("y").isNotNull())
        .groupBy("group")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.var_samp("y").alias("var"))
    )
    one = F.lit(1).alias("_one")  # the baseline's row beside every group (a join with one row)
    base = g.where(F.col("group") == baseline).select(one, F.col("n").alias("bn"), F.col("mean").alias("bm"), F.col("var").alias("bv"))
    j = g.select("*", one).join(F.broadcast(base), "_one", "left")
    pooled = F.sqrt(((F.col("n") - 1) * F.col("var") + (F.col("bn") - 1) * F.col("bv")) / _nz(F.col("n") + F.col("bn") - 2))
    return j.select(
        "group",
        F.col("n").cast("bigint").alias("n"),
        "mean",
        ((F.col("mean") - F.col("bm")) / _nz(pooled)).alias("d"),
    )


# E4
MAX_GROUPS = 100


def mann_whitney(df: DataFrame, y: str, by: str, baseline=None, pairs: Sequence[tuple] | None = None) -> DataFrame:
    """U, and z with tie correction and continuity correction, for every pair of
    groups, for the given ``pairs``, or for ``baseline`` against every other group.

    Values are counted once per (value, group), as one row per value with a
    column per group. In order of the value, running counts (per range of
    values, whose number follows that of the values, and inside the ranges) give how many values of each group are
    smaller, and every U is a sum over the values:
    U(a, b) = sum c_a (less_b + c_b / 2). No row is copied per pair.
    """
    clean = df.select(F.col(by).alias("g"), _num(y).alias("v")).where(
        F.col("g").isNotNull() & F.col("v").isNotNull()
    )
    gv = materialize(value_counts(clean, "v", by=["g"]))  # one scan of the input
    if pairs is None:
        labels = sorted(r.g for r in gv.select("g").distinct().limit(MAX_GROUPS + 1).collect())
        if len(labels) > MAX_GROUPS:
            raise ValueError(f"more than {MAX_GROUPS} groups: name the pairs to compare")
        if baseline is not None:
            pairs = [(baseline, g) for g in labels if g != baseline] if baseline in labels else []
        else:
            pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i + 1 :]]
    names = sorted({g for p in pairs for g in p})
    at = {g: i for i, g in enumerate(names)}
    kind = dict(clean.dtypes)["g"]
    if not pairs:
        return df.sparkSession.createDataFrame([], f"group1 {kind}, group2 {kind}, n1 bigint, n2 bigint, u double, z double")
    count = [F.sum(F.when(F.col("g") == F.lit(g), F.col("cnt")).otherwise(0)).alias(f"c{i}") for g, i in at.items()]
    wide = gv.where(F.col("g").isin(*names)).groupBy((F.col("v").cast("double") + F.lit(0.0)).alias("v")).agg(*count)
    ranged = in_order(wide, ["v"])
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = ranged.groupBy(F.col("_range").alias("_r")).agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in at.values()])
    offsets = totals.select("_r", *[F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).alias(f"o{i}") for i in at.values()])
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    less = ranged.select("*", *[F.coalesce(F.sum(f"c{i}").over(inside), F.lit(0)).alias(f"l{i}") for i in at.values()])
    j = less.join(offsets, F.col("_range") == F.col("_r"))
    aggs = [F.sum(f"c{i}").cast("double").alias(f"n{i}") for i in at.values()]
    for k, (a, b) in enumerate(pairs):
        ca, cb = F.col(f"c{at[a]}").cast("double"), F.col(f"c{at[b]}").cast("double")
        aggs.append(F.sum(ca * (F.col(f"o{at[b]}") + F.col(f"l{at[b]}") + cb / 2.0)).alias(f"u{k}"))
        aggs.append(F.sum((ca + cb) ** 3 - (ca + cb)).alias(f"ties{k}"))
    rows = [
        F.struct(
            F.lit(a).cast(kind).alias("group1"), F.lit(b).cast(kind).alias("group2"),
            F.col(f"n{at[a]}").alias("n1"), F.col(f"n{at[b]}").alias("n2"), F.col(f"u{k}").alias("u"), F.col(f"ties{k}").alias("ties"),
        )
        for k, (a, b) in enumerate(pairs)
    ]
    s = j.agg(*aggs).select(F.inline(F.array(*rows)))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    mu = n1 * n2 / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / _nz(n * (n - 1))))
    z = (F.abs(F.col("u") - mu) - 0.5) / _nz(sigma)
    return s.select(
        "group1",
        "group2",
        n1.cast("bigint").alias("n1"),
        n2.cast("bigint").alias("n2"),
        "u",
        F.when(sigma > 0, F.greatest(z, F.lit(0.0))).alias("z"),
    )


# E5
def residualize(df: DataFrame, y: str, x: str, name: str = "residual") -> DataFrame:
    """OLS residuals of y on x. The two coefficients are one aggregated row,
    read once on the driver and inlined as literals. ``df`` is read for them and for
    the residuals: it is evaluated once, into a table."""
    df = materialize(df, "to-residualize")
    coef = df.select(_num(y).alias("y"), _num(x).alias("x")).agg(
        F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a")
    ).first()
    b = 0.0 if coef["b"] is None else float(coef["b"])
    a = 0.0 if coef["a"] is None else float(coef["a"])
    return df.withColumn(name, _num(y) - (F.lit(a) + F.lit(b) * _num(x)))


# E6
def paired_ttest(df: DataFrame, y: str, unit: Sequence[str], cat: str, a, b, test_id: str = "E6") -> DataFrame:
    """t-test of the within-unit difference y(a) - y(b) (conditional aggregation, no self-join)."""
    d = df.groupBy(*unit).agg(
        F.avg(F.when(F.col(cat) == F.lit(a), _num(y))).alias("ya"),
        F.avg(F.when(F.col(cat) == F.lit(b), _num(y))).alias("yb"),
    ).select((F.col("ya") - F.col("yb")).alias("diff"))
    return ttest_1samp(d.where(F.col("diff").isNotNull()), "diff", 0.0, test_id=test_id)


# E8
def durbin_watson(df: DataFrame, y: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sum of squared successive differences / sum of squared residuals from
    the group means (within groups)."""
    pairs = lag_pairs(df, y, list(by), list(order)).where(F.col("prev").isNotNull() & F.col("cur").isNotNull())
    num = pairs.agg(
        F.sum((F.col("cur") - F.col("prev")) ** 2).alias("ssd"), F.count(F.lit(1)).alias("n_pairs")
    )
    den = (
        df.select(*by, _num(y).alias("y"))
        .where(F.col("y").isNotNull())
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("vp"))
        .agg(F.sum(F.col("vp") * F.col("n")).alias("ssr"), F.sum("n").alias("n"))
    )
    both = num.select("ssd", "n_pairs", _null().alias("ssr"), F.lit(None).cast("bigint").alias("n")).unionByName(
        den.select(_null().alias("ssd"), F.lit(None).cast("bigint").alias("n_pairs"), "ssr", F.col("n").cast("bigint"))
    )
    s = both.agg(F.max("ssd").alias("ssd"), F.max("n_pairs").alias("n_pairs"), F.max("ssr").alias("ssr"), F.max("n").alias("n"))
    return s.select(
        (F.col("ssd") / _nz(F.col("ssr"))).alias("dw"), F.col("n_pairs").cast("bigint"), F.col("n").cast("bigint")
    )


# E9
def temp_response(df: DataFrame, y: str = "ned_mean", temp: str = "temp") -> DataFrame:
    """Mean at the lowest and highest temperature, percent change, Pearson r."""
    per = df.groupBy(temp).agg(F.avg(_num(y)).alias("m")).where(F.col(temp).isNotNull())
    ends = per.agg(
        F.min(temp).alias("lo_temp"),
        F.max(temp).alias("hi_temp"),
        F.min_by("m", F.col(temp)).alias("mean_lo"),
        F.max_by("m", F.col(temp)).alias("mean_hi"),
    )
    mom = df.select(_num(y).alias("y"), _num(temp).alias("x")).agg(
        F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy")
    )
    r = mom.select((F.col("sxy") / _nz(F.sqrt(F.col("sxx") * F.col("syy")))).alias("r"))
    cols = ["lo_temp", "hi_temp", "mean_lo", "mean_hi", "r"]
    both = ends.unionByName(r, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in cols])
    return both.select(
        *cols[:4],
        ((F.col("mean_hi") - F.col("mean_lo")) / _nz(F.col("mean_lo")) * 100.0).alias("pct_change"),
        "r",
    )


# E10
def spread_comparison(df: DataFrame, by: str = "model", spread: str = "ned_std") -> DataFrame:
    """Mean within-sequence spread per family."""
    return df.groupBy(by).agg(F.avg(_num(spread)).alias("mean_spread"), F.count(F.lit(1)).cast("bigint").alias("n"))


# E11 / E12
def ks_normal(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """One-sample KS distance of x against Normal(mean, population sd), per group.

    The empirical cdf comes from the distributed rank helper on value counts;
    D = max over values of max(F_le - Phi, Phi - F_lt).
    """
    by = list(by)
    if not by:  # one group: a constant key keeps every step a keyed aggregation
        return ks_normal(df.withColumn("_all", F.lit(0)), x, ["_all"]).drop("_all")
    clean = df.select(*by, _num(x).alias("v")).where(F.col("v").isNotNull())
    mom = clean.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd")
    )
    vc = value_counts(clean, "v", by=by)
    ranked = average_ranks(vc, "v", by=by)
    lt = F.col("rank") - (F.col("cnt") + 1) / 2.0
    j = ranked.join(mom, by)
    phi = norm_cdf((F.col("v") - F.col("mu")) / _nz(F.col("sd")))
    dev = F.greatest((lt + F.col("cnt")) / F.col("n") - phi, phi - lt / F.col("n"))
    return j.groupBy(*by).agg(F.max(dev).alias("d"), F.max("n").cast("bigint").alias("n"))


def ks_vs_metric(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """Pearson r of the per-group KS distance with the per-group mean."""
    d = ks_normal(df, x, by)
    m = df.groupBy(*by).agg(F.avg(_num(x)).alias("mean"))
    j = d.join(m, list(by))
    mom = j.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_groups"),
        F.regr_sxy("mean", "d").alias("sxy"),
        F.regr_sxx("mean", "d").alias("sxx"),
        F.regr_syy("mean", "d").alias("syy"),
    )
    return mom.select("n_groups", (F.col("sxy") / _nz(F.sqrt(F.col("sxx") * F.col("syy")))).alias("r"))


# E13 / E14
def consensus(reports: DataFrame, alpha: float = 0.01, model: str = "model") -> DataFrame:
    """Per model: tests with p < alpha; weak at 4+, moderate at 6+, strong at all 8."""
    s = reports.groupBy(model).agg(
        F.sum(F.when(F.col("p_value") < alpha, 1).otherwise(0)).cast("bigint").alias("n_significant"),
        F.count(F.lit(1)).cast("bigint").alias("n_tests"),
    )
    verdict = (
        F.when(F.col("n_significant") >= 8, "strong")
        .when(F.col("n_significant") >= 6, "moderate")
        .when(F.col("n_significant") >= 4, "weak")
        .otherwise("none")
    )
    return s.withColumn("verdict", verdict)


def consensus_matrix(reports: DataFrame, models: Sequence[str], alpha: float = 0.01, model: str = "model") -> DataFrame:
    """test_id x model matrix of significance flags (pivot on known models)."""
    return (
        reports.groupBy("test_id")
        .pivot(model, list(models))
        .agg(F.max(F.col("p_value") < alpha))
    )


def effect_gate(report: DataFrame, alpha: float = 0.01, min_r: float = 0.1) -> DataFrame:
    """Reject on size as well as p: |r| > min_r for correlations (F4, F6),
    a positive slope for the regressions (F3, F8)."""
    sig = F.col("p_value") < alpha
    eff = (
        F.when(F.col("test_id").isin("F4", "F6"), F.abs(F.col("estimate")) > min_r)
        .when(F.col("test_id").isin("F3", "F8"), F.col("estimate") > 0)
        .otherwise(F.lit(True))
    )
    return report.select(
        *[c for c in report.columns],
        F.coalesce(sig, F.lit(False)).alias("significant"),
        F.coalesce(eff, F.lit(False)).alias("effect_ok"),
        F.coalesce(sig & eff, F.lit(False)).alias("rejected"),
    )


# E15
def pair_bias(df: DataFrame, unit: str, item: str, a: str, b: str, z: float = 2.576) -> DataFrame:
    """Share of ``a`` among a/b per unit, flagged outside the 99 % band around 0.5."""
    s = df.groupBy(unit).agg(
        F.sum(F.when(F.col(item) == a, 1).otherwise(0)).alias("n_a"),
        F.sum(F.when(F.col(item) == b, 1).otherwise(0)).alias("n_b"),
    ).where((F.col("n_a") + F.col("n_b")) > 0)
    n = (F.col("n_a") + F.col("n_b")).cast("double")
    share = F.col("n_a") / n
    bound = F.lit(z) * F.sqrt(F.lit(0.25) / n)
    return s.select(
        unit,
        n.cast("bigint").alias("n"),
        share.alias("share"),
        (F.abs(share - 0.5) > bound).alias("biased"),
    )


# E16
def entropy_slope(positions: DataFrame, keys: Sequence[str], pos: str = "pos", value: str = "ned") -> DataFrame:
    """Trend of the metric over positions per generation (slope, R^2)."""
    return positions.groupBy(*keys).agg(
        F.regr_slope(_num(value), F.col(pos).cast("double")).alias("slope"),
        F.regr_r2(_num(value), F.col(pos).cast("double")).alias("r2"),
        F.count(F.lit(1)).cast("bigint").alias("n"),
    )


# E17
def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """MI (nats) of two categorical columns and G = 2 N MI with (r-1)(c-1) df.

    MI = (sum n_ab ln n_ab - sum n_a ln n_a - sum n_b ln n_b) / N + ln N, so
    the joint table and both margins are independent aggregates, combined
    by one aggregation over their union (no join).
    """
    clean = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    # the contingency table (r x c rows) feeds three aggregations: one scan
    joint = materialize(clean.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")))
    ma = joint.groupBy(a).agg(F.sum("n").alias("n"))
    mb = joint.groupBy(b).agg(F.sum("n").alias("n"))
    nlogn = lambda: F.col("n") * F.log(F.col("n").cast("double"))
    parts = (
        joint.select(nlogn().alias("sab"), F.lit(0.0).alias("sa"), F.lit(0.0).alias("sb"), F.col("n").alias("nn"),
                     F.lit(0).alias("ka"), F.lit(0).alias("kb"))
        .unionByName(ma.select(F.lit(0.0).alias("sab"), nlogn().alias("sa"), F.lit(0.0).alias("sb"),
                               F.lit(0).cast("bigint").alias("nn"), F.lit(1).alias("ka"), F.lit(0).alias("kb")))
        .unionByName(mb.select(F.lit(0.0).alias("sab"), F.lit(0.0).alias("sa"), nlogn().alias("sb"),
                               F.lit(0).cast("bigint").alias("nn"), F.lit(0).alias("ka"), F.lit(1).alias("kb")))
    )
    s = parts.agg(
        F.sum("sab").alias("sab"), F.sum("sa").alias("sa"), F.sum("sb").alias("sb"),
        F.sum("nn").alias("N"), F.sum("ka").alias("r"), F.sum("kb").alias("c"),
    )
    n = F.col("N").cast("double")
    mi = (F.col("sab") - F.col("sa") - F.col("sb")) / _nz(n) + F.log(n)
    return s.select(
        mi.alias("mi"),
        (2.0 * n * mi).alias("g"),
        ((F.col("r") - 1) * (F.col("c") - 1)).cast("double").alias("df1"),
        F.col("N").cast("bigint").alias("n"),
    )


# E18
OVERSAMPLE = 24
MAX_PASSES = 60
_CHUNK = 1 << 16  # values of a partial sum in one row


def _rows_of(batch, width: int) -> np.ndarray:
    """The vectors of a batch as a matrix of doubles; rows without a full finite vector are left out."""
    column = batch.column("_v")
    full = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    x = column.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    return x[np.isfinite(x).all(axis=1)]


def _summed(vectors: DataFrame, width: int, part) -> np.ndarray:
    """Sum over all partitions of the flat arrays that ``part(matrix)`` gives. A task adds up its
    batches first and returns its sum in chunks, which are added per chunk."""

    def run(batches):
        total = None
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                x = _rows_of(batch.slice(i, 1024), width)
                if len(x):
                    total = part(x) if total is None else total + part(x)
        if total is not None:
            for c in range(0, len(total), _CHUNK):
                yield pa.record_batch([pa.array([c // _CHUNK], pa.int32()), pa.array([total[c : c + _CHUNK].tobytes()])], names=["c", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # one chunk's partial sums
        total = None
        for batch in batches:
            for c, s in zip(batch.column("c").to_pylist(), batch.column("s")):
                x = np.frombuffer(s.as_buffer())
                total = (c, x) if total is None else (c, total[1] + x)
        yield pa.record_batch([pa.array([total[0]], pa.int32()), pa.array([total[1].tobytes()])], names=["c", "s"])

    sums = vectors.mapInArrow(run, "c int, s binary").groupBy("c").applyInArrow(add, "c int, s binary").collect()
    return np.concatenate([np.frombuffer(r.s) for r in sorted(sums, key=lambda r: r.c)]) if sums else np.zeros(0)


def principal_axes(df: DataFrame, vec: str, k: int = 3, seed: int = 42, tol: float = 1e-6, max_passes: int = MAX_PASSES) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The first k principal axes (width x k, each with its largest loading positive), the
    variances along them, the total variance and the number of vectors.

    Subspace iteration from a random start of k + OVERSAMPLE columns W: a pass over
    the vectors returns the sums of (x - m) (x - m)' W, a width x columns matrix, from which
    the next W comes by a tall-skinny QR; the axes are the Ritz vectors of the last one.
    There is no width x width matrix anywhere, so a vocabulary of 256K entries is
    well within reach: memory is width x (k + OVERSAMPLE) doubles. Passes stop when the
    variances and axes of two passes agree within ``tol``.
    """
    vectors = materialize(df.select(F.col(vec).cast("array<double>").alias("_v")).where(F.col("_v").isNotNull()))
    width = vectors.agg(F.max(F.size("_v")).alias("w")).first().w or 0
    if not width:
        return np.zeros((0, k)), np.zeros(k), 0.0, 0
    first = _summed(vectors, width, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]))
    if not len(first):
        return np.zeros((width, k)), np.zeros(k), 0.0, 0
    n, mean = int(first[0]), first[1:] / first[0]
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(width, k + OVERSAMPLE))))[0]
    before = None
    for _ in range(max_passes):
        def part(x, w=w):
            c = x - mean
            return np.concatenate([[(c * c).sum()], (c.T @ (c @ w)).ravel()])

        got = _summed(vectors, width, part)
        total, z = got[0], got[1:].reshape(w.shape)
        values, turn = np.linalg.eigh((w.T @ z + z.T @ w) / 2)
        axes = (w @ turn[:, ::-1])[:, :k]
        axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
        variance = values[::-1][:k] / max(n - 1, 1)
        if before is not None and np.abs(axes - before[0]).max() <= tol and np.abs(variance - before[1]).max() <= tol * max(variance[0], 1e-300):
            break
        before = axes, variance
        w = np.linalg.qr(z)[0]
    return axes, variance, total / max(n - 1, 1), n


def pca_variance(df: DataFrame, vec: str, k: int = 3, tol: float = 1e-6) -> DataFrame:
    """(component, variance, share of the total variance)."""
    _, variance, total, _ = principal_axes(df, vec, k, tol=tol)
    rows = [(i + 1, float(v), float(v / total) if total else None) for i, v in enumerate(variance)]
    return df.sparkSession.createDataFrame(rows, "component int, variance double, share double")


def pca_fingerprint(df: DataFrame, vec: str, group: str, k: int = 3, tol: float = 1e-6) -> DataFrame:
    """Mean coordinates per group on the first k principal axes (see ``principal_axes``): the
    vectors are projected where they are, and only k numbers a row are aggregated. Rows
    without a full finite vector are left out."""
    axes = principal_axes(df, vec, k, tol=tol)[0]
    width, k = axes.shape

    def run(batches):
        for batch in batches:
            column, keys = batch.column("_v"), batch.column(0)
            full = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
            x = column.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
            good = np.isfinite(x).all(axis=1)
            y = x[good] @ axes
            yield pa.record_batch([keys.take(pa.array(full[good])), *[pa.array(np.ascontiguousarray(y[:, i])) for i in range(k)]], names=[group, *[f"_pc{i}" for i in range(k)]])

    data = df.select(group, F.col(vec).cast("array<double>").alias("_v")).where(F.col("_v").isNotNull() & (F.size("_v") == width) & (F.size("_v") > 0))
    kind = dict(df.dtypes)[group]
    pcs = data.mapInArrow(run, f"`{group}` {kind}, " + ", ".join(f"_pc{i} double" for i in range(k)))
    return pcs.groupBy(group).agg(*[F.avg(f"_pc{i}").alias(f"pc{i + 1}") for i in range(k)], F.count(F.lit(1)).cast("bigint").alias("n"))
