"""The test battery F1-F9 as aggregations, plus tails on one-row summaries.

Every test returns a statistics frame with the columns of ``STAT_COLS``
(one row per test); ``with_p`` adds ``p_value`` / ``log10_p``. Degenerate
input (too few rows or groups, zero variance) gives a NULL statistic and a
``note``, never an error: ANSI division by zero is avoided with ``nullif``.

Missing values (NULL or NaN; a file of runs cannot tell them apart) follow
``nan_policy``. With "omit" (the default) they are left out. With "propagate" F1, F2,
F2p, F4, F6 and F7 give a NULL result and a note as soon as one value they would read
is missing; F3, F5 and F8 drop incomplete rows or pairs under either policy. The flag is
one more aggregate beside the moments, so the policy costs no pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tukey
from ..functions.tails import with_p_value
from .ordinal import in_order, materialize
from .regress import ols_slope
from .ranks import average_ranks

STAT_COLS = ["test_id", "statistic", "df1", "df2", "estimate", "n", "note"]

# distribution of each test's statistic
KIND = {
    "F1": "t",
    "F2": "f",
    "F3": "t",
    "F4": "t",
    "F5": "t",
    "F6": "t",
    "F7": "chi2",
    "F8": "t",
}


def _num(c) -> Column:
    """NaN -> NULL, as double."""
    x = F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    return F.when(~F.isnan(x), x)


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


POLICIES = ("omit", "propagate")
MISSING = "missing values"


def _spoils(nan_policy: str, *cols: str) -> Column:
    """True for a row whose missing values make the result NULL."""
    if nan_policy not in POLICIES:
        raise ValueError(f"nan_policy is one of {POLICIES}, not {nan_policy!r}")
    if nan_policy == "omit":
        return F.lit(False)
    out = F.lit(False)
    for c in cols:
        x = F.col(c).cast("double")
        out = out | x.isNull() | F.isnan(x)
    return out


def _unless(spoiled: Column, parts: tuple, applies: Column | None = None) -> tuple:
    """The parts of a result row, with NULLs and a note where ``spoiled``; a test that does
    not apply at all keeps its own note."""
    bad = F.coalesce(spoiled, F.lit(False))
    if applies is not None:
        bad = bad & applies
    statistic, df1, df2, estimate, n, note = parts
    keep = lambda c: F.when(~bad, c)
    return keep(statistic), keep(df1), keep(df2), keep(estimate), n, F.when(bad, F.lit(MISSING)).otherwise(note)


def _row(test_id: str, statistic, df1, df2, estimate, n, note) -> list[Column]:
    return [
        F.lit(test_id).alias("test_id"),
        statistic.cast("double").alias("statistic"),
        df1.cast("double").alias("df1"),
        df2.cast("double").alias("df2"),
        estimate.cast("double").alias("estimate"),
        n.cast("bigint").alias("n"),
        note.cast("string").alias("note"),
    ]


def _null() -> Column:
    return F.lit(None).cast("double")


def with_p(stats: DataFrame) -> DataFrame:
    """p-values for a frame of test rows (distribution chosen by test id)."""
    kind = F.coalesce(
        *[F.when(F.col("test_id") == k, F.lit(v)) for k, v in KIND.items()], F.lit("t")
    )
    return with_p_value(stats.withColumn("_kind", kind), "_kind").drop("_kind")


# --- F1 --------------------------------------------------------------------


def ttest_1samp(
    df: DataFrame, y: str = "ned_mean", mu: float = 0.0, test_id: str = "F1", groups: Sequence[str] = (), nan_policy: str = "omit"
) -> DataFrame:
    """one-sample t-test against ``mu`` (per ``groups`` when given)."""
    m = df.groupBy(*groups).agg(
        F.count(_num(y)).alias("n"),
        F.avg(_num(y)).alias("mean"),
        F.stddev_samp(_num(y)).alias("sd"),
        F.bool_or(_spoils(nan_policy, y)).alias("spoiled"),
    )
    t = (F.col("mean") - F.lit(mu)) / _nz(F.col("sd") / F.sqrt(F.col("n")))
    note = F.when(F.col("n") < 2, F.lit("fewer than 2 values")).when(
        F.col("sd") == 0, F.lit("zero variance")
    )
    parts = F.when(F.col("n") >= 2, t), F.col("n") - 1, _null(), F.col("mean"), F.col("n"), note
    return m.select(*groups, *_row(test_id, *_unless(F.col("spoiled"), parts)))


# --- F2 and post-hoc ---------------------------------------------------------


def group_moments(df: DataFrame, y: str, by: str, groups: Sequence[str] = (), nan_policy: str = "omit") -> DataFrame:
    """n, mean, var_samp per non-null level of ``by`` (within ``groups``), and whether a
    missing value spoils the level."""
    spoils = _spoils(nan_policy, y)
    return (
        df.select(*groups, F.col(by).alias("level"), _num(y).alias("y"), spoils.alias("spoils"))
        .where(F.col("level").isNotNull() & (F.col("y").isNotNull() | F.col("spoils")))
        .groupBy(*groups, "level")
        .agg(
            F.count("y").alias("n"),
            F.avg("y").alias("mean"),
            F.var_samp("y").alias("var"),
            F.bool_or("spoils").alias("spoiled"),
        )
    )


def anova(
    df: DataFrame, y: str = "ned_mean", by: str = "temp", test_id: str = "F2", groups: Sequence[str] = (), nan_policy: str = "omit"
) -> DataFrame:
    """One-way F over the levels of ``by`` (NULL levels dropped), per ``groups``.

    Level moments in one aggregation; the total and the overall mean follow from
    the level rows, and SSB is the direct sum of n (m - M)^2 over them (a
    difference of total and within sums would cancel).
    """
    gs = list(groups)
    g = group_moments(df, y, by, gs, nan_policy)
    one = F.lit(1).alias("_one")  # without groups the totals are one row: joined on a constant
    total = g.groupBy(*gs).agg(F.sum("n").alias("_total"), (F.sum(F.col("n") * F.col("mean")) / _nz(F.sum("n"))).alias("_grand"))
    wide = g.select("*", one).join(total.select("*", one), [*gs, "_one"])
    s = wide.groupBy(*gs).agg(
        F.count(F.lit(1)).alias("k"),
        F.max("_total").alias("total"),
        F.sum(F.col("n") * (F.col("mean") - F.col("_grand")) ** 2).alias("ssb"),
        F.sum(F.coalesce(F.col("var"), F.lit(0.0)) * (F.col("n") - 1)).alias("ssw"),
        F.bool_or("spoiled").alias("spoiled"),
    )
    k, n = F.col("k"), F.coalesce("total", F.lit(0))
    ok = (k >= 2) & (n > k)
    f = (F.col("ssb") / (k - 1)) / _nz(F.col("ssw") / (n - k))
    note = F.when(k < 2, F.lit("fewer than 2 groups")).when(n <= k, F.lit("no within-group df")).when(
        F.col("ssw") == 0, F.lit("zero within-group variance")
    )
    return s.select(*groups, *_row(test_id, *_unless(F.col("spoiled"), (F.when(ok, f), k - 1, n - k, _null(), n, note))))


def tukey_hsd(
    df: DataFrame, y: str = "ned_mean", by: str = "temp", alpha: float = 0.05, groups: Sequence[str] = (), baseline=None,
    nan_policy: str = "omit",
) -> DataFrame:
    """F2p: all pairs of levels, meandiff = mean(group2) - mean(group1); with
    ``baseline`` only the pairs of that level with every other (linear in the levels).

    Tukey-Kramer standard error for unequal sizes; p from the studentized
    range with k groups and N - k df; confidence limits at 1 - alpha. The level rows are
    stored: tails and limits read them, not the input. A spoiled level
    (nan_policy) takes the common variance with it: no pair has more than a difference.
    Without a baseline the levels (a small set: one row each) are gathered into
    one sorted array to form the pairs.
    """
    gs = list(groups)
    g = materialize(group_moments(df, y, by, gs, nan_policy)).withColumn("mean", F.when(~F.col("spoiled"), F.col("mean")))
    level = F.struct("level", "n", "mean", "var")
    s = g.groupBy(*gs).agg(
        F.array_sort(F.collect_list(level)).alias("groups") if baseline is None
        else F.max(F.when(F.col("level") == F.lit(baseline), level)).alias("base"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("N"),
        F.sum(F.coalesce(F.col("var"), F.lit(0.0)) * (F.col("n") - 1)).alias("ssw"),
        F.bool_or("spoiled").alias("spoiled"),
    ).where(F.col("k") > 2)
    s = s.withColumn("df", (F.col("N") - F.col("k")).cast("double")).withColumn(
        "msw", F.when(~F.col("spoiled"), F.col("ssw") / _nz(F.col("df")))
    )
    s = s.withColumn("levels", F.col("k").cast("double"))
    crit = tukey.quantile(s.select("levels", "df").distinct(), ["levels", "df"], 1.0 - alpha, "levels", "df")
    s = s.join(crit, ["levels", "df"])
    if baseline is None:
        pairs = F.flatten(
            F.transform(
                F.col("groups"),
                lambda a, i: F.transform(
                    F.slice(F.col("groups"), i + 2, F.col("k")),
                    lambda b: F.struct(a.alias("g1"), b.alias("g2")),
                ),
            )
        )
        p = s.select(*gs, "k", "df", "msw", "q_crit", F.explode(pairs).alias("pr"))
    else:
        one = F.lit(1).alias("_one")  # without groups a join with one row
        others = g.where(F.col("level") != F.lit(baseline)).select(*gs, one, level.alias("other"))
        j = others.join(s.where(F.col("base").isNotNull()).select("*", one), [*gs, "_one"])
        p = j.select(*gs, "k", "df", "msw", "q_crit", F.struct(F.col("base").alias("g1"), F.col("other").alias("g2")).alias("pr"))
    se = F.sqrt(F.col("msw") / 2.0 * (1.0 / _nz(F.col("pr.g1.n")) + 1.0 / _nz(F.col("pr.g2.n"))))
    diff = F.col("pr.g2.mean") - F.col("pr.g1.mean")
    out = p.select(
        *gs,
        F.col("pr.g1.level").alias("group1"),
        F.col("pr.g2.level").alias("group2"),
        diff.alias("meandiff"),
        (F.abs(diff) / _nz(se)).alias("q"),
        (diff - F.col("q_crit") * se).alias("lower"),
        (diff + F.col("q_crit") * se).alias("upper"),
        F.col("k").cast("double").alias("k"),
        F.col("df"),
    )
    withp = with_p_value(out, "tukey", stat="q", df1="k", df2="df")
    return withp.select(
        *gs,
        "group1",
        "group2",
        "meandiff",
        "q",
        F.col("p_value").alias("p_adj"),
        "lower",
        "upper",
        (F.col("p_value") < alpha).alias("reject"),
    )


# --- F3 / F4 / F6: simple regression and correlation -------------------------


def _complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    sel = df.select(*[_num(c).alias(c) for c in cols])
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return sel.where(cond)


def _ols_parts():
    """(statistic, df1, df2, estimate, n, note) of a slope t-test from n, sxx, syy, sxy."""
    n = F.col("n")
    slope = F.col("sxy") / _nz(F.col("sxx"))
    se = F.sqrt((F.col("syy") - slope * F.col("sxy")) / _nz(n - 2) / _nz(F.col("sxx")))
    ok = (F.col("sxx") > 0) & (n > 2)
    note = F.when(~(F.col("sxx") > 0) | F.col("sxx").isNull(), F.lit("single value of predictor")).when(
        n <= 2, F.lit("fewer than 3 rows")
    )
    return F.when(ok, slope / _nz(se)), n - 2, _null(), F.when(ok, slope), n, note


def _ols_cols(y: str, x: str, test_id: str) -> list[Column]:
    return _row(test_id, *_ols_parts())


def _moment_aggs(y: str, x: str, prefix: str = "") -> list[Column]:
    yy, xx = F.col(y), F.col(x)
    return [
        F.regr_count(yy, xx).alias(prefix + "n"),
        F.regr_sxx(yy, xx).alias(prefix + "sxx"),
        F.regr_syy(yy, xx).alias(prefix + "syy"),
        F.regr_sxy(yy, xx).alias(prefix + "sxy"),
        F.regr_r2(yy, xx).alias(prefix + "r2"),
    ]


def ols(
    df: DataFrame,
    y: str = "ned_mean",
    x: str = "model_size",
    extra: DataFrame | None = None,
    test_id: str = "F3",
    transform: str | None = None,
    groups: Sequence[str] = (),
) -> DataFrame:
    """F3 (E7 with transform='ln'): slope t-test of y ~ x on complete rows, per ``groups``.

    ``extra`` runs are added for this test only, and to every group: their moments are
    one row, merged with the moments of each group.
    """
    gs = list(groups)

    def moments(src: DataFrame, keys: list[str]) -> DataFrame:
        xx = _num(x) if transform != "ln" else F.when(_num(x) > 0, F.log(_num(x)))
        data = src.select(*keys, _num(y).alias("_y"), xx.alias("_x"))
        means = [F.avg(F.when(F.col("_x").isNotNull(), F.col("_y"))).alias("my"), F.avg(F.when(F.col("_y").isNotNull(), F.col("_x"))).alias("mx")]
        return data.groupBy(*keys).agg(*_moment_aggs("_y", "_x"), *means)

    m = moments(df, gs)
    if extra is not None:
        one = F.lit(1).alias("_one")  # one row beside every group
        more = moments(extra, []).select(one, *[F.col(c).alias(f"e_{c}") for c in ("n", "sxx", "syy", "sxy", "mx", "my")])
        both = m.select("*", one).join(more, "_one")
        n = F.col("n") + F.col("e_n")
        cross = F.col("n") * F.col("e_n") / _nz(n.cast("double"))
        gap = {c: F.coalesce(F.col(f"e_m{c}") - F.col(f"m{c}"), F.lit(0.0)) for c in "xy"}
        whole = lambda c: F.coalesce(F.col(c), F.lit(0.0)) + F.coalesce(F.col(f"e_{c}"), F.lit(0.0))
        merged = {f"s{a}{b}": whole(f"s{a}{b}") + cross * gap[a] * gap[b] for a, b in ("xx", "yy", "xy")}
        m = both.select(*gs, n.alias("n"), *[v.alias(k) for k, v in merged.items()])
    return m.select(*gs, *_ols_cols(y, x, test_id))


def _pearson_parts(gate: Column | None = None):
    n = F.col("n")
    r = F.col("sxy") / _nz(F.sqrt(F.col("sxx") * F.col("syy")))
    t = r * F.sqrt((n - 2) / _nz(1.0 - r * r))
    ok = (n > 2) & r.isNotNull() & (F.abs(r) < 1.0)
    if gate is not None:
        ok = ok & gate
    note = F.when(n <= 2, F.lit("fewer than 3 pairs")).when(
        r.isNull(), F.lit("constant column")
    ).when(F.abs(r) >= 1.0, F.lit("perfect correlation"))
    if gate is not None:
        note = F.when(~gate, F.lit("single value of x")).otherwise(note)
    return F.when(ok, t), n - 2, _null(), r, n, note


def _pair_moments(df: DataFrame, y: str, x: str, nan_policy: str) -> DataFrame:
    """Moments of the complete pairs (regr_* pass over the others) and the spoiled flag."""
    pairs = df.select(_num(y).alias("_y"), _num(x).alias("_x"), _spoils(nan_policy, y, x).alias("spoils"))
    return pairs.agg(*_moment_aggs("_y", "_x"), F.bool_or("spoils").alias("spoiled"))


def pearson(df: DataFrame, y: str = "ned_mean", x: str = "temp", test_id: str = "F4", nan_policy: str = "omit") -> DataFrame:
    """Pearson r with r = s_xy / sqrt(s_xx s_yy) (never ``corr``:
    it raises on a constant column in ANSI mode); t = r sqrt((n-2)/(1-r^2))."""
    return _pair_moments(df, y, x, nan_policy).select(*_row(test_id, *_unless(F.col("spoiled"), _pearson_parts())))


def pearson_gated(df: DataFrame, y: str = "ned_mean", x: str = "seq_len", test_id: str = "F6", nan_policy: str = "omit") -> DataFrame:
    """as F4, not applicable when x takes a single value."""
    gate = F.col("sxx") > 0
    parts = _unless(F.col("spoiled"), _pearson_parts(gate), gate)
    return _pair_moments(df, y, x, nan_policy).select(*_row(test_id, *parts))


# --- F5: lag-1 persistence ----------------------------------------------------


def lag_pairs(df: DataFrame, y: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(by..., prev, cur) for consecutive rows inside each group.

    The rows are stored once as a run of ranges (see ``ordinal``), so a hot group is
    spread over many tasks. Inside a range the pairs come from ``lag``; the pair that
    spans two ranges of a group comes from the ranges' first and last rows, a small table.
    """
    base = in_order(df.select(*by, *order, _num(y).alias("_y")), [*by, *order])
    prev = F.lag(F.struct("_y")).over(Window.partitionBy("_range", *by).orderBy("_place"))
    inside = base.withColumn("_prev", prev).where(F.col("_prev").isNotNull())
    ends = base.groupBy("_range", *by).agg(F.min_by("_y", "_place").alias("cur"), F.max_by("_y", "_place").alias("_last"))
    across = F.lag(F.struct("_last")).over(Window.partitionBy(*by).orderBy("_range"))
    spans = ends.withColumn("_prev", across).where(F.col("_prev").isNotNull())
    return inside.select(*by, F.col("_prev._y").alias("prev"), F.col("_y").alias("cur")).unionByName(
        spans.select(*by, F.col("_prev._last").alias("prev"), "cur")
    )


def lag1_coefficients(df: DataFrame, y: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per group: lag-1 correlation over complete pairs (NULL when undefined)."""
    pairs = lag_pairs(df, y, by, order).where(F.col("prev").isNotNull() & F.col("cur").isNotNull())
    g = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.regr_sxx("cur", "prev").alias("sxx"),
        F.regr_syy("cur", "prev").alias("syy"),
        F.regr_sxy("cur", "prev").alias("sxy"),
    )
    phi = F.col("sxy") / _nz(F.sqrt(F.col("sxx") * F.col("syy")))
    return g.select(*by, "n_pairs", F.when(F.col("n_pairs") >= 2, phi).alias("phi"))


def lag1_persistence(
    df: DataFrame,
    y: str = "ned_mean",
    by: Sequence[str] = ("chkpt_id",),
    order: Sequence[str] = ("rank",),
    test_id: str = "F5",
    groups: Sequence[str] = (),
) -> DataFrame:
    """t-test of the per-group lag-1 coefficients against 0 (> 1 group)."""
    keys = [*groups, *[b for b in by if b not in groups]]
    coef = lag1_coefficients(df, y, keys, list(order)).where(F.col("phi").isNotNull())
    return ttest_1samp(coef, "phi", 0.0, test_id=test_id, groups=groups)


# --- F7: Kruskal-Wallis ---------------------------------------------------------


def kruskal(
    df: DataFrame, y: str = "ned_mean", by: str = "domain", test_id: str = "F7", groups: Sequence[str] = (), nan_policy: str = "omit"
) -> DataFrame:
    """H with tie correction; ranks from the distributed rank helper.

    Missing values are counted as one more value of their group, so the policy needs
    no second scan.

    Only (group, value) counts are joined to the value ranks; the statistic
    is one aggregation over the union of the per-group rank sums and the
    per-value tie terms.
    """
    gs = list(groups)
    rows = df.select(*gs, F.col(by).alias("_g"), _num(y).alias("_v"), _spoils(nan_policy, y).alias("spoils"))
    rows = rows.where(F.col("_g").isNotNull() & (F.col("_v").isNotNull() | F.col("spoils")))
    # one scan of the input
    every = materialize(rows.groupBy(*gs, "_g", "_v").agg(F.count(F.lit(1)).alias("cnt")))
    gv = every.where("_v is not null")
    vc = gv.groupBy(*gs, "_v").agg(F.sum("cnt").alias("cnt"))
    ranked = average_ranks(vc, "_v", by=gs).select(*gs, "_v", "rank", F.col("cnt").alias("t"))
    per_group = (
        gv.join(ranked.select(*gs, "_v", "rank"), [*gs, "_v"])
        .groupBy(*gs, "_g")
        .agg(F.sum(F.col("cnt") * F.col("rank")).alias("R"), F.sum("cnt").alias("n_g"))
    )
    # centred form: sum n_g (mean rank_g - (N + 1) / 2)^2, no cancellation
    # for large N; N comes from a window over the (few) group rows
    n_all = F.sum("n_g").over(Window.partitionBy(*gs)).cast("double")
    per_group = per_group.withColumn(
        "dev", F.col("n_g") * (F.col("R") / F.col("n_g") - (n_all + 1.0) / 2.0) ** 2
    )
    parts = per_group.select(
        *gs,
        F.col("dev").alias("r2n"),
        F.lit(1).alias("is_g"),
        F.lit(0.0).alias("tie"),
        F.lit(0).cast("bigint").alias("t"),
        F.lit(False).alias("spoiled"),
    ).unionByName(
        ranked.select(
            *gs,
            F.lit(0.0).alias("r2n"),
            F.lit(0).alias("is_g"),
            (F.col("t").cast("double") ** 3 - F.col("t").cast("double")).alias("tie"),
            F.col("t").cast("bigint").alias("t"),
            F.lit(False).alias("spoiled"),
        )
    )
    if nan_policy == "propagate":  # a group of missing values alone is a group too
        lost = every.where("_v is null").select(
            *gs, F.lit(0.0).alias("r2n"), F.lit(0).alias("is_g"), F.lit(0.0).alias("tie"), F.lit(0).cast("bigint").alias("t"), F.lit(True).alias("spoiled")
        )
        parts = parts.unionByName(lost)
    s = parts.groupBy(*gs).agg(
        F.sum("r2n").alias("sr2n"),
        F.coalesce(F.sum("is_g"), F.lit(0)).alias("k"),
        F.sum("tie").alias("ties"),
        F.sum("t").alias("N"),
        F.bool_or("spoiled").alias("spoiled"),
    )
    n = F.col("N").cast("double")
    h0 = F.lit(12.0) / _nz(n * (n + 1)) * F.col("sr2n")
    corr = F.lit(1.0) - F.col("ties") / _nz(n * n * n - n)
    ok = (F.col("k") > 1) & (n > 1)
    note = F.when(F.col("k") <= 1, F.lit("fewer than 2 groups")).when(
        corr.isNull() | (corr == 0), F.lit("all values equal")
    )
    result = F.when(ok, h0 / _nz(corr)), F.col("k") - 1, _null(), _null(), F.col("N"), note
    return s.select(*gs, *_row(test_id, *_unless(F.col("spoiled"), result)))


# --- F8: partial slope -----------------------------------------------------------


def ols_partial(
    df: DataFrame, y: str = "ned_mean", x: str = "rank", covariate: str | None = "temp", test_id: str = "F8"
) -> DataFrame:
    """Slope of x in y ~ x + covariate (df n - 3); without variation in the covariate,
    y ~ x. See ``regress.ols_slope`` for more covariates and for run dummies."""
    return ols_slope(df, y, x, [covariate] if covariate else [], test_id=test_id)


# --- F9: the battery --------------------------------------------------------------


def battery(
    df: DataFrame,
    y: str = "ned_mean",
    temp: str = "temp",
    size: str = "model_size",
    seq_len: str = "seq_len",
    domain: str = "domain",
    rank: str = "rank",
    chkpt: Sequence[str] | None = None,
    extra: DataFrame | None = None,
    groups: Sequence[str] = (),
    nan_policy: str = "omit",
    runs: Sequence[str] = (),
) -> DataFrame:
    """F1..F8 in order with p-values; a missing column gives a NULL row.

    With ``groups`` (e.g. model, prompt set) the eight tests run for every
    group at once: each aggregation is keyed by the group columns, so many
    runs cost the same number of jobs as one.

    F1, F3 (without extra runs), F4, F6 and F8 read their moments from ONE
    aggregation; F2, F5 and F7 need one shuffle each.

    F5 groups by (model, chkpt_id) when there is a model column, so that
    checkpoint ids of different runs in a combined table are not chained
    together; ``chkpt=("chkpt_id",)`` reproduces grouping by checkpoint only.
    Ranks of different runs overlap in the same way: ``runs`` names the columns that
    tell the runs of a combined table apart, and F8 then has a dummy per run.

    ``extra`` runs are added for F3 only, to every group (they need not have the
    group columns). See the module for ``nan_policy``.
    """
    cols = set(df.columns)
    groups = list(groups)
    if chkpt is None:
        chkpt = ("model", "chkpt_id") if "model" in cols and "model" not in groups else ("chkpt_id",)
    rows: list[DataFrame] = []
    has = lambda *c: all(x in cols for x in c)
    base = df.select(*groups).distinct() if groups else df.sparkSession.range(1)

    def missing(tid: str, what: str) -> DataFrame:
        return base.select(
            *groups, *_row(tid, _null(), _null(), _null(), _null(), F.lit(None), F.lit(f"missing column {what}"))
        )

    if not has(y):
        out = missing("F1", y)
        for i in range(2, 9):
            out = out.unionByName(missing(f"F{i}", y))
        return with_p(out)

    shared = _shared_moments(df, y, temp if has(temp) else None, size if has(size) and extra is None else None,
                             seq_len if has(seq_len) else None, rank if has(rank) and not runs else None, groups, nan_policy)
    rows.append(shared.where(F.col("test_id") == "F1"))
    rows.append(anova(df, y, temp, groups=groups, nan_policy=nan_policy) if has(temp) else missing("F2", temp))
    if has(size):
        rows.append(ols(df, y, size, extra=extra, groups=groups) if extra is not None else shared.where(F.col("test_id") == "F3"))
    else:
        rows.append(missing("F3", size))
    rows.append(shared.where(F.col("test_id") == "F4") if has(temp) else missing("F4", temp))
    rows.append(
        lag1_persistence(df, y, list(chkpt), [rank], groups=groups) if has(*chkpt, rank) else missing("F5", "chkpt_id")
    )
    rows.append(shared.where(F.col("test_id") == "F6") if has(seq_len) else missing("F6", seq_len))
    rows.append(kruskal(df, y, domain, groups=groups, nan_policy=nan_policy) if has(domain) else missing("F7", domain))
    if not has(rank):
        rows.append(missing("F8", rank))
    elif runs:
        rows.append(ols_slope(df, y, rank, [temp] if has(temp) else [], runs, groups))
    else:
        rows.append(shared.where(F.col("test_id") == "F8"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    order = F.substring(F.col("test_id"), 2, 2).cast("int")
    if groups:
        # 8 rows per group: a small sorted report
        return with_p(out.withColumn("test_no", order)).orderBy(*groups, "test_no").drop("test_no")
    # eight one-row results: moved (a shuffle of 8 rows) into one partition,
    # so the tails are one Arrow call and the sort is local, without a
    # range-sampling job; repartition, not coalesce, so that the upstream
    # post-shuffle work of every test stays parallel
    one = out.withColumn("test_no", order).repartition(1)
    return with_p(one).sortWithinPartitions("test_no").drop("test_no")


def _shared_moments(df: DataFrame, y: str, temp, size, seq_len, rank, groups: Sequence[str] = (), nan_policy: str = "omit") -> DataFrame:
    """One aggregation with the moments of F1, F3, F4, F6 and F8, unpacked into rows."""
    yy = _num(y)
    aggs = [F.count(yy).alias("f1_n"), F.avg(yy).alias("f1_mean"), F.stddev_samp(yy).alias("f1_sd")]
    for tid, x in (("f1_", None), ("f4_", temp), ("f6_", seq_len)):
        if x or tid == "f1_":
            aggs.append(F.bool_or(_spoils(nan_policy, *([y, x] if x else [y]))).alias(tid + "spoiled"))

    def pair(prefix: str, x: str):
        xx = _num(x)
        return [
            F.regr_count(yy, xx).alias(prefix + "n"),
            F.regr_sxx(yy, xx).alias(prefix + "sxx"),
            F.regr_syy(yy, xx).alias(prefix + "syy"),
            F.regr_sxy(yy, xx).alias(prefix + "sxy"),
        ]

    if size:
        aggs += pair("f3_", size)
    if temp:
        aggs += pair("f4_", temp)
    if seq_len:
        aggs += pair("f6_", seq_len)
    if rank:
        r = _num(rank)
        t = _num(temp) if temp else F.lit(0.0)
        comp = yy.isNotNull() & r.isNotNull() & t.isNotNull()
        ry, rr, tt = F.when(comp, yy), F.when(comp, r), F.when(comp, t)
        aggs += [
            F.count(ry).alias("f8_n"),
            F.var_samp(rr).alias("f8_c11"),
            F.covar_samp(rr, ry).alias("f8_c1y"),
            F.var_samp(ry).alias("f8_cyy"),
            F.var_samp(tt).alias("f8_c22"),
            F.covar_samp(rr, tt).alias("f8_c12"),
            F.covar_samp(tt, ry).alias("f8_c2y"),
        ]
    m = df.groupBy(*groups).agg(*aggs)

    # one row per test from the single aggregated row (inline of an array of
    # structs with common field names), then the formulas chosen by test id:
    # the aggregation runs once, not once per test
    fields = ["n", "mean", "sd", "sxx", "syy", "sxy", "c11", "c1y", "cyy", "c22", "c12", "c2y"]

    def entry(tid: str, src: dict[str, str]) -> Column:
        flag = f"{tid.lower()}_spoiled"
        return F.struct(
            F.lit(tid).alias("test_id"),
            (F.col(flag) if flag in m.columns else F.lit(False)).alias("spoiled"),
            *[(F.col(src[f]).cast("double") if f in src else _null()).alias(f) for f in fields],
        )

    entries = [entry("F1", {"n": "f1_n", "mean": "f1_mean", "sd": "f1_sd"})]
    parts: dict[str, tuple] = {}
    nn, mean, sd = F.col("n"), F.col("mean"), F.col("sd")
    spoiled = F.col("spoiled")
    parts["F1"] = _unless(spoiled, (
        F.when(nn >= 2, mean / _nz(sd / F.sqrt(nn))),
        nn - 1,
        _null(),
        mean,
        nn,
        F.when(nn < 2, F.lit("fewer than 2 values")).when(sd == 0, F.lit("zero variance")),
    ))
    pair = lambda p: {k: p + k for k in ("n", "sxx", "syy", "sxy")}
    if size:
        entries.append(entry("F3", pair("f3_")))
        parts["F3"] = _ols_parts()
    if temp:
        entries.append(entry("F4", pair("f4_")))
        parts["F4"] = _unless(spoiled, _pearson_parts())
    if seq_len:
        entries.append(entry("F6", pair("f6_")))
        gate = F.col("sxx") > 0
        parts["F6"] = _unless(spoiled, _pearson_parts(gate), gate)
    if rank:
        entries.append(entry("F8", {k: "f8_" + k for k in ("n", "c11", "c1y", "cyy", "c22", "c12", "c2y")}))
        parts["F8"] = _partial_parts()
    long = m.select(*groups, F.inline(F.array(*entries)))

    def pick(i: int) -> Column:
        expr = None
        for tid, p in parts.items():
            cond = F.col("test_id") == tid
            expr = F.when(cond, p[i]) if expr is None else expr.when(cond, p[i])
        return expr

    names = ["statistic", "df1", "df2", "estimate", "n", "note"]
    types = ["double", "double", "double", "double", "bigint", "string"]
    return long.select(
        *groups, "test_id", *[pick(i).cast(t).alias(nm) for i, (nm, t) in enumerate(zip(names, types))]
    )


def _partial_parts():
    """Slope of rank beside one covariate from the centred moments of the shared row."""
    n = F.col("n").cast("double")
    two = F.col("c22") > 0
    det = F.col("c11") * F.col("c22") - F.col("c12") * F.col("c12")
    b1_two = (F.col("c22") * F.col("c1y") - F.col("c12") * F.col("c2y")) / _nz(det)
    b2_two = (F.col("c11") * F.col("c2y") - F.col("c12") * F.col("c1y")) / _nz(det)
    rss_two = (n - 1) * (F.col("cyy") - b1_two * F.col("c1y") - b2_two * F.col("c2y"))
    var_b1_two = rss_two / _nz(n - 3) * F.col("c22") / _nz((n - 1) * det)
    b1_one = F.col("c1y") / _nz(F.col("c11"))
    rss_one = (n - 1) * (F.col("cyy") - b1_one * F.col("c1y"))
    var_b1_one = rss_one / _nz(n - 2) / _nz((n - 1) * F.col("c11"))
    b1 = F.when(two, b1_two).otherwise(b1_one)
    se = F.sqrt(F.when(two, var_b1_two).otherwise(var_b1_one))
    dfr = F.when(two, n - 3).otherwise(n - 2)
    ok = (F.col("c11") > 0) & (dfr > 0)
    note = F.when(~(F.col("c11") > 0) | F.col("c11").isNull(), F.lit("single value of predictor")).when(
        dfr <= 0, F.lit("too few rows")
    )
    return F.when(ok, b1 / _nz(se)), dfr, _null(), F.when(ok, b1), F.col("n"), note
