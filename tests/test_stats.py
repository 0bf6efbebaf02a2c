"""Test battery: values against closed forms and numpy, edge rules of the survey."""

import math

import numpy as np
import pandas as pd
import pytest

from concentra.operators import stats as st
from concentra.operators import vocab as vb


def _runs(spark, n=60, seed=0, const_len=False):
    rng = np.random.default_rng(seed)
    temps = np.repeat([0.7, 1.0, 1.3], n // 3)
    y = 0.8 - 0.3 * (temps - 0.7) + rng.normal(scale=0.05, size=n)
    pdf = pd.DataFrame(
        {
            "ned_mean": y,
            "temp": temps,
            "seq_len": np.full(n, 128) if const_len else rng.integers(50, 128, n),
            "domain": np.tile(["wiki", "news", "code"], n // 3),
            "model_size": np.where(np.arange(n) % 2 == 0, 7e9, 70e9).astype("int64"),
            "rank": np.arange(n),
            "chkpt_id": np.arange(n) // 20,
        }
    )
    return pdf, spark.createDataFrame(pdf)


def test_ttest_matches_formula(spark):
    pdf, df = _runs(spark)
    r = st.ttest_1samp(df, "ned_mean").first()
    y = pdf["ned_mean"].values
    t = y.mean() / (y.std(ddof=1) / math.sqrt(len(y)))
    assert r.statistic == pytest.approx(t)
    assert r.df1 == len(y) - 1


def test_anova_matches_formula(spark):
    pdf, df = _runs(spark)
    r = st.anova(df).first()
    groups = [g["ned_mean"].values for _, g in pdf.groupby("temp")]
    allv = pdf["ned_mean"].values
    ssb = sum(len(g) * (g.mean() - allv.mean()) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    f = (ssb / 2) / (ssw / (len(allv) - 3))
    assert r.statistic == pytest.approx(f, rel=1e-9)
    assert (r.df1, r.df2) == (2.0, len(allv) - 3.0)


def test_partial_slope_matches_lstsq(spark):
    pdf, df = _runs(spark)
    r = st.ols_partial(df, "ned_mean", "rank", "temp").first()
    X = np.column_stack([np.ones(len(pdf)), pdf["rank"], pdf["temp"]])
    beta, res, *_ = np.linalg.lstsq(X, pdf["ned_mean"], rcond=None)
    sigma2 = res[0] / (len(pdf) - 3)
    se = math.sqrt(sigma2 * np.linalg.inv(X.T @ X)[1, 1])
    assert r.estimate == pytest.approx(beta[1], rel=1e-8)
    assert r.statistic == pytest.approx(beta[1] / se, rel=1e-7)


def test_kruskal_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 400).astype(str), "v": rng.integers(0, 15, 400).astype(float)})
    r = st.kruskal(spark.createDataFrame(pdf), "v", "g").first()
    ranks = pdf["v"].rank(method="average")
    n = len(pdf)
    h = 12 / (n * (n + 1)) * sum(ranks[pdf.g == g].sum() ** 2 / (pdf.g == g).sum() for g in pdf.g.unique()) - 3 * (n + 1)
    t = pdf.groupby("v").size().values
    h /= 1 - (t**3 - t).sum() / (n**3 - n)
    assert r.statistic == pytest.approx(h, rel=1e-9)


def test_tukey_sign_and_pairs(spark):
    pdf, df = _runs(spark)
    rows = st.tukey_hsd(df).orderBy("group1", "group2").collect()
    assert [(r.group1, r.group2) for r in rows] == [(0.7, 1.0), (0.7, 1.3), (1.0, 1.3)]
    m = pdf.groupby("temp")["ned_mean"].mean()
    assert rows[1].meandiff == pytest.approx(m[1.3] - m[0.7])  # group2 - group1
    assert rows[1].meandiff < 0 and rows[1].reject
    assert rows[1].lower < rows[1].meandiff < rows[1].upper


def test_constant_column_gives_null_not_error(spark):
    pdf, _ = _runs(spark)
    pdf["temp"] = 1.0
    df = spark.createDataFrame(pdf)
    r = st.pearson(df, "ned_mean", "temp").first()
    assert r.statistic is None and r.note == "constant column"
    a = st.anova(df).first()
    assert a.statistic is None and a.note == "fewer than 2 groups"


def test_single_value_f6_and_f3(spark):
    _, df = _runs(spark, const_len=True)
    r = st.pearson_gated(df, "ned_mean", "seq_len").first()
    assert r.statistic is None and r.note == "single value of x"
    pdf, _ = _runs(spark)
    pdf["model_size"] = 7_000_000_000
    r3 = st.ols(spark.createDataFrame(pdf), "ned_mean", "model_size").first()
    assert r3.statistic is None and r3.note == "single value of predictor"


def test_nan_is_omitted(spark):
    pdf, _ = _runs(spark)
    pdf.loc[0, "ned_mean"] = float("nan")
    r = st.ttest_1samp(spark.createDataFrame(pdf), "ned_mean").first()
    assert r.n == len(pdf) - 1


def test_one_row_groups_in_lag1(spark):
    pdf = pd.DataFrame({"ned_mean": [0.1, 0.2, 0.3, 0.5, 0.2, 0.9], "chkpt_id": [0, 0, 0, 1, 1, 2], "rank": range(6)})
    coef = st.lag1_coefficients(spark.createDataFrame(pdf), "ned_mean", ["chkpt_id"], ["rank"]).orderBy("chkpt_id").collect()
    # group 0: 2 pairs, constant differences -> r = 1; group 1: one pair -> undefined; group 2: no pair
    assert coef[0].phi == pytest.approx(1.0)
    assert coef[1].phi is None
    assert len(coef) == 2


def test_battery_has_eight_rows_in_order(spark):
    _, df = _runs(spark)
    rows = st.battery(df).collect()
    assert [r.test_id for r in rows] == [f"F{i}" for i in range(1, 9)]
    for r in rows:
        assert r.p_value is None or 0.0 <= r.p_value <= 1.0
    assert rows[0].p_value < 0.01


def test_battery_missing_column_row(spark):
    pdf, _ = _runs(spark)
    rows = st.battery(spark.createDataFrame(pdf.drop(columns=["domain"]))).collect()
    f7 = [r for r in rows if r.test_id == "F7"][0]
    assert f7.p_value is None and f7.note == "missing column domain"


def test_spearman_golden_values(spark):
    # five languages of a published vocabulary summary (metric mean, fertility,
    # generation-side vocabulary): rho 0.10 and -0.30 with n = 5
    pdf = pd.DataFrame(
        {
            "ned": [0.329, 0.401, 0.388, 0.395, 0.408],
            "fertility": [0.2134, 0.3499, 0.7324, 0.7169, 0.4207],
            "vocab_used": [1996, 1815, 1358, 1808, 1712],
        }
    )
    from concentra.functions.tails import with_p_value

    s = vb.spearman(spark.createDataFrame(pdf), "ned", ["fertility", "vocab_used"])
    rows = {r.column: r for r in with_p_value(s, "t", "statistic", "df1", None).collect()}
    assert rows["fertility"].rho == pytest.approx(0.10)
    assert rows["fertility"].p_value == pytest.approx(0.87, abs=0.005)
    assert rows["vocab_used"].rho == pytest.approx(-0.30)
    assert rows["vocab_used"].p_value == pytest.approx(0.624, abs=0.001)


def test_battery_without_value_column(spark):
    pdf, _ = _runs(spark)
    rows = st.battery(spark.createDataFrame(pdf.drop(columns=["ned_mean"]))).collect()
    assert [r.test_id for r in rows] == [f"F{i}" for i in range(1, 9)]
    assert all(r.p_value is None and r.note == "missing column ned_mean" for r in rows)


def test_grouped_battery_equals_per_group(spark):
    pdf, _ = _runs(spark, n=90)
    pdf["model"] = np.where(np.arange(len(pdf)) % 2 == 0, "m1", "m2")
    df = spark.createDataFrame(pdf)
    grouped = {(r.model, r.test_id): r for r in st.battery(df, groups=["model"]).collect()}
    for m in ("m1", "m2"):
        single = st.battery(df.where(f"model = '{m}'").drop("model"), chkpt=("chkpt_id",)).collect()
        for r in single:
            g = grouped[(m, r.test_id)]
            for f in ("statistic", "df1", "df2", "estimate", "n", "p_value"):
                a, b = getattr(r, f), getattr(g, f)
                assert (a is None and b is None) or a == pytest.approx(b, rel=1e-9), (m, r.test_id, f)


def test_empty_input_notes(spark):
    empty = spark.createDataFrame([], "ned_mean double, temp double, domain string")
    assert st.anova(empty).first().note == "fewer than 2 groups"
    assert st.kruskal(empty).first().note == "fewer than 2 groups"
    assert st.ttest_1samp(empty).first().note == "fewer than 2 values"


def test_anova_sums_between_groups_directly(spark):
    """Large spread, small effect: a difference of sums of squares would lose F."""
    import numpy as np

    n = 200_000
    y = 1e6 * np.sin(np.arange(n))
    g = np.arange(n) % 2
    df = spark.range(n).selectExpr("1e6 * sin(id) as ned_mean", "cast(id % 2 as double) as temp")
    got = st.anova(df).first()
    parts = [y[g == k].astype(np.longdouble) for k in (0, 1)]
    m = y.astype(np.longdouble).mean()
    ssb = sum(len(p) * (p.mean() - m) ** 2 for p in parts)
    ssw = sum(((p - p.mean()) ** 2).sum() for p in parts)
    assert got.statistic == pytest.approx(float(ssb / (ssw / (n - 2))), rel=1e-6)


# --- missing values -----------------------------------------------------------


def _by_id(frame):
    return {r.test_id: r for r in frame.collect()}


@pytest.mark.parametrize("missing", [float("nan"), None])
def test_one_missing_value_spoils_f1_f2_f4_f6_f7_only(spark, missing):
    pdf, df = _runs(spark)
    whole = _by_id(st.battery(df))
    rows = [tuple(missing if i == 7 and c == "ned_mean" else (v.item() if hasattr(v, "item") else v) for c, v in zip(pdf.columns, r)) for i, r in enumerate(pdf.itertuples(index=False))]
    df = spark.createDataFrame(rows, df.schema)
    got = _by_id(st.battery(df, nan_policy="propagate"))
    for t in ("F1", "F2", "F4", "F6", "F7"):
        assert got[t].statistic is None and got[t].p_value is None and got[t].note == "missing values"
    for t in ("F3", "F5", "F8"):  # these drop the row, or the two pairs with it
        assert got[t].statistic is not None and got[t].note is None
    assert got["F3"].n == whole["F3"].n - 1
    omitted = _by_id(st.battery(df))
    assert all(omitted[t].statistic is not None for t in ("F1", "F2", "F4", "F6", "F7"))
    # without a missing value the policies agree
    again = _by_id(st.battery(_runs(spark)[1], nan_policy="propagate"))
    assert {t: r.statistic for t, r in again.items()} == pytest.approx({t: r.statistic for t, r in whole.items()})


def test_propagate_reads_only_the_rows_of_the_test(spark):
    # the missing value has no level: F2 and F7 don't read it, F1 does
    rows = [(float(i % 5) + i / 7, "a" if i % 2 else "b", 1.0 * i) for i in range(20)] + [(None, None, 3.0)]
    df = spark.createDataFrame(rows, "ned_mean double, domain string, temp double")
    assert st.anova(df, by="domain", nan_policy="propagate").first().statistic is not None
    assert st.kruskal(df, nan_policy="propagate").first().statistic is not None
    assert st.ttest_1samp(df, nan_policy="propagate").first().statistic is None
    # a missing x spoils a correlation as a missing y does
    df = spark.createDataFrame([(1.0 * i, 2.0 * i % 3) for i in range(9)] + [(1.0, None)], "ned_mean double, temp double")
    assert st.pearson(df, nan_policy="propagate").first().note == "missing values"
    assert st.pearson(df).first().statistic is not None
    # a single value of x is said before
    df = spark.createDataFrame([(1.0 * i, 5.0) for i in range(9)] + [(None, 5.0)], "ned_mean double, seq_len double")
    assert st.pearson_gated(df, nan_policy="propagate").first().note == "single value of x"
    with pytest.raises(ValueError):
        st.ttest_1samp(df, nan_policy="raise")


def test_propagate_by_group_and_in_tukey(spark):
    pdf, df = _runs(spark)
    both = df.selectExpr("*", "'a' AS g").unionByName(df.selectExpr("* EXCEPT (ned_mean)", "if(rank = 3, NULL, ned_mean) AS ned_mean", "'b' AS g"))
    got = {(r.g, r.test_id): r for r in st.battery(both, groups=["g"], nan_policy="propagate").collect()}
    for t in ("F1", "F2", "F4", "F6", "F7"):
        assert got["a", t].statistic is not None and got["b", t].statistic is None
    t = {(r.g, r.group1, r.group2): r for r in st.tukey_hsd(both, groups=["g"], nan_policy="propagate").collect()}
    assert len(t) == 6
    assert all((r.q is None) == (k[0] == "b") for k, r in t.items())
    assert t["b", 0.7, 1.0].meandiff is None and t["b", 1.0, 1.3].meandiff is not None


# --- regression with any number of covariates ------------------------------------


def _lstsq(X, y, at):
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    rank = np.linalg.matrix_rank(X)
    df = len(y) - rank
    s2 = ((y - X @ beta) ** 2).sum() / df
    return beta[at], beta[at] / math.sqrt(s2 * np.linalg.pinv(X.T @ X)[at, at]), df


def test_general_regression_matches_lstsq(spark):
    from concentra.operators.regress import ols_slope, ols_table

    rng = np.random.default_rng(3)
    n = 240
    runs = rng.integers(0, 7, n)
    a, b, c = rng.normal(size=n) + runs, rng.normal(size=n) * 1e6, rng.integers(0, 3, n) * 0.3 + 0.7
    y = 0.4 * a - 2e-6 * b + c + runs**2 + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": a, "b": b, "c": c, "run": runs}))
    dummies = np.eye(7)[runs]
    plain = np.column_stack([np.ones(n), b, c, a])
    est, t, dof = _lstsq(plain, y, 3)
    r = ols_slope(df, "y", "a", ["b", "c"]).first()
    assert (r.estimate, r.statistic, r.df1) == pytest.approx((est, t, dof), rel=1e-6)
    for k, x in enumerate("abc"):
        est, t, dof = _lstsq(np.column_stack([dummies, a, b, c]), y, 7 + k)
        r = ols_table(df, "y", ["a", "b", "c"], absorb=["run"]).where(f"term = '{x}'").first()
        assert (r.estimate, r.statistic, r.df1, r.n) == pytest.approx((est, t, dof, n), rel=1e-6)


def test_covariates_without_variation_take_no_degree_of_freedom(spark):
    from concentra.operators.regress import ols_slope

    rng = np.random.default_rng(4)
    x, z = rng.normal(size=50), rng.normal(size=50)
    pdf = pd.DataFrame({"y": x + rng.normal(size=50), "x": x, "z": z, "z2": 3 * z - 1, "one": 5.0})
    pdf.loc[3, "z"] = float("nan")
    df = spark.createDataFrame(pdf)
    full = pdf.dropna()
    est, t, dof = _lstsq(np.column_stack([np.ones(49), full.z, full.x]), full.y.values, 2)
    r = ols_slope(df, "y", "x", ["one", "z", "z2"]).first()
    assert (r.estimate, r.statistic, r.df1, r.n) == pytest.approx((est, t, dof, 49), rel=1e-8)
    assert ols_slope(df, "y", "z2", ["z"]).first().note == "predictor given by the covariates"
    assert ols_slope(df, "y", "one", ["z"]).first().note == "single value of predictor"
    assert ols_slope(df.limit(2), "y", "x", ["z"]).first().statistic is None
    assert ols_slope(df.where("false"), "y", "x", ["z"]).first().n == 0


def test_battery_with_run_dummies_and_extra_runs_by_group(spark):
    pdf, df = _runs(spark, seed=1)
    both = pd.concat([pdf.assign(run="a"), pdf.assign(run="b", ned_mean=pdf.ned_mean * 2 + 0.1 * np.arange(60) % 0.7)])
    frame = spark.createDataFrame(both)
    r = _by_id(st.battery(frame, runs=["run"]))["F8"]
    X = np.column_stack([np.eye(2)[(both.run == "b").astype(int)], both.temp, both["rank"]])
    est, t, dof = _lstsq(X, both.ned_mean.values, 3)
    assert (r.estimate, r.statistic, r.df1) == pytest.approx((est, t, dof), rel=1e-7)

    extra = spark.createDataFrame(pdf[["ned_mean"]].assign(model_size=1e9, other="x"))
    got = {(x.run, x.test_id): x for x in st.battery(frame, groups=["run"], extra=extra).collect()}
    for run in "ab":
        mine = pd.concat([both[both.run == run][["ned_mean", "model_size"]], pdf[["ned_mean"]].assign(model_size=1e9)])
        est, t, dof = _lstsq(np.column_stack([np.ones(len(mine)), mine.model_size / 1e9]), mine.ned_mean.values, 1)
        assert (got[run, "F3"].estimate * 1e9, got[run, "F3"].statistic, got[run, "F3"].df1) == pytest.approx((est, t, dof), rel=1e-6)
