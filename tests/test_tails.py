"""Tails against textbook quantiles, closed forms and the oracle engine's sums."""

import math

import pytest

from concentra.functions import tails as t
from concentra.plans import sqltails

LN10 = math.log(10)


def tail(spark, rows, kind="k"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, statistic double, df1 double, df2 double")
    return [(r.p_value, r.log10_p) for r in t.with_p_value(df, kind).orderBy("i").collect()]


def test_textbook_quantiles(spark):
    rows = [
        ("t", 2.228, 10.0, None), ("t", -2.228, 10.0, None), ("f", 3.885, 2.0, 12.0), ("f", 4.964, 1.0, 10.0),
        ("chi2", 5.991, 2.0, None), ("chi2", 18.307, 10.0, None), ("chi2", 3.841, 1.0, None), ("z", 1.96, None, None),
    ]
    for (p, lp), r in zip(tail(spark, rows), rows):
        assert p == pytest.approx(0.05, abs=2e-4), r
        assert lp == pytest.approx(math.log10(p))


def test_closed_forms(spark):
    rows = [("t", 0.0, 5.0, None), ("t", 1.0, 1.0, None), ("t", 1e8, 1.0, None), ("chi2", 40.0, 2.0, None), ("chi2", 1e-3, 2.0, None),
            ("f", 1000.0, 2.0, 4.0), ("f", 0.01, 2.0, 4.0), ("z", 1e-3, None, None), ("z", 5.0, None, None)]
    exact = [1.0, 0.5, 2 / math.pi * math.atan(1e-8), math.exp(-20.0), math.exp(-5e-4), (1 + 500.0) ** -2, (1 + 0.005) ** -2,
             math.erfc(1e-3 / math.sqrt(2)), math.erfc(5 / math.sqrt(2))]
    for (p, _), e in zip(tail(spark, rows), exact):
        assert p == pytest.approx(e, rel=1e-10)


def test_log_space_far_out(spark):
    # P(F(2, d) > x) = (1 + 2 x / d)^(-d / 2)
    rows = [("f", 1e6, 2.0, d) for d in (9.9e6, 9.999999e6, 1.0000001e7, 1.01e7, 1e9, 1e12)]
    for (p, lp), (_, x, _, d) in zip(tail(spark, rows), rows):
        assert p == 0.0 and lp * LN10 == pytest.approx(-d / 2 * math.log1p(2 * x / d), rel=1e-9)
    z = tail(spark, [("z", 40.0, None, None)])[0][1]
    assert z == pytest.approx(-349.13597646, abs=1e-6)


def test_continuous_in_the_degrees_of_freedom(spark):
    """Neither near p = 0.05 nor in the far tail is there a step."""
    dfs = [9.9e6, 9.9999e6, 9.99999e6, 1.000001e7, 1.0001e7, 1.01e7]
    for kind, x in (("t", 2000.0), ("t", 1.96), ("f", 1e6)):
        rows = [(kind, x, 2.0, d) if kind == "f" else (kind, x, d, None) for d in dfs]
        lp = [v for _, v in tail(spark, rows)]
        steps = [abs(b - a) / abs(d - c) for a, b, c, d in zip(lp, lp[1:], dfs, dfs[1:])]
        assert max(steps) <= 1.1 * min(steps) + 1e-12
    chi = [p for p, _ in tail(spark, [("chi2", d + math.sqrt(2 * d), d, None) for d in dfs])]
    assert all(abs(a - b) < 1e-5 for a, b in zip(chi, chi[1:])) and chi[0] == pytest.approx(0.1587, abs=1e-3)
    limit = tail(spark, [("t", 1.96, 1e13, None), ("z", 1.96, None, None)])
    assert limit[0][0] == pytest.approx(limit[1][0], rel=1e-9)


def test_undefined_is_null(spark):
    rows = [("t", None, 3.0, None), ("t", float("nan"), 3.0, None), ("f", 2.0, 0.0, 5.0), ("f", 2.0, 3.0, None), ("t", 2.0, None, None), ("chi2", 2.0, 0.0, None)]
    assert tail(spark, rows) == [(None, None)] * len(rows)
    assert tail(spark, [("f", -1.0, 2.0, 5.0), ("chi2", 0.0, 2.0, None)]) == [(1.0, 0.0)] * 2


def test_oracle_sums_agree(spark):
    import duckdb

    rows = [("t", s, d, None) for s in (0.01, 0.7, 3.0, 50.0) for d in (1.0, 7.0, 1e5)]
    rows += [("f", s, a, b) for s in (0.05, 0.9, 1.1, 20.0) for a in (1.0, 6.0) for b in (2.0, 1e4)]
    rows += [("chi2", s, d, None) for s in (0.5, 30.0) for d in (1.0, 12.0)] + [("z", 3.3, None, None)]
    got = tail(spark, rows)
    values = ", ".join(f"({i}, '{k}', {s}, {a or 'NULL'}, {b or 'NULL'})" for i, (k, s, a, b) in enumerate(rows))
    src = f"SELECT * FROM (VALUES {values}) v(i, k, statistic, df1, df2)"
    want = duckdb.sql(f"SELECT p_value, log10_p FROM ({sqltails.with_p(src, 'k')}) ORDER BY i").fetchall()
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-12)


def test_ks_tail(spark):
    n = 10000.0
    d05 = 1.358 / (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    df = spark.createDataFrame([(0, d05, n), (1, 0.3, n), (2, 1e-9, 10.0), (3, 0.0099, n), (4, 0.01, n)], "i int, d double, n double")
    got = [(r.p_value, r.log10_p) for r in t.with_p_value(df, "ks", stat="d", df1="n", df2=None).orderBy("i").collect()]
    assert got[0][0] == pytest.approx(0.05, abs=2e-3)
    assert got[1][1] * LN10 == pytest.approx(-1803.67, abs=0.1)  # p itself underflows
    assert got[2][0] == 1.0
    assert got[3][0] > got[4][0] > 0.25  # either side of the change of series


def test_normal_cdf(spark):
    z = [-30.0, -9.0, -7.2, -3.0, -1.0, 0.0, 0.5, 2.0, 8.0]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(z)), "i int, z double")
    got = [r.c for r in df.select("i", t.norm_cdf(F.col("z")).alias("c")).orderBy("i").collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in z], rel=1e-8)


def ranges(spark, rows):
    """ln P(Q > q) of (q, k, df) rows, in their order."""
    from concentra.functions import tukey

    df = spark.createDataFrame([(i, *map(lambda x: None if x is None else float(x), r)) for i, r in enumerate(rows)], "i int, q double, k double, df double")
    got = {r.i: r.lp for r in tukey.log_upper(df, ["i"], "q", "k", "df", "lp").collect()}
    return [got[i] for i in range(len(rows))]


def test_studentized_range_quantiles(spark):
    from concentra.functions import tukey

    # textbook values of the 95 % point; df None: infinitely many
    table = [(3, None, 3.314), (3, 10, 3.877), (4, 20, 3.958), (2, 10, 3.151), (3, 1, 26.98), (10, 5, 6.995), (1, 10, None), (3, 0, None), (None, 5, None)]
    df = spark.createDataFrame([(i, k and float(k), None if d is None else float(d)) for i, (k, d, _) in enumerate(table)], "i int, k double, df double")
    got = {r.i: r.q for r in tukey.quantile(df, ["i"], 0.95, "k", "df", "q").collect()}
    assert [got[i] for i in range(len(table))] == [None if q is None else pytest.approx(q, abs=1.5e-3 * max(1, q / 4)) for *_, q in table]
    back = ranges(spark, [(got[i], k, d) for i, (k, d, q) in enumerate(table) if q])
    assert back == pytest.approx([math.log(0.05)] * len(back), abs=1e-7)


def test_studentized_range_tail(spark):
    # two groups: the range of two normals is |z| sqrt(2), Q / sqrt(2) is |t|
    qs = (0.5, 3.0, 12.0, 40.0)
    assert ranges(spark, [(q, 2, None) for q in qs]) == pytest.approx([math.log(math.erfc(q / 2.0)) for q in qs], rel=1e-9)
    pairs = ((3.151, 10.0), (40.0, 300.0), (1.0, 1.0), (500.0, 2.0))
    t_tail = [lp * LN10 for _, lp in tail(spark, [("t", q / math.sqrt(2), d, None) for q, d in pairs])]
    assert ranges(spark, [(q, 2, d) for q, d in pairs]) == pytest.approx(t_tail, rel=1e-7)
    # far out: no floor, and no step at large degrees of freedom
    a, b, c, d, e, f, g = ranges(spark, [(8, 3, 300), (40, 3, 300), (3.3, 3, 24_750), (3.3, 3, 25_250), (3.314, 3, 1e9), (3.314, 3, None), (100, 3, 1000)])
    assert a > b and b == pytest.approx(-196.7143623, abs=1e-6) and g == pytest.approx(-898.37008, abs=1e-4)
    assert c == pytest.approx(d, abs=1e-4) and e == pytest.approx(f, rel=1e-6)
    assert ranges(spark, [(0, 3, 5), (-1, 3, 5), (None, 3, 5), (2, 1, 5), (2, 3, 0), (float("nan"), 3, 5)]) == [0.0, 0.0, None, None, None, None]
