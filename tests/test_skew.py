"""Hot keys: one group holding a third of the rows must not change results."""

import numpy as np
import pandas as pd
import pytest

from concentra.operators import ordinal, ranks
from concentra.operators import stats as st


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(11)
    n = 3000
    g = np.where(np.arange(n) < n // 3, "hot", rng.choice(["a", "b", "c", "d", "e"], n))
    pdf = pd.DataFrame({"g": g, "t": rng.permutation(n), "y": np.round(rng.normal(size=n), 1)})
    return pdf, spark.createDataFrame(pdf)


def test_grouped_ordinal_with_hot_group(spark, skewed):
    pdf, df = skewed
    got = ordinal.global_ordinal(df, ["t"], name="o", by=["g"], rows_per_range=200).toPandas()
    exp = pdf.assign(o=pdf.groupby("g")["t"].rank(method="first").astype(int) - 1)
    m = got.merge(exp, on=["g", "t"], suffixes=("", "_exp"))
    assert len(m) == len(pdf) and (m["o"] == m["o_exp"]).all()


def test_hot_group_is_spread_over_ranges(spark, skewed):
    _, df = skewed
    from pyspark.sql import functions as F

    ranged = ordinal.in_order(df, ["g", "t"], rows_per_range=200)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") == "hot").alias("hot")).collect()
    assert sum(r.hot > 0 for r in sizes) >= 4 and max(r.n for r in sizes) < 600
    # range and place ascend with the order
    rows = ranged.orderBy("g", "t").toPandas()
    assert rows["_range"].is_monotonic_increasing
    assert rows.groupby("_range")["_place"].apply(lambda p: (p.values == np.arange(len(p))).all()).all()


def test_ranges_with_nulls_and_many_ranges(spark):
    pdf = pd.DataFrame({"a": [None, 1.0, 2.0, None, 1.0] * 200, "b": range(1000)})
    df = spark.createDataFrame(pdf).selectExpr("if(isnan(a), null, a) as a", "b")
    got = ordinal.global_ordinal(df, ["a", "b"], name="o", rows_per_range=10).orderBy("o").collect()
    exp = sorted(((r.a is not None, r.a or 0, r.b) for r in got))
    assert [(r.a is not None, r.a or 0, r.b) for r in got] == exp
    assert [r.o for r in got] == list(range(1000))


def test_kruskal_and_lag_with_hot_group(spark, skewed):
    pdf, df = skewed
    h = st.kruskal(df, "y", "g").first().statistic
    r = pdf["y"].rank(method="average")
    n = len(pdf)
    h_exp = 12 / (n * (n + 1)) * sum(r[pdf.g == k].sum() ** 2 / (pdf.g == k).sum() for k in pdf.g.unique()) - 3 * (n + 1)
    t = pdf.groupby("y").size().values
    h_exp /= 1 - (t**3 - t).sum() / (n**3 - n)
    assert h == pytest.approx(h_exp, rel=1e-9)
    coef = st.lag1_coefficients(df, "y", ["g"], ["t"]).toPandas().set_index("g")["phi"]
    s = pdf.sort_values(["g", "t"])
    exp = s.groupby("g")["y"].apply(lambda v: v.autocorr(lag=1))
    assert np.allclose(coef.sort_index().values, exp.sort_index().values)


def test_ranks_with_hot_value(spark):
    vals = np.concatenate([np.zeros(1000), np.arange(1, 2001)]).astype(float)
    pdf = pd.DataFrame({"v": vals})
    got = ranks.average_ranks(ranks.value_counts(spark.createDataFrame(pdf), "v"), "v").toPandas()
    assert got.loc[got.v == 0.0, "rank"].iloc[0] == pytest.approx(500.5)
    assert got.loc[got.v == 1.0, "rank"].iloc[0] == pytest.approx(1001.0)
