"""Regression anchors: values probed on the sf0.01 tables (survey 7.8)."""

import pytest
from pyspark.sql import functions as F

from concentra.functions import metric
from concentra.operators import stats as st
from concentra.session import table
from concentra.sources import fixtures as fx

from conftest import SF_MID


def test_anova_by_temperature(spark):
    r = st.anova(fx.runs_vec(spark, SF_MID)).first()
    assert r.statistic == pytest.approx(822.885282, abs=1e-6)
    assert (r.df1, r.df2) == (2.0, 297.0)


def test_kruskal_with_heavy_ties(spark):
    r = st.kruskal(table(spark, SF_MID, "lineitem"), "l_quantity", "l_returnflag").first()
    assert r.statistic == pytest.approx(3.082416, abs=1e-6)


def test_mean_lag1_coefficient(spark):
    r = st.lag1_persistence(fx.series(spark, SF_MID), "value", ["user_id"], ["ts", "event_id"]).first()
    assert r.estimate == pytest.approx(-0.013043, abs=1e-6)
    assert r.n == 150


def test_partial_slope(spark):
    r = st.ols_partial(table(spark, SF_MID, "lineitem"), "l_extendedprice", "l_quantity", "l_discount").first()
    assert r.estimate == pytest.approx(7.186452, abs=1e-6)


def test_metric_on_raw_embeddings(spark):
    emb = table(spark, SF_MID, "embeddings")
    r = emb.select(metric.ned("embedding").alias("x")).agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("x").alias("n")
    ).first()
    assert r.m == pytest.approx(0.0018542, abs=1e-7)
    assert r.s == pytest.approx(0.00006133, abs=1e-8)
    assert r.n == 500


def test_run_means_by_temperature(spark):
    rows = {r.temp: r.m for r in fx.runs_vec(spark, SF_MID).groupBy("temp").agg(F.avg("ned_mean").alias("m")).collect()}
    assert rows[0.7] == pytest.approx(0.654, abs=5e-4)
    assert rows[1.0] == pytest.approx(0.489, abs=5e-4)
    assert rows[1.3] == pytest.approx(0.355, abs=5e-4)
