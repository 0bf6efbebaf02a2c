"""Properties of the concentration metric (uniform, peaked, bounds, widths)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concentra.functions import metric


def _frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, scores array<double>")


def _ned(spark, rows, temp=None):
    df = _frame(spark, rows).select("id", metric.ned("scores", temp).alias("ned")).orderBy("id")
    return [r.ned for r in df.collect()]


def _ned_numpy(row, temp=1.0):
    z = np.asarray(row, dtype=float) / temp
    p = np.exp(z - z.max())
    p /= p.sum()
    p = np.clip(p, 1e-45, None)
    return float(np.sum(p * (np.log(p) - np.log(1.0 / len(p)))) / np.log(len(p)))


def test_uniform_is_zero(spark):
    assert all(abs(v) < 1e-9 for v in _ned(spark, [[0.0] * 100] * 3))


def test_peaked_is_near_one(spark):
    row = [-100.0] * 100
    row[0] = 100.0
    assert _ned(spark, [row])[0] > 0.9


def test_bounds_and_agreement_with_numpy(spark):
    rng = np.random.default_rng(42)
    rows = rng.normal(size=(5, 100)).tolist()
    got = _ned(spark, rows)
    for g, r in zip(got, rows):
        assert 0.0 <= g <= 1.0
        assert g == pytest.approx(_ned_numpy(r), abs=1e-9)


@pytest.mark.parametrize("width", [100, 1000, 32000])
def test_widths(spark, width):
    rng = np.random.default_rng(width)
    row = rng.normal(size=width).tolist()
    assert _ned(spark, [row])[0] == pytest.approx(_ned_numpy(row), abs=1e-9)


def test_extreme_scores_no_nan(spark):
    rng = np.random.default_rng(0)
    rows = (rng.normal(size=(10, 300)) * 100).tolist()
    assert all(v == v for v in _ned(spark, rows))


def test_monotone_in_concentration(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=200)
    flat, peaked = _ned(spark, [(base * 0.1).tolist(), (base * 10).tolist()])
    assert peaked > flat


def test_temperature_flattens(spark):
    rng = np.random.default_rng(2)
    row = rng.normal(size=64).tolist()
    df = _frame(spark, [row]).select(
        metric.ned("scores", 0.7).alias("cold"), metric.ned("scores", 1.3).alias("hot")
    )
    r = df.first()
    assert r.cold > r.hot
    assert r.cold == pytest.approx(_ned_numpy(row, 0.7), abs=1e-9)


def test_single_position_width_one_is_null(spark):
    assert _ned(spark, [[3.0]]) == [None]


def test_arrow_path_equals_jvm_path(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(20, 500)).tolist()
    df = _frame(spark, rows).select(
        metric.ned("scores", 1.3).alias("a"), metric.ned_arrow(F.col("scores"), F.lit(1.3)).alias("b")
    )
    for r in df.collect():
        assert r.a == pytest.approx(r.b, abs=1e-9)


def test_argmax_and_topk(spark):
    df = _frame(spark, [[1.0, 5.0, 5.0, 2.0]]).select(
        metric.argmax_token("scores").alias("am"),
        metric.topk_mass("scores", 2).alias("m2"),
        metric.topk_mass("scores", 10).alias("m10"),
        metric.topk_mass_arrow(F.col("scores"), F.lit(1.0), F.lit(2)).alias("m2a"),
    )
    r = df.first()
    assert r.am == 1  # first of the ties
    p = np.exp([1.0, 5.0, 5.0, 2.0])
    p /= p.sum()
    assert r.m2 == pytest.approx(p[1] + p[2])
    assert r.m10 == pytest.approx(1.0)
    assert r.m2a == pytest.approx(r.m2)


def test_counts_metric_equals_vector_metric(spark):
    """C7 on a frequency table equals C2 on ln(count) scores, at any temperature."""
    from concentra.operators.reduce import ned_from_counts, ned_from_counts_temps

    counts = [5, 3, 3, 1, 1, 1, 20]
    cdf = spark.createDataFrame([("d", c) for c in counts], "k string, cnt long")
    vec = _frame(spark, [np.log(counts).tolist()])
    for t in (0.7, 1.0, 1.3):
        a = ned_from_counts(cdf, ["k"], "cnt", temp=t).first().ned
        b = vec.select(metric.ned("scores", t).alias("x")).first().x
        assert a == pytest.approx(b, abs=1e-12)
    multi = {r.temp: r.ned for r in ned_from_counts_temps(cdf, ["k"], "cnt", (0.7, 1.3)).collect()}
    assert multi[1.3] == pytest.approx(ned_from_counts(cdf, ["k"], "cnt", temp=1.3).first().ned, abs=1e-12)


def test_topk_masses_sort_once(spark):
    """Several k and temperatures from one order equal the single masses."""
    df = spark.createDataFrame([([0.1, 3.0, -2.0, 1.5],), ([1.0],), ([],), (None,)], "scores array<double>")
    rows = df.select(
        metric.topk_masses("scores", (1, 3, 10), (0.5, 2.0)).alias("a"),
        *[metric.topk_mass("scores", k, t).alias(f"m{k}_{int(t * 10)}") for k in (1, 3, 10) for t in (0.5, 2.0)],
    ).collect()
    for r in rows[:2]:
        for e in r.a:
            for k in (1, 3, 10):
                assert e[f"m{k}"] == pytest.approx(r[f"m{k}_{int(e.temp * 10)}"])
    assert all(e["m1"] is None for r in rows[2:] for e in r.a or [])
