"""Principal axes of wide vectors, stored sketches, first occurrences, block metrics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from concentra.functions import metric
from concentra.operators import effects as ef
from concentra.operators import grid
from concentra.operators import vocab as vb


def _clustered(n, width, seed=0):
    rng = np.random.default_rng(seed)
    group = rng.integers(0, 5, n)
    return group, rng.normal(size=(5, width))[group] * 3 + rng.normal(size=(n, width)) * 0.1 + 2.0


@pytest.mark.parametrize("n,width", [(200, 6), (150, 64), (60, 32_000)])
def test_principal_axes_of_narrow_and_wide_vectors(spark, n, width):
    group, x = _clustered(n, width)
    df = spark.createDataFrame(pd.DataFrame({"g": group, "v": list(x)})).repartition(3)
    df = df.unionByName(spark.createDataFrame([(0, None), (1, [1.0]), (2, [float("nan")] * width)], "g bigint, v array<double>"))
    axes, variance, total, count = ef.principal_axes(df, "v", 3, tol=1e-8)
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert count == n and total == pytest.approx((c * c).sum() / (n - 1))
    assert variance == pytest.approx(s[:3] ** 2 / (n - 1), rel=1e-7)
    assert np.abs(np.abs((axes * vt[:3].T).sum(axis=0)) - 1).max() < 1e-7
    assert (axes[np.abs(axes).argmax(axis=0), range(3)] > 0).all()
    got = {r.g: (r.pc1, r.pc2, r.pc3, r.n) for r in ef.pca_fingerprint(df, "v", "g", tol=1e-8).collect()}
    for g in range(5):
        assert got[g][3] == (group == g).sum()
        assert got[g][:3] == pytest.approx((x[group == g] @ axes).mean(axis=0), abs=1e-5 * np.abs(x @ axes).max())


def test_principal_axes_of_nothing(spark):
    df = spark.createDataFrame([], "g int, v array<float>")
    assert ef.pca_fingerprint(df, "v", "g").count() == 0 and ef.pca_variance(df, "v").count() == 3
    assert ef.principal_axes(df, "v")[3] == 0


def test_sketches_merge_over_days_and_replace_a_day(spark, tmp_path):
    path = str(tmp_path / "sketches")
    text = lambda lo, hi: " ".join(f"w{i}" for i in range(lo, hi))
    days = {"a": [("en", text(0, 4000)), ("fr", "un deux")], "b": [("en", text(3000, 9000)), ("fr", None)]}
    for _ in range(2):  # the second delivery of a day replaces the first
        for day, rows in days.items():
            df = spark.createDataFrame([(day, *r) for r in rows], "day string, lang string, text string")
            vb.store_sketches(vb.usage_sketches(df, ["day"]), path, ["day"])
    kept = spark.read.parquet(path)
    assert kept.count() == 3
    got = {r.language: r.vocab_used_approx for r in vb.merged_usage(kept).collect()}
    assert got["en"] == pytest.approx(9000, rel=3 * 1.04 / 64) and got["fr"] == 2
    assert {r.language: r.vocab_used_approx for r in vb.merged_usage(kept.where("day = 'b'")).collect()}["en"] == pytest.approx(6000, rel=3 * 1.04 / 64)


def test_first_occurrence_order(spark):
    rows = [("en", "b", 3), ("en", "a", 1), ("en", "b", 0), ("fr", "a", 2), ("en", "c", 5), ("en", None, 4), ("en", "a", 9)]
    df = spark.createDataFrame(rows, "language string, prompt string, at int").repartition(4)
    got = grid.distinct_prompts(df, order=["at"]).collect()
    assert sorted((r.language, r.first_seen, r.prompt) for r in got) == [("en", 0, "b"), ("en", 1, "a"), ("en", 2, None), ("en", 3, "c"), ("fr", 0, "a")]
    assert grid.distinct_prompts(df).count() == 5


def test_block_metrics_equal_the_row_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=w).tolist(), t) for i, (w, t) in enumerate([(5, 1.0), (9, 0.7), (5, 1.3), (1, 1.0), (0, 1.0), (9, None)] * 7)] + [(99, None, 1.0)]
    df = spark.createDataFrame(rows, "i int, z array<double>, t double")
    got = df.select("i", metric.ned_arrow("z", "t").alias("ned"), metric.topk_mass_arrow("z", "t", F.lit(3)).alias("mass")).collect()
    by = {r[0]: r for r in rows}
    for r in got:
        _, z, t = by[r.i]
        if t is None or not z:
            assert r.ned is None and r.mass is None
            continue
        e = np.exp(np.array(z) / t)
        p = np.sort(e / e.sum())
        assert r.mass == pytest.approx(p[-3:].sum())
        assert (r.ned is None) if len(z) < 2 else r.ned == pytest.approx(1 + (p * np.log(p)).sum() / np.log(len(p)))


def test_blocks_are_bounded(monkeypatch):
    monkeypatch.setattr(metric, "BLOCK_VALUES", 20)
    rows = np.array([list(range(8))] * 11 + [None, []], dtype=object)
    sizes = [z.shape for _, z in metric._blocks(rows, [1.0] * 13)]
    assert sizes == [(2, 8)] * 5 + [(1, 8)]
