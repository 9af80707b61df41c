"""The Shapiro-Wilk test against published results and its definition."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import normality

SPEED = [4, 4, 7, 7, 8, 9, 10, 10, 10, 11, 11, 12, 12, 12, 12, 13, 13, 13, 13, 14, 14, 14, 14, 15, 15, 15, 16, 16, 17, 17, 17, 18, 18, 18, 18, 19, 19, 19, 20, 20, 20, 20, 20, 22, 23, 24, 24, 24, 24, 25]
DISTANCE = [2, 10, 4, 22, 16, 10, 18, 26, 34, 17, 28, 14, 20, 24, 28, 26, 34, 34, 46, 26, 36, 60, 80, 20, 26, 54, 32, 40, 32, 40, 50, 42, 56, 76, 84, 36, 46, 68, 32, 48, 52, 56, 64, 66, 54, 70, 92, 93, 120, 85]


def run(spark, groups, **options):
    rows = [(k, i, v) for k, values in groups.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series string, bar_id long, v double")
    return {r.series: r for r in normality.shapiro_wilk(df, "v", **options).collect()}


def test_published_results(spark):
    """The cars table that comes with R, and what R prints for it."""
    got = run(spark, {"speed": [float(v) for v in SPEED], "distance": [float(v) for v in DISTANCE] + [None, float("nan")]})
    assert (round(got["speed"].w, 5), round(got["speed"].p, 4), got["speed"].n) == (0.97765, 0.4576, 50)
    assert (round(got["distance"].w, 5), round(got["distance"].p, 4), got["distance"].tested) == (0.95144, 0.0391, 50)


def test_normal_quantiles(spark):
    p = [1e-9, 1e-4, 0.02, 0.074, 0.076, 0.3, 0.5, 0.9, 0.99999]
    rows = spark.createDataFrame([(x,) for x in p], "p double").select("p", normality.normal_quantile(F.col("p")).alias("q"))
    assert all(r.q == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-9, abs=1e-12) for r in rows.collect())


def test_sizes_and_edges(spark):
    rng = np.random.default_rng(3)
    groups = {f"n{k}": rng.normal(size=k).tolist() for k in (1, 2, 3, 4, 5, 6, 11, 12, 300)} | {"same": [2.0] * 20, "skewed": rng.exponential(size=300).tolist()}
    got = run(spark, groups)
    assert got["n1"].w is got["n2"].w is got["same"].w is got["n1"].p is got["same"].p is None
    for k in (3, 4, 5, 6, 11, 12, 300):
        assert 0.7 < got[f"n{k}"].w <= 1 and 0 <= got[f"n{k}"].p <= 1
    assert got["n300"].p > 0.01 > 1e-6 > got["skewed"].p
    moved = run(spark, {k: [1e3 - 5 * x for x in v] for k, v in groups.items()})
    assert all(moved[k].w == pytest.approx(got[k].w, rel=1e-9) for k in groups if got[k].w is not None)


def test_levels_hold(spark):
    """Of normal series, about a twentieth is rejected at 0.05, whatever their length."""
    rng = np.random.default_rng(8)
    for n in (5, 9, 40):
        got = run(spark, {str(k): rng.normal(size=n).tolist() for k in range(400)})
        assert 0.02 < np.mean([r.p < 0.05 for r in got.values()]) < 0.09


def test_long_series_are_sampled(spark):
    rng = np.random.default_rng(5)
    got = run(spark, {"long": rng.normal(size=4000).tolist(), "short": rng.normal(size=90).tolist()}, most=500)
    assert (got["long"].n, got["long"].tested, got["short"].tested) == (4000, 500, 90) and got["long"].p > 0.001
