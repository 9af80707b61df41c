"""Barrier searches against one run a setting, and information by neighbours against all pairs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import barrier_search, labels, neighbours


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(2)
    parts = []
    for k, n in ((1, 300), (2, 40), (3, 1)):
        c = 100 * np.exp(np.cumsum(rng.standard_normal(n) * 0.02))
        parts.append(pd.DataFrame({"series": k, "bar_id": range(n), "close": c, "vol": np.where(rng.random(n) < 0.1, np.nan, 0.01 + rng.random(n) * 0.02)}))
    return spark.createDataFrame(pd.concat(parts)).withColumns({"vol": F.when(~F.isnan("vol"), F.col("vol")), "close": F.when((F.col("series") != 2) | (F.col("bar_id") != 7), F.col("close"))})


def test_grid_is_one_run_a_setting(events):
    tried = barrier_search.settings((0.5, 1.0, 3.0), (0.0, 0.01), (1, 5, 20))
    grid = {r.setting: r for r in barrier_search.barrier_grid(events, "vol", tried, shares=(0.05, 0.8)).collect()}
    touches = barrier_search.first_touches(events, "vol", tried)
    best = None
    for i, s in enumerate(tried):
        one = labels.triple_barrier(events, "vol", *s)
        same = lambda df: sorted((r.series, r.bar_id, r.t1, r.ret, r.label) for r in df.select("series", "bar_id", "t1", "ret", "label").collect())
        assert same(one) == same(touches.where(F.col("setting") == i))
        told = labels.economics(one).first()
        r, n = grid[i], {x.label: x.n for x in labels.class_shares(one).collect()}
        assert (r.n_down, r.n_flat, r.n_up, r.n) == (n.get(-1, 0), n.get(0, 0), n.get(1, 0), sum(n.values()))
        assert r.n_trades == told.n_trades and all(a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in ((r.total_return, told.total_return), (r.win_rate, told.win_rate), (r.sharpe, told.sharpe)))
        assert r.balanced == all(0.05 <= n.get(c, 0) / r.n <= 0.8 for c in (-1, 0, 1)) and (r.score is None) == (not r.balanced)
        if r.score is not None and (best is None or r.score > grid[best].score):
            best = i
    assert best is not None and [i for i, r in grid.items() if r.best] == [best]


def test_grid_without_events(events):
    tried = barrier_search.settings((1.0,), (0.0,), (5,))
    assert barrier_search.barrier_grid(events.where("series = 3"), "vol", tried).count() == 0
    assert barrier_search.barrier_grid(events.limit(0), "vol", tried).count() == 0
    flat = events.withColumn("close", F.lit(1.0))
    (r,) = barrier_search.barrier_grid(flat, "vol", tried).collect()
    assert r.sharpe is None and r.score is None and not r.best and r.n_down == r.n


def test_labels_are_applied_and_reported(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, 7), (1, 2, 0.6, 7), (2, 1, 0.7, 7), (None, 1, 0.1, 7)], "series long, bar_id long, x double, label int")
    marks = spark.createDataFrame([(1, 1, 1, 5), (1, 3, -1, 6), (2, 1, None, 4)], "series long, bar_id long, label int, t1 long")
    got = barrier_search.apply_labels(rows, marks)
    assert got.columns == ["series", "bar_id", "x", "label", "t1"]
    assert sorted((r.x, r.label, r.t1) for r in got.collect()) == [(0.1, None, None), (0.5, 1, 5), (0.6, None, None), (0.7, None, 4)]
    assert tuple(barrier_search.alignment(rows, marks).first()) == (4, 2, 1, 3, 1)
    assert tuple(barrier_search.alignment(rows.limit(0), marks.limit(0)).first()) == (0, 0, 0, 0, 0)


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def plain_mi(x, y, k=3):
    x, y = x / (x.std() or 1), y / (y.std() or 1)
    dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    both = np.maximum(dx, dy)
    np.fill_diagonal(both, np.inf)
    r = np.sort(both, axis=1)[:, k - 1]
    inside = lambda d: np.where(r > 0, (d < r[:, None] * (1 - 1e-10)).sum(1), (d == 0).sum(1)) - 1
    nx, ny = inside(dx), inside(dy)
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(a + 1) + psi(b + 1) for a, b in zip(nx, ny)]))


@pytest.mark.parametrize("cells", [1, 12])
def test_information_is_that_of_all_pairs(spark, cells):
    rng = np.random.default_rng(4)
    n = 900
    y = rng.standard_normal(n)
    data = {"near": y + 0.3 * rng.standard_normal(n), "free": rng.standard_normal(n), "squared": y**2 + 0.1 * rng.standard_normal(n), "ties": rng.integers(0, 5, n).astype(float), "third": np.where(rng.random(n) < 0.35, 2.5, rng.standard_normal(n)), "tails": rng.standard_cauchy(n), "constant": np.ones(n)}
    y[:40] = y[0]  # copies of whole points, with the ties
    pdf = pd.DataFrame(data | {"y": y})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None,) * 7 + (1.0,), (1.0,) * 6 + (float("nan"), 1.0)], ", ".join(f"{c} double" for c in pdf.columns)))
    got = {r.feature: r.mi for r in neighbours.mutual_information(df, list(data), "y", 3, cells).collect()}
    for name, x in data.items():
        assert math.isclose(got[name], plain_mi(x, y), rel_tol=1e-9, abs_tol=1e-9), name
    assert got["near"] > 0.5 > 0.2 > got["free"]


def test_information_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0)], "a double, y double")
    assert [tuple(r) for r in neighbours.mutual_information(df, ["a"], "y").collect()] == [("a", None)]
    assert [tuple(r) for r in neighbours.mutual_information(df.limit(0), ["a"], "y").collect()] == [("a", None)]
    same = spark.createDataFrame([(1.0, 2.0)] * 20, "a double, y double")
    assert neighbours.mutual_information(same, ["a"], "y").first().mi is not None


def test_edges_of_intervals():
    rng = np.random.default_rng(1)
    x, z = rng.standard_normal(2000) * 10.0 ** rng.integers(-8, 8, 2000), rng.standard_normal(2000)
    r = np.abs(z - x)
    b = neighbours.edge_of(x, r)
    assert (((b - x) >= r) & ((np.nextafter(b, -np.inf) - x) < r))[r > 0].all()
