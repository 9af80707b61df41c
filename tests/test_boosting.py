"""Boosted trees against a plain one in numpy, and trees of features against a plain search for the nearest groups."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import boosting, linkage, models


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.standard_normal((n, 3))
    x[rng.random(n) < 0.1, 1] = np.nan
    y = np.where(x[:, 0] + rng.standard_normal(n) * 0.3 > 0.8, 1, np.where((x[:, 2] > 0) & (x[:, 0] < 0), -1, 0))
    rows = [(1, i, *[None if v != v else float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame([*rows, (1, n, 0.0, 0.0, 0.0, None)], "series long, bar_id long, a double, b double, c double, label int")


def plain_tree(bins, g, h, depth, l2, rate, least):
    """Values of rows by a tree grown by trying every split."""

    def grow(rows, level):
        def value(s):
            return g[s].sum() ** 2 / (h[s].sum() + l2)

        best = (1e-9, None)
        for f, b in itertools.product(range(bins.shape[1]), range(64)) if level < depth else ():
            left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
            if len(left) >= least and len(right) >= least and (gain := value(left) + value(right) - value(rows)) > best[0] + 1e-12:
                best = (gain, (left, right))
        if best[1] is None:
            out[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)
        else:
            for part in best[1]:
                grow(part, level + 1)

    out = np.zeros(len(bins))
    grow(np.arange(len(bins)), 0)
    return out


@pytest.mark.parametrize("gamma,weighted", [(0.0, None), (2.0, "balanced")])
def test_one_round_is_the_plain_tree(data, gamma, weighted):
    x, y, df = data
    model = boosting.boost(df, ["a", "b", "c"], rounds=1, depth=2, rate=0.3, bins=16, gamma=gamma, class_weight=weighted, least=5)
    bins, k = boosting.binned(x, model.edges), np.searchsorted([-1, 0, 1], y)
    w = len(y) / (3 * np.bincount(k))[k] if weighted else np.ones(len(y))
    _, g, h = boosting.focal(np.zeros((len(y), 3)), k, w, gamma)
    want = np.stack([plain_tree(bins, g[:, c], h[:, c], 2, 1.0, 0.3, 5) for c in range(3)], axis=1)
    assert np.allclose(boosting.scores(bins, model.start, model.rounds), want, atol=1e-12)


@pytest.mark.parametrize("gamma", [0.0, 0.5, 2.0])
def test_gradient_is_the_loss_slope(gamma):
    rng = np.random.default_rng(1)
    z, y, w = rng.standard_normal((50, 3)), rng.integers(0, 3, 50), rng.random(50) + 0.1
    _, g, h = boosting.focal(z, y, w, gamma)
    for k in range(3):
        step = np.zeros(3)
        step[k] = 1e-6
        slope = (boosting.focal(z + step, y, w, gamma)[0] - boosting.focal(z - step, y, w, gamma)[0]) / 2e-6
        assert np.allclose(slope, g[:, k], atol=1e-7) and (h[:, k] > 0).all()


def test_loss_falls_and_rewriting_changes_nothing(data, monkeypatch):
    _, y, df = data
    runs = []
    for rewrite in (2, 100):
        monkeypatch.setattr(boosting, "REWRITE", rewrite)
        runs.append(boosting.boost(df, ["a", "b", "c"], rounds=5, depth=2, rate=0.3, gamma=1.0, class_weight={1: 2.0}))
    one, two = runs
    assert len(one.losses) == 6 and all(b < a for a, b in itertools.pairwise(one.losses)) and np.allclose(one.losses, two.losses)
    told = one.transform(df.where("label is not null"))
    assert told.where("prediction = label").count() > 0.8 * len(y)
    assert told.where(F.abs(F.aggregate("proba", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-9).count() == 0


def test_rounds_end_early_and_folds(data):
    df = data[2]
    noise = df.withColumn("label", (F.hash("bar_id") % 2).cast("int"))
    model = boosting.boost(noise.where("bar_id < 200"), ["a", "b", "c"], rounds=12, depth=3, rate=0.8, held_out=noise.where("bar_id >= 200"), patience=2)
    best = int(np.argmin(model.held_out))
    assert len(model.rounds) == best < 12 and len(model.held_out) <= best + 3
    told = models.out_of_fold(df.where("label is not null"), lambda rows: boosting.boost(rows, ["a", "b"], rounds=1, depth=1), folds=2)
    assert {r.coverage for r in told.collect()} == {0, 1}


def test_boosting_edges(spark):
    schema = "series long, bar_id long, a double, b double, label int"
    with pytest.raises(ValueError, match="no training rows"):
        boosting.boost(spark.createDataFrame([], schema), ["a", "b"])
    one = boosting.boost(spark.createDataFrame([(1, i, 5.0, None, 7) for i in range(5)], schema), ["a", "b"], rounds=1)
    assert [r.prediction for r in one.transform(spark.createDataFrame([(1, 9, None, 2.0, None)], schema)).collect()] == [7]


def plain_merges(far, method):
    groups = {i: [i] for i in range(len(far))}
    out = []
    while len(groups) > 1:
        def apart(a, b):
            if method == "ward":  # growth of the sum of squares, as a distance
                square = far**2
                inner = lambda g: sum(square[i, j] for i, j in itertools.combinations(g, 2)) / len(g)
                return np.sqrt(max(0, 2 * (inner(a + b) - inner(a) - inner(b))))
            pairs = far[np.ix_(a, b)]
            return {"average": pairs.mean, "single": pairs.min, "complete": pairs.max}[method]()

        d, i, j = min((apart(groups[i], groups[j]), i, j) for i, j in itertools.combinations(groups, 2))
        groups[len(far) + len(out)] = groups.pop(i) + groups.pop(j)
        out.append((min(i, j), max(i, j), d, len(groups[len(far) + len(out)])))
    return out


@pytest.mark.parametrize("method", ["average", "single", "complete", "ward"])
def test_merges(method):
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 14):
        p = rng.standard_normal((n, 3))
        far = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        got, want = linkage.merges(far, method), plain_merges(far, method)
        assert [(a, b, s) for a, b, _, s in got] == [(a, b, s) for a, b, _, s in want]
        assert np.allclose([m[2] for m in got], [m[2] for m in want])
        cuts = [linkage.flat(got, n, k) for k in range(1, n + 1)]
        assert [len(set(c)) for c in cuts] == list(range(1, n + 1))
        for fine, coarse in zip(cuts[1:], cuts):  # nested
            assert len(set(zip(fine, coarse))) == len(set(fine))
        if n > 2:
            assert linkage.flat(got, n, height=(got[0][2] + got[1][2]) / 2) == cuts[n - 2]


def test_feature_trees(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 2))
    rows = [tuple(float(v) for v in (a, a + 0.1 * n[0], -a + 0.1 * n[1], b, b + 0.2 * n[2], 1.0)) for (a, b), n in zip(base, rng.standard_normal((300, 3)))]
    df, names = spark.createDataFrame(rows, "a1 double, a2 double, a3 double, b1 double, b2 double, flat double"), ["a1", "a2", "a3", "b1", "b2", "flat"]
    best = [r for r in linkage.numbers_of_groups(df, names).collect() if r.best]
    assert [r.k for r in best] == [3]
    got = {r.feature: (r.cluster, r.silhouette) for r in linkage.cut_tree(df, names, k=3).collect()}
    assert [got[c][0] for c in names] == [0, 0, 0, 1, 1, 2] and got["a1"][1] > 0.5 and got["flat"][1] == 0
    assert [c for c in linkage.cut_tree(df, names, height=0.5, method="ward").toPandas()["cluster"]] == [0, 0, 0, 1, 1, 2]
    assert linkage.feature_tree(df, names).count() == 5
