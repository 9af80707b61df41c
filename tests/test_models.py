"""Ridge against numpy, folds, and the greedy choice of columns."""

import numpy as np
import pytest

from tickloom.operators import evaluation, models, transform


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 2)) * [1, 40]
    label = np.where(x[:, 0] + x[:, 1] / 40 > 0.7, 1, np.where(x[:, 0] < -0.5, -1, 0))
    return x, label, spark.createDataFrame([(0, i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, label))], "series long, bar_id long, a double, b double, label int")


def test_ridge(data):
    x, label, df = data
    z = (x - x.mean(0)) / x.std(0)
    scores = np.stack([(t := np.where(label == c, 1.0, -1.0)).mean() + z @ np.linalg.solve(z.T @ z + 2 * np.eye(2), z.T @ (t - t.mean())) for c in (-1, 0, 1)], 1)
    got = models.ridge(df, ["a", "b"], alpha=2.0).transform(df).orderBy("bar_id").collect()
    assert [r["prediction"] for r in got] == (scores.argmax(1) - 1).tolist()
    e = np.exp(scores - scores.max(1, keepdims=True))
    assert np.allclose([r["proba"] for r in got], e / e.sum(1, keepdims=True))


def test_out_of_fold(data):
    df = data[2]
    seen = []

    class Last:
        def transform(self, rows):
            return evaluation.persistence(rows)

    def fit(train):
        seen.append(max(r["bar_id"] for r in train.collect()))
        return Last()

    told = models.out_of_fold(df, fit, folds=4, embargo=3).collect()
    assert seen == [14, 32, 50, 68] and len(told) == 90
    assert sorted(r["bar_id"] for r in told if not r["coverage"]) == list(range(18))


def test_boosted_trees_and_random_guess(data):
    df = data[2]
    told = models.trees(df, ["a", "b"], boosted=True, maxIter=3).transform(df)
    assert told.where("prediction = label").count() > 75
    assert {r["prediction"] for r in evaluation.random_guess(df, df).collect()} <= {-1, 0, 1}


def test_columns_to_drop():
    corr = [("a", "b", 0.9), ("a", "c", 0.2), ("b", "c", -0.95)]
    assert transform.columns_to_drop(corr, ["a", "b", "c"], 0.8) == ["b"]
    assert transform.columns_to_drop(corr, ["a", "b", "c"], 0.99) == []
