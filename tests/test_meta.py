"""Meta-labels and their metrics against plain counts, and order in time."""

import numpy as np
import pytest

from tickloom.operators import evaluation, models


def test_binary_metrics(spark):
    rng = np.random.default_rng(1)
    t, s = rng.integers(0, 2, 80), rng.integers(0, 6, 80) / 5
    g = (s > 0.5).astype(int)
    df = spark.createDataFrame([*[(int(a), int(b), float(c)) for a, b, c in zip(t, g, s)], (None, 1, 0.5)], "t int, g int, s double")
    r = evaluation.binary_metrics(df, "t", "g", "s").first()
    pairs = [(a, b) for a in s[t == 1] for b in s[t == 0]]
    auc = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    hit = int(((t == 1) & (g == 1)).sum())
    assert r.n == 80 and np.allclose([r.accuracy, r.precision, r.recall, r.auc], [(t == g).mean(), hit / g.sum(), hit / t.sum(), auc])
    assert np.isclose(r.f1, 2 * r.precision * r.recall / (r.precision + r.recall))
    one = evaluation.binary_metrics(df.where("t = 1 and g = 0"), "t", "g", "s").first()
    assert one.auc is None and one.precision is None and one.recall == 0
    assert evaluation.binary_metrics(df.limit(0), "t", "g").first().n == 0


def test_meta_features_take_medians(spark):
    schema = "series long, bar_id long, a double, b double, label int, prediction int, coverage int"
    rows = [(1, 1, 1.0, None, 1, 1, 1), (1, 2, None, None, -1, 1, 1), (1, 3, 3.0, None, 0, 0, 1), (1, 4, float("nan"), None, 1, -1, 0), (1, 5, 7.0, None, -1, -1, 1)]
    df = spark.createDataFrame(rows, schema)
    got = [(r.bar_id, r.a, r.b, r.meta_label) for r in models.meta_features(df, ["a", "b"]).orderBy("bar_id").collect()]
    assert got == [(1, 1.0, 0.0, 1), (2, 4.0, 0.0, 0), (5, 7.0, 0.0, 1)]
    assert models.meta_features(df, ["a"], directional=False).count() == 4 and models.meta_features(df.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize("back", [False, True])
def test_temporal_order(spark, back):
    rows = [(1, i, i if not back or i != 5 else 2) for i in range(9)] + [(2, 0, None), (2, 1, 5)]
    got = {r.series: tuple(r)[1:] for r in evaluation.temporal_order(spark.createDataFrame(rows, "series long, bar_id long, ts long")).collect()}
    assert got == {1: (9, int(back), not back), 2: (2, 0, True)}
    split = spark.createDataFrame([(1, 3, "train"), (1, 4, "test"), (2, 4, "train"), (2, 4, "test"), (3, 1, "train")], "series long, ts long, split string")
    assert {r.series: r.apart for r in evaluation.temporal_split(split).collect()} == {1: True, 2: False, 3: None}
