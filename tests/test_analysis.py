"""The analysis operators that SQL can't state, against numpy."""

import math

import numpy as np
import pytest

from tickloom.functions import special
from tickloom.operators import analysis, stats


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(5)
    x, y = np.cumsum(rng.normal(size=120)), rng.normal(size=120)
    y[2:] += 0.6 * np.diff(x)[:-1]
    return x, y


@pytest.fixture(scope="module")
def frame(spark, made):
    return spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(*made))], "series long, bar_id long, x double, y double")


def ols(a, y):
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    r = y - a @ beta
    return beta, float(r @ r)


def test_tails():
    assert special.chi2_sf(3.0, 2) == pytest.approx(math.exp(-1.5)) and special.chi2_sf(40.0, 2) == pytest.approx(math.exp(-20))
    assert special.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6) and special.chi2_sf(0.0, 3) == 1
    assert special.f_sf(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.t_sf(1.0, 1) == pytest.approx(0.5) and special.t_sf(2.228139, 10) == pytest.approx(0.05, abs=1e-6)


def test_granger(frame, made):
    x, y = made
    for r in analysis.granger(frame, "x", "y", 3).collect():
        k = r["lag"]
        past = lambda v: np.stack([v[k - i : len(v) - i] for i in range(1, k + 1)], 1)  # noqa: B023, E731
        few = np.column_stack([np.ones(120 - k), past(y)])
        _, a = ols(few, y[k:])
        _, b = ols(np.column_stack([few, past(x)]), y[k:])
        assert r["f"] == pytest.approx((a - b) / k / (b / (120 - k - 2 * k - 1)), rel=1e-6)
        assert 0 <= r["p"] <= 1
    short = analysis.granger(frame.where("bar_id < 5"), "x", "y", 3).where("lag = 3").collect()
    assert [r["f"] for r in short] == [None]


@pytest.mark.parametrize("choose", [False, True])
def test_adf(frame, made, choose):
    x = made[0]
    d, found = np.diff(x), []
    for p in range(5) if choose else [4]:
        a = np.column_stack([np.ones(115), x[4:-1], *[d[4 - i : len(d) - i] for i in range(1, p + 1)]])
        beta, ssr = ols(a, d[4:])
        found.append((115 * math.log(ssr / 115) + 2 * (p + 2), p, beta[1] / math.sqrt(ssr / (115 - p - 2) * np.linalg.inv(a.T @ a)[1, 1])))
    r = analysis.adf(frame, "x", 4, choose).first()
    assert (r["n"], r["lags"]) == (115, min(found)[1]) and r["statistic"] == pytest.approx(min(found)[2], rel=1e-6)
    assert analysis.adf(frame, "y", 4).first()["stationary"] and not r["stationary"]


def test_partial_autocorrelation(frame, made):
    y = made[1] - made[1].mean()
    acf = [1.0, *[float(y[k:] @ y[:-k] / (y @ y)) for k in range(1, 6)]]
    got = {r["lag"]: r["pacf"] for r in analysis.partial_autocorrelation(frame, "y", 5).collect()}
    for k in range(1, 6):
        m = [[acf[abs(i - j)] for j in range(k)] for i in range(k)]
        assert got[k] == pytest.approx(np.linalg.solve(m, acf[1 : k + 1])[-1])


def test_groups_and_eigenvalues(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 300))
    rows = [(float(p), float(-p + e), float(q), float(q + f)) for p, q, e, f in zip(a, b, *rng.normal(scale=0.2, size=(2, 300)))]
    df = spark.createDataFrame(rows, "p double, n double, q double, r double")
    cluster = {r["feature"]: r["cluster"] for r in analysis.feature_groups(df, ["p", "n", "q", "r"]).collect()}
    assert cluster["p"] == cluster["n"] != cluster["q"] == cluster["r"]
    got = [r["eigenvalue"] for r in analysis.eigenvalues(df, ["p", "n", "q", "r"]).orderBy("component").collect()]
    assert got == pytest.approx(np.linalg.eigvalsh(np.corrcoef(np.array(rows).T))[::-1].tolist())


def test_cluster_scores_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, *(rng.normal(size=3) + k).tolist()) for k in range(9) for _ in range(1 if k == 8 else 12)] + [(None, 1.0, 1.0, 1.0), (3, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "label int, a double, b double, c double")
    v, of = np.array([r[1:] for r in rows[:-2]]), np.array([r[0] for r in rows[:-2]])
    far = ((v[:, None] - v[None]) ** 2).sum(2)
    scores = []
    for i, k in enumerate(of):
        own = far[i][(of == k) & (np.arange(len(of)) != i)]
        b = min(far[i][of == o].mean() for o in range(9) if o != k)
        scores.append((b - own.mean()) / max(b, own.mean()) if len(own) else 0.0)
    m = np.array([v[of == k].mean(0) for k in range(9)])
    s = np.array([np.sqrt(((v[of == k] - m[k]) ** 2).sum(1)).mean() for k in range(9)])
    worst = [max((s[i] + s[j]) / np.sqrt(((m[i] - m[j]) ** 2).sum()) for j in range(9) if j != i) for i in range(9)]
    for size in (stats.BLOCK, 12):  # all clusters in one array, and two in each
        monkeypatch.setattr(stats, "BLOCK", size)
        r = stats.cluster_scores(df, ["a", "b", "c"], "label").first()
        assert (r["n_clusters"], r["silhouette"], r["davies_bouldin"]) == (9, pytest.approx(np.mean(scores)), pytest.approx(np.mean(worst)))


def test_entropies_are_those_of_plain_counts():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(3, 30)), np.ones((1, 30)), np.tile([1.0, 2.0, 4.0], (1, 10))])
    apen, sampen = analysis.entropies(x)
    for row, a, s in zip(x, apen, sampen):
        if row.std() < 1e-10:
            assert (a, s) == (0, 0)
            continue
        z = (row - row.mean()) / row.std()
        like = lambda i, j, k: max(abs(z[i + t] - z[j + t]) for t in range(k)) <= 0.2  # noqa: B023, E731
        phi = [np.mean([math.log(np.mean([like(i, j, k) for j in range(31 - k)])) for i in range(31 - k)]) for k in (2, 3)]
        n = [sum(like(i, j, k) for i in range(28) for j in range(i)) for k in (2, 3)]
        assert a == pytest.approx(phi[0] - phi[1]) and s == pytest.approx(-math.log(n[1] / n[0]) if min(n) else math.log(30))
