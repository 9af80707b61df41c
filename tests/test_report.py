"""Reports on features: measures are the operators', and odd tables give nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import analysis, stats
from tickloom.plans import report

SCHEMA = "series string, bar_id long, p double, q double, r double, flat double, y double"


def bars(spark, n=60):
    rng, rows = np.random.default_rng(9), []
    for k in ("a", "b"):
        x = rng.normal(size=(n, 3)).cumsum(axis=0)
        y = x[:, 0] ** 2 + rng.normal(size=n)
        rows += [(k, i, *map(float, x[i]), 1.0, float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_measures_are_those_of_the_operators(spark):
    df = bars(spark)
    got = {(r.analysis, r.measure, r.a, r.b, r.series): r.value for r in report.report(df, ["p", "q", "r"], "y").collect()}
    near = lambda x: pytest.approx(x, rel=1e-9, abs=1e-12)
    for r in stats.correlations(df, ["p", "q", "r", "y"]).collect():
        assert got["relations", "corr", r["a"], r["b"], None] == near(r["corr"])
    for r in stats.f_scores(df, ["p", "q", "r"], "y").collect():
        assert got["target", "f_score", r["feature"], "y", None] == near(r["f_score"])
    for r in stats.vif(df, ["p", "q", "r"]).collect():
        assert got["collinearity", "vif", r["feature"], None, None] == near(r["vif"])
    for c in ("p", "r"):
        for r in stats.autocorrelation(df, c).collect():
            assert got["time", "acf", c, str(r["lag"]), r["series"]] == near(r["acf"])
        for r in analysis.adf(df, c, choose=True).collect():
            assert got["stationarity", "statistic", c, None, r["series"]] == near(r["statistic"]) and got["stationarity", "lags", c, None, r["series"]] == r["lags"]
    assert sum(v for k, v in got.items() if k[:2] == ("components", "eigenvalue")) == near(3.0)
    assert {k[2] for k in got if k[:2] == ("groups", "cluster")} == {"p", "q", "r"}


def test_ranking(spark):
    found = report.report(bars(spark), ["p", "q", "r", "flat"], "y", (report.of_target, report.collinearity))
    rows = report.ranking(found).orderBy("place").collect()
    assert [r.place for r in rows] == [1, 2, 3, 4] and rows[-1].feature == "flat" and rows[-1].f_score is None
    assert [r.score for r in rows[:-1]] == sorted((r.score for r in rows[:-1]), reverse=True)


@pytest.mark.parametrize("kind", ["constant", "short", "nulls"])
def test_odd_tables(spark, kind):
    df = bars(spark, 2 if kind == "short" else 30)
    if kind == "nulls":
        df = df.withColumn("q", F.when(F.col("bar_id") % 3 > 0, F.col("q")))
    names = ["p", "q", "flat"] if kind == "constant" else ["p", "q"]
    got = report.report(df, names, "y", (report.relations, report.of_target, report.in_time)).collect()
    assert got and {r.a for r in got} >= set(names)
    assert all(r.value is None for r in got if r.a == "flat" and r.measure in ("pearson", "corr", "score", "f_score"))


def test_what_is_refused(spark):
    df = bars(spark, 3)
    for names, target in (([], "y"), (["p", "p"], "y"), (["p", "y"], "y")):
        with pytest.raises(ValueError):
            report.report(df, names, target)
    with pytest.raises(KeyError, match="nothing"):
        report.report(df, ["nothing"], "y")


def test_inflation_of_constants(spark):
    df = bars(spark)
    got = {r["feature"]: r["vif"] for r in stats.vif(df, ["p", "flat", "q"]).collect()}
    assert got["flat"] is None and got["p"] == pytest.approx({r["feature"]: r["vif"] for r in stats.vif(df, ["p", "q"]).collect()}["p"])
    assert [r["vif"] for r in stats.vif(df.limit(0), ["p", "q"]).collect()] == [None, None]
    assert {r["feature"]: r["vif"] for r in stats.vif(df, ["flat", "p"]).collect()} == {"flat": None, "p": pytest.approx(1.0)}
