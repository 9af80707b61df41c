"""Merged statistics, dependence, paths of a baseline and the table of features, on small rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import dependence, evaluation, incremental
from tickloom.plans import feature_table

from .test_edges import PRICES, bars_of

NAN = float("nan")


def test_merged_scalers(spark, tmp_path):
    rows = [(i % 4, None if i % 7 == 0 else NAN if i % 11 == 0 else i * 1.5 - 9, 2.0, None) for i in range(60)]
    df = spark.createDataFrame(rows, "batch int, x double, flat double, none double")
    parts = None
    for b in (0, 1, 2, 3, 9):  # the last is empty
        part = incremental.moments(df.where(F.col("batch") == b), ["x", "flat", "none"])
        parts = part if parts is None else parts.unionByName(part)
    met = {r["feature"]: r for r in incremental.merge(parts).collect()}
    known = np.array([r[1] for r in rows if r[1] is not None and r[1] == r[1]])
    assert met["x"]["n"] == len(known) and met["none"]["n"] == 0 and met["none"]["mean"] is None
    assert met["x"]["mean"] == pytest.approx(known.mean()) and met["x"]["m2"] == pytest.approx(((known - known.mean()) ** 2).sum())
    standard, ranged = incremental.standard_of(incremental.merge(parts)), incremental.minmax_of(incremental.merge(parts))
    assert standard.scale["x"] == pytest.approx(known.std(ddof=1)) and standard.scale["flat"] == standard.scale["none"] == 1.0
    assert ranged.shift["x"] - ranged.scale["x"] == pytest.approx(known.min()) and ranged.shift["x"] + ranged.scale["x"] == pytest.approx(known.max())
    for i, scaler in enumerate((standard, ranged)):
        incremental.save_scaler(spark, scaler, str(tmp_path / f"s{i}"))
        assert incremental.load_scaler(spark, str(tmp_path / f"s{i}")) == scaler


def test_merged_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3)) + 50
    x[:, 1] += 2 * x[:, 0]
    gaps = x.copy()
    gaps[::9, 1] = NAN
    df = spark.createDataFrame([(i % 3, *map(float, r), 7.0) for i, r in enumerate(gaps)], "batch int, a double, b double, c double, flat double")
    parts = None
    for b in range(3):
        part = incremental.co_moments(df.where(F.col("batch") == b), ["a", "b", "c", "flat"])
        parts = part if parts is None else parts.unionByName(part)
    got = incremental.components_of(parts, 0.7)
    filled = np.where(np.isnan(gaps), np.nanmean(gaps, axis=0), gaps)
    values = np.linalg.eigvalsh(np.block([[np.corrcoef(filled.T), np.zeros((3, 1))], [np.zeros((1, 3)), np.ones((1, 1))]]))[::-1]
    assert got.shares == pytest.approx(values[: len(got.shares)] / values.sum())
    out = got.transform(df, "g")
    assert out.columns == ["batch", *[f"pca_g_c{i}" for i in range(len(got.shares))]] and out.where(F.isnan("pca_g_c0") | F.col("pca_g_c0").isNull()).count() == 0


def test_mutual_information_sees_what_correlation_does_not(spark):
    rng = random.Random(2)
    rows = [(x, x * x, rng.random()) for x in (rng.uniform(-1, 1) for _ in range(600))]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (NAN, 1.0, 1.0)], "x double, y double, noise double")
    mi = {r["feature"]: r["mi"] for r in dependence.mutual_information(df, ["x", "noise"], "y").collect()}
    assert mi["x"] > 5 * mi["noise"] and mi["noise"] >= 0
    told = {r["feature"]: r for r in dependence.nonlinearity(df, ["x", "noise"], "y").collect()}
    assert abs(told["x"]["pearson"]) < 0.2 and told["x"]["score"] > 0.8 > told["noise"]["score"]


def test_least_order(spark):
    rng = np.random.default_rng(1)
    walk, noise = np.exp(np.cumsum(rng.normal(size=500)) / 50), np.exp(rng.normal(size=500))
    rows = [(s, i, float(v)) for s, x in enumerate((walk, noise)) for i, v in enumerate(x)]
    got = {r["series"]: r["order"] for r in dependence.least_order(spark.createDataFrame(rows, "series long, bar_id long, close double")).collect()}
    assert 0 < got[0] <= 1 and got[1] == 0


@pytest.mark.parametrize("kind", sorted(PRICES))
def test_edges(spark, kind):
    bars = bars_of(spark, PRICES[kind])
    for result in (incremental.merge(incremental.moments(bars, ["close", "volume"])), dependence.mutual_information(bars, ["volume"], "close"), dependence.nonlinearity(bars, ["volume"], "close"), dependence.least_order(bars)):
        result.collect()
    if kind == "constant":
        assert [r["mi"] for r in dependence.mutual_information(bars, ["volume"], "close").collect()] == [0.0]
        assert [r["score"] for r in dependence.nonlinearity(bars, ["volume"], "close").collect()] == [None]


def test_markov_path(spark):
    train = [(1, i, v) for i, v in enumerate([0, 1, -1, 0, 1, -1, 0, 1])] + [(2, i, v) for i, v in enumerate([5, 5, 5])]
    test = [(s, 10 + i, None) for s in (1, 2, 3) for i in range(7)]
    schema = "series long, bar_id long, label int"
    got = evaluation.markov_path(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema)).orderBy("series", "bar_id").collect()
    after = {0: 1, 1: -1, -1: 0, 5: 5}
    for s, start in ((1, 1), (2, 5), (3, None)):
        here, want = start, []
        for _ in range(7):
            here = -1 if here is None else after[here]
            want.append(here)
        assert [r["prediction"] for r in got if r["series"] == s] == want
    none = evaluation.markov_path(spark.createDataFrame([], schema), spark.createDataFrame(test, schema)).collect()
    assert {r["prediction"] for r in none} == {None}


def test_feature_table(spark):
    rng = random.Random(3)
    price, closes = 50.0, []
    for _ in range(80):
        price *= 1 + rng.uniform(-0.02, 0.02)
        closes.append(price)
    bars = bars_of(spark, closes).drop("bar_duration_ts", "vol").withColumns({"volume": F.lit(1.0) + F.col("bar_id") % 7, "log_return": F.log(F.col("close") / (F.col("close") - 0.1))})
    made = feature_table.all_features(bars)
    assert max(Counter(made.columns).values()) == 1 and made.count() == 80
    alone = [set(block(bars).columns) - set(bars.columns) for block in (*feature_table.BLOCKS[:14], *feature_table.TECHNICAL)]
    assert {c for c, n in Counter(c for names in alone for c in names).items() if n > 1} == {"mfi_14"}
    table, standard, _ = feature_table.prepare(bars, feature_table.BLOCKS[:4], (1,), ["ma_20"])
    train = table.where("split = 'train'").agg(F.avg("ma_20").alias("m"), F.stddev("ma_20").alias("s")).first()
    assert table.count() == 80 - 19 - 1 and train["m"] == pytest.approx(0, abs=1e-9) and train["s"] == pytest.approx(1)
    assert not [c for c in standard.shift if c.startswith("cross_ma") or c == "log_return"]
    assert table.where(F.greatest(*[F.col(c).isNull().cast("int") for c in standard.shift]) == 1).count() == 0
