"""Series cut into many slices give what a plain loop over the whole series gives."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import convolution, running, slices
from tickloom.operators import bars, cleaning, features, indicators, labels


def plain_bars(p, v, threshold, span=None, factors=(0.5, 2.0)):
    out, total, start, average, now = [], 0.0, 0, threshold, threshold
    for i in range(len(p)):
        total += p[i] * v[i]
        if total >= now:
            out.append((start, i + 1 - start, max(p[start : i + 1]), min(p[start : i + 1]), p[start], p[i], total, now))
            if span is not None:
                a = 2 / (span + 1)
                average = a * total + (1 - a) * average
                now = min(max(average, factors[0] * threshold), factors[1] * threshold)
            total, start = 0.0, i + 1
    return out


def tape_of(spark, series):
    """A shuffled tape of {series: (prices, amounts)}."""
    rows = pd.concat([pd.DataFrame({"series": k, "seq": range(len(p)), "price": p, "amount": v}) for k, (p, v) in series.items()])
    return spark.createDataFrame(rows.sample(frac=1, random_state=1)).withColumn("ts", F.timestamp_seconds("seq"))


def close(a, b):
    return all(x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(a, b, strict=True))


RNG = np.random.default_rng(3)
N = 3000
TAPES = {
    "random": (RNG.random(N) * 10, RNG.random(N)), "tenths": (np.full(N, 0.1), np.ones(N)), "half_zero": (np.where(RNG.random(N) < 0.5, 0.0, RNG.random(N)), RNG.random(N)),
    "heavy": (np.exp(RNG.standard_normal(N) * 2), np.exp(RNG.standard_normal(N))), "huge_tick": (np.where(np.arange(N) == 1500, 1e6, 1.0), np.ones(N)),
}


@pytest.mark.parametrize("many", [3, 60, 900])
@pytest.mark.parametrize("name", sorted(TAPES))
def test_fixed_bars(spark, name, many):
    p, v = TAPES[name]
    tape = tape_of(spark, {1: (p, v), 2: (p[:70], v[:70]), 3: (v, p)})
    known = {r.series: r.threshold for r in bars.threshold_for(tape, many).collect()}
    got = bars.dollar_bars(tape, many, slices=16).orderBy("series", "bar_id").collect()
    for k, (a, b) in {1: (p, v), 2: (p[:70], v[:70]), 3: (v, p)}.items():
        own, want = [r for r in got if r.series == k], plain_bars(a, b, known[k])
        assert [r.bar_id for r in own] == list(range(len(want)))
        assert all(close((int(r.ts_open.timestamp()), r.n_ticks, r.high, r.low, r.open, r.close, r.cum_dollar, r.threshold_used), w) for r, w in zip(own, want))


@pytest.mark.parametrize("many,span", [(20, 100), (900, 5)])
@pytest.mark.parametrize("name", ["random", "tenths", "heavy"])
def test_adaptive_bars(spark, name, many, span):
    p, v = TAPES[name]
    tape = tape_of(spark, {1: (p, v), 2: (p[:70], v[:70]), 3: (v, p)})
    known = {r.series: r.threshold for r in bars.threshold_for(tape, many).collect()}
    got = bars.dollar_bars(tape, many, True, span, slices=16).orderBy("series", "bar_id").collect()
    for k, (a, b) in {1: (p, v), 2: (p[:70], v[:70]), 3: (v, p)}.items():
        own, want = [r for r in got if r.series == k], plain_bars(a, b, known[k], span)
        assert len(own) == len(want)
        assert all(close((int(r.ts_open.timestamp()), r.n_ticks, r.high, r.low, r.open, r.close, r.cum_dollar, r.threshold_used), w) for r, w in zip(own, want))


def test_open_bars_and_slices_without_an_edge(spark):
    tape = tape_of(spark, {1: (np.ones(100), np.ones(100))})
    got = bars.dollar_bars(tape, 1, keep_last=True, slices=16).collect()
    assert [(r.bar_id, r.n_ticks, r.cum_dollar, r.volume) for r in got] == [(0, 100, 100.0, 100.0)]
    got = bars.dollar_bars(tape.withColumn("amount", F.when(F.col("seq") == 99, 0.5).otherwise(F.col("amount"))), 3, keep_last=True, slices=16).orderBy("bar_id").collect()
    assert [r.n_ticks for r in got] == [34, 34, 32] and sum(r.volume for r in got) == 99.5


def test_tables_compose():
    rng = np.random.default_rng(1)
    for _ in range(200):
        parts = [rng.random(rng.integers(1, 9)) * rng.choice([0.1, 1, 4]) for _ in range(4)]
        table = bars.table_of(parts[0], 3.0)
        for part in parts[1:]:
            table = bars.then(table, bars.table_of(part, 3.0))
        for value in rng.random(20) * 3:
            total, n = value, 0
            for x in np.concatenate(parts):
                total += x
                if total >= 3.0:
                    total, n = 0.0, n + 1
            end, closed = bars.look_up(table, np.array([value]))
            assert math.isclose(end[0], total, abs_tol=1e-9) and closed[0] == n


def test_scan():
    b = RNG.standard_normal(5000)
    for keep in (0.0, 0.3, 0.98, 0.9999, 1.0):
        y, want = 0.5, []
        for x in b:
            y = keep * y + x
            want.append(y)
        assert np.allclose(slices.scan(keep, b, 0.5), want, rtol=1e-9, atol=1e-9)


def bars_frame(spark, n=400, series=(1, 2, 3)):
    rng = np.random.default_rng(5)
    out = []
    for k in series:
        size = n if k == 1 else n // 7
        c = 100 + np.cumsum(rng.standard_normal(size))
        r = np.concatenate([[np.nan], np.diff(np.log(c))])
        r[rng.random(size) < 0.05] = np.nan
        out.append(pd.DataFrame({"series": k, "bar_id": range(size), "close": c, "high": c + rng.random(size), "low": c - rng.random(size), "open": c, "volume": rng.random(size), "log_return": r}))
    df = pd.concat(out)
    return df, spark.createDataFrame(df).withColumn("log_return", F.when(~F.isnan("log_return"), F.col("log_return")))


@pytest.mark.parametrize("cuts", [1, 16])
def test_ewm_volatility(spark, cuts):
    pdf, df = bars_frame(spark)
    got = labels.ewm_volatility(df, 20, 5, slices=cuts).toPandas().sort_values(["series", "bar_id"])
    want = pdf.groupby("series")["log_return"].transform(lambda r: r.ewm(span=20, min_periods=5).std())
    assert np.allclose(got["vol"].to_numpy(float), want.to_numpy(), rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("cuts", [1, 16])
def test_smooth(spark, cuts):
    pdf, df = bars_frame(spark)
    steps = [("a", "log_return", 0.1), ("b", "a", 0.5), ("c", lambda p: p["b"] - p["a"], None), ("d", "c", 0.2), ("e", "close", 1 / 14)]
    got = indicators.smooth(df, steps, slices=cuts).toPandas().sort_values(["series", "bar_id"], ignore_index=True)
    mean = lambda x, a: x.groupby(got["series"]).transform(lambda s: s.ewm(alpha=a, adjust=False, ignore_na=True).mean())
    x = got["log_return"].astype(float)
    a = mean(x, 0.1)
    b = mean(a, 0.5)
    for name, want in (("a", a), ("b", b), ("d", mean(b - a, 0.2)), ("e", mean(got["close"], 1 / 14))):
        assert np.allclose(got[name].astype(float), want, rtol=1e-9, equal_nan=True), name


def plain_quantiles(x, q, least):
    out, seen = [], []
    for v in x:
        if v == v:
            seen.append(v)
        out.append(np.quantile(seen, q) if len(seen) >= max(1, least) else np.nan)
    return np.array(out)


@pytest.mark.parametrize("cuts", [1, 16])
def test_prefix_quantiles(spark, cuts):
    rng = np.random.default_rng(6)
    parts = {1: rng.standard_normal(700).cumsum(), 2: rng.integers(0, 4, 300).astype(float), 3: np.ones(40), 4: rng.standard_normal(5), None: rng.standard_normal(200)}
    parts[1][rng.random(700) < 0.1] = np.nan
    rows = [(k, i, 2**60 + i, None if v != v else float(v)) for k, x in parts.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series long, bar_id long, big long, x double")
    sliced = slices.in_slices(df, "bar_id", slices=cuts)
    got = running.add_quantiles(sliced, "x", {"a": 0.5, "b": 0.95, "c": 0.0}, ("bar_id",), running.shape(sliced), 3).collect()
    assert len(got) == len(rows) and all(r.big == 2**60 + r.bar_id for r in got)
    for k, x in parts.items():
        own = sorted((r for r in got if r.series == k), key=lambda r: r.bar_id)
        for name, q in (("a", 0.5), ("b", 0.95), ("c", 0.0)):
            assert np.allclose(np.array([r[name] for r in own], float), plain_quantiles(x, q, 3), equal_nan=True), (k, name)


def test_near_the_median(spark):
    rng = np.random.default_rng(7)
    p = np.where(rng.random(900) < 0.03, 50.0, rng.standard_normal(900))
    tape = tape_of(spark, {1: (p, np.ones(900)), 2: (p[:50], np.ones(50))})
    for cuts in (1, 16):
        got = {(r.series, r.seq) for r in cleaning.drop_by_mad(tape, threshold=5.0, least=20, slices=cuts).collect()}
        want = set()
        for k, x in ((1, p), (2, p[:50])):
            middle = plain_quantiles(x, 0.5, 20)
            spread = plain_quantiles(np.abs(x - middle), 0.5, 20)
            want |= {(k, i) for i in range(len(x)) if not (spread[i] > 0 and abs(x[i] - middle[i]) > 5 * 1.4826 * spread[i])}
        assert got == want


def test_regime_is_the_same_for_any_cut(spark):
    _, df = bars_frame(spark)
    one, many = (sorted(map(tuple, features.volatility_regime(df, 5, least=10, slices=k).select("series", "bar_id", "vol_regime_75", "vol_regime_95").collect())) for k in (1, 16))
    assert one == many and any(r[2] for r in one)


def test_far_weights_and_blocks():
    for d in (0.3, 0.5, 1.7, -0.4, 1.0, 0.0):
        w = convolution.weights(d, 20_000)
        assert np.allclose(convolution.far_weights(d, np.arange(60.0, 20_000)), w[60:], rtol=1e-11, atol=1e-300)
    x, d, block = RNG.standard_normal(1000) + 5, 0.4, 64
    want = np.convolve(x, convolution.weights(d, 1000))[:1000]
    moments = np.array([x[i : i + block] @ convolution.basis(np.arange(len(x[i : i + block])), block) for i in range(0, 1000, block)])
    far = convolution.far_sums(moments, d, block)
    for b in range(len(moments)):
        own, before = x[b * block : (b + 1) * block], x[max(0, b - 1) * block : b * block]
        got = convolution.near_sums(own, before, convolution.weights(d, 2 * block)) + (convolution.basis(np.arange(len(own)), block) @ far[b] if b > 1 else 0)
        assert np.allclose(got, want[b * block : (b + 1) * block], rtol=1e-10, atol=1e-11)


def test_expanding_difference(spark):
    pdf, df = bars_frame(spark)
    df = df.withColumn("close", F.when((F.col("series") != 3) | (F.col("bar_id") != 30), F.col("close")))
    got = features.frac_diff_expanding(df, 0.4, 20, block=64, slices=16).toPandas().sort_values(["series", "bar_id"])
    for k in (1, 2, 3):
        own = pdf[pdf["series"] == k]
        want = np.convolve(np.log(own["close"]), convolution.weights(0.4, len(own)))[: len(own)]
        want[:19] = np.nan
        if k == 3:
            want[30:] = np.nan
        assert np.allclose(got[got["series"] == k]["frac_diff_expanding"].to_numpy(float), want, rtol=1e-9, equal_nan=True)


def test_running_zscore_is_the_frames(spark):
    rng = np.random.default_rng(9)
    p = np.where(rng.random(600) < 0.02, 40.0, rng.standard_normal(600))
    p[200:300] = 2.5
    tape = tape_of(spark, {1: (p, np.ones(600))})
    got = {r.seq for r in cleaning.drop_by_zscore(tape, 50, 3.0, 10).collect()}
    want = set()
    for i in range(600):
        f = p[max(0, i - 49) : i + 1]
        s = f.std(ddof=1) if len(f) > 1 else None
        if len(f) < 10 or s is None or ((f != f[0]).any() and abs(p[i] - f.mean()) <= 3 * s):
            want.add(i)
    assert got == want
