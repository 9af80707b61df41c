"""Zeros, constants, nulls, single rows and empty tables: a defined result, never an error."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tickloom.functions.frames import correlation
from tickloom.functions.running import Quantile
from tickloom.operators import analysis, bars, cleaning, evaluation, features, flow, indicators, labels, stats, transform
from tickloom.sources import tape

def tape_rows(prices):
    return [(s, i, 60 * i, p, a, "buy" if i % 2 else "sell") for s, (p_, a) in enumerate(((prices, 1.0), (prices, 0.0))) for i, p in enumerate(p_)]


def ticks_of(spark, prices):
    df = spark.createDataFrame(tape_rows(prices), "series long, seq long, t long, price double, amount double, side string")
    return df.select("series", "seq", F.timestamp_seconds("t").alias("ts"), "price", "amount", "side")


def bars_of(spark, closes):
    rows = [(1, i, 60 * i, 60 * i + 60, c, c, c, c, 0.0, 0.0, 0.0, 0.0 if i else None, 0.0 if c is not None else None, 60.0) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "series long, bar_id long, a long, b long, open double, high double, low double, close double, volume double, v_buy double, v_sell double, log_return double, vol double, bar_duration_ts double")
    return df.withColumns({"ts_open": F.timestamp_seconds("a"), "ts_close": F.timestamp_seconds("b")}).drop("a", "b")


TICK_OPS = {
    "jumps": cleaning.drop_jumps, "zscore": cleaning.drop_by_zscore, "mad": lambda t: cleaning.drop_by_mad(t, least=2), "value": lambda t: cleaning.drop_by_dollar_value(t, least=2), "volume": cleaning.drop_by_volume,
    "chain": lambda t: cleaning.clean(t)[-1][1], "first": lambda t: cleaning.first_of_each(t, ("series", "price")), "rule": flow.tick_rule, "imbalance": lambda t: flow.imbalance(flow.direct(t), ["series"]),
    "tick_bars": tape.tick_bars, "dollar": bars.dollar_bars, "adaptive": lambda t: bars.dollar_bars(t, adaptive=True, keep_last=True), "bounds": lambda t: bars.bounds_for(t, 5),
    "asof": lambda t: flow.bar_of_tick(t, tape.tick_bars(t, 3)), "intrabar": lambda t: flow.intrabar(t, tape.tick_bars(t, 3)),
}
BAR_OPS = {
    "momentum": features.momentum, "averages": features.moving_averages, "price_z": features.price_zscore, "streak": features.return_streak, "realized": features.realized, "jumps": features.jumps, "range": features.range_volatility,
    "flow": features.order_flow, "calendar": features.calendar, "drawdowns": features.drawdowns, "shock": lambda b: features.since_shock(b, 0.1), "regime": lambda b: features.volatility_regime(b, least=2), "roll_z": lambda b: features.rolling_zscore(b, ["volume"]),
    "frac": features.frac_diff, "frac_all": lambda b: features.frac_diff_expanding(b, least=2), "entropy": lambda b: features.entropy(b, 4), "durations": features.durations, "acceleration": lambda b: features.acceleration(b, span=3), "spearman_w": lambda b: features.rolling_spearman(b, "volume", "close", 3),
    "ta_momentum": indicators.momentum_indicators, "ta_volatility": indicators.volatility_indicators, "ta_trend": indicators.trend_indicators, "ta_volume": indicators.volume_indicators,
    "ewm": labels.ewm_volatility, "barrier": lambda b: labels.triple_barrier(b, "vol"), "economics": lambda b: labels.economics(labels.triple_barrier(b, "vol")), "touch": lambda b: labels.first_touch(b, labels.side_barriers(b.select("series", "bar_id", "vol", F.lit(1).alias("side")), 1.0, 1.0), 3),
    "corr": lambda b: stats.correlations(b, ["close", "volume"]), "spearman": lambda b: stats.spearman(b, "close", "volume"), "f": lambda b: stats.f_scores(b, ["volume", "close"], "close"), "acf": lambda b: stats.autocorrelation(b, "close", 2), "lb": lambda b: stats.ljung_box(b, "close", 2), "jb": lambda b: stats.jarque_bera(b, "close"),
    "mk": lambda b: stats.mann_kendall(b, "close"), "rolling_corr": lambda b: stats.rolling_correlation(b, "close", "volume", 3), "stability": lambda b: stats.stability(b, "close", 2), "quality": lambda b: stats.quality(b, ["close", "volume"]), "trend": lambda b: stats.linear_trend(b, "close"),
    "clusters": lambda b: stats.cluster_scores(b, ["close", "volume"], "series"), "outliers": lambda b: stats.embedding_outliers(b, "close", "volume"), "kendall": lambda b: analysis.kendall(b, "close", "volume"), "dcor": lambda b: analysis.distance_correlation(b, "close", "volume"),
    "expanding": lambda b: analysis.expanding_zscore(b, ["close"]), "scaled": analysis.volume_scaling, "kpss": lambda b: analysis.kpss(b, "close", 2), "pacf": lambda b: analysis.partial_autocorrelation(b, "close", 2), "split": transform.split_by_time, "log": lambda b: transform.signed_log(b, ["close"]),
    "fill": lambda b: cleaning.fill_forward(b, ["close"]), "incomplete": lambda b: cleaning.drop_first_incomplete(b, ["close"]), "backtest": lambda b: evaluation.backtest(b.withColumn("pos", F.lit(0.1)), "pos"), "folds": lambda b: evaluation.folds(b, 2, 0.0, 1, None),
}
PRICES = {"zeros": [0.0] * 12, "zero_between": [1.0, 0.0, 2.0, 0.0, 3.0, 1.0, 1.0, 5.0], "constant": [5.0] * 12, "single": [3.0], "empty": []}


@pytest.mark.parametrize("name", sorted(TICK_OPS))
def test_tick_operators(spark, name):
    for kind, prices in PRICES.items():
        TICK_OPS[name](ticks_of(spark, prices)).collect()
    TICK_OPS[name](ticks_of(spark, [1.0, None, 2.0])).collect()


@pytest.mark.parametrize("name", sorted(BAR_OPS))
def test_bar_operators(spark, name):
    for kind, closes in PRICES.items():
        BAR_OPS[name](bars_of(spark, closes)).collect()
    BAR_OPS[name](bars_of(spark, [1.0, None, 2.0, 0.0])).collect()


def test_constant_columns(spark):
    b = bars_of(spark, [5.0] * 12)
    assert b.agg(correlation("close", "bar_id").alias("r")).first().r is None
    assert {r.acf for r in stats.autocorrelation(b, "close", 2).collect()} == {None}
    assert analysis.kendall(b, "close", "bar_id").first().tau is None and analysis.distance_correlation(b, "close", "bar_id").first().dcor == 0
    assert all(r.constant and r.max_z is None for r in stats.quality(b, ["close"]).collect())


def test_running_quantile():
    rng = random.Random(1)
    for q in (0.0, 0.5, 0.75, 0.95, 1.0):
        run, seen = Quantile(q), []
        for _ in range(300):
            seen.append(rng.choice([rng.random(), 0.5]))
            run.push(seen[-1])
            s, at = sorted(seen), q * (len(seen) - 1)
            assert math.isclose(run.value(), s[int(at)] + (s[math.ceil(at)] - s[int(at)]) * (at - int(at)))


def test_bars_equal_a_plain_loop():
    rng = random.Random(2)
    p, v = [rng.random() for _ in range(500)], [rng.random() for _ in range(500)]
    want, start, total = [], 0, 0.0
    for i in range(500):
        total += p[i] * v[i]
        if total >= 3.0:
            want.append((start, i + 1 - start, total))
            start, total = i + 1, 0.0
    import numpy as np

    fold, got, at = bars.Fold(3.0, None, (0.0, math.inf)), [], 0
    for size in (1, 2, 7, 90, 400):
        got += fold.feed(np.arange(at, at + size), np.array(p[at : at + size]), np.array(v[at : at + size]))
        at += size
    assert [(g[1], g[10], g[8]) for g in got] == want and statistics.mean(g[10] for g in got) > 5


def test_concordance_with_ties(spark):
    rng = random.Random(3)
    rows = [(s, i, float(rng.randint(0, 9)), float(rng.randint(0, 9))) for s in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "series long, bar_id long, x double, y double")
    sign = lambda a: (a > 0) - (a < 0)
    for r in stats.mann_kendall(df, "x").collect():
        own = [x for s, _, x, _ in rows if s == r.series]
        assert r.s == sum(sign(own[j] - own[i]) for j in range(60) for i in range(j))


def test_splits_are_written_and_read(spark, tmp_path):
    df = transform.split_by_time(bars_of(spark, [float(i) for i in range(10)]))
    tape.write_splits(df, str(tmp_path / "s"))
    assert tape.read_split(spark, str(tmp_path / "s"), "train").count() == 8 and tape.read_split(spark, str(tmp_path / "s"), "test").count() == 2
    tape.write_subset(df, str(tmp_path / "f"), ["close"])
    assert spark.read.parquet(str(tmp_path / "f")).columns == ["series", "bar_id", "close"]
    with pytest.raises(KeyError, match="nothing"):
        tape.write_subset(df, str(tmp_path / "g"), ["nothing"])
