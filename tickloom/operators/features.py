"""Windowed features of bars. Every function adds columns to (series, bar_id, ...) bars; all of one pass share a sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.convolution import fractional_difference
from ..functions.frames import from_row, full, last, logarithm, order, over, previous, quotient, row, so_far
from ..functions.running import add_quantiles, shape
from ..functions.slices import SLICE, in_slices
from .indicators import smooth


#: Beginnings of names of columns that a lag adds nothing to: places in the calendar, states and sums of all that went before.
TIMELESS: set[str] = set()


def timeless(*names: str):
    """Declares such columns of a block."""

    def keep(block):
        TIMELESS.update(names)
        return block

    return keep


def R() -> Column:
    return F.col("log_return")


def C() -> Column:
    return F.col("close")


def momentum(bars: DataFrame, horizons=(1, 3, 5, 10, 20), extremes=(5, 10, 20)) -> DataFrame:
    """cum_return_k (row k needs all k returns, later rows skip nulls), max_return_k and min_return_k."""
    total = lambda k: F.when((row() > k) | ((row() == k) & (F.count(R()).over(last(k)) == k)), F.sum(R()).over(last(k)))
    cols = {f"cum_return_{k}": total(k) for k in horizons}
    cols |= {f"max_return_{k}": from_row(F.max(R()).over(last(k)), k) for k in extremes} | {f"min_return_{k}": from_row(F.min(R()).over(last(k)), k) for k in extremes}
    return bars.withColumns(cols)


def moving_averages(bars: DataFrame, windows=(5, 10, 20, 50), pairs=((5, 20), (10, 50))) -> DataFrame:
    """ma_k over full frames, and cross_ma_s_l, the sign of their difference."""
    ma = lambda k: full(F.avg, C(), k)
    return bars.withColumns({f"ma_{k}": ma(k) for k in windows} | {f"cross_ma_{s}_{n}": F.signum(ma(s) - ma(n)) for s, n in pairs})


def price_zscore(bars: DataFrame, windows=(10, 20, 50)) -> DataFrame:
    """Distance from the mean of the k rows before in their deviations; 0 while that deviation is null or tiny."""

    def z(k: int) -> Column:
        w = previous(k)
        std = full(F.stddev_samp, C(), k, w)
        return F.coalesce(F.when(std > 1e-10, (C() - F.avg(C()).over(w)) / std), F.lit(0.0))

    return bars.withColumns({f"price_zscore_{k}": z(k) for k in windows})


@timeless("return_streak")
def return_streak(bars: DataFrame) -> DataFrame:
    """Signed length of the current run of returns of one sign; 0 for a 0 return; a null repeats the run before it."""
    rows = bars.withColumn("__s", F.signum(R()))
    known = rows.withColumn("__prev", F.last(F.lag("__s").over(order()), True).over(so_far())).withColumn("__new", (F.col("__s").isNotNull() & (~F.col("__s").eqNullSafe(F.col("__prev")))).cast("int")).withColumn("__g", F.sum("__new").over(so_far()))
    run = Window.partitionBy("series", "__g").orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)
    streak = F.coalesce(F.last("__s", True).over(run) * F.count("__s").over(run), F.lit(0.0))
    return known.withColumn("return_streak", streak).drop("__s", "__prev", "__new", "__g")


def lags(df: DataFrame, columns: list[str], ks=(1, 5, 10, 15, 25, 50)) -> DataFrame:
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(order()) for c in columns for k in ks})


def future_return(df: DataFrame, target: str = "log_return") -> DataFrame:
    """The target of the next row; the last row of a series goes."""
    return df.withColumn("__next", F.lead("bar_id").over(order())).withColumn(target, F.lead(target).over(order())).where("__next is not null").drop("__next")


def realized(bars: DataFrame, horizons=(5, 10, 20), moments=(10, 20, 50)) -> DataFrame:
    """Realized volatility, return over volatility, and bias-corrected skewness and kurtosis over full frames."""
    vol = lambda k: F.sqrt(full(F.sum, R() * R(), k))
    ratio = lambda k: F.when(F.coalesce(vol(k) <= 1e-10, F.lit(True)), 0.0).otherwise(full(F.sum, R(), k) / vol(k))
    skew = lambda k: full(F.skewness, R(), k) * (math.sqrt(k * (k - 1)) / (k - 2))
    kurt = lambda k: (full(F.kurtosis, R(), k) * (k + 1) + 6) * ((k - 1) / ((k - 2) * (k - 3)))
    return bars.withColumns({f"realized_vol_{k}": vol(k) for k in horizons} | {f"return_vol_ratio_{k}": ratio(k) for k in horizons} | {f"realized_skew_{k}": skew(k) for k in moments} | {f"realized_kurt_{k}": kurt(k) for k in moments})


def jumps(bars: DataFrame, horizons=(10, 20)) -> DataFrame:
    """Bipower variation over the pairs inside a frame (from the row after it fills), and the jump part of realized variance."""
    rows = bars.withColumn("__p", F.abs(R()) * F.abs(F.lag(R()).over(order())))
    out = {}
    for k in horizons:
        pairs = last(k - 1)
        bv = F.when((row() > k) & (F.count("__p").over(pairs) >= k // 2), math.pi / 2 * F.sum("__p").over(pairs))
        rv = full(F.sum, R() * R(), k)
        jump = F.when(bv.isNotNull() & rv.isNotNull(), F.greatest(rv - bv, F.lit(0.0)))
        out |= {f"bipower_var_{k}": bv, f"jump_{k}": jump, f"jump_ratio_{k}": F.when(F.coalesce(rv <= 1e-15, F.lit(True)), 0.0).otherwise(jump / rv)}
    return rows.withColumns(out).drop("__p")


def range_volatility(bars: DataFrame, windows=(5, 10, 20)) -> DataFrame:
    """Parkinson, Garman-Klass, Rogers-Satchell and Yang-Zhang volatility, range and body ratios. Terms with a price of 0 or less are null."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    good = (o > 0) & (h > 0) & (lo > 0) & (c > 0)
    hl, co = F.log(over(h, lo)), F.log(over(c, o))
    rows = bars.withColumns({"__pk": F.when((h > 0) & (lo > 0), hl * hl / (4 * math.log(2))), "__gk": F.when(good, 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co), "__rs": F.when(good, F.log(over(h, c)) * F.log(over(h, o)) + F.log(over(lo, c)) * F.log(over(lo, o))), "__on": F.log(over(o, F.lag("close").over(order()))), "__co": F.when(good, co)})
    floor, out = lambda x: F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0)))), {}
    for k in windows:
        w = last(k)
        mean = lambda x: from_row(F.avg(x).over(w), k)  # noqa: B023, E731
        kappa = 0.34 / (1.34 + (k + 1) / (k - 1))
        yz = F.var_samp("__on").over(w) + kappa * F.var_samp("__co").over(w) + (1 - kappa) * F.avg("__rs").over(w)
        out |= {f"parkinson_vol_{k}": F.sqrt(mean("__pk")), f"garman_klass_vol_{k}": floor(mean("__gk")), f"rogers_satchell_vol_{k}": floor(mean("__rs")), f"yang_zhang_vol_{k}": F.when((row() > k) & (F.count("__on").over(w) >= 2), floor(yz))}
    out |= {"range_ratio": F.when(c > 0, over(h - lo, c)), "body_ratio": F.when(c > 0, F.when(h - lo > 1e-10, over(F.abs(c - o), h - lo)).otherwise(0.0))}
    return rows.withColumns(out).drop("__pk", "__gk", "__rs", "__on", "__co")


def order_flow(bars: DataFrame, window: int = 50) -> DataFrame:
    """vpin and Kyle's lambda: the slope of price changes on signed volume, null unless the frame is full."""
    b, s, w = F.col("v_buy"), F.col("v_sell"), last(window)
    rows = bars.withColumns({"__d": C() - F.lag("close").over(order()), "__v": b - s})
    total = F.sum(b + s).over(w)
    spread = F.var_pop("__v").over(w) * window
    cols = {f"vpin_{window}": F.when((row() >= window) & (total > 0), over(F.sum(F.abs(b - s)).over(w), total)), f"kyle_lambda_{window}": F.when((F.count("__d").over(w) >= window) & (spread >= 1e-10), over(F.covar_pop("__v", "__d").over(w), F.var_pop("__v").over(w)))}
    return rows.withColumns(cols).drop("__d", "__v")


@timeless("hour_", "day_", "dow_", "month_")
def calendar(bars: DataFrame, ts: str = "ts_close") -> DataFrame:
    """Hour with minutes, weekday (Monday 0), month day, ISO week, month, quarter; sines and cosines of hour, weekday, month."""
    t = F.col(ts)
    hour, dow, month = F.hour(t) + F.minute(t) / 60, F.weekday(t), F.month(t)
    turn = lambda x, n: 2 * math.pi * x / n
    return bars.withColumns({"hour": hour, "day_of_week": dow, "day_of_month": F.dayofmonth(t), "week": F.weekofyear(t), "month": month, "quarter": F.quarter(t), "hour_sin": F.sin(turn(hour, 24)), "hour_cos": F.cos(turn(hour, 24)), "dow_sin": F.sin(turn(dow, 7)), "dow_cos": F.cos(turn(dow, 7)), "month_sin": F.sin(turn(month, 12)), "month_cos": F.cos(turn(month, 12))})


@timeless("rolling_max", "rolling_min", "drawdown", "drawup", "crash_")
def drawdowns(bars: DataFrame, crashes=(0.05, 0.10, 0.20)) -> DataFrame:
    """Running extremes, distances from them, rows since them, and crash flags."""
    w = so_far()
    top, low = F.max(C()).over(w), F.min(C()).over(w)
    rows = bars.withColumns({"rolling_max": top, "rolling_min": low})
    rows = rows.withColumns({"__t": F.when(F.coalesce(C() > F.lag("rolling_max").over(order()), F.lit(True)), F.col("bar_id")), "__l": F.when(F.coalesce(C() < F.lag("rolling_min").over(order()), F.lit(True)), F.col("bar_id"))})
    dd = over(C(), F.col("rolling_max")) - 1
    cols = {"drawdown": dd, "drawup": quotient(C(), F.col("rolling_min")) - 1, "bars_since_high": F.col("bar_id") - F.last("__t", True).over(w), "bars_since_low": F.col("bar_id") - F.last("__l", True).over(w)}
    return rows.withColumns(cols | {f"crash_{round(100 * x)}pct": (dd <= -x).cast("int") for x in crashes}).drop("__t", "__l")


def since_shock(bars: DataFrame, threshold: float, name: str = "bars_since_shock") -> DataFrame:
    """Rows since the last absolute return over ``threshold``; before any, since the start."""
    hit = F.last(F.when(F.abs(R()) > threshold, row()), True).over(so_far())
    return bars.withColumn(name, F.coalesce(row() - hit, row() - 1))


@timeless("vol_regime_", "vol_zscore")
def volatility_regime(bars: DataFrame, window: int = 20, quantiles=(0.75, 0.90, 0.95), least: int = 40, slices: int | None = None) -> DataFrame:
    """Rolling deviation of returns, flags of whether it is over the quantiles of all so far, and its z-score among all so far.

    The quantiles are exact and taken by slices of time (``functions/running.py``). Runs jobs while the plan is built.
    """
    rows = bars.withColumn("volatility", full(F.stddev_samp, R(), window, least=2))
    v, w = F.col("volatility"), so_far()
    std = F.stddev_samp(v).over(w)
    rows = rows.withColumn("vol_zscore", F.when((F.count(v).over(w) >= least) & (std > 1e-10), (v - F.avg(v).over(w)) / std))
    names = {f"vol_regime_{round(100 * q)}": q for q in quantiles}
    sliced = in_slices(rows, "bar_id", slices=slices)
    found = add_quantiles(sliced, "volatility", {f"__{n}": q for n, q in names.items()}, ("bar_id",), shape(sliced), least)
    return found.withColumns({n: F.coalesce((v > F.col(f"__{n}")) & ~F.isnan(v), F.lit(False)).cast("int") for n in names}).drop(SLICE, *[f"__{n}" for n in names])


def durations(bars: DataFrame) -> DataFrame:
    """bar_duration_ts and time_gap_bars in seconds; the first gap of a series is 0."""
    seconds = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6
    gap = seconds(F.lag("ts_close").over(order()), F.col("ts_open"))
    return bars.withColumns({"bar_duration_ts": seconds(F.col("ts_open"), F.col("ts_close")), "time_gap_bars": F.coalesce(gap, F.lit(0.0))})


def acceleration(bars: DataFrame, column: str = "bar_duration_ts", span: int | None = None) -> DataFrame:
    """temporal_acceleration: the duration before less the own one; temporal_jerk: how it changes. With a span also temporal_acceleration_smooth, of
    exponential averages that start at a series' first value; a null repeats the average before it."""
    d = F.col(column)
    rows = bars.withColumn("temporal_acceleration", F.lag(d).over(order()) - d)
    rows = rows.withColumn("temporal_jerk", F.col("temporal_acceleration") - F.lag("temporal_acceleration").over(order()))
    if span is None:
        return rows
    rows = smooth(rows, [("__ema", column, 2.0 / (span + 1.0))])
    return rows.withColumn("temporal_acceleration_smooth", F.lag("__ema").over(order()) - F.col("__ema")).drop("__ema")


def planned_lags(df: DataFrame, columns: list[str], ks=(1, 5, 10, 15, 25, 50)) -> DataFrame:
    """Lags of the columns that no block declares to say all at their own time (``timeless``)."""
    return lags(df, [c for c in columns if not c.startswith(tuple(TIMELESS))], ks)


def rolling_spearman(df: DataFrame, a: str, b: str, k: int = 50) -> DataFrame:
    """spearman_wk: correlation of the ranks of two columns in a frame of k rows; ties are ranked in order of rows; null unless the frame has k rows and no null."""
    pair = F.collect_list(F.struct(F.col(a).alias("x"), F.col(b).alias("y"))).over(last(k))
    rank = lambda p, i: F.size(F.filter("__w", lambda q, j: (q[i] < p[i])))
    tied = lambda p, i, at: F.size(F.filter("__w", lambda q, j: (q[i] == p[i]) & (j < at)))
    far = F.transform("__w", lambda p, at: F.pow((rank(p, "x") + tied(p, "x", at) - rank(p, "y") - tied(p, "y", at)).cast("double"), 2))
    total = F.aggregate(far, F.lit(0.0), lambda s, x: s + x)
    good = (F.size("__w") == k) & F.forall("__w", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return df.withColumn("__w", pair).withColumn(f"spearman_w{k}", F.when(good, 1 - 6 * total / (k * (k * k - 1)))).drop("__w")


def rolling_zscore(df: DataFrame, columns: list[str], window: int = 100, least: int = 10) -> DataFrame:
    def z(c: str) -> Column:
        w = last(window)
        std = F.stddev_samp(c).over(w)
        return F.when(F.count(c).over(w) < least, F.lit(None)).when(F.coalesce(std <= 1e-10, F.lit(True)), 0.0).otherwise((F.col(c) - F.avg(c).over(w)) / std)

    return df.withColumns({f"{c}_zscore": z(c) for c in columns})


def frac_diff(bars: DataFrame, d: float = 0.5, size: int = 20, name: str | None = None) -> DataFrame:
    """Fractional difference of log price with the first ``size`` weights; null while the frame isn't full."""
    weights = [1.0]
    for k in range(1, size):
        weights.append(-weights[-1] * (d - k + 1) / k)
    x = logarithm(C())
    terms = sum((F.lit(v) * F.lag(x, k).over(order()) for k, v in enumerate(weights) if k), start=x * weights[0])
    return bars.withColumn(name or f"frac_diff_d{round(10 * d):02d}", terms)


@timeless("frac_diff")
def frac_diff_expanding(bars: DataFrame, d: float = 0.5, least: int = 20, name: str = "frac_diff_expanding", block: int | None = None, slices: int | None = None) -> DataFrame:
    """Fractional difference of log price with weights over all history; null before ``least`` rows and from the first unknown price on.
    A price of 0 makes its row and all later ones infinite, by the sign of its weight there, or NaN where two such disagree.

    Each row's sum is over all rows before it; ``functions/convolution.py`` takes all of them in n log n. Rows are known by (series, bar_id). Runs jobs while the plan is built.
    """
    found = fractional_difference(bars.select("series", "bar_id", F.log(F.when(C() == 0, 1.0).otherwise(C())).alias("x")), "bar_id", d, block, slices)
    value = found.select(F.col("series").alias("__series"), F.col("bar_id").alias("__bar"), F.when(F.col("pos") >= least - 1, F.col("y")).alias(name))
    # beyond d all weights have one sign
    zero, edge, signs = F.coalesce((C() == 0).cast("int"), F.lit(0)), math.ceil(abs(d)) + 1, [1.0]
    for k in range(edge + 1):
        signs.append(-signs[-1] * (d - k) / (k + 1))
    met = [F.coalesce(F.lag("__zero", k).over(order()), F.lit(0)) for k in range(edge + 1)] + [F.coalesce(F.max("__zero").over(order().rowsBetween(Window.unboundedPreceding, -edge - 1)), F.lit(0))]
    infinite = sum((F.when(m > 0, -w * float("inf")).otherwise(0.0) for m, w in zip(met, signs)), start=F.lit(0.0))
    marked = bars.withColumn("__zero", zero).withColumn("__infinite", infinite).drop("__zero")
    joined = marked.join(value, F.col("series").eqNullSafe(F.col("__series")) & (F.col("bar_id") == F.col("__bar")), "left")
    return joined.withColumn(name, F.col(name) + F.col("__infinite")).drop("__series", "__bar", "__infinite")


def entropy(bars: DataFrame, window: int = 50, bins: int = 10) -> DataFrame:
    """Shannon entropy of a frame's returns in equal-width bins; half a frame of values is needed."""
    w = last(window)
    rows = bars.withColumns({"__x": F.collect_list("log_return").over(w)})
    low, high, n = F.array_min("__x"), F.array_max("__x"), F.size("__x")
    bin_of = F.transform("__x", lambda v: F.least(F.floor(over(v - low, high - low) * bins), F.lit(bins - 1)))
    share = lambda b: F.size(F.filter(bin_of, lambda v: v == b)) / n
    terms = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.when(share(b) > 0, -share(b) * F.log(share(b))).otherwise(0.0))
    value = F.when((row() < window) | (n < window // 2), F.lit(None)).when(high == low, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t))
    return rows.withColumn(f"shannon_entropy_{window}", value).drop("__x")
