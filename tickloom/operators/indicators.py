"""Technical indicators of bars (series, bar_id, open, high, low, close, volume).

A family has three parts: what hangs on the bar before or on all bars so far, in one narrow sort of the series; exponential and Wilder averages, linear recurrences that ``smooth`` takes
by slices of time; and windows of at most ``FAR`` bars, over pieces of series. Several families go through each part together (``prepared``, ``finished``). A value is null until its window is full, or its average has seen as many values as its length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import full, last, logarithm, order, over, quotient, row, so_far
from ..functions.pieces import MINE, in_pieces, of_pieces
from ..functions.slices import carry_beside, in_slices, stitch, summaries


def _cols() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("high", "low", "close", "volume"))


def _typical() -> Column:
    h, lo, c, _ = _cols()
    return (h + lo + c) / 3


def _before(c: str) -> Column:
    return F.lag(c).over(order())


def _over(a: Column, b: Column) -> Column:
    """a / b, null for a b of 0."""
    return F.when(b != 0, a / b)


Step = tuple[str, str | Callable[[pd.DataFrame], pd.Series], float | str | None]
#: In place of a step's weight: the number of values so far.
COUNT = "count"
#: The name of a row's number in its series, from 1; bars that windows look back on, and bars of a piece.
ROW, FAR, PIECE = "__row", 64, 4096


def smooth(bars: DataFrame, steps: list[Step], slices: int | None = None) -> DataFrame:
    """Add columns step by step: y = a * x + (1 - a) * y over a series in order, from its first x on; nulls keep y.

    A step is (name, x, a); x is a column, also one of an earlier step, or a function of earlier steps' columns, row by row; without a, y is x,
    and with ``COUNT`` the number of x that are there.

    Series are cut in time. Over n values that begin with x0, y becomes y0 + (1 - a)^n (y - x0), where y0 is what the values give alone: a slice is
    summed up by (n, x0, y0), and composing these gives the y with which each slice begins. Averages of averages take a pass for each level. Runs jobs
    while the plan is built; a task holds a batch and each average's last value.
    """
    sliced = in_slices(bars, "bar_id", slices=slices)
    level: dict[str, int] = {}
    for name, source, a in steps:  # a function may read all that comes before it
        below = level.get(source, 0) if isinstance(source, str) else max(level.values(), default=0)
        level[name] = below + (a is not None)

    def average(x: pd.Series, a: float, before: float) -> pd.Series:
        known = pd.concat([pd.Series([before]), x])
        return known.ewm(alpha=a, adjust=False, ignore_na=True).mean().iloc[1:]

    def add(pdf: pd.DataFrame, held: dict, top: int) -> pd.DataFrame:
        """The steps of all levels up to ``top``, from the last values in ``held``, which move on."""
        pdf = pdf.copy()
        for name, source, a in steps:
            if level[name] <= top:
                x = (pdf[source] if isinstance(source, str) else source(pdf)).astype(float)
                pdf[name] = x if a is None else held.get(name, 0.0) + x.notna().cumsum() if a == COUNT else average(x, a, held.get(name, float("nan")))
                if a is not None:
                    held[name] = pdf[name].iloc[-1]
        return pdf

    read = sorted({x for _, x, _ in steps if isinstance(x, str) and x not in level})
    states: dict[int, dict] = {}
    for top in range(1, max(level.values(), default=0) + 1):
        own = {name: (source, a) for name, source, a in steps if a is not None and level[name] == top}

        def feed(total, part, top=top, own=own):
            rows = add(part, total["held"], top - 1)
            for name, (source, a) in own.items():
                x = (rows[source] if isinstance(source, str) else source(rows)).astype(float)
                known = x.dropna()
                if a == COUNT:
                    total["own"][name] = total["own"].get(name, 0.0) + len(known)
                elif len(known):
                    n, first, y = total["own"].get(name, (0, float(known.iloc[0]), float("nan")))
                    total["own"][name] = (n + len(known), first, float(average(known, a, y).iloc[-1]))

        def advance(state, total, own=own):
            out = {}
            for name, (_, a) in own.items():
                if a == COUNT:
                    out[name] = (state or {}).get(name, 0.0) + total["own"].get(name, 0.0)
                    continue
                n, first, y = total["own"].get(name, (0, 0.0, float("nan")))
                before = (state or {}).get(name, float("nan"))
                out[name] = before if not n else y if before != before else y + (1 - a) ** n * (before - first)
            return out

        parts = summaries(sliced, read, lambda state: {"held": dict(state or {}), "own": {}}, feed, states)
        states = {k: states.get(k, {}) | v for k, v in stitch(parts, advance).items()}

    top = max(level.values(), default=0)

    def step(held, part):
        return add(part, held, top), held

    return carry_beside(sliced, states, lambda state: dict(state or {}), step, read, [name for name, _, _ in steps])


class Family(NamedTuple):
    """The parts of a family: columns before its averages, the averages, and the windows that give its indicators."""

    before: Callable[[DataFrame], DataFrame]
    steps: list[Step]
    after: Callable[[DataFrame], DataFrame]


def prepared(bars: DataFrame, families: Sequence[Family]) -> DataFrame:
    """Bars with what the families' windows need, and their number as ``ROW``. Runs jobs while the plan is built."""
    rows = bars
    for f in families:
        rows = f.before(rows)
    return smooth(rows, [(ROW, lambda p: pd.Series(1.0, p.index), COUNT), *[s for f in families for s in f.steps]])


def finished(df: DataFrame) -> DataFrame:
    """Without what only the families need."""
    return df.drop(*[c for c in df.columns if c.startswith("__") and c != MINE])


def _alone(bars: DataFrame, family: Family) -> DataFrame:
    pieces = in_pieces(prepared(bars, [family]), PIECE, FAR, at=F.col(ROW) - 1)
    return of_pieces(finished(family.after(pieces)))


def _counted(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({f"__n_{c}": F.count(c).over(so_far()) for c in columns})


def _seen(x: str, n: int, value: Column) -> Column:
    return F.when(F.col(f"__n_{x}") >= n, value)


def money_flow(n: int = 14) -> Column:
    """Share of typical price times volume in rows that rise, of those that rise or fall; needs __tp and __dtp."""
    flow = F.col("__tp") * F.col("volume")
    up, down = (F.sum(F.when(F.signum("__dtp") == s, flow).otherwise(0.0)).over(last(n)) for s in (1, -1))
    return F.when(F.count("__dtp").over(last(n)) >= n, 100 * _over(up, up + down))


def _before_momentum(bars: DataFrame) -> DataFrame:
    h, lo, c, _ = _cols()
    rows = bars.withColumns({"__d": c - _before("close"), "__pc": _before("close"), "__tp": _typical(), "__mid": (h + lo) / 2})
    rows = rows.withColumns({"__dtp": F.col("__tp") - _before("__tp"), "__up": F.greatest("__d", F.lit(0.0)), "__down": F.greatest(-F.col("__d"), F.lit(0.0)), "__bp": c - F.least("low", "__pc"), "__utr": F.greatest("high", "__pc") - F.least("low", "__pc")})
    rows = rows.withColumns({"__up": F.when(F.col("__d").isNotNull(), F.col("__up")), "__down": F.when(F.col("__d").isNotNull(), F.col("__down"))})
    return _counted(rows, "close", "__d")


_MOMENTUM: list[Step] = [(f"__{k}{n}", f"__{k}", 1 / n) for n in (14, 7) for k in ("up", "down")]
_MOMENTUM += [("__e12", "close", 2 / 13), ("__e26", "close", 2 / 27), ("__macd", lambda p: p["__e12"] - p["__e26"], None), ("__ppo", lambda p: 100 * p["__macd"] / p["__e26"].where(p["__e26"] != 0), None), ("__ms", "__macd", 0.2), ("__ps", "__ppo", 0.2)]


def _after_momentum(rows: DataFrame) -> DataFrame:
    h, lo, c, _ = _cols()
    high, low = F.max("high").over(last(14)), F.min("low").over(last(14))
    ready = F.count("close").over(last(14)) >= 14
    rows = rows.withColumn("stoch_k", F.when(ready, _over(100 * (c - low), high - low)))
    share = lambda n: over(full(F.sum, F.col("__bp"), n), F.sum("__utr").over(last(n)))
    out = {f"rsi_{n}": _seen("__d", n, F.when(F.col(f"__down{n}") == 0, 100.0).otherwise(100 - 100 / (1 + over(F.col(f"__up{n}"), F.col(f"__down{n}"))))) for n in (14, 7)}
    for name, x, s in (("macd", "__macd", "__ms"), ("ppo", "__ppo", "__ps")):
        out |= {name: _seen("close", 26, F.col(x)), f"{name}_signal": _seen("close", 34, F.col(s)), f"{name}_diff": _seen("close", 34, F.col(x) - F.col(s))}
    out |= {"stoch_d": full(F.avg, F.col("stoch_k"), 3), "williams_r": F.when(ready, _over(-100 * (high - c), high - low))}
    out |= {f"roc_{n}": 100 * (quotient(c, F.lag("close", n).over(order())) - 1) for n in (10, 20)}
    out |= {"awesome": full(F.avg, F.col("__mid"), 5) - full(F.avg, F.col("__mid"), 34), "ultimate": 100 * (4 * share(7) + 2 * share(14) + share(28)) / 7, "mfi_14": money_flow()}
    return rows.withColumns(out)


MOMENTUM = Family(_before_momentum, _MOMENTUM, _after_momentum)


def momentum_indicators(bars: DataFrame) -> DataFrame:
    """RSI (14, 7), MACD and PPO with signal and difference, stochastic and Williams %R (14), ROC (10, 20), awesome and ultimate oscillators, MFI (14)."""
    return _alone(bars, MOMENTUM)


def _before_volatility(bars: DataFrame) -> DataFrame:
    h, lo, _, _ = _cols()
    rows = bars.withColumn("__pc", _before("close"))
    return _counted(rows.withColumn("__tr", F.greatest(h - lo, F.abs(h - F.col("__pc")), F.abs(lo - F.col("__pc")))), "__tr")


def _after_volatility(rows: DataFrame) -> DataFrame:
    h, lo, c, _ = _cols()
    rows = rows.withColumn("__fall", 100 * (over(c, F.max("close").over(last(14))) - 1))
    mean, std = full(F.avg, c, 20), full(F.stddev_pop, c, 20)
    bands = {"bb": (mean - 2 * std, mean, mean + 2 * std), "kc": (full(F.avg, (4 * lo - 2 * h + c) / 3, 20), full(F.avg, _typical(), 20), full(F.avg, (4 * h - 2 * lo + c) / 3, 20))}
    low, high = full(F.min, lo, 20), full(F.max, h, 20)
    bands["dc"] = (low, low + (high - low) / 2, high)
    out = {}
    for k, (low, mid, high) in bands.items():
        out |= {f"{k}_low": low, f"{k}_mid": mid, f"{k}_high": high, f"{k}_width": 100 * over(high - low, F.avg("close").over(last(20)) if k == "dc" else mid), f"{k}_place": _over(c - low, high - low)}
    out |= {f"atr_{n}": _seen("__tr", n, F.col(f"__atr{n}")) for n in (14, 7)} | {"ulcer": F.sqrt(full(F.avg, F.col("__fall") ** 2, 14))}
    return rows.withColumns(out)


VOLATILITY = Family(_before_volatility, [(f"__atr{n}", "__tr", 1 / n) for n in (14, 7)], _after_volatility)


def volatility_indicators(bars: DataFrame) -> DataFrame:
    """Bollinger (20, 2), Keltner (20) and Donchian (20) bands with width and place, ATR (14, 7), ulcer index (14)."""
    return _alone(bars, VOLATILITY)


def _before_trend(bars: DataFrame) -> DataFrame:
    h, lo, _, _ = _cols()
    rows = bars.withColumns({"__pc": _before("close"), "__u": h - _before("high"), "__w": _before("low") - lo, "__tp": _typical(), "__hl": h - lo, "__vp": F.abs(h - _before("low")), "__vm": F.abs(lo - _before("high"))})
    move = lambda a, b: F.when(F.col("__pc").isNotNull(), F.when((F.col(a) > F.col(b)) & (F.col(a) > 0), F.col(a)).otherwise(0.0))
    rows = rows.withColumns({"__ttr": F.when(F.col("__pc").isNotNull(), F.greatest(h - lo, F.abs(h - F.col("__pc")), F.abs(lo - F.col("__pc")))), "__plus": move("__u", "__w"), "__minus": move("__w", "__u")})
    return _counted(rows, "close", "__ttr")


_TREND: list[Step] = [(f"__ema{n}", "close", 2 / (n + 1)) for n in (7, 14, 20, 50)]
_TREND += [("__str", "__ttr", 1 / 14), ("__sp", "__plus", 1 / 14), ("__sm", "__minus", 1 / 14), ("__dx", lambda p: (100 * (p["__sp"] - p["__sm"]).abs() / (p["__sp"] + p["__sm"])).where((p["__sp"] + p["__sm"] != 0) | p["__sp"].isna(), 0.0), None), ("__adx", "__dx", 1 / 14), ("__n___dx", "__dx", COUNT)]
_TREND += [("__t1", "close", 1 / 8), ("__t2", "__t1", 1 / 8), ("__t3", "__t2", 1 / 8), ("__m1", "__hl", 0.2), ("__m2", "__m1", 0.2), ("__mass", lambda p: p["__m1"] / p["__m2"].where(p["__m2"] != 0), None)]


def _after_trend(rows: DataFrame) -> DataFrame:
    h, lo, c, _ = _cols()
    out = {f"sma_{n}": full(F.avg, c, n) for n in (7, 14, 20, 50)} | {f"ema_{n}": _seen("close", n, F.col(f"__ema{n}")) for n in (7, 14, 20, 50)}
    out |= {"adx": _seen("__dx", 27, F.col("__adx")), "di_plus": _seen("__ttr", 14, 100 * _over(F.col("__sp"), F.col("__str"))), "di_minus": _seen("__ttr", 14, 100 * _over(F.col("__sm"), F.col("__str")))}
    far = last(26)
    since = lambda at: F.when(row() >= 26, 100 * (25 - (row() - at)) / 25)
    rows = rows.withColumn("__rn", row())
    out |= {"aroon_up": since(F.max(F.struct("high", "__rn")).over(far)["__rn"]), "aroon_down": since(-F.min(F.struct(F.col("low"), (-F.col("__rn")).alias("r"))).over(far)["r"])}
    for n in (14, 20):
        rows = rows.withColumns({f"__l{n}": F.collect_list("__tp").over(last(n)), f"__a{n}": full(F.avg, F.col("__tp"), n)})
        mean = F.col(f"__a{n}")
        spread = F.aggregate(F.transform(f"__l{n}", lambda x: F.abs(x - mean)), F.lit(0.0), lambda a, x: a + x) / n  # noqa: B023
        out[f"cci_{n}"] = _over(F.col("__tp") - F.col(f"__a{n}"), 0.015 * spread)
    out |= {"trix": 100 * _seen("close", 43, over(F.col("__t3"), F.lag("__t3").over(order())) - 1), "mass_index": F.when(row() >= 41, full(F.sum, F.col("__mass"), 25))}
    out |= {f"vortex_{k}": over(full(F.sum, F.col(x), 14), F.sum("__ttr").over(last(14))) for k, x in (("plus", "__vp"), ("minus", "__vm"))}
    mid = lambda n: (full(F.max, h, n) + full(F.min, lo, n)) / 2
    out |= {"dpo": F.lag("close", 11).over(order()) - full(F.avg, c, 20), "ichimoku_conversion": mid(9), "ichimoku_base": mid(26), "ichimoku_a": (mid(9) + mid(26)) / 2, "ichimoku_b": mid(52)}
    return rows.withColumns(out)


TREND = Family(_before_trend, _TREND, _after_trend)


def trend_indicators(bars: DataFrame) -> DataFrame:
    """SMA and EMA (7, 14, 20, 50), ADX with both directions (14), Aroon (25), CCI (14, 20), TRIX (15), vortex (14), mass index, DPO (20), Ichimoku."""
    return _alone(bars, TREND)


def _before_volume(bars: DataFrame) -> DataFrame:
    h, lo, c, v = _cols()
    rows = bars.withColumns({"__d": c - _before("close"), "__pc": _before("close"), "__pv": _before("volume"), "__tp": _typical(), "__mf": F.when(h == lo, 0.0).otherwise(over(2 * c - h - lo, h - lo)) * v, "__dm": (h + lo) / 2 - F.lag((h + lo) / 2).over(order())})
    rows = rows.withColumns({"__dtp": F.col("__tp") - _before("__tp"), "__f": F.col("__d") * v, "__n": F.when(v < F.col("__pv"), logarithm(quotient(c, F.col("__pc")))).otherwise(0.0)})
    w = so_far()
    sums = {"__obv": F.sum(F.coalesce(F.signum("__d"), F.lit(0.0)) * v).over(w), "__adi": F.sum("__mf").over(w), "__nvi": 1000 * F.exp(F.sum("__n").over(w)), "__vwap": _over(F.sum(F.col("__tp") * v).over(w), F.sum("volume").over(w))}
    return _counted(rows.withColumns(sums), "__f")


def _after_volume(rows: DataFrame) -> DataFrame:
    h, lo, _, v = _cols()
    rows = rows.withColumn("emv", _over(F.col("__dm") * (h - lo), v))
    out = {"obv": F.col("__obv"), "cmf_20": _over(full(F.sum, F.col("__mf"), 20), F.sum("volume").over(last(20))), "adi": F.col("__adi"), "emv_14": full(F.avg, F.col("emv"), 14), "force_13": _seen("__f", 13, F.col("__force"))}
    return rows.withColumns(out | {"mfi_14": money_flow(), "nvi": F.col("__nvi"), "vwap_cumulative": F.col("__vwap")})


VOLUME = Family(_before_volume, [("__force", "__f", 1 / 7)], _after_volume)


def volume_indicators(bars: DataFrame) -> DataFrame:
    """OBV, CMF (20), accumulation/distribution, ease of movement with mean (14), force index (13), MFI (14), negative volume index, cumulative VWAP."""
    return _alone(bars, VOLUME)


#: The parts of each function.
FAMILIES = {momentum_indicators: MOMENTUM, volatility_indicators: VOLATILITY, trend_indicators: TREND, volume_indicators: VOLUME}
