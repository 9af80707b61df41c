"""Volume-clock bars: a bar closes when its traded value reaches a threshold, fixed or adaptive.

A bar begins where the one before ended, so each bar hangs on all before it. Series are nevertheless cut in time (``functions/slices.py``). A slice's
effect on the value of the open bar is a step function of what it is at the slice's start, as bars that once share an edge share all later
ones: for a fixed threshold each slice works that table out, and the driver looks up one entry a slice. An adaptive threshold
forgets its past as its average does, so each slice is first folded as if its series began there. All slices are then folded from the states
so found, and again those whose state is not what the slice before left, until none is. A state that agrees to ``NEAR`` is agreed where no
tick of the slice comes as near to a threshold, so bars are those of a plain loop.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slices import SLICE, Part, carry, in_slices, runs, stitch, summaries

SCHEMA = "series long, bar_id long, ts_open timestamp, ts_close timestamp, open double, high double, low double, close double, volume double, cum_dollar double, vwap double, n_ticks long, threshold_used double"
PIECE = "bar_id long, piece int, ts_open timestamp, ts_close timestamp, open double, high double, low double, close double, volume double, cum_dollar double, n_ticks long, threshold_used double, closed boolean"
NEAR = 1e-9
#: Ticks that a table is worked out for at a time.
BLOCK = 1 << 17
#: Ticks whose values a pass in order takes as one row.
PACK = 512


def threshold_for(ticks: DataFrame, bars: int) -> DataFrame:
    """Per series the threshold that gives about ``bars`` bars."""
    return ticks.groupBy("series").agg(F.greatest(F.sum(F.col("price") * F.col("amount")) / bars, F.lit(1e-10)).alias("threshold"))


def bounds_for(ticks: DataFrame, bars: int, factors: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Per series the threshold and the least and largest one that an adaptive threshold may take; 1 for all without ticks or bars."""
    total = F.sum(F.col("price") * F.col("amount")) / bars if bars > 0 else F.lit(1.0)
    low = 1e-10
    return ticks.groupBy("series").agg(F.greatest(total, F.lit(low)).alias("threshold"), F.greatest(total * factors[0], F.lit(low)).alias("least"), (total * factors[1]).alias("most"))


class Fold:
    """The open bar and the threshold of a series. Ticks come in runs of any length, in order; what is held does not grow."""

    def __init__(self, threshold: float, span: int | None, bounds: tuple[float, float], state: tuple | None = None) -> None:
        self.threshold = self.average = threshold
        self.span, self.bounds, self.bar, self.step, self.edge = span, bounds, 0, 64, False
        self.clear()
        if state is not None:
            self.value, self.average, self.threshold, self.bar = state

    def state(self) -> tuple[float, float, float, int]:
        return self.value, self.average, self.threshold, self.bar

    def clear(self) -> None:
        self.n, self.value, self.volume, self.first, self.high, self.low, self.last, self.began, self.ended = 0, 0.0, 0.0, 0.0, -np.inf, np.inf, 0.0, None, None

    def add(self, ts, p: np.ndarray, v: np.ndarray) -> None:
        if not self.n:
            self.first, self.began = p[0], ts[0]
        self.n, self.volume, self.last, self.ended = self.n + len(p), self.volume + float(v.sum()), p[-1], ts[-1]
        self.high, self.low = max(self.high, p.max()), min(self.low, p.min())

    def piece(self) -> tuple:
        """The open bar's part of this fold's ticks."""
        vwap = self.value / self.volume if self.volume > 0 else self.last
        return self.bar, self.began, self.ended, self.first, self.high, self.low, self.last, self.volume, self.value, vwap, self.n, self.threshold

    def close(self) -> tuple:
        row = self.piece()
        if self.span is not None:  # the threshold follows an average of bars' values
            alpha = 2.0 / (self.span + 1.0)
            self.average = alpha * self.value + (1 - alpha) * self.average
            self.threshold = min(max(self.average, self.bounds[0]), self.bounds[1])
        self.bar, self.step = self.bar + 1, max(2 * self.n, 16)
        self.clear()
        return row

    def feed(self, ts, p: np.ndarray, v: np.ndarray) -> list[tuple]:
        """Bars that close in a run of ticks. A bar's value is summed tick by tick from its first, so it closes where a plain loop would close it."""
        out, i, dollars = [], 0, p * v
        while i < len(p):
            sums = np.cumsum(np.concatenate([[self.value], dollars[i : i + self.step]]))
            hit = np.flatnonzero(sums[1:] >= self.threshold)
            k = int(hit[0]) + 1 if len(hit) else len(sums) - 1
            if not self.edge:
                near = np.abs(sums[max(0, k - 1) : k + 1] - self.threshold)
                self.edge = bool((near <= 2 * NEAR * abs(self.threshold)).any())
            self.add(ts[i : i + k], p[i : i + k], v[i : i + k])
            self.value = float(sums[k])
            if len(hit):
                out.append(self.close())
            i += k
        return out


def table_of(dollars: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A run of ticks as a step function: (least value at the start, value at the end, bars closed, whether the start's value adds to the end's).

    Entries are in order of the first; the entry that holds is the last with at most the value at the start.
    """
    sums = np.cumsum(dollars)
    n, total = len(sums), float(sums[-1])
    after = np.minimum(np.searchsorted(sums, sums + threshold, "left"), n)  # the edge after an edge at each tick
    count = np.append((after < n).astype(np.int64), 0)
    last = np.append(np.where(after < n, after, np.arange(n)), n)
    while True:  # the last edge that each leads to, by doubling
        further = last[last]
        if (further == last).all():
            break
        count, last = count + count[last], further
    top = int(np.searchsorted(sums, threshold, "left"))  # the first edge lies here at the latest
    first = np.arange(min(top, n - 1) + 1)
    least = np.maximum(threshold - sums[first], 0.0)[::-1]
    end, bars = (total - sums[last[first]])[::-1], (count[first] + 1)[::-1]
    adds = np.zeros(len(first), bool)
    if top >= n:  # a small value closes no bar
        least, end, bars, adds = np.append(0.0, least), np.append(total, end), np.append(0, bars), np.append(True, adds)
    keep = np.append(True, (end[1:] != end[:-1]) | (bars[1:] != bars[:-1]) | (adds[1:] != adds[:-1]))
    return least[keep], end[keep], bars[keep], adds[keep]


def look_up(table, value):
    """Values at the end and bars closed for values at the start."""
    least, end, bars, adds = table
    at = np.maximum(np.searchsorted(least, value, "right") - 1, 0)
    return end[at] + np.where(adds[at], value, 0.0), bars[at]


def then(one, two):
    """The table of one run of ticks after another."""
    least, end, bars, adds = one
    # where the start's value adds, the second table's steps show through
    inner = [two[0] - e for e in end[adds]]
    starts = np.unique(np.concatenate([least, *[x[(x >= lo) & (x < hi)] for x, lo, hi in zip(inner, least[adds], np.append(least, np.inf)[1:][adds])]]))
    inside = np.append((starts[1:] + starts[:-1]) / 2, starts[-1] + 1.0)  # rounding may put a step's own start before it
    at = np.maximum(np.searchsorted(least, inside, "right") - 1, 0)
    middle = end[at] + np.where(adds[at], inside, 0.0)
    where = np.maximum(np.searchsorted(two[0], middle, "right") - 1, 0)
    both = adds[at] & two[3][where]
    out = two[1][where] + np.where(two[3][where], end[at], 0.0)  # where both add, so does the start's value
    total = bars[at] + two[2][where]
    keep = np.append(True, (out[1:] != out[:-1]) | (total[1:] != total[:-1]) | (both[1:] != both[:-1]))
    return starts[keep], out[keep], total[keep], both[keep]


def _arrays(part: pd.DataFrame):
    return part["ts"].to_numpy(), part["price"].to_numpy(float), part["amount"].to_numpy(float)


def _guess(sliced: DataFrame) -> dict[int, tuple]:
    """States at slices' starts from their tables, for fixed thresholds."""

    def feed(total, part):
        total["threshold"] = float(part["threshold"].iloc[0])
        dollars = (part["price"] * part["amount"]).to_numpy(float)
        for i in range(0, len(dollars), BLOCK):
            own = table_of(dollars[i : i + BLOCK], total["threshold"])
            total["table"] = own if total["table"] is None else then(total["table"], own)

    def advance(state, total):
        value, _, t, bar = state or (0.0, 0.0, total["threshold"], 0)
        end, bars = look_up(total["table"], np.array([value]))
        return float(end[0]), t, t, bar + int(bars[0])

    return stitch(summaries(sliced, ["price", "amount", "threshold"], lambda _: {"table": None}, feed), advance)


def _agreed(a: tuple, b: tuple, strict: bool) -> bool:
    """Whether two states but for the bars' numbers are the same, or near enough."""
    scale = NEAR * abs(b[2])
    return a[:3] == b[:3] if strict else all(abs(x - y) <= scale for x, y in zip(a[:3], b[:3]))


def _states(sliced: DataFrame, span: int | None, factors: tuple[float, float]) -> dict[int, tuple]:
    """The state with which each slice's first series begins, if it began before."""
    columns = ["ts", "price", "amount", "threshold"]

    def start(state):
        return {"from": state, "fold": None}

    def feed(total, part):
        if total["fold"] is None:
            t = float(part["threshold"].iloc[0])
            total["fold"] = Fold(t, span, (factors[0] * t, factors[1] * t), total["from"])
        total["fold"].feed(*_arrays(part))

    def fold(states: dict, only: set[int] | None = None) -> dict[int, Part]:
        found = summaries(sliced, columns, start, feed, {k: (*v[:3], 0) for k, v in states.items()}, only)
        return {p.number: p._replace(sum=(*p.sum["fold"].state(), p.sum["fold"].edge)) for p in found}

    used = _guess(sliced) if span is None else {}
    parts = fold(used)
    left = 2 * len(parts)
    while True:
        states = stitch(sorted(parts.values(), key=lambda p: p.number), lambda before, done: (*done[:3], (before[3] if before else 0) + done[3]))
        # where the last series of a slice begins in it, what it leaves doesn't hang on slices before
        whole = {k for k, p in parts.items() if not p.fresh and k in states and (k not in used or not _agreed(used[k], states[k], p.sum[4]))}
        if not whole:
            return states
        if 2 * len(whole) > left:  # a threshold that forgets too slowly for slices of this length
            return _sweep(sliced, span, factors, parts, states, min(whole))
        left = len(whole)
        used |= {k: states[k] for k in whole}
        parts |= fold(used, whole)


def _sweep(sliced: DataFrame, span: int | None, factors: tuple[float, float], parts: dict[int, Part], states: dict[int, tuple], least: int) -> dict[int, tuple]:
    """Exact states from slice ``least`` on: each series streams once through its slices, with the open bar as its state. Ticks come as packs of their values, 8 bytes each."""
    known = sliced.sparkSession.sparkContext.broadcast({k: v for k, v in states.items() if k <= least})

    def pack(batches):
        at = 0
        for pdf in batches:
            for key, part in runs(pdf):
                dollars = (part["price"] * part["amount"]).to_numpy(float)
                starts = range(0, len(dollars), PACK)
                yield pd.DataFrame({"series": pd.Series([key] * len(starts), dtype=part["series"].dtype), "number": int(part[SLICE].iloc[0]), "at": range(at, at + len(starts)), "threshold": float(part["threshold"].iloc[0]), "dollars": [dollars[i : i + PACK].tobytes() for i in starts]})
                at += len(starts)

    def run(batches):
        last = number = fold = None
        for pdf in batches:
            for key, part in runs(pdf):
                for own, t, packed in zip(part["number"], part["threshold"], part["dollars"]):
                    if fold is None or key != last:
                        fold = Fold(t, span, (factors[0] * t, factors[1] * t), known.value.get(int(own)) if int(own) == least else None)
                    elif own != number:
                        yield pd.DataFrame([(int(own), *fold.state())], columns=["number", "value", "average", "threshold", "bar"])
                    last, number = key, own
                    dollars = np.frombuffer(packed)
                    fold.feed(np.zeros(len(dollars)), dollars, np.ones(len(dollars)))

    # only series that reach beyond a slice matter; the first of slice ``least`` begins from its known state
    firsts = {p.first for p in parts.values() if p.number in states}
    named = F.col("series").cast("string").isin([k for k in firsts if k is not None]) | (F.col("series").isNull() & F.lit(None in firsts))
    rows = sliced.where(F.col(SLICE) >= least).where(named).select("series", SLICE, "price", "amount", "threshold")
    # slices are in order within themselves, so that only packs are sorted
    packs = rows.mapInPandas(pack, f"series {dict(sliced.dtypes)['series']}, number int, at long, threshold double, dollars binary")
    got = packs.repartition("series").sortWithinPartitions("series", "number", "at").mapInPandas(run, "number int, value double, average double, threshold double, bar long").collect()
    return {k: v for k, v in states.items() if k <= least} | {r[0]: tuple(r[1:]) for r in got}


def dollar_bars(ticks: DataFrame, bars: int = 20, adaptive: bool = False, span: int = 100, factors: tuple[float, float] = (0.5, 2.0), keep_last: bool = False, slices: int | None = None) -> DataFrame:
    """Bars of each series; ticks with a null price, amount or time take no part.

    Slices are folded apart from known states; of a bar that spans slices each gives a piece, and pieces are joined by their number. Runs jobs while the plan is
    built. A task holds a batch and the open bar, and for a fixed threshold a table of at most one bar's ticks.
    """
    known = ticks.dropna(subset=["ts", "price", "amount"])
    rows = known.join(threshold_for(known, bars), "series").select("series", "seq", "ts", "price", "amount", "threshold")
    sliced, own = in_slices(rows, "ts", "seq", slices=slices), span if adaptive else None
    names = [c.split()[0] for c in PIECE.split(", ")]

    def table(key, number, found, closed) -> pd.DataFrame:
        out = pd.DataFrame([(f[0], number, *f[1:9], *f[10:], closed) for f in found], columns=names)
        out.insert(0, "series", key)
        return out

    def step(state, part):
        fold, before = state
        if fold is None:
            t = float(part["threshold"].iloc[0])
            fold = Fold(t, own, (factors[0] * t, factors[1] * t), before)
        key = part["series"].iloc[0]
        return table(None if pd.isna(key) else key, int(part[SLICE].iloc[0]), fold.feed(*_arrays(part)), True), (fold, None)

    def rest(state, key, number):
        return table(key, number, [state[0].piece()] if state[0].n else [], False)

    kind = dict(sliced.dtypes)["series"]
    pieces = carry(sliced, _states(sliced, own, factors), lambda s: (None, s), step, f"series {kind}, {PIECE}", rest)
    # a bar's pieces: at most one that is not the last in each slice that it spans
    whole = pieces.groupBy("series", "bar_id").agg(F.min("ts_open").alias("ts_open"), F.max("ts_close").alias("ts_close"), F.min_by("open", "piece").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "piece").alias("close"), F.sum("volume").alias("volume"), F.max_by("cum_dollar", "piece").alias("cum_dollar"), F.sum("n_ticks").alias("n_ticks"), F.max_by("threshold_used", "piece").alias("threshold_used"), F.max("closed").alias("closed"))
    kept = whole if keep_last else whole.where("closed")
    return kept.withColumn("vwap", F.when(F.col("volume") > 0, F.col("cum_dollar") / F.col("volume")).otherwise(F.col("close"))).select(*[c.split()[0] for c in SCHEMA.split(", ")])

