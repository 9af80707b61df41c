"""Triple-barrier labels and their statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import over, quotient
from ..functions.slices import carry, in_slices, scan, stitch, summaries


class Weighted:
    """Exponentially weighted sums of a run of values: of the weights, their squares, and the values' distances from ``centre`` and these squared.

    Sums that follow each other compose: the earlier ones fade by the later ones' length and move to their centre.
    """

    def __init__(self, keep: float, sums: tuple | None = None) -> None:
        self.keep, self.rows = keep, 0
        self.n, self.w, self.w2, self.centre, self.x, self.xx = sums or (0, 0.0, 0.0, None, 0.0, 0.0)

    def sums(self) -> tuple:
        return self.n, self.w, self.w2, self.centre, self.x, self.xx

    def feed(self, r: np.ndarray) -> tuple[np.ndarray, ...]:
        """Number of values, and weights, squared weights, sums and sums of squares after each row; nulls (NaN) only let the past fade."""
        known = ~np.isnan(r)
        if self.centre is None and known.any():
            self.centre = float(r[known][0])
        d = np.where(known, r - (self.centre or 0.0), 0.0)
        n = self.n + np.cumsum(known)
        out = tuple(scan(k, b, y) for k, b, y in ((self.keep, known.astype(float), self.w), (self.keep**2, known.astype(float), self.w2), (self.keep, d, self.x), (self.keep, d * d, self.xx)))
        self.rows += len(r)
        self.n, (self.w, self.w2, self.x, self.xx) = int(n[-1]), (float(o[-1]) for o in out)
        return n, *out

    def after(self, before: tuple | None) -> tuple:
        """The sums of all values before and these."""
        if before is None or before[3] is None:
            return self.sums()
        n, w, w2, centre, x, xx = before
        fade = self.keep**self.rows
        d = (centre if self.centre is None else self.centre) - centre
        x, xx = x - d * w, xx - 2 * d * x + d * d * w
        return n + self.n, fade * w + self.w, fade * fade * w2 + self.w2, centre + d, fade * x + self.x, fade * xx + self.xx


def ewm_volatility(bars: DataFrame, span: int = 100, least: int = 10, slices: int | None = None) -> DataFrame:
    """Bias-corrected deviation of exponentially weighted returns: five sums that are linear recurrences, by slices of time. Runs jobs while the plan is built."""
    keep = 1 - 2.0 / (span + 1)
    sliced = in_slices(bars.select("series", "bar_id", "log_return"), "bar_id", slices=slices)
    returns = lambda part: part["log_return"].to_numpy(float, na_value=np.nan)
    parts = summaries(sliced, ["log_return"], lambda _: Weighted(keep), lambda total, part: total.feed(returns(part)) and None)
    states = stitch(parts, lambda before, total: total.after(before))

    def step(total, part):
        n, w, w2, x, xx = total.feed(returns(part))
        with np.errstate(all="ignore"):
            spread = np.maximum(xx / w - (x / w) ** 2, 0.0)
            vol = np.sqrt(spread * w * w / (w * w - w2))
        good = (n >= max(least, 2)) & (w * w > w2)
        return pd.DataFrame({"series": part["series"], "bar_id": part["bar_id"], "vol": pd.Series(np.where(good, vol, np.nan), index=part.index)}), total

    found = carry(sliced, states, lambda s: Weighted(keep, s), step, f"series {dict(bars.dtypes)['series']}, bar_id {dict(bars.dtypes)['bar_id']}, vol double")
    return bars.join(found, ["series", "bar_id"])


def triple_barrier(bars: DataFrame, vol: str, up: float = 1.5, down: float = 1.0, hold: int = 10, least: float = 0.0) -> DataFrame:
    """First touch within ``hold`` bars: ret at or over up * vol, or at or under -down * vol, else the last bar of the path.

    Adds t1 (bar of the exit), ret and label: 0 under ``least``, else the sign (-1 for no return). The path is an array of
    at most ``hold`` prices, so memory is bounded and one window pass does.
    """
    w = Window.partitionBy("series").orderBy("bar_id").rowsBetween(1, hold)
    rows = bars.where(F.col("close").isNotNull()).withColumn("__p", F.collect_list("close").over(w)).where(F.col(vol).isNotNull() & (F.size("__p") > 0))
    rows = rows.withColumn("__r", F.transform("__p", lambda p: quotient(p, F.col("close")) - 1))
    hit = F.filter(F.transform("__r", lambda r, i: F.when((r >= up * F.col(vol)) | (r <= -down * F.col(vol)), i)), lambda i: i.isNotNull())
    at = F.when(F.size(hit) > 0, hit[0]).otherwise(F.size("__p") - 1)
    rows = rows.withColumn("__at", at).withColumns({"t1": F.col("bar_id") + F.col("__at") + 1, "ret": F.get("__r", F.col("__at"))})
    return rows.withColumn("label", F.when(F.abs("ret") < least, 0).when(F.col("ret") > 0, 1).otherwise(-1)).drop("__p", "__r", "__at")


def class_shares(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def economics(labelled: DataFrame, cost: float = 0.01) -> DataFrame:
    """Of trades with a label other than 0: number, net return, win rate, Sharpe (null where all trades are equal)."""
    net = F.col("label") * F.col("ret") - cost * F.abs("ret")
    trades = labelled.where("label <> 0").select(net.alias("net"))
    return trades.agg(F.count("*").alias("n_trades"), F.sum("net").alias("total_return"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), (over(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.count("*"))).alias("sharpe"))


def vertical_barriers(bars: DataFrame, events: DataFrame, hold: int) -> DataFrame:
    """t1 of each event (series, bar_id): the bar ``hold`` rows later, or the last of the series; null where the event has no bar."""
    w = Window.partitionBy("series").orderBy("bar_id")
    ends = bars.select("series", "bar_id", F.coalesce(F.lead("bar_id", hold).over(w), F.max("bar_id").over(Window.partitionBy("series"))).alias("t1"))
    return events.drop("t1").join(ends, ["series", "bar_id"], "left")


def side_barriers(events: DataFrame, up: float, down: float, vol: str = "vol", side: str = "side") -> DataFrame:
    """pt and sl, the barriers of an event in the direction of its side."""
    return events.withColumns({"pt": up * F.col(vol) * F.col(side), "sl": -down * F.col(vol) * F.col(side)})


def first_touch(bars: DataFrame, events: DataFrame, hold: int, side: str = "side") -> DataFrame:
    """For events with pt and sl (``side_barriers``): touch, the first of at most ``hold`` bars after each where the return
    reaches a barrier; t1, it or the last bar of the path; ret there; meta_label: whether ret goes with the side. A side of 1 takes profit from above, any other from
    below; a barrier on the wrong side of 0 is never touched. Events without a path go."""
    w = Window.partitionBy("series").orderBy("bar_id").rowsBetween(1, hold)
    paths = bars.where(F.col("close").isNotNull()).select("series", "bar_id", F.transform(F.collect_list(F.struct("bar_id", "close")).over(w), lambda p: F.struct(p["bar_id"].alias("t"), (quotient(p["close"], F.col("close")) - 1).alias("r"))).alias("__p"))
    rows = events.join(paths, ["series", "bar_id"]).where("size(__p) > 0")
    pt, sl, r = F.col("pt"), F.col("sl"), lambda p: p["r"]
    long = lambda p: ((pt > 0) & (r(p) >= pt)) | ((sl < 0) & (r(p) <= sl))
    short = lambda p: ((pt < 0) & (r(p) <= pt)) | ((sl > 0) & (r(p) >= sl))
    hits = F.filter("__p", lambda p: F.coalesce(F.when(F.col(side) == 1, long(p)).otherwise(short(p)), F.lit(False)))
    rows = rows.withColumn("__hit", F.get(hits, F.lit(0))).withColumn("__end", F.coalesce("__hit", F.element_at("__p", -1)))
    return rows.withColumns({"touch": F.col("__hit.t"), "t1": F.col("__end.t"), "ret": F.col("__end.r")}).withColumn("meta_label", F.coalesce(F.col("ret") * F.col(side) > 0, F.lit(False)).cast("int")).drop("__p", "__hit", "__end")


def meta_label(labelled: DataFrame, side: str = "side") -> DataFrame:
    return labelled.withColumn("meta_label", (F.col("ret") * F.col(side) > 0).cast("int"))
