"""Settings of the triple barrier, all told from one pass over the paths; labels brought to other tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import over, quotient


class Setting(NamedTuple):
    """Upper and lower barrier in volatilities, bars held at most, least return that counts."""

    up: float
    down: float
    hold: int
    least: float


def settings(downs: Sequence[float], leasts: Sequence[float], holds: Sequence[int], ratio: float = 1.5) -> list[Setting]:
    """Every combination; the upper barrier is ``ratio`` times the lower."""
    return [Setting(ratio * d, d, int(h), least) for d, least, h in product(downs, leasts, holds)]


def first_touches(bars: DataFrame, vol: str, tried: Sequence[Setting]) -> DataFrame:
    """(series, bar_id, setting, t1, ret, label) of each event under each setting, as ``triple_barrier`` gives them.

    An event's path, at most as long as the longest holding time, is collected once; the first touch of each distinct barrier is found once, and a
    setting takes the earlier of its two. Rows are multiplied by the settings only after the window, so the one shuffle is the path's.
    """
    ups, downs = sorted({s.up for s in tried}), sorted({s.down for s in tried})
    w = Window.partitionBy("series").orderBy("bar_id").rowsBetween(1, max(s.hold for s in tried))
    paths = bars.where(F.col("close").isNotNull()).withColumn("__p", F.collect_list("close").over(w)).where(F.col(vol).isNotNull() & (F.size("__p") > 0))
    paths = paths.withColumn("__r", F.transform("__p", lambda p: quotient(p, F.col("close")) - 1))
    none = F.lit(2**31 - 1)
    touch = lambda hit: F.coalesce(F.nullif(F.array_position(F.transform("__r", hit), True), F.lit(0).cast("long")).cast("int"), none)
    above, below = (lambda x: touch(lambda r: r >= x * F.col(vol))), (lambda x: touch(lambda r: r <= -x * F.col(vol)))
    paths = paths.withColumns({"__u": F.array(*map(above, ups)), "__d": F.array(*map(below, downs))})
    table = F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(ups.index(s.up) + 1).alias("u"), F.lit(downs.index(s.down) + 1).alias("d"), F.lit(s.hold).alias("hold"), F.lit(float(s.least)).alias("least")) for i, s in enumerate(tried)])
    each = paths.select("series", "bar_id", "__r", "__u", "__d", F.explode(table).alias("s"))
    hit = F.least(F.element_at("__u", F.col("s.u")), F.element_at("__d", F.col("s.d")))
    at = F.when(hit <= F.col("s.hold"), hit).otherwise(F.least(F.col("s.hold"), F.size("__r")))
    rows = each.select("series", "bar_id", F.col("s.setting").alias("setting"), (F.col("bar_id") + at).alias("t1"), F.get("__r", at - 1).alias("ret"), F.col("s.least").alias("least"))
    return rows.withColumn("label", F.when(F.abs("ret") < F.col("least"), 0).when(F.col("ret") > 0, 1).otherwise(-1)).drop("least")


def barrier_grid(bars: DataFrame, vol: str, tried: Sequence[Setting], cost: float = 0.01, shares: tuple[float, float] = (0.2, 0.5), trades: int = 10) -> DataFrame:
    """A row per setting that labels anything: its barriers, n, the classes' counts and whether each class has a share within ``shares``, the trades' economics
    (as ``labels.economics``), score and best.

    score is the Sharpe ratio per trade, 0 with fewer than ``trades`` trades or where all are equal, null where the classes are out of proportion. The largest score is
    best, the first of equals; none is where all are null. Tasks sum up by setting before anything is sent.
    """
    net = F.when(F.col("label") != 0, F.col("label") * F.col("ret") - cost * F.abs("ret"))
    n = lambda c: F.sum((F.col("label") == c).cast("long"))
    told = first_touches(bars, vol, tried).withColumn("net", net).groupBy("setting").agg(F.count("*").alias("n"), n(-1).alias("n_down"), n(0).alias("n_flat"), n(1).alias("n_up"), F.count("net").alias("n_trades"), F.sum("net").alias("total_return"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), (over(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.count("net"))).alias("sharpe"))
    table = bars.sparkSession.createDataFrame([(i, *map(float, s[:2]), s.hold, float(s.least)) for i, s in enumerate(tried)], "setting int, up double, down double, hold int, least double")
    fair = F.lit(True)
    for c in ("n_down", "n_flat", "n_up"):
        fair = fair & F.col(c).between(shares[0] * F.col("n"), shares[1] * F.col("n"))
    rows = table.join(told, "setting").withColumn("balanced", fair)
    rows = rows.withColumn("score", F.when(F.col("balanced"), F.when(F.col("n_trades") < trades, 0.0).otherwise(F.coalesce("sharpe", F.lit(0.0)))))
    first = F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), "setting"))  # one row a setting
    return rows.withColumn("best", (first == 1) & F.col("score").isNotNull())


def apply_labels(rows: DataFrame, labelled: DataFrame, key: tuple[str, ...] = ("series", "bar_id"), columns: tuple[str, ...] = ("label", "t1")) -> DataFrame:
    """Rows with ``columns`` from the labels of the same key, null where there is none; columns of these names are replaced. Of labels that repeat a key, the least counts, null first."""
    one = labelled.groupBy(*key).agg(F.min(F.struct(*columns)).alias("__l"))
    kept = rows.drop(*columns)
    return kept.join(one, list(key), "left").select(*kept.columns, *[F.col(f"__l.{c}").alias(c) for c in columns])


def alignment(rows: DataFrame, labelled: DataFrame, key: tuple[str, ...] = ("series", "bar_id")) -> DataFrame:
    """One row: n_rows, n_labels, n_matched, rows_without_label, labels_without_row; rows and labels whose key repeats count each, and null labels are none."""
    mine, theirs = rows.groupBy(*key).agg(F.count("*").alias("a")), labelled.where(F.col("label").isNotNull()).groupBy(*key).agg(F.count("*").alias("b"))
    both = mine.join(theirs, list(key), "full")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return both.agg(total("a").alias("n_rows"), total("b").alias("n_labels"), total(F.when(F.col("b").isNotNull(), F.col("a"))).alias("n_matched"), total(F.when(F.col("b").isNull(), F.col("a"))).alias("rows_without_label"), total(F.when(F.col("a").isNull(), F.col("b"))).alias("labels_without_row"))
