"""Trade classification and joins of ticks with bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import logarithm, over, quotient


def _by():
    return Window.partitionBy("series").orderBy("ts", "seq")


def tick_rule(ticks: DataFrame) -> DataFrame:
    """trade_sign: the sign of the price change; no change repeats the sign before; the first is 1."""
    sign = F.nullif(F.signum(F.col("price") - F.lag("price").over(_by())), F.lit(0.0))
    rows = ticks.withColumn("__s", sign)
    return rows.withColumn("trade_sign", F.coalesce(F.last("__s", True).over(_by().rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)).cast("int")).drop("__s")


def direct(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("trade_sign", F.when(F.col("side") == "buy", 1).when(F.col("side") == "sell", -1).otherwise(0))


def imbalance(signed: DataFrame, key: list[str]) -> DataFrame:
    """(buys - sells) / (buys + sells) of volume by key, 0 if there is none."""
    buy, sell = (F.sum(F.when(F.col("trade_sign") == s, F.col("amount")).otherwise(0.0)) for s in (1, -1))
    return signed.groupBy(*key).agg(F.when(buy + sell > 0, (buy - sell) / (buy + sell)).otherwise(0.0).alias("volume_imbalance"))


def bar_of_tick(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """As-of join: each tick gets the first bar that closes at or after it, later ticks the last bar.

    Both sides go through one union and one sort by time, so no pair is made and a long series is streamed.
    """
    rows = ticks.select("series", "seq", "ts", "price", "amount", "side", F.lit(1).alias("__k"), F.lit(None).cast("long").alias("__bar"))
    ends = bars.groupBy("series", F.col("ts_close").alias("ts")).agg(F.min("bar_id").alias("__bar")).select("series", F.lit(None).cast("long").alias("seq"), "ts", F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("side"), F.lit(2).alias("__k"), "__bar")
    both, so_far = Window.partitionBy("series"), (Window.unboundedPreceding, 0)
    # both frames only grow: the one that looks ahead runs in descending order
    ahead = F.last("__bar", True).over(both.orderBy(F.desc("ts"), F.desc("__k"), F.desc("seq")).rowsBetween(*so_far))
    back = F.last("__bar", True).over(both.orderBy("ts", "__k", "seq").rowsBetween(*so_far))
    return rows.unionByName(ends).withColumn("bar_id", F.coalesce(ahead, back)).where("__k = 1").drop("__k", "__bar")


def ticks_in_bars(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """Range join: (series, bar_id, seq, ts, price) of each tick with each bar with ts_open <= ts <= ts_close; a shared edge gives both bars.

    Bars are put in order of their ends; an earlier bar may not end after a later one nor start after it. The bars around a tick are then a run of numbers:
    from the first that ends at or after the tick to the last that starts at or before it. Both are running values over one union, so no tick meets a bar
    that does not hold it.
    """
    numbered = bars.select("series", "bar_id", "ts_open", "ts_close", F.row_number().over(Window.partitionBy("series").orderBy("ts_open", "ts_close", "bar_id")).alias("__i"))
    none = lambda kind: F.lit(None).cast(kind)
    side = lambda ts, k: numbered.select("series", none("long").alias("seq"), F.col(ts).alias("ts"), none("double").alias("price"), F.lit(k).alias("__k"), "__i")
    rows = ticks.select("series", "seq", "ts", "price", F.lit(1).alias("__k"), none("int").alias("__i")).unionByName(side("ts_open", 0)).unionByName(side("ts_close", 2))
    both, so_far = Window.partitionBy("series"), (Window.unboundedPreceding, 0)
    at = lambda k: F.when(F.col("__k") == k, F.col("__i"))
    high = F.last(at(0), True).over(both.orderBy("ts", "__k", "__i", "seq").rowsBetween(*so_far))
    low = F.last(at(2), True).over(both.orderBy(F.desc("ts"), F.desc("__k"), F.desc("__i"), F.desc("seq")).rowsBetween(*so_far))
    held = rows.withColumns({"__high": high, "__low": low}).where("__k = 1 and __low <= __high")
    return held.select("series", "seq", "ts", "price", F.explode(F.sequence("__low", "__high")).alias("__i")).join(numbered.select("series", "__i", "bar_id"), ["series", "__i"]).drop("__i")


def intrabar(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """Statistics of the ticks of each bar (``ticks_in_bars``); a ratio to a price of 0 is null."""
    w = Window.partitionBy("series", "bar_id").orderBy("ts", "seq")
    rows = ticks_in_bars(ticks, bars).withColumn("r", logarithm(quotient(F.col("price"), F.lag("price").over(w))))
    n = F.count("*")
    enough = lambda x: F.when((n >= 2) & (F.count("r") >= 2), x)
    return rows.groupBy("series", "bar_id").agg(n.alias("tick_count"), F.sqrt(enough(F.var_samp("r"))).alias("intrabar_vol"), enough(over(F.max("price") - F.min("price"), F.max_by("price", F.struct("ts", "seq")))).alias("tick_range"), enough(F.sum(F.col("r") * F.col("r"))).alias("tick_rv"), enough(F.avg("r")).alias("tick_mean"))
