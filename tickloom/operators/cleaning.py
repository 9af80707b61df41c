"""Filters on ticks: missing values, repeats, dust and outliers; imputation and column pruning."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import over, quotient
from ..functions.lineage import cut
from ..functions.running import add_quantiles, shape
from ..functions.slices import in_slices


def _by():
    return Window.partitionBy("series").orderBy("ts", "seq")


def drop_missing(df: DataFrame, required: tuple[str, ...] = ("ts", "price", "amount")) -> DataFrame:
    return df.dropna(subset=list(required))


def first_of_each(df: DataFrame, key: tuple[str, ...] = ("series", "ts", "seq"), by: str = "seq") -> DataFrame:
    """The first row of each key, by an aggregate that tasks prepare, so a key with many rows is no hot spot; nulls of a key are equal, of ``by`` first."""
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.min_by(F.struct(*df.columns), F.struct(by)).alias("__row")).select("__row.*")


def in_range(df: DataFrame, start, end) -> DataFrame:
    """start <= ts < end, pushed to the scan."""
    return df.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))


def drop_dust(df: DataFrame, least: float = 1e-10) -> DataFrame:
    return df.where(F.col("amount") >= least)


def drop_jumps(df: DataFrame, most: float = 0.05) -> DataFrame:
    """Drop ticks that move by more than ``most`` from the tick before, as any does after a price of 0; the first stays."""
    before = F.lag("price").over(_by())
    return df.withColumn("__c", F.abs(quotient(F.col("price"), before) - 1)).where(F.col("__c").isNull() | (F.col("__c") <= most)).drop("__c")


def drop_by_zscore(df: DataFrame, window: int = 1000, threshold: float = 6.0, least: int = 100) -> DataFrame:
    """Keep ticks within ``threshold`` deviations of the mean of the last ``window``; all while fewer than ``least`` are there.

    A frame's sums are differences of running sums, so a row costs the same for any window; values are taken about the series' mean, and whether a frame is
    constant comes from the rows since the price last changed, not from a difference that rounding may spoil.
    """
    w, whole = _by(), Window.partitionBy("series")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("price")
    known = F.when(x.isNotNull() & ~F.isnan(x), x)
    rows = df.withColumn("__x", known - F.avg(known).over(whole))
    rows = rows.withColumns({"__n": F.count("__x").over(so_far), "__s": F.coalesce(F.sum("__x").over(so_far), F.lit(0.0)), "__ss": F.coalesce(F.sum(F.col("__x") * F.col("__x")).over(so_far), F.lit(0.0)), "__r": F.row_number().over(w), "__before": F.last("__x", True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    rows = rows.withColumn("__changed", F.max(F.when(F.col("__x") != F.col("__before"), F.col("__n"))).over(so_far))
    left = lambda c: F.col(c) - F.coalesce(F.lag(c, window).over(w), F.lit(0))
    rows = rows.withColumns({"__fn": left("__n"), "__fs": left("__s"), "__fss": left("__ss")})
    n = F.col("__fn")
    mean = over(F.col("__fs"), n)
    constant = F.coalesce(F.col("__n") - F.col("__changed") + 1 >= n, F.lit(True))
    std = F.when(n > 1, F.when(constant, 0.0).otherwise(F.sqrt(F.greatest(F.col("__fss") - n * mean * mean, F.lit(0.0)) / (n - 1))))
    far = F.abs(F.col("__x") - mean)
    keep = (n < least) | std.isNull() | ((std > 0) & (far <= threshold * std))
    return rows.where(keep).select(df.columns)


def drop_by_mad(df: DataFrame, column: str = "price", threshold: float = 15.0, least: int = 100, high_only: bool = False, slices: int | None = None) -> DataFrame:
    """Median and median absolute deviation so far; a row stays if it is near, or if the deviation is null or 0.

    Both medians are exact and taken by slices of time (``functions/running.py``), so no task holds a series. Runs jobs while the plan is built.
    """
    by = ("ts", "seq")
    sliced = in_slices(df, *by, slices=slices)
    parts = shape(sliced)
    x = F.col(column).cast("double")
    rows = cut(add_quantiles(sliced, column, {"__middle": 0.5}, by, parts, least).withColumn("__far", F.abs(x - F.col("__middle"))))
    rows = add_quantiles(rows, "__far", {"__mad": 0.5}, by, parts, least)
    out = (F.col("__mad") > 0) & (F.col("__far") > threshold * 1.4826 * F.col("__mad"))
    if high_only:
        out = out & (x > F.col("__middle"))
    return rows.where(~F.coalesce(out & ~F.isnan("__far"), F.lit(False))).select(df.columns)


def dollar_value(price: str = "price", amount: str = "amount", quoted: bool = False):
    """What a trade is worth: price times amount, or the amount where it is given in the quote currency."""
    return F.col(amount) if quoted else F.col(price) * F.col(amount)


def drop_by_dollar_value(df: DataFrame, threshold: float = 15.0, least: int = 100, quoted: bool = False) -> DataFrame:
    """``drop_by_mad`` of price times amount."""
    return drop_by_mad(df.withColumn("__value", dollar_value(quoted=quoted)), "__value", threshold, least).drop("__value")


def drop_by_volume(df: DataFrame, threshold: float = 20.0, dust: float = 1e-10, least: int = 100, by_mad: bool = True) -> DataFrame:
    """Dust goes first; then amounts far over the median so far, unless ``by_mad`` is off."""
    rows = drop_dust(df, dust)
    return drop_by_mad(rows, "amount", threshold, least, high_only=True) if by_mad else rows


def strip_columns(df: DataFrame, unwanted: tuple[str, ...] = ("symbol", "info")) -> DataFrame:
    return df.drop(*unwanted)


def valid_numbers(df: DataFrame, columns: tuple[str, ...] = ("price", "amount")) -> DataFrame:
    """Columns as doubles; what is no number is null, and rows with a null, NaN or infinity go."""
    rows = df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in columns})
    good = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns]
    return rows.where(reduce(and_, good)) if good else rows


def outlier_report(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(step, stage, n, removed): rows after each stage and how many fewer than after the one before."""
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "n") for i, (name, df) in enumerate(stages)])
    before = F.lag("n").over(Window.orderBy("step"))  # one row a stage
    return counts.withColumn("removed", F.coalesce(before - F.col("n"), F.lit(0)))


def clean(df: DataFrame, key: tuple[str, ...] = ("series", "ts", "seq"), value_threshold: float = 15.0) -> list[tuple[str, DataFrame]]:
    """The chain of a tape's cleaning, by stage: numbers, repeats, dust, dollar values. The last stage's rows are the clean tape."""
    stages = [("all", df), ("numbers", valid_numbers(drop_missing(strip_columns(df))))]
    for name, step in (("repeats", lambda d: first_of_each(d, key)), ("dust", lambda d: drop_by_volume(d, by_mad=False)), ("dollar_value", lambda d: drop_by_dollar_value(d, value_threshold))):
        stages.append((name, step(stages[-1][1])))
    return stages


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0.0, subset=columns)


def drop_first_incomplete(df: DataFrame, columns: list[str], by: str = "bar_id") -> DataFrame:
    """Rows of each series before its first row without a null in ``columns`` go; a series without such a row goes whole."""
    whole = reduce(and_, [F.col(c).isNotNull() for c in columns])
    first = F.min(F.when(whole, F.col(by))).over(Window.partitionBy("series"))
    return df.withColumn("__first", first).where(F.col(by) >= F.col("__first")).drop("__first")


def fill_forward(df: DataFrame, columns: list[str], by: str = "bar_id") -> DataFrame:
    """Nulls take the value before; a leading gap takes the first value after it."""
    w = Window.partitionBy("series").orderBy(by)
    # the first value of a series, found by an aggregate over the whole of it, fills its leading gap
    back, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("series")
    return df.withColumns({c: F.coalesce(F.last(c, True).over(back), F.min_by(c, F.when(F.col(c).isNotNull(), F.col(by))).over(whole)) for c in columns})


def fill_train_median(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Nulls take the median of the training rows, 0 if there is none; the medians are one row, so they join as literals of a bounded size."""
    medians = df.where(F.col(split) == "train").agg(*[F.percentile(c, 0.5).alias(c) for c in columns]).first()
    return df.fillna({c: float(medians[c]) if medians[c] is not None else 0.0 for c in columns})


def drop_empty_columns(df: DataFrame, most: float = 0.95) -> DataFrame:
    """Columns with a share of nulls over ``most`` go; all come from one aggregate."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if shares[c] is not None and (shares[c] > most or shares[c] == 1.0)])
