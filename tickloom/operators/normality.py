"""The Shapiro-Wilk test by Royston's approximation (Applied Statistics 44, 1995, algorithm AS R94), for 3 to 5000 values.

A longer series is tested on 5000 of its values, those with the least hashes of their keys: the approximation goes no further, and a larger test would call
any series of real returns not normal. Hashes are cut at a bound that lets about twice as many through, so a series' order is that of some
10,000 values at most, whatever its length. All else is expressions and one aggregate; Python sees a row a series.
"""

from __future__ import annotations

from math import asin, erfc, exp, log, pi, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import finite

MOST = 5000

# Polynomials of AS R94, from the constant term up.
_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_FEW_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
_FEW_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
_MANY_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_MANY_SPREAD = (-0.4803, -0.082676, 0.0030302)
_FEW_BOUND = (-2.273, 0.459)

# The normal distribution's quantiles by Wichura's AS 241, numerators and denominators from the constant term up.
_MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
_TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)

def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """For p from 1e-10 to 1 - 1e-10, to 1e-15 of itself or so."""
    q = p - 0.5
    middle, r = 0.180625 - q * q, F.sqrt(-F.log(F.least(p, 1 - p))) - 1.6
    return F.when(F.abs(q) <= 0.425, q * _poly(_MIDDLE[0], middle) / _poly(_MIDDLE[1], middle)).otherwise(F.signum(q) * _poly(_TAIL[0], r) / _poly(_TAIL[1], r))


def _tail(z: float) -> float:
    return erfc(z / sqrt(2)) / 2


def _value(coefficients: tuple[float, ...], x: float) -> float:
    return sum(c * x**k for k, c in enumerate(coefficients))


def _chance(w: float, n: int) -> float:
    """P of a smaller w among n normal values."""
    if n == 3:
        return max(0.0, 6 / pi * (asin(sqrt(w)) - asin(sqrt(0.75))))
    if w >= 1:
        return 1.0
    y = log(1 - w)
    if n > 11:
        return _tail((y - _value(_MANY_MEAN, log(n))) / exp(_value(_MANY_SPREAD, log(n))))
    bound = _value(_FEW_BOUND, n)
    return 1e-99 if y >= bound else _tail((-log(bound - y) - _value(_FEW_MEAN, n)) / exp(_value(_FEW_SPREAD, n)))


def _one(n: int, mm: float, mx: float, ss: float, m0: float, m1: float, d0: float, d1: float) -> tuple[float | None, float | None]:
    """w and p from a series' sums: of squared and weighted normal scores, of squares, the largest two scores, and the gaps between the ends."""
    if n < 3 or ss <= 1e-300:
        return None, None
    if n == 3:
        total = sqrt(0.5) * d0
    else:
        last, second = _value(_LAST, n**-0.5) + m0 / sqrt(mm), _value(_NEXT, n**-0.5) + m1 / sqrt(mm)
        if n < 6:  # the next to last have no weight of their own
            second = m1 = 0.0
        own = sqrt((mm - 2 * m0 * m0 - 2 * m1 * m1) / (1 - 2 * last * last - 2 * second * second))
        total = (mx - m0 * d0 - m1 * d1) / own + last * d0 + second * d1
    w = min(total * total / ss, 1.0)
    return w, _chance(w, n)


def _test(n: pd.Series, mm: pd.Series, mx: pd.Series, ss: pd.Series, m0: pd.Series, m1: pd.Series, d0: pd.Series, d1: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_one(*r) for r in zip(n, mm, mx, ss, m0, m1, d0, d1)], columns=["w", "p"], dtype=float)


def shapiro_wilk(df: DataFrame, column: str, key: str = "bar_id", most: int = MOST) -> DataFrame:
    """(series, n, tested, w, p): values that are null or not finite are left out; w and p are null for fewer than 3 of them or equal ones.

    ``tested`` of the ``n`` values are in the test. Equal values are told apart by nothing: any order gives the same w.
    """
    rows = df.select("series", F.col(key).alias("__k"), finite(F.col(column).cast("double")).alias("x")).where("x is not null")
    counts = rows.groupBy("series").agg(F.count("*").alias("n"))
    share = (F.pmod(F.xxhash64("__k"), F.lit(1 << 32)) / float(1 << 32)).alias("__h")
    few = rows.join(counts, "series").select("*", share).where(F.col("__h") < 2.0 * most / F.col("n"))
    w = Window.partitionBy("series")
    few = few.withColumn("__r", F.row_number().over(w.orderBy("__h", "__k", "x"))).where(F.col("__r") <= most)
    few = few.withColumns({"i": F.row_number().over(w.orderBy("x", "__h")), "t": F.count("*").over(w)})
    few = few.withColumn("m", normal_quantile((F.col("i") - 0.375) / (F.col("t") + 0.25)))
    at = lambda k: F.max(F.when(F.col("i") == F.col("t") - k, F.col("m"))).alias(f"m{k}")
    ends = lambda k: (F.max(F.when(F.col("i") == F.col("t") - k, F.col("x"))) - F.max(F.when(F.col("i") == 1 + k, F.col("x")))).alias(f"d{k}")
    sums = few.withColumn("x", F.col("x") - F.avg("x").over(w)).groupBy("series").agg(F.max("n").alias("n"), F.max("t").alias("t"), F.sum(F.col("m") ** 2).alias("mm"), F.sum(F.col("m") * F.col("x")).alias("mx"), F.sum(F.col("x") ** 2).alias("ss"), at(0), at(1), ends(0), ends(1))
    return sums.withColumn("f", F.pandas_udf(_test, "struct<w double, p double>")("t", "mm", "mx", "ss", "m0", "m1", "d0", "d1")).select("series", "n", F.col("t").alias("tested"), "f.w", "f.p")
