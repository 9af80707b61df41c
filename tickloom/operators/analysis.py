"""Rank and distance dependence, regressions on lags, stationarity, complexity, and groups of features.

Regressions are solved from sums of products, one aggregate a series; what a task solves has the number of columns squared.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import finite, last, order, over, row, so_far
from ..functions.special import chi2_sf, f_sf
from . import stats


def _both(df: DataFrame, a: str, b: str) -> DataFrame:
    """(series, x, y, i, r): values of rows with both, around their means, and the dense ranks of each."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("series", F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    w = Window.partitionBy("series")
    rows = rows.select("series", (F.col("x") - F.avg("x").over(w)).alias("x"), (F.col("y") - F.avg("y").over(w)).alias("y"))
    return rows.withColumns({"i": stats.dense_rank("x").cast("long"), "r": stats.dense_rank("y")})


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-b by series, counted without making pairs; null where a column is constant."""
    rows = _both(df, a, b)
    s = stats.rises_and_falls(rows.select("series", "i", "r")).groupBy("series").agg(F.sum(F.when(F.col("up") == 1, F.col("met")).otherwise(-F.col("met"))).alias("s"))
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    tied = lambda k: rows.groupBy("series", k).agg(F.count("*").alias("n")).groupBy("series").agg(F.sum("n").alias("n"), F.sum(pairs("n")).alias(f"t_{k}"))
    ties = tied("i").join(tied("r").drop("n"), "series")
    return s.join(ties, "series").select("series", over(F.col("s").cast("double"), F.sqrt((pairs("n") - F.col("t_i")) * (pairs("n") - F.col("t_r")))).alias("tau"))


def distance_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distance correlation by series; 0 where a column is constant.

    Sums of distances come from running sums in order of one column; the sum of products of distances from running sums of values by
    bits of the other column's rank. So there are n log n rows and no pairs.
    """
    rows = _both(df, a, b).withColumn("xy", F.col("x") * F.col("y"))
    n, w = F.count("*").over(Window.partitionBy("series")), Window.partitionBy("series")

    def far(c: str, k: str):
        below = w.orderBy(k).rangeBetween(Window.unboundedPreceding, -1)
        less, less_sum = F.coalesce(F.count("*").over(below), F.lit(0)), F.coalesce(F.sum(c).over(below), F.lit(0.0))
        return F.col(c) * (2 * less - n) - 2 * less_sum + F.sum(c).over(w)

    ends = rows.withColumns({"rx": far("x", "i"), "ry": far("y", "r")}).groupBy("series").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("rx") * F.col("ry")).alias("rxy"), F.sum(F.col("rx") ** 2).alias("rxx"), F.sum(F.col("ry") ** 2).alias("ryy"), F.sum("rx").alias("tx"), F.sum("ry").alias("ty"), *[(F.count("*") * F.sum(F.col(c) ** 2) - F.sum(c) ** 2).alias(c * 2) for c in ("x", "y")])
    met = stats.rises_and_falls(rows, {"sx": "x", "sy": "y", "sxy": "xy"})
    product = F.col("met") * F.col("xy") - F.col("y") * F.col("sx") - F.col("x") * F.col("sy") + F.col("sxy")
    pairs = met.groupBy("series").agg(F.sum(F.when(F.col("up") == 1, product).otherwise(-product)).alias("xy"))
    m = F.col("n")
    part = lambda k, u, v: F.greatest(2 * F.col(k) / m**2 - 2 * F.col(f"r{k}") / m**3 + F.col(f"t{u}") * F.col(f"t{v}") / m**4, F.lit(0.0))
    spread = F.sqrt(part("xx", "x", "x") * part("yy", "y", "y"))
    return pairs.join(ends, "series").select("series", F.coalesce(F.sqrt(over(part("xy", "x", "y"), F.when(spread > 1e-24, spread))), F.lit(0.0)).alias("dcor"))


def expanding_zscore(df: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """Distance from the mean so far in deviations so far; 0 for a deviation of 1e-10 or less; null before ``least`` values."""
    w = so_far()

    def z(c: str):
        std = F.stddev_samp(c).over(w)
        return F.when(F.count(c).over(w) < least, F.lit(None)).when(F.coalesce(std <= 1e-10, F.lit(True)), 0.0).otherwise((F.col(c) - F.avg(c).over(w)) / std)

    return df.withColumns({f"{c}_zscore": z(c) for c in columns})


def volume_scaling(bars: DataFrame, window: int = 21) -> DataFrame:
    """Volume over its rolling mean of at least a third of a frame; 1 where that isn't known."""
    w = last(window)
    mean = F.when(F.count("volume").over(w) >= max(1, window // 3), F.avg("volume").over(w))
    return bars.withColumn("volume_scaled", F.coalesce(F.when(mean != 0, F.col("volume") / mean), F.lit(1.0)))


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(series, n, g): sums of products of a constant and the columns, upper triangle by rows, over complete rows."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    return df.dropna(subset=columns).groupBy("series").agg(F.count("*").alias("n"), F.array(*[F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]).alias("g"))


def _square(g, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = g
    return m + np.triu(m, 1).T


def _solve(m: np.ndarray, y: int, xs: list[int]) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, sum of squared residuals, and the inverse of the sums of products."""
    inverse = np.linalg.pinv(m[np.ix_(xs, xs)], hermitian=True)
    beta = inverse @ m[xs, y]
    return beta, float(m[y, y] - beta @ m[xs, y]), inverse


def _granger_test(k: int):
    @F.pandas_udf("struct<f double, p double>")
    def test(n: pd.Series, g: pd.Series) -> pd.DataFrame:
        rows = []
        for size, cells in zip(n, g):
            m, free = _square(cells, 2 * k + 2), size - 2 * k - 1
            if free <= 0:
                rows.append((None, None))
                continue
            few = _solve(m, 1, [0, *range(2, k + 2)])[1]
            all_ = max(_solve(m, 1, [0, *range(2, 2 * k + 2)])[1], 1e-300)
            f = max(few - all_, 0.0) / k / (all_ / free)
            rows.append((f, f_sf(f, k, free)))
        return pd.DataFrame(rows, columns=["f", "p"], dtype=float)

    return test


def granger(df: DataFrame, column: str, target: str, most: int = 5) -> DataFrame:
    """(series, lag, f, p): whether ``lag`` earlier values of a column help those of the target to tell its next one; null where too short.

    One pass sums up the products for every number of lags, each over the rows that are whole for it.
    """
    lags = [f"__{c}{i}" for i in range(1, most + 1) for c in ("y", "x")]
    lagged = df.select("series", F.col(target).cast("double").alias("__y"), *[F.lag(c, i).over(order()).cast("double").alias(f"__{n}{i}") for i in range(1, most + 1) for n, c in (("y", target), ("x", column))])
    sums = []
    for k in range(1, most + 1):
        x = [F.lit(1.0), *[F.col(f"__{c}") for c in ("y", *[f"y{i}" for i in range(1, k + 1)], *[f"x{i}" for i in range(1, k + 1)])]]
        whole = reduce(and_, [finite(F.col(c)).isNotNull() for c in ("__y", *lags[: 2 * k])])
        sums += [F.count_if(whole).alias(f"n{k}"), F.array(*[F.sum(F.when(whole, x[i] * x[j])) for i in range(len(x)) for j in range(i, len(x))]).alias(f"g{k}")]
    tested = lagged.groupBy("series").agg(*sums).select("series", *[_granger_test(k)(f"n{k}", f"g{k}").alias(f"t{k}") for k in range(1, most + 1)])
    return tested.select("series", F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"t{k}.f"), F.col(f"t{k}.p")) for k in range(1, most + 1)])))


#: MacKinnon's response surface for one variable with a constant, 5 per cent.
_ADF_5 = (-2.86154, -2.8903, -4.234, -40.040)


def adf(df: DataFrame, column: str, lags: int = 10, choose: bool = False) -> DataFrame:
    """(series, n, lags, statistic, critical, stationary): the augmented Dickey-Fuller t statistic with a constant.

    With ``choose`` the number of lagged differences with the least Akaike criterion, up to ``lags``, over the same rows. Statistic 0 if too short.
    """
    rows = df.where(finite(F.col(column).cast("double")).isNotNull()).select("series", "bar_id", (F.col(column) - F.avg(column).over(Window.partitionBy("series"))).alias("__x"))
    rows = rows.withColumn("__d", F.col("__x") - F.lag("__x").over(order()))
    rows = rows.withColumns({"__l": F.lag("__x").over(order())} | {f"__d{i}": F.lag("__d", i).over(order()) for i in range(1, lags + 1)})

    @F.pandas_udf("struct<lags int, statistic double, critical double>")
    def test(n: pd.Series, g: pd.Series) -> pd.DataFrame:
        out = []
        for size, cells in zip(n, g):
            m, best = _square(cells, lags + 3), None
            for p in range(lags + 1) if choose else [lags]:
                xs = [0, 2, *range(3, p + 3)]
                beta, ssr, inverse = _solve(m, 1, xs)
                free = size - len(xs)
                if free <= 0 or ssr <= 0 or inverse[1, 1] <= 0:
                    continue
                score = size * np.log(ssr / size) + 2 * len(xs)
                if best is None or score < best[0]:
                    best = score, p, float(beta[1] / np.sqrt(ssr / free * inverse[1, 1]))
            a, b, c, d = _ADF_5
            out.append((best[1] if best else lags, best[2] if best else 0.0, a + b / size + c / size**2 + d / size**3))
        return pd.DataFrame(out, columns=["lags", "statistic", "critical"])

    found = gram(rows, ["__d", "__l", *[f"__d{i}" for i in range(1, lags + 1)]]).select("series", "n", test("n", "g").alias("t"))
    return found.select("series", "n", "t.*", (F.col("t.statistic") < F.col("t.critical")).alias("stationary"))


def kpss(df: DataFrame, column: str, lags: int = 10) -> DataFrame:
    """(series, kpss): squared partial sums around the mean over n squared times a long-run variance with Bartlett weights. 0.463 is its 5 per cent point."""
    rows = df.where(F.col(column).isNotNull()).select("series", "bar_id", (F.col(column) - F.avg(column).over(Window.partitionBy("series"))).alias("x"))
    rows = rows.withColumns({"s": F.sum("x").over(so_far())} | {f"p{k}": F.col("x") * F.lag("x", k).over(order()) for k in range(1, lags + 1)})
    n = F.count("*")
    spread = F.sum(F.col("x") ** 2) + 2 * sum((1 - k / (lags + 1)) * F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) for k in range(1, lags + 1))
    return rows.groupBy("series").agg((F.sum(F.col("s") ** 2) / n / F.when(spread > 0, spread)).alias("kpss"))


def partial_autocorrelation(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """(series, lag, pacf) by Durbin and Levinson's recursion on the biased autocorrelations."""

    @F.pandas_udf("array<double>")
    def levinson(acf: pd.Series) -> pd.Series:
        out = []
        for r in acf:
            r, phi, left, found = np.asarray(r, float), np.zeros(0), 1.0, []
            for k in range(len(r)):
                a = (r[k] - phi @ r[:k][::-1]) / left if left else 0.0
                phi = np.append(phi - a * phi[::-1], a)
                left *= 1 - a * a
                found.append(float(a))
            out.append(found)
        return pd.Series(out)

    acf = stats.autocorrelation(df, column, most).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("r"))
    return acf.select("series", F.posexplode(levinson(F.transform("r", lambda x: x["acf"]))).alias("i", "pacf")).select("series", (F.col("i") + 1).alias("lag"), "pacf")


def ljung_box(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The statistic with its tail probability."""

    @F.pandas_udf("double")
    def tail(q: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else chi2_sf(v, most) for v in q], dtype="float64")

    return stats.ljung_box(df, column, most).withColumn("p", tail("q"))


def entropies(x: np.ndarray, m: int = 2, tolerance: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Approximate and sample entropy of each row of ``x``, over its deviation; 0 for a constant row, NaN for m values or fewer."""
    n = x.shape[1]
    if n <= m:
        return np.full(len(x), np.nan), np.full(len(x), np.nan)
    std = x.std(axis=1)
    flat = std < 1e-10
    x = (x - x.mean(axis=1)[:, None]) / np.where(flat, 1.0, std)[:, None]
    close = np.abs(x[:, :, None] - x[:, None, :]) <= tolerance
    # runs of k values that are alike pairwise: those of k - 1, and the next value too
    alike = [close]
    for k in range(1, m + 1):
        alike.append(alike[-1][:, :-1, :-1] & close[:, k:, k:])
    few, more = alike[m - 1], alike[m]
    approximate = np.log(few.mean(axis=2)).mean(axis=1) - np.log(more.mean(axis=2)).mean(axis=1)
    b, a = ((c[:, : n - m, : n - m].sum(axis=(1, 2)) - (n - m)) / 2 for c in (few, more))
    none = (a == 0) | (b == 0)
    sample = np.where(none, np.log(n), -np.log(np.where(none, 1.0, a) / np.where(none, 1.0, b)))
    return np.where(flat, 0.0, approximate), np.where(flat, 0.0, sample)


#: Frames that are compared at a time.
_LOT = 256


def complexity(bars: DataFrame, window: int = 50, m: int = 2, tolerance: float = 0.2) -> DataFrame:
    """Approximate and sample entropy of a frame's normalised returns: apen_k, sampen_k. Half a frame of values is needed; 0 for a constant frame.

    Both come from one table of which values are alike, for many frames of one length at a time. A frame with an infinite return has no deviation: no two of its values are alike, and apen_k is NaN.
    """

    @F.pandas_udf("struct<apen double, sampen double>")
    def run(x: pd.Series) -> pd.DataFrame:
        out = np.full((len(x), 2), np.nan)
        size = np.array([-1 if v is None else len(v) for v in x])
        for n in np.unique(size[size >= 0]):
            at = np.flatnonzero(size == n)
            for i in range(0, len(at), _LOT):
                part = at[i : i + _LOT]
                out[part] = np.stack(entropies(np.stack(x.to_numpy()[part]).astype(float), m, tolerance), axis=1)
        return pd.DataFrame(out, columns=["apen", "sampen"])

    w = last(window)
    frame = F.when((row() >= window) & (F.count("log_return").over(w) >= window // 2), F.collect_list("log_return").over(w))
    known = lambda x: F.when(F.size("__x") > m, F.coalesce(x, F.lit(float("nan"))))  # noqa: E731  pandas hands NaN back as null
    return bars.withColumn("__x", frame).withColumn("__e", run("__x")).withColumns({f"{k}_{window}": known(F.col(f"__e.{k}")) for k in ("apen", "sampen")}).drop("__x", "__e")


def _matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The correlation matrix; 0 with a constant column. As many entries as columns squared, whatever the rows."""
    m = np.eye(len(columns))
    for r in stats.correlations(df.dropna(subset=columns), columns).collect():
        i, j = columns.index(r["a"]), columns.index(r["b"])
        m[i, j] = m[j, i] = r["corr"] if r["corr"] is not None and np.isfinite(r["corr"]) else 0.0
    return m


def eigenvalues(df: DataFrame, columns: list[str]) -> DataFrame:
    """(component, eigenvalue, share, cumulative, condition_index) of the correlation matrix; the last index is the condition number."""
    values = np.maximum(np.linalg.eigvalsh(_matrix(df, columns))[::-1], 0.0)
    share = values / values.sum()
    rows = [(i, float(v), float(share[i]), float(share[: i + 1].sum()), float(np.sqrt(values[0] / v)) if v > 0 else None) for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, share double, cumulative double, condition_index double")


def feature_groups(df: DataFrame, columns: list[str], threshold: float = 0.7) -> DataFrame:
    """(feature, cluster, size, mean_corr): average-linkage groups of columns, joined while their mean distance 1 - |corr| is at most 1 - threshold."""
    near = np.abs(_matrix(df, columns))
    groups = [[i] for i in range(len(columns))]
    while len(groups) > 1:
        far, i, j = min((1 - near[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if far > 1 - threshold:
            break
        groups[i] = sorted(groups[i] + groups.pop(j))
    rows = []
    for k, g in enumerate(sorted(groups)):
        inner = near[np.ix_(g, g)][np.triu_indices(len(g), 1)]
        rows += [(columns[i], k, len(g), float(inner.mean()) if len(inner) else None) for i in g]
    return df.sparkSession.createDataFrame(rows, "feature string, cluster int, size int, mean_corr double")
