"""Scalers and components from statistics that merge: each batch is read once, its small table is kept, and new batches add to it.

A table of moments has one row a column, one of co-moments one row a pair of columns, whatever the rows of the batch. Nulls and NaN are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import finite
from .transform import Scaler

#: A spread below this counts as none.
LEAST = 1e-10


def _known(c: str):
    return finite(F.col(c).cast("double"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, mean, m2, low, high) of a batch; m2 is the sum of squared deviations. An empty batch gives n of 0 and nulls."""
    one = lambda c: F.struct(F.lit(c).alias("feature"), F.count(_known(c)).alias("n"), F.avg(_known(c)).alias("mean"), (F.var_pop(_known(c)) * F.count(_known(c))).alias("m2"), F.min(_known(c)).alias("low"), F.max(_known(c)).alias("high"))
    return df.agg(F.array(*[one(c) for c in columns]).alias("x")).select(F.inline("x"))


def merge(parts: DataFrame) -> DataFrame:
    """Moments of all batches from the rows of their tables, in any order."""
    w = Window.partitionBy("feature")
    whole = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    rows = parts.where("n > 0").withColumn("whole", whole)
    met = rows.groupBy("feature").agg(F.sum("n").alias("n"), F.first("whole").alias("mean"), F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("whole")) ** 2).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"))
    return parts.select("feature").distinct().join(met, "feature", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def standard_of(moments: DataFrame) -> Scaler:
    """By mean and sample deviation; 1 for a column without spread, 0 and 1 for one without values."""
    rows = moments.collect()
    deviation = lambda r: (r["m2"] / (r["n"] - 1)) ** 0.5 if r["n"] > 1 else 0.0
    return Scaler({r["feature"]: r["mean"] or 0.0 for r in rows}, {r["feature"]: s if (s := deviation(r)) >= LEAST else 1.0 for r in rows})


def minmax_of(moments: DataFrame) -> Scaler:
    """To [-1, 1] by the range seen; values beyond it are clipped."""
    rows = [(r["feature"], r["low"] or 0.0, w if r["n"] and (w := r["high"] - r["low"]) >= LEAST else 1.0) for r in moments.collect()]
    return Scaler({c: low + width / 2 for c, low, width in rows}, {c: width / 2 for c, _, width in rows}, clip=True)


def save_scaler(spark: SparkSession, scaler: Scaler, path: str) -> None:
    spark.createDataFrame([(c, scaler.shift[c], scaler.scale[c], scaler.clip) for c in scaler.shift], "feature string, shift double, scale double, clip boolean").write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> Scaler:
    rows = spark.read.parquet(path).collect()
    return Scaler({r["feature"]: r["shift"] for r in rows}, {r["feature"]: r["scale"] for r in rows}, clip=any(r["clip"] for r in rows))


def scaled_columns(df: DataFrame, target: str = "log_return", with_target: bool = False, with_target_lags: bool = False, more: tuple[str, ...] = ("frac_diff",)) -> list[str]:
    """Numeric columns to scale: none that is bounded or a code by its name, keys and the target left out unless asked for."""
    bounded = ("_sin", "_cos", "time", "crash", "vol_regime", "cross_ma", *more)
    numbers = [c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal")]
    lagged = [c for c in numbers if c.startswith(f"{target}_lag")]
    plain = [c for c in numbers if c not in ("series", "bar_id", target) and c not in lagged and not any(b in c for b in bounded)]
    return plain + (lagged if with_target_lags else []) + ([target] if with_target and target in numbers else [])


def co_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, mean_a, mean_b, c) of each pair with a not after b: over rows with both, c the sum of products of deviations."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def one(a: str, b: str):
        x, y = F.when(_known(b).isNotNull(), _known(a)), F.when(_known(a).isNotNull(), _known(b))
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"), F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"), (F.covar_pop(x, y) * F.count(x)).alias("c"))

    return df.agg(F.array(*[one(a, b) for a, b in pairs]).alias("x")).select(F.inline("x"))


@dataclass(frozen=True)
class Components:
    """Standardised columns projected on ``vectors`` (columns x components); nulls count as the mean."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    vectors: tuple[tuple[float, ...], ...]
    shares: tuple[float, ...]

    def transform(self, df: DataFrame, name: str) -> DataFrame:
        """The columns are replaced by pca_<name>_c<i>."""
        z = [(F.coalesce(_known(c), F.lit(m)) - m) / s for c, m, s in zip(self.columns, self.mean, self.scale)]
        parts = {f"pca_{name}_c{i}": sum((z[j] * self.vectors[j][i] for j in range(1, len(z))), start=z[0] * self.vectors[0][i]) for i in range(len(self.shares))}
        return df.withColumns(parts).drop(*self.columns)


def components_of(parts: DataFrame, variance: float = 0.9) -> Components:
    """The first components that hold ``variance`` of the correlation matrix of all batches, from the rows of their co-moments.

    Nulls count as the mean of all batches, so they add nothing to a sum of products. Only columns squared numbers reach the driver; a component's first
    loading that isn't near 0 is positive. Columns without spread have no correlation with others.
    """
    own = parts.where("n > 0")
    means = own.where("a = b").groupBy("a").agg((F.sum(F.col("n") * F.col("mean_a")) / F.sum("n")).alias("m"))
    about = own.join(F.broadcast(means), "a").join(F.broadcast(means.select(F.col("a").alias("b"), F.col("m").alias("k"))), "b")
    got = {(r["a"], r["b"]): (r["n"], r["c"]) for r in about.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(F.col("c") + F.col("n") * (F.col("mean_a") - F.col("m")) * (F.col("mean_b") - F.col("k"))).alias("c")).collect()}
    mean = {r["a"]: r["m"] for r in means.collect()}
    columns = sorted({r["a"] for r in parts.select("a").distinct().collect()})
    cell = lambda a, b: got.get((a, b)) or got.get((b, a)) or (0, 0.0)
    spread = {a: (cell(a, a)[1] / (cell(a, a)[0] - 1)) ** 0.5 if cell(a, a)[0] > 1 else 0.0 for a in columns}
    flat = {a for a in columns if spread[a] < LEAST}
    root = lambda a, b: (cell(a, a)[1] * cell(b, b)[1]) ** 0.5
    m = np.array([[1.0 if a == b else 0.0 if {a, b} & flat else cell(a, b)[1] / root(a, b) for b in columns] for a in columns])
    values, vectors = np.linalg.eigh(m)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    vectors = vectors * np.array([np.sign(v[np.abs(v) > 1e-9][0]) for v in vectors.T])
    k = min(int(np.searchsorted(np.cumsum(values) / values.sum(), variance) + 1), len(columns))
    return Components(tuple(columns), tuple(float(mean.get(c, 0.0)) for c in columns), tuple(1.0 if c in flat else spread[c] for c in columns), tuple(tuple(float(x) for x in row[:k]) for row in vectors), tuple(float(v) for v in values[:k] / values.sum()))
