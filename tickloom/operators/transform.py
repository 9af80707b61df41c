"""Splits, scalers, log transforms and component reduction, fitted on training rows only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_by_time(df: DataFrame, ratio: float = 0.8, by: str = "bar_id") -> DataFrame:
    """split: the first part of each series is train, the rest test."""
    w = Window.partitionBy("series")
    return df.withColumn("split", F.when(F.row_number().over(w.orderBy(by)) <= F.floor(F.count("*").over(w) * ratio), "train").otherwise("test"))


@dataclass(frozen=True)
class Scaler:
    """x -> (x - shift) / scale, then clipped if ``clip``. One pair of numbers a column."""

    shift: dict[str, float]
    scale: dict[str, float]
    clip: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        def one(c: str):
            x = (F.col(c) - self.shift[c]) / self.scale[c]
            return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) if self.clip else x

        return df.withColumns({c: F.when(F.col(c).isNotNull(), one(c)) for c in self.shift})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * self.scale[c] + self.shift[c] for c in self.shift})


def standard_scaler(train: DataFrame, columns: list[str]) -> Scaler:
    r = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]).first()
    return Scaler({c: r[f"m_{c}"] or 0.0 for c in columns}, {c: s if (s := r[f"s_{c}"]) is not None and s >= 1e-10 else 1.0 for c in columns})


def minmax_scaler(train: DataFrame, columns: list[str]) -> Scaler:
    """To [-1, 1] by the training range; values beyond it are clipped."""
    r = train.agg(*[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"b_{c}") for c in columns]).first()
    low = {c: r[f"a_{c}"] if r[f"a_{c}"] is not None else 0.0 for c in columns}
    width = {c: w if (w := (r[f"b_{c}"] if r[f"b_{c}"] is not None else 1.0) - low[c]) >= 1e-10 else 1.0 for c in columns}
    return Scaler({c: low[c] + width[c] / 2 for c in columns}, {c: width[c] / 2 for c in columns}, clip=True)


def signed_log(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.signum(c) * F.log1p(F.abs(c)) for c in columns})


def group_components(train: DataFrame, df: DataFrame, columns: list[str], name: str, variance: float = 0.9) -> DataFrame:
    """Replace a group of columns by its first components that hold ``variance``; median-imputed and standardised on train.

    The covariance has the columns' number squared entries; rows stay in Spark.
    """
    medians = train.agg(*[F.percentile(c, 0.5).alias(c) for c in columns]).first().asDict()
    fill = {c: float(v) if v is not None else 0.0 for c, v in medians.items()}
    scaler = standard_scaler(train.fillna(fill), columns)
    z = scaler.transform(train.fillna(fill))
    got = z.agg(*[F.covar_samp(a, b).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()
    m = np.array([[got[f"{min(i, j)}_{max(i, j)}"] for j in range(len(columns))] for i in range(len(columns))])
    values, vectors = np.linalg.eigh(m)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(columns))])
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), variance) + 1)
    out = scaler.transform(df.fillna(fill))
    parts = {f"pca_{name}_c{i}": sum(F.col(c) * float(vectors[j, i]) for j, c in enumerate(columns)) for i in range(min(k, len(columns)))}
    return out.withColumns(parts).drop(*columns)


def columns_to_drop(corr: list[tuple[str, str, float]], columns: list[str], threshold: float) -> list[str]:
    """Of each pair over the threshold the column with the larger mean absolute correlation."""
    m = {(a, b): abs(r) for a, b, r in corr} | {(b, a): abs(r) for a, b, r in corr}
    mean = {a: sum(m[a, b] for b in columns if b != a) / max(len(columns) - 1, 1) for a in columns}
    gone: set[str] = set()
    for i, a in enumerate(columns):
        if a not in gone:
            rivals = [b for b in columns[i + 1 :] if b not in gone and m[a, b] > threshold]
            gone |= {a if mean[a] > mean[b] else b for b in rivals}
    return sorted(gone)


def impute_medians(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls get the training median; 0 where the column has none."""
    r = train.agg(*[F.median(c).alias(c) for c in columns]).first()
    return df.fillna({c: float(r[c]) if r[c] is not None else 0.0 for c in columns})


@dataclass(frozen=True)
class LogTransform:
    """By column: ``signed`` (sign times log1p of the size) or ``log1p`` of the value plus a shift."""

    kinds: dict[str, tuple[str, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.signum(c) * F.log1p(F.abs(c)) if kind == "signed" else F.log1p(F.col(c) + shift) for c, (kind, shift) in self.kinds.items()})


def log_transform(train: DataFrame, columns: list[str], least: float = 1e-10) -> LogTransform:
    """Signed for columns with a negative training value; else log1p, shifted by ``least`` if the smallest value is under it."""
    r = train.agg(*[F.min(c).alias(c) for c in columns]).first()
    low = {c: r[c] if r[c] is not None else 0.0 for c in columns}
    return LogTransform({c: ("signed", 0.0) if low[c] < 0 else ("log1p", least if low[c] < least else 0.0) for c in columns})


def sequences(df: DataFrame, columns: list[str], length: int, by: str = "bar_id") -> DataFrame:
    """sequence: the ``length`` rows before each row, oldest first, an array of the columns each; rows with fewer before them go."""
    w = Window.partitionBy("series").orderBy(by)
    rows = df.withColumns({"sequence": F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w.rowsBetween(-length, -1)), "__i": F.row_number().over(w)})
    return rows.where(F.col("__i") > length).drop("__i")
