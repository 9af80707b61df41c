"""Centroid clustering: plain Lloyd rounds in exact integer arithmetic.

Components become integers floor(scale * x). The first centroids are the kept vectors whose ids have the least SHA-256 hashes. In each round the
centroids, k x dim numbers, are broadcast; ``mapInPandas`` takes integer squared differences per centroid, the argmin takes the lowest
number, and each task returns one row of sums per cluster, which a groupBy merges: k rows reach the driver, whatever the input.
The integers are written once, so that the rounds don't decode the source again.

Kept are vectors with exactly ``dim`` components, none null or non-finite. A component whose integer is ``LIMIT`` or more in size would bring a
squared distance that no long holds: such a vector is left out too. With fewer than k kept vectors there are as many clusters as vectors; an empty table gives no rows.
A null id is hashed as an empty text and passes through; rows that repeat are vectors of their own; equal hashes are ordered by their vectors.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DIM, SCALE, K, ROUNDS = 64, 1024, 8, 10
#: 64 squared differences of integers below it sum to less than 2^63.
LIMIT = 1 << 27
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(rows: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<long>) of the kept vectors."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == dim)
    kept = v.where(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LIMIT / scale), F.lit(False))))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def first_centroids(x: DataFrame, k: int = K, salt: str = "3:") -> np.ndarray:
    """The vectors with the k least hashes of salt and id, in the hashes' order."""
    by = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["x"] for r in x.orderBy(by, "x").limit(k).collect()], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the lowest of equals, and the squared distance."""
    far = np.stack([np.einsum("ij,ij->i", d, d) for d in (x - c for c in centroids)])
    at = np.argmin(far, axis=0)
    return at, far[at, np.arange(len(x))]


def _sums(x: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Per non-empty cluster: rows, summed distance, summed components."""
    shared, (k, dim) = x.sparkSession.sparkContext.broadcast(centroids), centroids.shape

    def run(batches):
        n, far, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for pdf in batches:
            if len(pdf):
                own = np.stack(pdf["x"].to_numpy())
                at, d = nearest(own, shared.value)
                n += np.bincount(at, minlength=k)
                np.add.at(far, at, d)
                for c in np.unique(at):
                    sums[c] += own[at == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": some, "n": n[some], "far": far[some], "sums": list(sums[some])})

    parts = x.select("x").mapInPandas(run, "cluster int, n long, far long, sums array<long>")
    merged = parts.groupBy("cluster").agg(F.sum("n"), F.sum("far"), *[F.sum(F.col("sums")[i]) for i in range(dim)]).collect()
    shared.unpersist()
    return {r[0]: (r[1], r[2], list(r[3:])) for r in merged}


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = "3:") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 per kept vector. Runs ``rounds`` + 1 jobs while the plan is built."""
    x = cut(integers(rows, dim, scale))
    centroids = first_centroids(x, k, salt)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], RESULT)
    for _ in range(rounds):
        centroids = centroids.copy()
        for c, (n, _, sums) in _sums(x, centroids).items():
            centroids[c] = [s // n for s in sums]
    far = {c: d for c, (_, d, _) in _sums(x, centroids).items()}
    each = np.array([far.get(c, 0) for c in range(len(centroids))], np.int64)
    names = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], object)
    shared = x.sparkSession.sparkContext.broadcast((centroids, each, sum(far.values()), names))

    def run(batches):
        centroids, each, total, names = shared.value
        for pdf in batches:
            if len(pdf):
                at, d = nearest(np.stack(pdf["x"].to_numpy()), centroids)
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "cluster": at.astype(np.int32), "distance": d, "cluster_inertia": each[at], "inertia": total, "centroid_sha256": names[at]})

    # ids travel as texts: pandas would turn longs with a null among them into doubles
    found = x.select(F.col("vec_id").cast("string").alias("id"), "x").mapInPandas(run, RESULT.replace("vec_id long", "id string"))
    return found.select(F.col("id").cast("long").alias("vec_id"), *found.columns[1:])
