"""Mutual information from nearest neighbours (Kraskov, Stoegbauer and Grassberger 2004, first estimator), exact and without pairs of all rows.

Points (x, y), each axis over its standard deviation, are dealt by ranges of (feature, x, y) to cells; the cells' boxes, one a cell and feature, are all that the
driver holds. A cell splits its points into leaves at medians, as a k-d tree does, and finds each point's k nearest in the largest norm
among its own. Only a point whose square of that radius leaves its cell is sent on, to the cells whose boxes the square meets; these answer with
nearer ones. How many values lie within the radius on either axis comes from the values and the intervals' ends in one order, with
running sums carried over slices. Equal points are one with a weight, of which at most k + 1 copies matter to a radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import finite
from ..functions.lineage import cut
from ..functions.slices import MOST, carry, in_slices, stitch, summaries

LEAF = 128
#: Distances taken at a time.
LOT = 1 << 21
#: Distances that differ by less than this part of themselves are equal, so that values on a grid don't hang on rounding.
SAME = 1e-10


def leaves(p: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Rows of ``p`` in groups of at most ``size``, split at the median of the wider side."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        own = p[rows]
        side = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.argpartition(own[:, side], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return [rows for rows in out if len(rows)]


def _least(near: np.ndarray, k: int) -> np.ndarray:
    """The k least of each row in order, with infinities where there are fewer."""
    if near.shape[1] < k:
        near = np.concatenate([near, np.full((len(near), k - near.shape[1]), np.inf)], axis=1)
    return np.sort(np.partition(near, k - 1, axis=1)[:, :k], axis=1)


class Tree:
    """Points in leaves with their boxes."""

    def __init__(self, p: np.ndarray) -> None:
        self.p, self.leaves = p, leaves(p)
        self.low, self.high = (np.array([f(p[rows], axis=0) for rows in self.leaves]).reshape(-1, 2) for f in (np.min, np.max))

    def around(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Points in a box, its sides among them."""
        met = np.flatnonzero((self.low <= high).all(axis=1) & (self.high >= low).all(axis=1))
        got = self.p[np.concatenate([self.leaves[i] for i in met])] if len(met) else self.p[:0]
        return got[((got >= low) & (got <= high)).all(axis=1)]

    def nearest(self, q: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
        """The k least distances of each q to points, those beyond q's ``reach`` only where they happen to be met."""
        out = np.empty((len(q), k))
        for rows in leaves(q):
            far = reach[rows].max()
            near = self.around(q[rows].min(axis=0) - far, q[rows].max(axis=0) + far)
            best = np.full((len(rows), k), np.inf)
            for i in range(0, len(near), LOT // LEAF):
                part = near[i : i + LOT // LEAF]
                apart = np.maximum(np.abs(q[rows, None, 0] - part[None, :, 0]), np.abs(q[rows, None, 1] - part[None, :, 1]))
                best = _least(np.concatenate([best, apart], axis=1), k)
            out[rows] = best
        return out

    def own(self, q: np.ndarray, k: int) -> np.ndarray:
        """The k least distances of each point q of the tree to the others."""
        reach = np.empty(len(q))
        for rows in leaves(q):  # among its leaf's points at first
            apart = np.maximum(np.abs(q[rows, None, 0] - q[None, rows, 0]), np.abs(q[rows, None, 1] - q[None, rows, 1]))
            reach[rows] = _least(apart, k + 1)[:, k]
        bound = np.abs(self.p).max() * 4 + 1
        return self.nearest(q, np.minimum(reach, bound), k + 1)[:, 1:]


def _groups(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows of each group whole; batches come in order of the keys."""
    now, held = None, []
    for pdf in batches:
        for key, part in pdf.groupby(list(keys), sort=False):
            if held and key != now:
                yield now, pd.concat(held, ignore_index=True)
                held = []
            now = key
            held.append(part)
    if held:
        yield now, pd.concat(held, ignore_index=True)


def radii(points: DataFrame, k: int, cells: int | None = None) -> DataFrame:
    """(id, feature, x, y, w, r) for distinct ``points(feature, x, y, w)``: r is the distance in the largest norm to the k-th nearest of all other points of the feature, copies among them.

    Runs jobs while the plan is built. A point with fewer than k others has an infinite r.
    """
    n = cells or min(MOST, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(points.repartitionByRange(n, "feature", "x", "y").withColumn("cell", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()))
    boxes: dict[str, np.ndarray] = {}
    found = placed.groupBy("feature", "cell").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).collect()
    for name in {r[0] for r in found}:
        boxes[name] = np.array([tuple(r)[1:] for r in found if r[0] == name], float)
    shared = points.sparkSession.sparkContext.broadcast(boxes)

    def first(batches):
        for (name, cell), pdf in _groups(batches, "feature", "cell"):
            p, copies = pdf[["x", "y"]].to_numpy(float), np.minimum(pdf["w"].to_numpy(np.int64), k + 1)
            near = Tree(np.repeat(p, copies, axis=0)).own(p, k)
            r, box = near[:, -1], shared.value[name]
            mine = box[box[:, 0] == cell][0]
            edge = np.flatnonzero((p[:, 0] - r <= mine[1]) | (p[:, 0] + r >= mine[2]))
            others, targets = box[box[:, 0] != cell], [[] for _ in range(len(p))]
            for i in range(0, len(edge), 4096):
                e = edge[i : i + 4096]
                x, y, far = p[e, 0, None], p[e, 1, None], r[e, None]
                met = (others[None, :, 1] <= x + far) & (others[None, :, 2] >= x - far) & (others[None, :, 3] <= y + far) & (others[None, :, 4] >= y - far)
                for a, b in zip(*np.nonzero(met)):
                    targets[e[a]].append(int(others[b, 0]))
            yield pdf[["id", "feature", "x", "y", "w", "cell"]].assign(near=list(near), targets=targets)

    local = cut(placed.sortWithinPartitions("feature", "cell").mapInPandas(first, "id long, feature string, x double, y double, w long, cell int, near array<double>, targets array<int>"))
    asked = local.where(F.size("targets") > 0).select("id", "feature", "x", "y", F.lit(0).cast("long").alias("w"), F.explode("targets").alias("cell"), F.element_at("near", -1).alias("r"))
    both = placed.select("id", "feature", "x", "y", "w", "cell", F.lit(None).cast("double").alias("r"))
    both = both.join(asked.select("feature", "cell").distinct(), ["feature", "cell"], "left_semi").select(*asked.columns).unionByName(asked)

    def answer(batches):
        for _, pdf in _groups(batches, "feature", "cell"):
            known = pdf["w"].to_numpy(np.int64) > 0
            p, q = pdf.loc[known, ["x", "y"]].to_numpy(float), pdf[~known]
            tree = Tree(np.repeat(p, np.minimum(pdf.loc[known, "w"].to_numpy(np.int64), k + 1), axis=0))
            bound = np.abs(p).max() * 4 + np.abs(q[["x", "y"]].to_numpy(float)).max() * 4 + 1
            near = tree.nearest(q[["x", "y"]].to_numpy(float), np.minimum(q["r"].to_numpy(float), bound), k)
            yield pd.DataFrame({"id": q["id"].to_numpy(), "near": list(near)})

    told = both.repartition("feature", "cell").sortWithinPartitions("feature", "cell").mapInPandas(answer, "id long, near array<double>")
    told = told.unionByName(local.where(F.size("targets") > 0).select("id", "near"))
    # k distances from each cell that a square meets
    least = told.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("near")))[k - 1].alias("least"))
    return local.join(least, "id", "left").select("id", "feature", "x", "y", "w", F.coalesce("least", F.element_at("near", -1)).alias("r"))


def edge_of(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The least value whose difference from x, as doubles have it, is r or more: found between two values a few roundings apart, by halving their places among all doubles."""
    room = 4 * np.spacing(np.maximum(np.abs(x), r))
    place = lambda v: np.where((i := v.view(np.int64)) < 0, np.iinfo(np.int64).min - i, i)
    value = lambda i: np.where(i < 0, np.iinfo(np.int64).min - i, i).view(np.float64)
    low, high = place(x + r - room), place(x + r + room)
    while (high - low > 1).any():
        middle = low + (high - low) // 2
        reached = value(middle) - x >= r
        low, high = np.where(reached, low, middle), np.where(reached, middle, high)
    return value(high)


def within(reach: DataFrame) -> DataFrame:
    """(id, axis, n): for (id, feature, x, y, w, r), the other values of the feature's axis nearer than r (by more than ``SAME``); where r is 0, the equal ones.

    Values and interval ends are put in one order, by slices; an end's count is the running sum of weights before it.
    """

    def ends(batches):
        for pdf in batches:
            for axis in ("x", "y"):
                v, r, name = pdf[axis].to_numpy(float), pdf["r"].to_numpy(float) * (1 - SAME), pdf["feature"] + f"/{axis}"
                high, low = edge_of(v, r), -edge_of(-v, r)
                zero = r == 0
                # kind 0 stands before equal values, 1 is a value, 2 stands after equal values
                yield pd.DataFrame({"series": name, "v": v, "kind": 1, "w": pdf["w"], "id": -1, "sign": 0})
                yield pd.DataFrame({"series": name, "v": np.where(zero, v, high), "kind": np.where(zero, 2, 0), "w": 0, "id": pdf["id"], "sign": 1})
                yield pd.DataFrame({"series": name, "v": np.where(zero, v, low), "kind": np.where(zero, 0, 2), "w": 0, "id": pdf["id"], "sign": -1})

    sliced = in_slices(reach.mapInPandas(ends, "series string, v double, kind int, w long, id long, sign int"), "v", "kind")

    def feed(total, part):
        total[0] += int(part["w"].sum())

    states = stitch(summaries(sliced, ["w"], lambda _: [0], feed), lambda before, total: (before or 0) + total[0])

    def step(before, part):
        sums = before + np.cumsum(part["w"].to_numpy(np.int64))
        asked = (part["sign"] != 0).to_numpy()
        return pd.DataFrame({"id": part["id"].to_numpy()[asked], "axis": part["series"].str[-1].to_numpy()[asked], "n": (sums * part["sign"].to_numpy())[asked]}), int(sums[-1])

    counted = carry(sliced, states, lambda s: s or 0, step, "id long, axis string, n long")
    return counted.groupBy("id", "axis").agg((F.sum("n") - 1).alias("n"))


def digamma(x: Column) -> Column:
    """The digamma function of numbers of 1 or more: shifted up by eight, then its asymptotic series."""
    z = x + 8
    return F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - sum((1 / (x + i) for i in range(1, 8)), start=1 / x)


def mutual_information(df: DataFrame, columns: list[str], target: str, k: int = 3, cells: int | None = None) -> DataFrame:
    """(feature, mi): mutual information with the target in nats by the k nearest neighbours, 0 at least; rows not finite in all columns are left out.

    Both axes are taken over their deviation (a constant stays as it is); nothing random breaks ties. With k rows or fewer mi is null. Runs jobs while the plan is built.
    """
    whole = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in dict.fromkeys([*columns, target])]).dropna()
    spread = whole.agg(F.count("*").alias("n"), *[F.stddev_pop(c).alias(c) for c in whole.columns]).first()
    scale = {c: spread[c] if spread[c] else 1.0 for c in whole.columns}
    pairs = whole.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) / scale[c]).alias("x"), (F.col(target) / scale[target]).alias("y")) for c in columns])).alias("p")).select("p.*")
    reach = cut(radii(pairs.groupBy("feature", "x", "y").agg(F.count("*").alias("w")), k, cells).where(F.col("r") < float("inf")))
    counts = within(reach).groupBy("id").agg(F.sum(digamma(F.col("n") + 1)).alias("told"))
    means = reach.join(counts, "id").groupBy("feature").agg((F.sum(F.col("told") * F.col("w")) / F.sum("w")).alias("mean"), F.sum("w").alias("n"))
    mi = means.select("feature", F.greatest(digamma(F.col("n").cast("double")) + digamma(F.lit(float(k))) - F.col("mean"), F.lit(0.0)).alias("mi"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(F.broadcast(mi), "feature", "left")
