"""Boosted trees with a softmax over classes, focal loss, class weights and early stopping, by histograms.

Features are binned once, by quantiles of the training rows; rows are written as bytes of bins. For each level of a round's trees one pass sums gradients and
curvatures by (class, node, feature, bin) in each task; tasks' sums are added by cell, and the driver, which gets classes x nodes x features x bins
numbers whatever the number of rows, picks the splits. Scores of rows are written every ``REWRITE`` rounds, so that a pass applies few trees.

A null or NaN is a bin of its own, below all others; a column that is constant is never split. Rows with a null label are left out; without any row left it is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

REWRITE = 8


@dataclass(frozen=True)
class Tree:
    """A tree in heap order: node i has the children 2i + 1 and 2i + 2; a leaf has feature -1. Bins up to ``at`` go left."""

    feature: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[node]
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > self.at[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: 0 for none, else 1 and the number of edges below it."""
    return np.stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c, "left")) for c, e in zip(x.T, edges)], axis=1).astype(np.uint8)


def scores(bins: np.ndarray, start: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    out = np.tile(start, (len(bins), 1)) if start.ndim == 1 else start.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += tree.value[tree.leaf(bins)]
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def focal(z: np.ndarray, y: np.ndarray, w: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each row, -w (1 - p)^gamma ln p with p the probability of its class, and gradients and curvatures by score; with gamma 0 the log loss."""
    p = softmax(z)
    own = np.clip(p[np.arange(len(y)), y], 1e-15, 1 - 1e-12)
    rest = 1 - own
    slope = gamma * own * rest ** (gamma - 1) * np.log(own) - rest**gamma
    hit = np.zeros(p.shape)
    hit[np.arange(len(y)), y] = 1
    return -w * rest**gamma * np.log(own), (w * slope)[:, None] * (hit - p), np.maximum((w * -slope)[:, None] * p * (1 - p), 1e-12)


@dataclass
class Boosted:
    """A fitted model: bins' edges, the rounds' trees, and the losses of the training and the held-out rows before the first round and after each."""

    features: list[str]
    classes: list
    edges: list[np.ndarray]
    start: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    held_out: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction, the class of the largest score, the first on ties, and proba in the order of ``classes``."""
        shared = df.sparkSession.sparkContext.broadcast((self.edges, self.start, self.rounds))

        @F.pandas_udf("array<double>")
        def told(x: pd.Series) -> pd.Series:
            edges, start, rounds = shared.value
            bins = binned(np.stack([np.asarray(v, float) for v in x]), edges) if len(x) else np.zeros((0, len(edges)), np.uint8)
            return pd.Series(list(softmax(scores(bins, start, rounds))))

        rows = df.withColumn("proba", told(_vector(self.features)))
        best = F.array_position("proba", F.array_max("proba")).cast("int")
        return rows.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes)), best))


def _vector(features: list[str]):
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])


def _edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Edges between bins of about equal numbers of rows, from one aggregate; the largest value is no edge."""
    at = [i / (bins - 1) for i in range(1, bins - 1)]
    x = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    got = rows.agg(*[F.percentile_approx(c, at, 10_000).alias(f"q{i}") for i, c in enumerate(x)], *[F.max(c).alias(f"m{i}") for i, c in enumerate(x)]).first()
    return [np.array([e for e in sorted(set(got[f"q{i}"] or [])) if e < got[f"m{i}"]]) for i in range(len(features))]


def _written(rows: DataFrame, features: list[str], label: str, classes: list, weights: dict, edges: list[np.ndarray], start: np.ndarray) -> DataFrame:
    """(bins, y, w, z): bytes of bins, number of the class, weight, scores."""
    y = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
    w = F.element_at(F.array(*[F.lit(float(weights[c])) for c in classes]), (y + 1).cast("int"))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                bins = binned(np.stack([np.asarray(v, float) for v in pdf["x"]]), edges)
                yield pd.DataFrame({"bins": [b.tobytes() for b in bins], "y": pdf["y"], "w": pdf["w"], "z": [start] * len(pdf)})

    return cut(rows.select(_vector(features).alias("x"), y.cast("int").alias("y"), w.alias("w")).where("y >= 0").mapInPandas(run, "bins binary, y int, w double, z array<double>"))


def _arrays(pdf: pd.DataFrame, rounds: list[list[Tree]]):
    bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), -1)
    return bins, scores(bins, np.stack(pdf["z"].to_numpy()), rounds), pdf["y"].to_numpy(np.int64), pdf["w"].to_numpy(float)


def _histograms(rows: DataFrame, pending: list[list[Tree]], growing: list[Tree], level: int, shape: tuple[int, int], gamma: float) -> tuple[dict, float]:
    """Sums of (gradient, curvature, rows) by feature and bin for each (class, node of the level), and the loss over the weight."""
    shared, (n, bins) = rows.sparkSession.sparkContext.broadcast((pending, growing)), shape
    first = (1 << level) - 1

    def run(batches):
        pending, growing = shared.value
        held: dict[int, np.ndarray] = {-1: np.zeros(2)}
        for pdf in batches:
            for i in range(0, len(pdf), 50_000):
                x, z, y, w = _arrays(pdf.iloc[i : i + 50_000], pending)
                loss, g, h = focal(z, y, w, gamma)
                held[-1] += loss.sum(), w.sum()
                for k, tree in enumerate(growing):
                    node = tree.leaf(x) - first
                    here = np.flatnonzero(node >= 0)
                    for a in np.unique(node[here]):
                        mine = here[node[here] == a]
                        total = held.setdefault((k << level) + int(a), np.zeros((n, bins, 3)))
                        for f in range(n):
                            own = x[mine, f]
                            for j, v in enumerate((g[mine, k], h[mine, k], None)):
                                total[f, :, j] += np.bincount(own, v, bins)
        yield pd.DataFrame({"cell": list(held), "sums": [v.tobytes() for v in held.values()]})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, v in zip(pdf["cell"], pdf["sums"]):
                held[k] = held.get(k, 0) + np.frombuffer(v)
        if held:
            yield pd.DataFrame({"cell": list(held), "sums": [v.tobytes() for v in held.values()]})

    kind = "cell int, sums binary"
    found = {r[0]: np.frombuffer(r[1]) for r in rows.mapInPandas(run, kind).repartition("cell").mapInPandas(add, kind).collect()}
    loss, weight = found.pop(-1, np.zeros(2))
    return {divmod(c, 1 << level): v.reshape(n, bins, 3) for c, v in found.items()}, loss / weight if weight else float("nan")


def best_split(sums: np.ndarray, l2: float, least: int, gain: float = 1e-9) -> tuple[int, int] | None:
    """(feature, bin) whose split of a node gains most, the first of equals; None if none gains with ``least`` rows on either side."""
    left = np.cumsum(sums, axis=1)
    whole = left[:, -1:]
    right = whole - left
    value = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    found = np.where((left[..., 2] >= least) & (right[..., 2] >= least), value(left) + value(right) - value(whole), -np.inf)[:, :-1]
    f, b = np.unravel_index(np.argmax(found), found.shape)
    return (int(f), int(b)) if found[f, b] > gain else None


def boost(train: DataFrame, features: list[str], label: str = "label", rounds: int = 50, depth: int = 3, rate: float = 0.1, bins: int = 64, gamma: float = 0.0, class_weight: str | dict | None = None, held_out: DataFrame | None = None, patience: int = 10, l2: float = 1.0, least: int = 1) -> Boosted:
    """Fit by rounds of one tree a class.

    class_weight is "balanced" (rows over classes times the class's rows), a weight of each class, or None. With ``held_out`` rows, rounds end once their loss
    has not fallen for ``patience`` rounds, and the rounds after its least are dropped; rows there of a class that training lacks are left out.
    """
    if not 3 <= bins <= 255:
        raise ValueError("bins must be between 3 and 255")
    rows = train.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    classes = sorted(counts)
    if not classes:
        raise ValueError("no training rows")
    n = sum(counts.values())
    weights = {c: n / (len(classes) * counts[c]) for c in classes} if class_weight == "balanced" else {c: (class_weight or {}).get(c, 1.0) for c in classes}
    edges, start = _edges(rows, features, bins), np.zeros(len(classes))
    model = Boosted(list(features), classes, edges, start)
    data = {"train": _written(rows, features, label, classes, weights, edges, start)}
    if held_out is not None:
        data["held_out"] = _written(held_out.where(F.col(label).isNotNull()), features, label, classes, weights, edges, start)
    done, nodes, shape = 0, (1 << (depth + 1)) - 1, (len(features), bins + 1)
    for _ in range(rounds):
        if len(model.rounds) - done >= REWRITE:
            fresh = model.rounds[done:]

            def rewrite(batches, fresh=fresh):
                for pdf in batches:
                    if len(pdf):
                        yield pdf.assign(z=list(_arrays(pdf, fresh)[1]))

            data = {k: cut(d.mapInPandas(rewrite, d.schema)) for k, d in data.items()}
            done = len(model.rounds)
        growing = [Tree(np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)) for _ in classes]
        for level in range(depth + 1):
            found, loss = _histograms(data["train"], model.rounds[done:], growing, level, shape, gamma)
            if level == 0:
                model.losses.append(loss)
            for (k, a), sums in found.items():
                node, whole = (1 << level) - 1 + a, sums[0].sum(axis=0)
                split = best_split(sums, l2, least) if level < depth else None
                if split is None:
                    growing[k].value[node] = -rate * whole[0] / (whole[1] + l2)
                else:
                    growing[k].feature[node], growing[k].at[node] = split
        model.rounds.append(growing)
        if "held_out" in data:
            if not model.held_out:
                model.held_out.append(_histograms(data["held_out"], [], [], 0, shape, gamma)[1])
            model.held_out.append(_histograms(data["held_out"], model.rounds[done:], [], 0, shape, gamma)[1])
            if len(model.held_out) - 1 - int(np.nanargmin(model.held_out)) >= patience:
                break
    model.losses.append(_histograms(data["train"], model.rounds[done:], [], 0, shape, gamma)[1])
    if model.held_out and not np.isnan(model.held_out).all():
        keep = int(np.nanargmin(model.held_out))
        model.rounds, model.losses = model.rounds[:keep], model.losses[: keep + 1]
    return model
