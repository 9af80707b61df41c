"""Trees of features: a table of merges, flat cuts of it, and the number of groups by silhouette.

Distances come from one aggregate over the rows; what is held has the number of columns squared. Merges are found by chains of nearest neighbours with the updates
of Lance and Williams. With distance 1 - |corr|, or, for Ward's method, sqrt(2 (1 - |corr|)); a column without a correlation (a constant) has the largest distance to all others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .analysis import _matrix

Merge = tuple[int, int, float, int]


def distances(df: DataFrame, columns: list[str], method: str = "average") -> np.ndarray:
    near = np.nan_to_num(np.abs(np.asarray(_matrix(df, columns), float)), nan=0.0).clip(0, 1)
    np.fill_diagonal(near, 1.0)
    return np.sqrt(2 * (1 - near)) if method == "ward" else 1 - near


def merges(far: np.ndarray, method: str = "average") -> list[Merge]:
    """(left, right, height, size) in order of height: columns are 0 to n - 1, the k-th merge is n + k; left is the smaller number."""
    n = len(far)
    d = (far**2 if method == "ward" else far).astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, chain, found = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            top = chain[-1]
            row = np.where(alive, d[top], np.inf)
            row[top] = np.inf
            near = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        height = d[a, b]
        others = alive.copy()
        others[[a, b]] = False
        x, y, na, nb, nc = d[a, others], d[b, others], size[a], size[b], size[others]
        new = {"single": lambda: np.minimum(x, y), "complete": lambda: np.maximum(x, y), "average": lambda: (na * x + nb * y) / (na + nb), "ward": lambda: ((na + nc) * x + (nb + nc) * y - nc * height) / (na + nb + nc)}[method]()  # noqa: B023
        d[a, others] = d[others, a] = new
        alive[b], size[a] = False, na + nb
        found.append((a, b, float(np.sqrt(max(height, 0.0)) if method == "ward" else height)))
    # chains meet merges out of order; of equal heights the first found goes first
    name, count, out = list(range(n)), [1] * n, []
    for k, (a, b, height) in enumerate(sorted(found, key=lambda m: m[2])):
        # either place stands for its whole group
        left, right = sorted((_top(name, a), _top(name, b)))
        name += [n + k]
        count.append(count[left] + count[right])
        name[left] = name[right] = n + k
        out.append((left, right, height, count[-1]))
    return out


def _top(name: list[int], i: int) -> int:
    while name[i] != i:
        i = name[i]
    return i


def flat(found: list[Merge], n: int, k: int | None = None, height: float | None = None) -> list[int]:
    """Group of each column, numbered by first columns: merges up to ``height``, or up to the least height that leaves k groups or fewer."""
    if k is not None:
        height = found[n - k - 1][2] if 0 < n - k <= len(found) else -1.0 if n - k <= 0 else found[-1][2] if found else 0.0
    name = list(range(n))
    for i, (a, b, far, _) in enumerate(found):
        name.append(n + i)
        if far <= height:
            name[_top(name, a)] = name[_top(name, b)] = n + i
    tops = [_top(name, i) for i in range(n)]
    seen: dict[int, int] = {}
    return [seen.setdefault(t, len(seen)) for t in tops]


def silhouettes(far: np.ndarray, groups: list[int]) -> np.ndarray:
    """Of each column: how much nearer its own group is than the next; 0 for a group of one or a single group."""
    g, out = np.asarray(groups), np.zeros(len(groups))
    names = np.unique(g)
    if len(names) < 2:
        return out
    for i in range(len(g)):
        own = (g == g[i]) & (np.arange(len(g)) != i)
        if own.any():
            a, b = far[i, own].mean(), min(far[i, g == c].mean() for c in names if c != g[i])
            out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def feature_tree(df: DataFrame, columns: list[str], method: str = "average") -> DataFrame:
    """(step, left, right, height, size): what is merged at each step; names below the number of columns are columns, others n plus a step."""
    found = merges(distances(df, columns, method), method)
    return df.sparkSession.createDataFrame([(i, *m) for i, m in enumerate(found)], "step int, left int, right int, height double, size int")


def cut_tree(df: DataFrame, columns: list[str], k: int | None = None, height: float | None = None, method: str = "average") -> DataFrame:
    """(feature, cluster, silhouette) of a cut into k groups or at a height."""
    if (k is None) == (height is None):
        raise ValueError("name either a number of groups or a height")
    far = distances(df, columns, method)
    groups = flat(merges(far, method), len(columns), k, height)
    rows = zip(columns, groups, silhouettes(far, groups).tolist())
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], "feature string, cluster int, silhouette double")


def numbers_of_groups(df: DataFrame, columns: list[str], least: int = 2, most: int = 10, method: str = "average") -> DataFrame:
    """(k, groups, silhouette, best) for each k from ``least`` to ``most``, one less than the columns at most; the largest mean silhouette is best, the smallest k of equals."""
    far = distances(df, columns, method)
    found, rows = merges(far, method), []
    for k in range(least, min(most, len(columns) - 1) + 1):
        groups = flat(found, len(columns), k)
        rows.append((k, len(set(groups)), float(silhouettes(far, groups).mean())))
    best = max(rows, key=lambda r: (r[2], -r[0]), default=None)
    return df.sparkSession.createDataFrame([(*r, r == best) for r in rows], "k int, groups int, silhouette double, best boolean")
