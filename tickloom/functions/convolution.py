"""Sums over all history with the weights of fractional differences, in n log n.

A series is cut into blocks of equal length. What a block gets from itself and the block before is a product of spectra (FFT) of three blocks' length. Further
back the weights are smooth: seen from a block and to a block, both at least a block apart, they are interpolated at ``NODES`` Chebyshev nodes each
to the precision of doubles. So each block is summed up by as many moments, the moments of all blocks before give the sum's values at a
block's nodes, and interpolation between these gives every row's. A task holds three blocks, or one series' moments, whose number
is bounded as blocks grow with the table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import SLICE, carry, in_slices, runs, stitch, summaries

NODES = 24
LEAST, BLOCKS = 4096, 2048


def weights(d: float, n: int) -> np.ndarray:
    """The first n weights of a difference of order d."""
    k = np.arange(1, n)
    return np.cumprod(np.concatenate([[1.0], (k - 1 - d) / k]))[:n]


def far_weights(d: float, k: np.ndarray) -> np.ndarray:
    """The weights as a function of a real, large lag: gamma(k - d) / (gamma(-d) gamma(k + 1)), by Stirling's series."""
    if d >= 0 and d == int(d):
        return np.zeros(k.shape)

    def rest(x):
        return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)

    a, b = k - d, k + 1
    log = (a - 0.5) * np.log1p(-d / k) - (b - 0.5) * np.log1p(1 / k) - (d + 1) * np.log(k) + d + 1 + rest(a) - rest(b)
    return np.exp(log) / math.gamma(-d)


def _nodes(block: int) -> np.ndarray:
    """Places of the Chebyshev nodes in a block."""
    return (block - 1) / 2 * (1 + np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES))


def basis(at: np.ndarray, block: int) -> np.ndarray:
    """(places x nodes): what each node's value counts at each place of a block."""
    t = np.clip(2 * at / (block - 1) - 1, -1, 1)
    j, angles = np.arange(NODES), np.pi * (np.arange(NODES) + 0.5) / NODES
    to = 2 / NODES * np.cos(np.outer(j, angles))
    to[0] /= 2
    return np.cos(np.outer(np.arccos(t), j)) @ to


def near_sums(own: np.ndarray, before: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of a block's rows over itself and the block before it."""
    x = np.concatenate([before, own])
    size = 1 << (2 * len(x) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(w[: len(x)], size), size)[len(before) : len(x)]


def far_sums(moments: np.ndarray, d: float, block: int) -> np.ndarray:
    """(blocks x nodes): at each block's nodes, the sum over all blocks two or more before it."""
    at, out = _nodes(block), np.zeros(moments.shape)
    for back in range(2, len(moments)):
        out[back:] += moments[:-back] @ far_weights(d, back * block + at[:, None] - at[None]).T
    return out


def _spread(part: pd.DataFrame, block: int, values: np.ndarray) -> np.ndarray:
    out = np.zeros(block)
    out[part["pos"].to_numpy() % block] = values
    return out


def fractional_difference(rows: DataFrame, by: str, d: float, block: int | None = None, slices: int | None = None) -> DataFrame:
    """(series, ``by``, pos, y) for ``rows(series, by, x)``: the row's place in its series from 0, and the difference of order d over all history; null from the first null or NaN x on."""
    sliced = in_slices(rows, by, slices=slices)

    def feed(total, part):
        total[0] += len(part)
        total[1] |= bool(part["x"].isna().any())

    parts = summaries(sliced, ["x"], lambda _: [0, False], feed)
    states = stitch(parts, lambda before, total: ((before or (0, False))[0] + total[0], (before or (0, False))[1] or total[1]))
    block = block or max(LEAST, 1 << (sum(p.rows for p in parts) // BLOCKS).bit_length())

    def number(state, part):
        n, lost = state
        bad = np.logical_or.accumulate(np.concatenate([[lost], part["x"].isna().to_numpy()]))[1:]
        out = part.drop(columns=SLICE).assign(pos=np.arange(n, n + len(part), dtype=np.int64), bad=bad)
        return out.assign(x=out["x"].where(~bad, 0.0), block=out["pos"] // block), (n + len(part), bool(bad[-1]))

    kind = dict(rows.dtypes)
    placed = carry(sliced, states, lambda s: s or (0, False), number, f"series {kind['series']}, `{by}` {kind[by]}, x double, pos long, bad boolean, block long")

    def sum_up(batches):
        now, place, total = None, None, None
        for pdf in batches:
            for key, series in runs(pdf):
                for b, part in series.groupby("block", sort=False):
                    if total is not None and (key, b) != now:
                        yield pd.DataFrame({"series": [now[0]], "block": [now[1]], "moments": [total.tolist()]})
                        total = None
                    now, total = (key, b), np.zeros(NODES) if total is None else total
                    for i in range(0, len(part), 1 << 16):
                        place = part["pos"].to_numpy()[i : i + (1 << 16)] % block
                        total = total + part["x"].to_numpy(float)[i : i + (1 << 16)] @ basis(place, block)
        if total is not None:
            yield pd.DataFrame({"series": [now[0]], "block": [now[1]], "moments": [total.tolist()]})

    moments = placed.select("series", "block", "pos", "x").repartition("series", "block").sortWithinPartitions("series", "block", "pos").mapInPandas(sum_up, f"series {kind['series']}, block long, moments array<double>")

    def see(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        return pdf.assign(moments=list(far_sums(np.array(pdf["moments"].tolist()), d, block)))

    # a series has a row per block here, BLOCKS or some more whatever its length
    far = moments.groupBy("series").applyInPandas(see, moments.schema)
    none = F.lit(None)
    own = placed.select("series", "block", F.lit(2).alias("kind"), "pos", F.col(by).alias("by"), "x", "bad", none.cast("array<double>").alias("far"))
    halo = placed.select("series", (F.col("block") + 1).alias("block"), F.lit(1).alias("kind"), "pos", F.col(by).alias("by"), "x", "bad", none.cast("array<double>").alias("far"))
    seen = far.select("series", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast(kind[by]).alias("by"), none.cast("double").alias("x"), F.lit(False).alias("bad"), F.col("moments").alias("far"))
    cells = own.unionByName(halo).unionByName(seen).repartition("series", "block").sortWithinPartitions("series", "block", "kind", "pos")

    def settle(key, held: list[pd.DataFrame]):
        whole = pd.concat(held, ignore_index=True)
        mine, before, sight = (whole[whole["kind"] == k] for k in (2, 1, 0))
        if not len(mine):
            return
        x, old = mine["x"].to_numpy(float), _spread(before, block, before["x"].to_numpy(float)) if len(before) else np.zeros(0)
        y = near_sums(x, old, weights(d, len(x) + len(old)))
        if len(before) and len(sight):
            values = np.asarray(sight["far"].iloc[0], float)
            for i in range(0, len(x), 1 << 16):
                y[i : i + (1 << 16)] += basis(mine["pos"].to_numpy()[i : i + (1 << 16)] % block, block) @ values
        y[mine["bad"].to_numpy(bool)] = np.nan
        yield pd.DataFrame({"series": key, by: mine["by"].to_numpy(), "pos": mine["pos"].to_numpy(), "y": y})

    def run(batches):
        now, held = None, []
        for pdf in batches:
            for key, series in runs(pdf):
                for b, part in series.groupby("block", sort=False):
                    if held and (key, b) != now:
                        yield from settle(now[0], held)
                        held = []
                    now = (key, b)
                    held.append(part)
        if held:
            yield from settle(now[0], held)

    return cells.mapInPandas(run, f"series {kind['series']}, `{by}` {kind[by]}, pos long, y double").withColumn("y", F.when(~F.isnan("y"), F.col("y")))
