"""Exact quantiles of all values so far, along each series in order.

Series are cut in time. The quantile of a prefix that ends in a slice lies, among the values before the slice, within as many ranks of the slice's own quantile as the slice has
values; so a slice needs no more of the past than that stretch and the number of values below it. Values are dealt by ranges to buckets, the driver has
the counts of buckets by slices (``BUCKETS`` times slices at most), and each slice is sent the values, with their counts, of the buckets
that its stretch touches. A slice then finds all its prefixes' quantiles together, by the bits of the values' ranks (a wavelet
tree). What a task holds is a slice and its stretch, never a series; what is sent is a few times the table.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .slices import SLICE, Part, summaries

BUCKETS = 512


class Quantile:
    """The interpolated quantile of the values pushed so far, in logarithmic time each; it holds the values, 8 to 32 bytes each."""

    def __init__(self, q: float) -> None:
        self.q, self.low, self.high = q, [], []

    def push(self, x: float) -> None:
        if not self.low or x <= -self.low[0]:
            heapq.heappush(self.low, -x)
        else:
            heapq.heappush(self.high, x)
        want = math.floor(self.q * (len(self.low) + len(self.high) - 1)) + 1
        while len(self.low) > want:
            heapq.heappush(self.high, -heapq.heappop(self.low))
        while len(self.low) < want:
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def __len__(self) -> int:
        return len(self.low) + len(self.high)

    def value(self) -> float:
        place = self.q * (len(self) - 1)
        a, part = -self.low[0], place - math.floor(place)
        return a + (self.high[0] - a) * part if part > 0 else a


class Ranks:
    """A wavelet tree over the ranks of a run of values, beside values that were there before them."""

    def __init__(self, x: np.ndarray, before: np.ndarray, counts: np.ndarray) -> None:
        self.values = np.unique(np.concatenate([x, before]))
        self.bits = max(1, int(len(self.values) - 1).bit_length())
        self.base = np.zeros((1 << self.bits) + 1, np.int64)  # counts of earlier values below each rank
        np.add.at(self.base, np.searchsorted(self.values, before) + 1, counts)
        self.base = np.cumsum(self.base)
        rank, self.levels = np.searchsorted(self.values, x), []
        for bit in range(self.bits - 1, -1, -1):
            right = (rank >> bit) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(1 - right)]))
            rank = np.concatenate([rank[right == 0], rank[right == 1]])

    def smallest(self, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of which k[i] are smaller, among the earlier values and the run's first n[i]."""
        lo, hi, node, k = np.zeros(len(n), np.int64), n.astype(np.int64), np.zeros(len(n), np.int64), k.astype(np.int64)
        for level, zeros in enumerate(self.levels):
            half = 1 << (self.bits - 1 - level)
            left = zeros[hi] - zeros[lo] + self.base[node + half] - self.base[node]
            down = k < left
            k = np.where(down, k, k - left)
            lo, hi = np.where(down, zeros[lo], zeros[-1] + lo - zeros[lo]), np.where(down, zeros[hi], zeros[-1] + hi - zeros[hi])
            node = np.where(down, node, node + half)
        return self.values[np.minimum(node, len(self.values) - 1)]


def prefix_quantiles(x: np.ndarray, q: float, before: np.ndarray, counts: np.ndarray, below: int, known_before: int, least: int) -> np.ndarray:
    """Interpolated quantiles of all values so far after each of x (NaN is none); NaN before ``least`` values.

    Of the ``known_before`` earlier ones, ``before`` with its counts holds those that can matter, ``below`` are smaller than these.
    """
    seen = np.cumsum(~np.isnan(x))
    total = known_before + seen
    at = np.flatnonzero(total >= max(1, least))
    out = np.full(len(x), np.nan)
    if len(at):
        tree = Ranks(x[~np.isnan(x)], before, counts)
        place = q * (total[at] - 1)
        low = np.floor(place).astype(np.int64)
        a, part = tree.smallest(seen[at], low - below), place - low
        b = tree.smallest(seen[at], np.minimum(low + 1, total[at] - 1) - below)
        out[at] = np.where(part > 0, a + (b - a) * part, a)
    return out


def shape(sliced: DataFrame) -> list[Part]:
    """Where series begin and end among the slices."""
    return summaries(sliced, [], lambda _: None, lambda total, part: None)


def _stretches(parts: list[Part], counted: np.ndarray, qs: tuple[float, ...]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(slice, quantile) -> (first and last bucket needed, values below these, values before the slice), for slices whose first series began before.

    ``counted`` has the number of values of each slice's last series by (slice, bucket); of one series, buckets are in order.
    """
    out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    so_far, now = np.zeros(counted.shape[1], np.int64), object()
    for p in parts:
        n = int(so_far.sum())
        if now == p.first and n:
            edges = np.cumsum(so_far)
            for i, q in enumerate(qs):
                low = min(max(math.floor(q * (n - 1)) - p.rows, 0), n - 1)
                high = min(max(math.floor(q * (n + p.rows - 1)) + 1, 0), n - 1)
                a, b = int(np.searchsorted(edges, low, "right")), int(np.searchsorted(edges, high, "right"))
                out[p.number, i] = (a, b, int(edges[a - 1]) if a else 0, n)
        if p.fresh or now != p.first:
            so_far = np.zeros(counted.shape[1], np.int64)
        so_far, now = so_far + counted[p.number], p.last
    return out


def _past(rows: DataFrame, column: str, parts: list[Part], qs: tuple[float, ...]) -> tuple[dict, DataFrame]:
    """The stretches, and (slice, quantile, x, c): the values of earlier slices in them, with counts."""
    spark = rows.sparkSession
    crossing = {a.last for a, b in zip(parts, parts[1:]) if a.last == b.first}
    if not crossing:
        return {}, spark.createDataFrame([], f"{SLICE} int, quantile int, x double, c long")
    slices = 1 + parts[-1].number
    # of a slice, only its last series passes to the next one
    lasts = spark.createDataFrame([(p.number, p.last) for p in parts if p.last in crossing], f"{SLICE} int, last string")
    same = lambda name: F.col("series").cast("string").eqNullSafe(F.col(name))
    x = F.col(column).cast("double")
    values = rows.where(x.isNotNull() & ~F.isnan(x)).select("series", SLICE, x.alias("x")).join(F.broadcast(lasts), SLICE).where(same("last"))
    n = min(BUCKETS, 2 * slices)
    dealt = cut(values.groupBy("series", SLICE, "x").agg(F.count("*").alias("c")).repartitionByRange(n, "series", "x").withColumn("bucket", F.spark_partition_id()))
    counted, sums = np.zeros((slices, n), np.int64), dealt.groupBy(SLICE, "bucket").agg(F.sum("c").alias("c")).toArrow()
    counted[sums[SLICE].to_numpy(), sums["bucket"].to_numpy()] = sums["c"].to_numpy()
    stretches = _stretches(parts, counted, qs)
    firsts = {p.number: p.first for p in parts}
    targets = spark.createDataFrame([(k, i, firsts[k], a, b) for (k, i), (a, b, _, _) in stretches.items()], "target int, quantile int, first string, lo int, hi int")
    wants = targets.select("target", "quantile", "first", F.explode(F.sequence("lo", "hi")).alias("bucket"))  # slices times quantiles, a few buckets each
    sent = dealt.join(F.broadcast(wants), "bucket").where((F.col(SLICE) < F.col("target")) & same("first"))
    return stretches, sent.groupBy("target", "quantile", "x").agg(F.sum("c").alias("c")).withColumnRenamed("target", SLICE)


def add_quantiles(rows: DataFrame, column: str, names: dict[str, float], by: tuple[str, ...], parts: list[Part], least: int = 1) -> DataFrame:
    """Columns of the quantiles (name -> q) of ``column`` over all rows so far of the row's series; null and NaN are no values, and before ``least`` values it is null.

    ``rows`` hold the slices of ``in_slices`` with the same ``by``, ``parts`` their ``shape``. Runs jobs while the plan is built.
    """
    stretches, past = _past(rows, column, parts, tuple(names.values()))
    shared = rows.sparkSession.sparkContext.broadcast(stretches)
    both = rows.withColumns({"__q": F.lit(None).cast("int"), "__x": F.lit(None).cast("double"), "__c": F.lit(None).cast("long")})
    both = both.unionByName(past.select(SLICE, F.col("quantile").alias("__q"), F.col("x").alias("__x"), F.col("c").alias("__c")), allowMissingColumns=True)
    slices = 1 + max((p.number for p in parts), default=0)
    both = both.repartition(slices, SLICE).sortWithinPartitions(SLICE, F.col("__q").asc_nulls_last(), "series", *by)
    at, kept = both.columns.index(SLICE), rows.columns

    def settle(number: int, held: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(held)
        old = pc.is_valid(whole["__q"])
        base, own = whole.filter(old), whole.filter(pc.invert(old)).select(kept)
        q, value, count = (base[c].to_numpy() for c in ("__q", "__x", "__c"))
        x = own[column].cast(pa.float64()).to_numpy()
        series = own["series"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        edges = [0, *(np.flatnonzero(series[1:] != series[:-1]) + 1), len(series)]
        for i, (name, part) in enumerate(names.items()):
            found = np.full(len(x), np.nan)
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                mine = q == i if k == 0 else np.zeros(len(q), bool)  # only the first series of a slice began before it
                _, _, below, n = shared.value.get((number, i), (0, 0, 0, 0)) if k == 0 else (0, 0, 0, 0)
                found[a:b] = prefix_quantiles(x[a:b], part, value[mine], count[mine], below, n, least)
            own = own.append_column(name, pa.array(found, from_pandas=True))
        yield from own.to_batches(max_chunksize=10_000)

    def run(batches):
        number, held = None, []
        for b in batches:
            k = np.asarray(b.column(at))
            edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    if held and k[lo] != number:
                        yield from settle(number, held)
                        held = []
                    number = int(k[lo])
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from settle(number, held)

    return both.mapInArrow(run, rows.withColumns({n: F.lit(None).cast("double") for n in names}).schema)
