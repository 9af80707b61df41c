"""Series cut in time, and what passes from one slice to the next.

Rows are dealt by ranges of (series, time), so a slice is a task's share of the whole table's order: long series span many slices, and many
short ones share a slice. Only the first series of a slice can hang on slices before. A pass sums each slice's last series up (``summaries``),
the driver folds these sums, one a slice and ``MOST`` at most, into the state with which each slice begins (``stitch``), and another pass
over the slices carries on from there (``carry``). The slices are written once, so that all passes see the same cuts.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .lineage import cut

#: Slices at most, so that a row of each may reach the driver whatever the input.
MOST = 4096
SLICE = "__slice"


class Part(NamedTuple):
    """A slice: its number and rows, first and last series as texts, whether the last begins in it, and the sum of the last."""

    number: int
    rows: int
    first: str | None
    last: str | None
    fresh: bool
    sum: Any


def in_slices(df: DataFrame, *by: str, slices: int | None = None) -> DataFrame:
    """Rows in order of series and ``by``, written, with their slice's number; as many slices as there are shuffle partitions by default."""
    n = min(MOST, slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, "series", *by).sortWithinPartitions("series", *by).withColumn(SLICE, F.spark_partition_id()))


def runs(pdf: pd.DataFrame) -> Iterator[tuple[Any, pd.DataFrame]]:
    """Series of a batch in order; null is one of them."""
    for key, part in pdf.groupby("series", sort=False, dropna=False):
        yield None if pd.isna(key) else key, part


def summaries(sliced: DataFrame, columns: list[str], start: Callable, feed: Callable, states: dict[int, Any] | None = None, only: set[int] | None = None) -> list[Part]:
    """Of each slice (of ``only``), the sum of its last series: ``start(state or None)``, then ``feed(sum, batch)`` for each batch, in place.

    ``states`` has what first series begin with.
    """
    shared = sliced.sparkSession.sparkContext.broadcast(states or {})

    def run(batches):
        number = first = last = total = None
        rows, began, fresh = 0, False, False
        for pdf in batches:
            rows += len(pdf)
            if number is None and len(pdf):
                number = int(pdf[SLICE].iloc[0])
                if only is not None and number not in only:
                    return
            for key, part in runs(pdf):
                if not began:
                    first, last, total, began = key, key, start(shared.value.get(number)), True
                elif key != last:
                    last, total, fresh = key, start(None), True
                feed(total, part)
        if began:
            yield pd.DataFrame({"part": [pickle.dumps(Part(number, rows, first, last, fresh, total))]})

    return sorted((pickle.loads(r[0]) for r in sliced.select(F.col("series").cast("string").alias("series"), SLICE, *columns).mapInPandas(run, "part binary").collect()), key=lambda p: p.number)


def stitch(parts: list[Part], advance: Callable) -> dict[int, Any]:
    """The state of each slice's first series where the slice begins, if it began before: ``advance(state or None, sum)`` over its slices."""
    states: dict[int, Any] = {}
    before = None
    for p in parts:
        state = before[1] if before is not None and before[0] == p.first else None
        if state is not None:
            states[p.number] = state
        before = (p.last, advance(None if p.fresh else state, p.sum))
    return states


def carry(sliced: DataFrame, states: dict[int, Any], begin: Callable, step: Callable, schema, finish: Callable | None = None) -> DataFrame:
    """``step(state, batch)`` gives a batch of output and the next state; series begin with ``begin(state or None)`` and end with ``finish(state)``."""
    shared = sliced.sparkSession.sparkContext.broadcast(states)

    def run(batches):
        state = last = number = None
        for pdf in batches:
            for key, part in runs(pdf):
                if number is None:
                    number, last = int(part[SLICE].iloc[0]), key
                    state = begin(shared.value.get(number))
                elif key != last:
                    if finish is not None:
                        yield finish(state, last, number)
                    last, state = key, begin(None)
                out, state = step(state, part)
                yield out
        if number is not None and finish is not None:
            yield finish(state, last, number)

    return sliced.mapInPandas(run, schema)


def carry_beside(sliced: DataFrame, states: dict[int, Any], begin: Callable, step: Callable, read: list[str], names: list[str]) -> DataFrame:
    """``carry`` whose steps see only ``read`` and give the columns ``names``, doubles that stand beside the rows' own. These pass as they are: through pandas, NaN would be null."""
    shared = sliced.sparkSession.sparkContext.broadcast(states)
    own = [c for c in sliced.columns if c != SLICE]

    def run(batches):
        state = last = number = None
        for b in batches:
            made = []
            for key, part in runs(b.select(list(dict.fromkeys(["series", SLICE, *read]))).to_pandas()):
                if number is None:
                    number, last = int(part[SLICE].iloc[0]), key
                    state = begin(shared.value.get(number))
                elif key != last:
                    last, state = key, begin(None)
                out, state = step(state, part)
                made.append(out)
            if made:
                found = pd.concat(made)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], *[pa.array(found[n], pa.float64(), from_pandas=True) for n in names]], [*own, *names])

    schema = StructType([*[f for f in sliced.schema.fields if f.name != SLICE], *[StructField(n, DoubleType()) for n in names]])
    return sliced.mapInArrow(run, schema)


def scan(keep: float, b: np.ndarray, before: float = 0.0) -> np.ndarray:
    """y[t] = keep * y[t - 1] + b[t], by prefix sums of b over powers of ``keep``, in stretches in which these stay moderate."""
    if keep <= 0:
        return b.astype(float)
    stretch = len(b) if keep >= 1 else max(1, int(math.log(1e-4) / math.log(keep)))
    out = np.empty(len(b))
    for i in range(0, len(b), max(1, stretch)):
        part = b[i : i + stretch]
        powers = keep ** np.arange(1, len(part) + 1)
        out[i : i + stretch] = powers * (before + np.cumsum(part / powers))
        before = out[min(i + stretch, len(b)) - 1]
    return out
