"""Streaming ingestion: deduplicated ticks, and volume-clock bars that are the batch operator's.

Ticks may come late, repeated and out of order within the watermark's delay. They wait in map state, by time and number, until the watermark passes them; a timer then
takes the due ones in order and folds them as ``operators.bars`` does. A series' state is its waiting ticks and one open bar; both are in the state store, so a
query that restarts from its checkpoint goes on with the same bars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.bars import SCHEMA, Fold

#: The state store that map state and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
KEY, TICK = "us long, seq long", "price double, amount double"
OPEN = "bar long, n long, value double, volume double, first double, high double, low double, last double, began long, ended long"


def deduplicate(ticks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (series, seq) once while the watermark holds it."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["series", "seq"])


def _fold(threshold: float, held: tuple | None) -> Fold:
    fold = Fold(threshold, None, (0.0, np.inf))
    if held is not None:
        fold.bar, fold.n, fold.value, fold.volume, fold.first, fold.high, fold.low, fold.last, fold.began, fold.ended = held
    return fold


class TickBars(StatefulProcessor):
    """Bars of a fixed threshold; see ``dollar_bars``."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.open = handle.getMapState("waiting", KEY, TICK), handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        pdf = pdf.dropna(subset=["ts", "price", "amount"])
        if len(pdf):
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            for at, seq, price, amount in zip(us.tolist(), pdf["seq"].tolist(), pdf["price"].tolist(), pdf["amount"].tolist()):
                self.waiting.updateValue((at, seq), (price, amount))
            for ms in sorted(set((us // 1000 + 1).tolist())):
                self.handle.registerTimer(ms)
        yield from ()

    @staticmethod
    def _plain(v):
        return v.item() if isinstance(v, np.generic) else v

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((*k, *v) for k, v in self.waiting.iterator() if k[0] < limit)
        if not due:  # an earlier timer of this batch took them
            return
        for t in due:
            self.waiting.removeKey(t[:2])
        fold = _fold(self.threshold, self.open.get() if self.open.exists() else None)
        us, price, amount = (np.array([t[i] for t in due]) for i in (0, 2, 3))
        found = fold.feed(us, price.astype(float), amount.astype(float))
        self.open.update(tuple(map(self._plain, (fold.bar, fold.n, fold.value, fold.volume, fold.first, fold.high, fold.low, fold.last, fold.began or 0, fold.ended or 0))))
        at = lambda t: pd.Timestamp(int(t), unit="us")
        if found:
            yield pd.DataFrame([(key[0], f[0], at(f[1]), at(f[2]), *f[3:]) for f in found], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def dollar_bars(ticks: DataFrame, threshold: float, delay: str = "10 minutes") -> DataFrame:
    """Bars of each series of a stream with a fixed threshold: those of the batch operator over all ticks that the watermark has passed.

    A tick later than the watermark is dropped by Spark; ticks with a null time, price or amount take no part. Append mode, with the state store of ``STORE``.
    """
    marked = ticks.withWatermark("ts", delay)
    return marked.groupBy("series").transformWithStateInPandas(statefulProcessor=TickBars(threshold), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
