"""Streams give what the batch operators give, also after a restart, with ticks out of order."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars
from tickloom.streaming import ingest

SCHEMA = "series long, seq long, ts timestamp, price double, amount double"


@pytest.fixture
def feed(spark, tmp_path):
    """Five files of shuffled neighbours; each batch reads one. The last tick moves the watermark beyond all others."""
    rng = np.random.default_rng(2)
    rows = [(k, i, (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=10 * i)).to_pydatetime(), float(rng.random() * 10), float(rng.random())) for i in range(300) for k in (1, 2)]
    order = np.argsort(np.arange(len(rows)) + rng.random(len(rows)) * 60, kind="stable")
    parts = np.array_split(order, 5)
    folder = tmp_path / "in"

    def write(k):
        own = [rows[i] for i in parts[k]]
        own += own[:7] if k else []  # repeats
        if k == 4:
            own.append((9, 0, pd.Timestamp("2024-02-01").to_pydatetime(), 1.0, 1.0))
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    return spark.createDataFrame(rows, SCHEMA), folder, write


def run(spark, frame, where):
    query = frame.writeStream.format("parquet").option("path", str(where / "out")).option("checkpointLocation", str(where / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.read.parquet(str(where / "out"))


def test_bars_of_a_stream_are_those_of_the_batch(spark, feed, tmp_path):
    whole, folder, write = feed
    old = spark.conf.get(ingest.STORE[0], None)
    spark.conf.set(*ingest.STORE)
    try:
        def stream():
            read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
            return ingest.dollar_bars(read, 40.0, "20 minutes")

        for k in (0, 1, 2):
            write(k)
        run(spark, stream(), tmp_path)
        for k in (3, 4):  # a new query from the same checkpoint
            write(k)
        got = sorted(run(spark, stream(), tmp_path).collect())
    finally:
        spark.conf.unset(ingest.STORE[0]) if old is None else spark.conf.set(ingest.STORE[0], old)
    want = {}
    for k in (1, 2):
        fold = bars.Fold(40.0, None, (0.0, math.inf))
        own = whole.where(F.col("series") == k).orderBy("ts", "seq").toPandas()
        want |= {(k, f[0]): f for f in fold.feed(own["ts"].to_numpy(), own["price"].to_numpy(), own["amount"].to_numpy())}
    assert len(got) == len(want) > 20
    for r in got:
        f = want[r.series, r.bar_id]
        assert (r.n_ticks, pd.Timestamp(r.ts_open), pd.Timestamp(r.ts_close)) == (f[10], pd.Timestamp(f[1]), pd.Timestamp(f[2]))
        assert np.allclose([r.open, r.high, r.low, r.close, r.volume, r.cum_dollar, r.vwap], f[3:10])
