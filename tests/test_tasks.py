"""What one task holds: no long series whole, nothing computed again for each fold."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import bars, models, stats
from tickloom.sources import tape

from .test_slices import TAPES, close, plain_bars, tape_of


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "long"])
def test_bars_by_stretches_of_time(spark, kind):
    """Many ticks at one time, series that begin late, null series and times."""
    rows = [(s, i, None if i % 50 == 49 else i // 7 * (400 if i > 150 else 1), float(1 + (i * 7) % 13), 1.0, "buy") for s in (1, 2, None) for i in range(300 if s == 1 else 31)]
    ts = {"timestamp": F.timestamp_seconds("ts"), "timestamp_ntz": F.expr("timestamp_ntz '2024-03-31 00:00:00' + make_dt_interval(0, 0, 0, ts)"), "long": F.col("ts")}[kind]
    ticks = spark.createDataFrame(sorted(rows, key=lambda r: hash(r[1:4])), "series long, seq long, ts long, price double, amount double, side string").withColumn("ts", ts)
    want = {}
    for s in (1, 2, None):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        for k in range(0, len(own), 10):
            want[s, k // 10] = [r[3] for r in own[k : k + 10]]
    got = {(r.series, r.bar_id): r for r in tape.tick_bars(ticks, stretches=16, piece=3).collect()}
    assert set(got) == set(want)
    for (s, k), p in want.items():
        r, before = got[s, k], want.get((s, k - 1))
        assert (r.n_ticks, r.high, r.low, r.close) == (len(p), max(p), min(p), p[-1])
        assert r.log_return is None if before is None else math.isclose(r.log_return, math.log(p[-1] / before[-1]), abs_tol=1e-12)


def test_ticks_of_one_series_are_many_tasks(spark):
    ticks = spark.range(20_000).select(F.lit(1).cast("long").alias("series"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert tape.numbered(ticks, "i").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_bits_of_one_series_are_many_tasks(spark):
    rows = spark.range(500).select(F.lit(1).alias("series"), F.col("id").alias("i"), (F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy((F.col("id") * 77) % 500)) - 1).alias("r"))
    rows = rows.withColumn("r", F.col("r") + 0 * F.count("*").over(Window.partitionBy("series")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert stats.rises_and_falls(rows).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_pass_in_order_takes_packs_of_values(spark, monkeypatch):
    """A threshold that never forgets streams once through all slices."""
    monkeypatch.setattr(bars, "PACK", 7)
    swept, sweep = [], bars._sweep
    monkeypatch.setattr(bars, "_sweep", lambda *a: swept.append(1) or sweep(*a))
    p, v = TAPES["heavy"]
    tape_ = tape_of(spark, {1: (p, v), 2: (v, p)})
    known = {r.series: r.threshold for r in bars.threshold_for(tape_, 20).collect()}
    got = bars.dollar_bars(tape_, 20, adaptive=True, span=2000, slices=12).orderBy("series", "bar_id").collect()
    assert swept
    for k, (a, b) in {1: (p, v), 2: (v, p)}.items():
        own, want = [r for r in got if r.series == k], plain_bars(a, b, known[k], 2000)
        assert len(own) == len(want) and all(close((r.n_ticks, r.cum_dollar, r.threshold_used), (w[1], w[6], w[7])) for r, w in zip(own, want))


def test_folds_read_rows_written_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(240).select((F.col("id") % 2).alias("series"), F.floor(F.col("id") / 2).alias("bar_id"), F.col("id").cast("double").alias("x"), F.signum(F.sin("id")).cast("int").alias("label"))
    told = models.out_of_fold(rows.mapInPandas(count, rows.schema), lambda train: models.ridge(train, ["x"]))
    assert told.where("coverage = 1").count() == 200 and seen.value == 240
