"""Windows over pieces of series give what windows over whole series give, from more than one task a series."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions.pieces import in_pieces, of_pieces
from tickloom.operators import indicators
from tickloom.plans import feature_table
from tickloom.sources import tape


def test_features_of_one_series_in_pieces(spark):
    bars = tape.tick_bars(tape.ticks(spark, "/root/testdata/sf0.001", 1), 3)
    blocks = (feature_table.features.durations, *sorted(feature_table.WINDOWED, key=lambda b: b.__name__), feature_table.features.drawdowns)
    rows = lambda df: [tuple(None if v != v else v for v in r) for r in df.orderBy("bar_id").collect()]
    cut, whole = (feature_table.all_features(bars, blocks, (1, 10), p) for p in (1, 1 << 20))
    assert cut.columns == whole.columns and rows(cut) == rows(whole)
    plain = bars
    for block in blocks:
        plain = block(plain)
    plain = plain.select(*[c for c in cut.columns if c in plain.columns])
    assert rows(cut.select(*plain.columns)) == rows(plain)


def test_one_series_is_many_pieces(spark):
    df = spark.range(1000).select(F.lit(7).cast("long").alias("series"), F.col("id").alias("bar_id"))
    cut = in_pieces(df, 100, 60)
    sizes = {r.piece: (r.n, r.mine) for r in cut.groupBy("series.piece").agg(F.count("*").alias("n"), F.count_if("__mine").alias("mine")).collect()}
    assert sizes == {k: (160 if k else 100, 100) for k in range(10)} | {10: (60, 0)}
    assert of_pieces(cut).orderBy("bar_id").collect() == df.orderBy("bar_id").collect()
    with pytest.raises(ValueError):
        in_pieces(df, 10, 11)


def test_indicators_of_one_series_in_pieces(spark, monkeypatch):
    bars = tape.tick_bars(tape.ticks(spark, "/root/testdata/sf0.001", 1), 3).withColumn("close", F.when(F.col("bar_id") % 50 > 0, F.col("close")))
    cuts, plain = [], indicators.in_slices
    monkeypatch.setattr(indicators, "in_slices", lambda *a, **k: cuts.append(a) or plain(*a, **k))
    rows = lambda df: [tuple(None if v != v else v for v in r) for r in df.orderBy("bar_id").collect()]
    cut = feature_table.all_features(bars, feature_table.TECHNICAL, (), 1)
    assert len(cuts) == 1  # all families are smoothed together
    whole = feature_table.all_features(bars, feature_table.TECHNICAL, (), 1 << 20)
    assert cut.columns == whole.columns and not any(c.startswith("__") for c in cut.columns) and rows(cut) == rows(whole)
