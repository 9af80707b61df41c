"""A feed in pages: pages left out by filters, the same tape from batches and streams, across a restart."""

import glob
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tickloom.sources import feed
from tickloom.streaming import ingest

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def trades(spark, hours, extra=False):
    rows = [(k, i, START + timedelta(seconds=97 * i), float(i % 7), 0.5 * k, "buy" if i % 2 else None) for i in range(int(hours[0] * 37), int(hours[1] * 37)) for k in (1, 2)]
    df = spark.createDataFrame(rows, feed.SCHEMA)
    return df.withColumn("noise", F.lit(1)) if extra else df


def keyed(df):
    return sorted(tuple(r) for r in df.select("series", "seq", F.unix_millis("ts"), "price", "amount", "side").collect())


def read(spark, path, **options):
    feed.register(spark)
    return spark.read.format("trade_feed").options(**options).load(path)


def test_batch_is_the_tape(spark, tmp_path):
    path, whole = str(tmp_path / "feed"), trades(spark, (0, 20), extra=True)
    feed.write_pages(whole.unionByName(whole.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))), path, 3_600_000, 600_000)
    raw = read(spark, path, partitionBytes=4000)
    assert raw.count() > whole.count() and raw.rdd.getNumPartitions() > 5
    assert keyed(feed.tape(raw)) == keyed(whole)
    assert keyed(feed.tape(read(spark, f"file:{path}"))) == keyed(whole)
    part = raw.where((F.col("ts") >= START + timedelta(hours=5)) & (F.col("ts") < START + timedelta(hours=7)))
    assert keyed(feed.tape(part)) == keyed(whole.where((F.col("ts") >= START + timedelta(hours=5)) & (F.col("ts") < START + timedelta(hours=7))))
    assert part.rdd.getNumPartitions() < raw.rdd.getNumPartitions()
    assert keyed(feed.tape(raw.where(F.col("ts") == START + timedelta(seconds=970)))) == keyed(whole.where("seq = 10"))
    assert raw.where("price > 5 and ts < '2024-01-01 03:00:00'").count() == feed.tape(raw).where("price > 5 and ts < '2024-01-01 03:00:00'").count() + raw.where("price > 5 and ts < '2024-01-01 03:00:00'").groupBy("series", "seq").count().where("count > 1").count()


def test_filters_keep_pages_from_being_opened(spark, tmp_path):
    path = str(tmp_path / "feed")
    feed.write_pages(trades(spark, (0, 10)), path, 3_600_000)
    for broken in glob.glob(f"{path}/page=*/*.parquet"):
        if int(broken.split("page=")[1].split("_")[0]) >= (START + timedelta(hours=4)).timestamp() * 1000:
            with open(broken, "wb") as f:
                f.write(b"not a page")
    early = read(spark, path).where(F.col("ts") < START + timedelta(hours=3))
    assert early.count() == trades(spark, (0, 10)).where(F.col("ts") < START + timedelta(hours=3)).count()
    with pytest.raises(Exception):
        read(spark, path).count()


def test_columns_and_empty_feeds(spark, tmp_path):
    feed.register(spark)
    (tmp_path / "empty").mkdir()
    assert read(spark, str(tmp_path / "empty")).count() == 0
    path = str(tmp_path / "feed")
    feed.write_pages(trades(spark, (0, 2)).drop("side"), path, 3_600_000)
    few = spark.read.format("trade_feed").schema("side string, seq long").load(path)
    assert few.where("side is null and seq is not null").count() == few.count() == trades(spark, (0, 2)).count()
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("trade_feed").schema("seq long, colour string").load(path).count()
    with pytest.raises(ValueError):
        feed.write_pages(trades(spark, (0, 1)), path, 10, 11)


def test_stream_is_the_tape_across_a_restart(spark, tmp_path):
    feed.register(spark)
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")

    def run():
        source = spark.readStream.format("trade_feed").option("open", 1).load(path)
        query = ingest.deduplicate(source, "2 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.read.parquet(out)

    hour = 3_600_000
    feed.write_pages(trades(spark, (0, 6.5)), path, hour, hour // 6)
    first = keyed(run())
    assert first and len(first) == len(set(first)) < trades(spark, (0, 6.5)).count()  # the newest page is still open
    feed.write_pages(trades(spark, (6.5, 12)), path, hour, hour // 6)
    again = keyed(run())
    closed = max(r[2] for r in again)
    whole = keyed(trades(spark, (0, 12)))
    assert again == [r for r in whole if r[2] <= closed] and len(again) > len(first) and len(again) > len(whole) - 80
    assert again == keyed(feed.tape(read(spark, path, open=1)))
