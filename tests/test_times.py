"""Times of mixed forms: the same wall times in every session zone."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions import times

CASES = {
    "2024-01-31": "2024-01-31 00:00:00", "2024-01-31 12:30:05": "2024-01-31 12:30:05", "2024-01-31T12:30:05.25Z": "2024-01-31 12:30:05.25", "2024-01-31 12:30:05+05:00": "2024-01-31 12:30:05", " 2024/1/31 ": "2024-01-31 00:00:00",
    "2024/01/31 23:59:59": "2024-01-31 23:59:59", "1/31/2024": "2024-01-31 00:00:00", "01/31/2024 08:00:00": "2024-01-31 08:00:00", "20240131": "2024-01-31 00:00:00", "20240131T081500": "2024-01-31 08:15:00", "20240131 08:15:00": "2024-01-31 08:15:00",
    "2024-03-31 02:30:00": "2024-03-31 02:30:00", "31/01/2024": None, "2024-02-30": None, "n/a": None, "": None, "12:30": None, "2024": "2024-01-01 00:00:00",
}


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/New_York"])
def test_forms(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k,) for k in [*CASES, None]], "t string")
        got = {r.t: r.x for r in df.select("t", times.parsed(F.col("t")).cast("string").alias("x")).collect()}
        assert got == CASES | {None: None}
        texts = {r.t: r.x for r in df.select("t", times.written(F.col("t")).alias("x")).collect()}
        assert texts == {k: v and v[:10] for k, v in (CASES | {None: None}).items()}
        passed = df.limit(1).select(F.to_date(F.lit("2024-01-31")).alias("d"), F.lit("2024-01-31 02:00:00").cast("timestamp_ntz").alias("n"))
        assert passed.select(times.written(F.col("d")), times.written(F.col("n"), "dd.MM.yyyy HH:mm")).first()[:] == ("2024-01-31", "31.01.2024 02:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_strict(spark):
    df = spark.createDataFrame([("2024-01-01",), (None,)], "t string")
    assert df.select(times.strictly_parsed(F.col("t")).cast("string")).collect()[1][0] is None
    with pytest.raises(Exception, match="start: no time in 'soon'"):
        spark.createDataFrame([("soon",)], "t string").select(times.strictly_parsed(F.col("t"), "start")).collect()
