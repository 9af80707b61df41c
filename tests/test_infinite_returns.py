"""Prices of 0, two of them one after the other, so that returns are infinite and NaN: what SQL makes of these, here told apart from null."""

import math

import pytest

from tickloom.operators import analysis, features, indicators
from tickloom.plans import catalogue, feature_table

from .oracle import compare
from .test_zero_prices import zeros  # noqa: F401  a fixture


def test_averages_leave_rows_as_they_are(spark):
    bars = spark.createDataFrame([(1, i, float(i), x) for i, x in enumerate([1.0, float("nan"), None, float("inf")])], "series long, bar_id long, close double, log_return double")
    got = [r.log_return for r in indicators.smooth(bars, [("y", "close", 0.5)]).orderBy("bar_id").collect()]
    assert got[0] == 1.0 and got[1] is not None and math.isnan(got[1]) and got[2] is None and got[3] == float("inf")


def test_windows_after_averages_match_sql(spark, zeros):  # noqa: F811
    def narrow(s, d):
        table = feature_table.all_features(catalogue._bars(s, d), (features.durations, feature_table.smooth_acceleration, features.momentum), (5, 10))
        return catalogue._pick(table, ["cum_return_5", "cum_return_5_lag5", "volume_lag10"])

    assert compare(spark, narrow, catalogue.oracle_sql()["feature_table"], zeros) is None


def test_entropy_of_an_infinite_frame_is_nan(spark):
    returns = [None, 0.1, float("-inf"), float("inf"), *[0.1 * (i % 3) for i in range(8)]]
    bars = spark.createDataFrame([(1, i, r) for i, r in enumerate(returns)], "series long, bar_id long, log_return double")
    got = [r.apen_4 for r in analysis.complexity(bars, 4).orderBy("bar_id").collect()]
    assert got[:3] == [None] * 3 and all(x is not None and math.isnan(x) for x in got[3:7]) and all(x is not None and math.isfinite(x) for x in got[7:])


@pytest.mark.parametrize("name", ["feature_ranking", "feature_report", "mutual_information", "nonlinearity", "ta_momentum", "ta_volume"])
def test_matches_sql(spark, zeros, name):  # noqa: F811
    assert compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], zeros) is None
