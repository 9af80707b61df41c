"""A tape with prices of 0, some of them last in a bar: returns are infinite, as SQL has them, and models and tests pass them over."""

import duckdb
import pytest

from tickloom.operators import features
from tickloom.plans import catalogue

from .oracle import compare

NAMES = ["autocorrelation", "backtest", "barrier_grid", "barrier_touches", "baseline_markov", "baseline_markov_path", "baseline_persistence", "baseline_transitions", "class_weights", "clean_price_jumps", "frac_diff", "frac_diff_expanding", "future_return", "jarque_bera", "jumps", "source_tick_bars", "drawdowns"]


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    folder = tmp_path_factory.mktemp("zeros")
    duckdb.connect().execute(f"""COPY (SELECT * EXCLUDE (s, n) REPLACE (CASE WHEN (n % 10 = 9 AND ((s = 0 AND n // 10 = 120) OR (s = 1 AND n // 10 IN (60, 160, 161)))) OR (s = 2 AND n = 555) THEN 0.0 ELSE value END AS value)
 FROM (SELECT *, user_id % 4 AS s, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS n FROM '/root/testdata/sf0.01/events.parquet') ORDER BY event_id) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, zeros, name):
    assert compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], zeros) is None


@pytest.mark.parametrize("name", ["forest_predictions", "granger", "ridge_out_of_fold"])
def test_infinite_returns_are_passed_over(spark, zeros, name):
    assert catalogue.queries()[name](spark, zeros).count() > 0


def test_returns_at_a_price_of_0(spark, zeros):
    bars = catalogue._bars(spark, zeros).where("series = 1 and bar_id between 160 and 162").orderBy("bar_id")
    first, second, third = [r.log_return for r in bars.collect()]
    assert first == float("-inf") and second != second and third == float("inf")


def test_fractional_differences_of_any_order(spark):
    prices = [1.0, 2.0, 0.0, 3.0, 1.0, 5.0]
    bars = spark.createDataFrame([(1, i, p) for i, p in enumerate(prices)], "series long, bar_id long, close double")
    for d, want in ((0.4, [-1, 1, 1, 1]), (1.5, [-1, 1, -1, -1])):
        got = [r.y for r in features.frac_diff_expanding(bars, d, 1, "y").orderBy("bar_id").collect()]
        assert got[2:] == [s * float("inf") for s in want] and all(abs(y) < 10 for y in got[:2])
