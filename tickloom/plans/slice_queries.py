"""Queries of one long series in many slices, of a feed in pages, of whole feature tables, of order in time, and of meta-labels, trees and groups of features."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import times
from ..functions.lineage import new_folder
from ..operators import bars as B
from ..operators import boosting, cleaning, evaluation, labels, linkage, models, transform
from ..sources import feed, tape
from . import catalogue as C
from . import indicator_queries, more_queries
from .catalogue import _SQL, _TB, KEY, TICKS, O, _bars, _labelled, _pick, query
from .feature_table import BLOCKS, TECHNICAL, all_features

_ONE = TICKS.replace("user_id % 4 AS series", "user_id % 1 AS series")


def one_series(name: str) -> str:
    """A query's SQL over the whole tape as one series."""
    return _SQL[name].replace(TICKS, _ONE)


def _one(s, d):
    return tape.ticks(s, d, 1)


@query("dollar_bars_one_series", one_series("dollar_bars_fixed"))
def _(s, d):
    found = B.dollar_bars(_one(s, d), slices=64)
    return found.select(*KEY, "ts_open", "ts_close", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume")], F.round("cum_dollar", 4).alias("cum_dollar"), F.round("vwap", 6).alias("vwap"), "n_ticks")


@query("dollar_bars_adaptive_one_series", one_series("dollar_bars_adaptive"))
def _(s, d):
    return B.dollar_bars(_one(s, d), adaptive=True, slices=64).select(*KEY, F.round("cum_dollar", 4).alias("cum_dollar"), F.round("threshold_used", 4).alias("threshold_used"))


@query("clean_expanding_mad_one_series", one_series("clean_expanding_mad"))
def _(s, d):
    return cleaning.drop_by_mad(_one(s, d), threshold=3.0, slices=64).select("series", "seq")


@query("ewm_volatility_one_series", one_series("ewm_volatility"))
def _(s, d):
    return _pick(labels.ewm_volatility(tape.tick_bars(_one(s, d)), slices=64), ["vol"])


@query("source_feed", f"WITH {TICKS}, m AS (SELECT date_trunc('day', min(ts)) AS a FROM ticks) SELECT series, seq, CAST(epoch_us(ts) AS BIGINT) AS us, price, amount, side FROM ticks, m WHERE ts >= a + INTERVAL 2 DAY AND ts < a + INTERVAL 9 DAY")
def _(s, d):
    """All events as pages of a day that overlap by an hour, and a week of the tape read back from them."""
    trades, path = tape.ticks(s, d).withColumn("ts", F.col("ts").cast("timestamp")), new_folder(s, "feed")
    feed.write_pages(trades, path, 86_400_000, 3_600_000)
    feed.register(s)
    first = trades.agg(F.date_trunc("day", F.min("ts")).alias("a")).first()["a"].astimezone()
    week = s.read.format("trade_feed").load(path).where((F.col("ts") >= first + timedelta(days=2)) & (F.col("ts") < first + timedelta(days=9)))
    return feed.tape(week).select("series", "seq", F.unix_micros("ts").alias("us"), "price", "amount", "side")


#: The time of an event as its number says: with a zone, slashes, the month first, in one run, or not at all.
_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+05:00'", "yyyy/M/d", "MM/dd/yyyy HH:mm:ss", "yyyyMMdd", "'n/a'")


@query("source_times_of_mixed_forms", """SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS t, strftime(t, '%d.%m.%Y') AS day FROM (SELECT event_id, CASE event_id % 6 WHEN 2 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('day', ts) WHEN 5 THEN NULL ELSE date_trunc('second', ts) END AS t FROM events)""")
def _(s, d):
    events = s.read.parquet(f"{d}/events.parquet")
    text = F.get(F.array(*[F.date_format("ts", f) for f in _FORMS]), (F.col("event_id") % 6).cast("int"))
    rows = events.select("event_id", text.alias("text"))
    return rows.select("event_id", F.date_format(times.parsed(F.col("text")), "yyyy-MM-dd HH:mm:ss").alias("t"), times.written(F.col("text"), "dd.MM.yyyy").alias("day"))


# whole tables: each block's columns as its own query has them, all from one plan

_WINDOWED = {"momentum": C._MOM, "moving_averages": C._MA, "price_zscore": C._PZ, "realized_moments": C._RV, "jumps": C._J, "range_volatility": C._RG, "order_flow": C._FL, "bar_durations": more_queries._DUR}
_WINDOWED = {k: list(v) for k, v in _WINDOWED.items()} | {
    "return_streak": ["return_streak"], "frac_diff": ["frac_diff_d05"], "volatility_regime": ["volatility", "vol_regime_75", "vol_regime_95", "vol_zscore"], "temporal_acceleration": ["temporal_acceleration", "temporal_jerk", "temporal_acceleration_smooth"],
    "calendar": ["hour", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "day_of_week", "day_of_month", "week", "month", "quarter"], "drawdowns": ["rolling_max", "rolling_min", "drawdown", "drawup", "bars_since_high", "bars_since_low", "crash_10pct"],
}


def _joined(blocks: dict[str, list[str]]) -> str:
    """The blocks' SQL side by side; a column that two have comes from the first."""
    seen, columns = set(), []
    for k, (name, own) in enumerate(blocks.items()):
        columns += [f"t{k}.{c}" for c in own if c not in seen]
        seen |= set(own)
    first, *rest = blocks
    return f"SELECT t0.series, t0.bar_id, {', '.join(columns)} FROM ({_SQL[first]}) t0 " + " ".join(f"JOIN ({_SQL[name]}) t{k} ON t{k}.series = t0.series AND t{k}.bar_id = t0.bar_id" for k, name in enumerate(rest, 1))


@query("feature_table_windows", _joined(_WINDOWED))
def _(s, d):
    table = all_features(_bars(s, d), BLOCKS[:-1], (1, 5, 10))
    return _pick(table, list(dict.fromkeys(c for own in _WINDOWED.values() for c in own)))


@query("feature_table_indicators", _joined(indicator_queries.NAMED))
def _(s, d):
    table = all_features(_bars(s, d), TECHNICAL, ())
    return _pick(table, list(dict.fromkeys(c for own in indicator_queries.NAMED.values() for c in own)))


# order in time

@query("temporal_order", f"WITH {TICKS}, l AS (SELECT *, lag(ts) OVER (PARTITION BY series ORDER BY seq) AS before FROM ticks) SELECT series, count(*) AS n, CAST(count(*) FILTER (ts < before) AS BIGINT) AS n_back, count(*) FILTER (ts < before) = 0 AS in_order FROM l GROUP BY series")
def _(s, d):
    return evaluation.temporal_order(C._ticks(s, d), "seq")


@query("temporal_split", f"WITH {C.BARS}, t AS (SELECT *, row_number() OVER {O} <= floor(count(*) OVER (PARTITION BY series) * 0.8) AS early FROM bars) SELECT series, max(ts_close) FILTER (early) AS train_end, min(ts_close) FILTER (NOT early) AS test_start, max(ts_close) FILTER (early) < min(ts_close) FILTER (NOT early) AS apart FROM t GROUP BY series")
def _(s, d):
    return evaluation.temporal_split(transform.split_by_time(_bars(s, d)), "ts_close")


# meta-labels: whether a direction told by the label before came true

def _told(s, d):
    return evaluation.persistence(_labelled(s, d)).withColumn("coverage", F.col("prediction").isNotNull().cast("int"))


@query("meta_labels", _TB + f", m AS (SELECT *, lag(label) OVER {O} AS prediction FROM lab) SELECT series, bar_id, prediction, CAST(prediction = label AS INT) AS meta_label FROM m WHERE prediction <> 0")
def _(s, d):
    return models.meta_rows(_told(s, d)).select(*KEY, "prediction", "meta_label")


_META = ["volume", "v_buy", "v_sell", "vol"]


@query("meta_features", _TB + f""", m AS (SELECT lab.*, lag(label) OVER (PARTITION BY lab.series ORDER BY lab.bar_id) AS prediction FROM lab), f AS (SELECT m.series, m.bar_id, m.prediction, v.vol, CASE WHEN v.bar_id % 7 > 0 THEN v.volume END AS volume FROM m JOIN v ON v.series = m.series AND v.bar_id = m.bar_id WHERE m.prediction <> 0)
SELECT series, bar_id, round(vol, 6) AS vol, round(coalesce(volume, (SELECT quantile_cont(volume, 0.5) FROM f)), 6) AS volume FROM f""")
def _(s, d):
    rows = _told(s, d).withColumn("volume", F.when(F.col("bar_id") % 7 > 0, F.col("volume")))
    return _pick(models.meta_features(rows, ["vol", "volume"]), ["vol", "volume"])


@query("meta_model")
def _(s, d):
    rows = models.meta_features(_told(s, d), _META)
    return _pick(models.train_meta(rows, _META, lambda train: boosting.boost(train, _META, "meta_label", rounds=10, class_weight="balanced"))[1], ["accuracy", "precision", "recall", "f1", "auc"], ["n"])


@query("boosted_predictions")
def _(s, d):
    rows = transform.split_by_time(_labelled(s, d))
    model = boosting.boost(rows.where("split = 'train'"), _META, rounds=15, gamma=1.0, class_weight="balanced", held_out=rows.where("split = 'test'"), patience=5)
    return model.transform(rows.where("split = 'test'")).select(*KEY, "label", "prediction", *[F.round(F.col("proba")[i], 6).alias(f"p{i}") for i in range(len(model.classes))])


_PRICES = ["open", "high", "low", "close", "volume", "v_buy", "v_sell"]


@query("feature_tree")
def _(s, d):
    return _pick(linkage.feature_tree(_bars(s, d), _PRICES), ["left", "right", "height", "size"], ["step"])


@query("feature_cut")
def _(s, d):
    return _pick(linkage.cut_tree(_bars(s, d), _PRICES, k=3, method="ward"), ["cluster", "silhouette"], ["feature"])


@query("feature_group_numbers")
def _(s, d):
    return _pick(linkage.numbers_of_groups(_bars(s, d), _PRICES), ["groups", "silhouette", "best"], ["k"])
