"""Queries of the tick and bar operators over the test tables, each with independent SQL.

Numbers are rounded to six places on both sides, as sums may run in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import cleaning, evaluation, features, flow, labels, stats, transform
from ..sources import tape

KEY = ["series", "bar_id"]
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

TICKS = """ticks AS (SELECT user_id % 4 AS series, event_id AS seq, ts, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS amount,
 CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'error' THEN 'sell' END AS side FROM events)"""
BARS = TICKS + """, numbered AS (SELECT *, (row_number() OVER (PARTITION BY series ORDER BY ts, seq) - 1) // 10 AS bar_id FROM ticks),
plain AS (SELECT series, bar_id, min(ts) AS ts_open, max(ts) AS ts_close, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
 sum(amount) AS volume, sum(CASE WHEN side = 'buy' THEN amount ELSE 0 END) AS v_buy, sum(CASE WHEN side = 'sell' THEN amount ELSE 0 END) AS v_sell, count(*) AS n_ticks FROM numbered GROUP BY ALL),
bars AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY series ORDER BY bar_id)) AS log_return, row_number() OVER (PARTITION BY series ORDER BY bar_id) AS rn FROM plain)"""


def _w(k: int) -> str:
    return f"(PARTITION BY series ORDER BY bar_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


O, ALL = "(PARTITION BY series ORDER BY bar_id)", "(PARTITION BY series ORDER BY bar_id ROWS UNBOUNDED PRECEDING)"


def query(name: str, sql: str | None = None):
    def keep(f):
        _Q[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def _ticks(s, d):
    return tape.ticks(s, d)


def _bars(s, d):
    return tape.tick_bars(tape.ticks(s, d))


def _pick(df: DataFrame, columns: list[str], key=KEY) -> DataFrame:
    """The key and rounded columns."""
    kinds = dict(df.dtypes)
    return df.select(*key, *[F.round(c, 6).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns])


def _r(named: dict[str, str]) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in named.items())


def _bar_sql(named: dict[str, str], extra: str = "", source: str = "bars") -> str:
    return f"WITH {BARS}{extra} SELECT series, bar_id, {_r(named)} FROM {source}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.dollar_bars(_ticks(spark, sf_dir).withColumn("series", F.lit(0).cast("long")))
    return found.withColumn("log_return", F.log(F.try_divide(F.col("close"), F.lag("close").over(features.order())))).orderBy("bar_id")


# cleaning

@query("clean_drop_missing", f"WITH {TICKS} SELECT series, seq, price FROM ticks WHERE ts IS NOT NULL AND price IS NOT NULL AND amount IS NOT NULL")
def _(s, d):
    return cleaning.drop_missing(_ticks(s, d)).select("series", "seq", "price")


@query("clean_drop_dust", f"WITH {TICKS} SELECT series, seq, amount FROM ticks WHERE amount >= 1e-10")
def _(s, d):
    return cleaning.drop_dust(_ticks(s, d)).select("series", "seq", "amount")


@query("clean_first_of_each", f"WITH {TICKS} SELECT series, side, min(seq) AS seq FROM ticks GROUP BY ALL")
def _(s, d):
    return cleaning.first_of_each(_ticks(s, d), ("series", "side")).select("series", "side", "seq")


@query("clean_price_jumps", f"WITH {TICKS}, b AS (SELECT *, abs(price / lag(price) OVER (PARTITION BY series ORDER BY ts, seq) - 1) AS c FROM ticks) SELECT series, seq FROM b WHERE c IS NULL OR c <= 0.05")
def _(s, d):
    return cleaning.drop_jumps(_ticks(s, d)).select("series", "seq")


_TW = "(PARTITION BY series ORDER BY ts, seq ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)"


@query("clean_rolling_zscore", f"WITH {TICKS}, b AS (SELECT *, count(price) OVER {_TW} AS n, avg(price) OVER {_TW} AS m, stddev_samp(price) OVER {_TW} AS sd FROM ticks) SELECT series, seq FROM b WHERE n < 100 OR sd IS NULL OR (sd > 0 AND abs(price - m) <= 6 * sd)")
def _(s, d):
    return cleaning.drop_by_zscore(_ticks(s, d)).select("series", "seq")


_TA = "(PARTITION BY series ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"


@query("clean_expanding_mad", f"""WITH {TICKS}, a AS (SELECT *, CASE WHEN count(price) OVER {_TA} >= 100 THEN quantile_cont(price, 0.5) OVER {_TA} END AS m FROM ticks),
b AS (SELECT *, abs(price - m) AS dev FROM a), c AS (SELECT *, CASE WHEN count(dev) OVER {_TA} >= 100 THEN quantile_cont(dev, 0.5) OVER {_TA} END AS mad FROM b)
SELECT series, seq FROM c WHERE mad IS NULL OR mad = 0 OR dev <= 3 * 1.4826 * mad""")
def _(s, d):
    return cleaning.drop_by_mad(_ticks(s, d), threshold=3.0).select("series", "seq")


@query("clean_date_range", f"WITH {TICKS}, m AS (SELECT min(ts) AS a FROM ticks) SELECT series, seq FROM ticks, m WHERE ts >= date_trunc('day', a) + INTERVAL 1 DAY AND ts < date_trunc('day', a) + INTERVAL 3 DAY")
def _(s, d):
    t = _ticks(s, d)
    a = t.agg(F.date_trunc("day", F.min("ts")).alias("a")).first()["a"]
    from datetime import timedelta

    return cleaning.in_range(t, a + timedelta(days=1), a + timedelta(days=3)).select("series", "seq")


@query("clean_fill_forward", f"WITH {BARS}, g AS (SELECT *, CASE WHEN bar_id % 3 = 1 THEN close END AS x FROM bars) SELECT series, bar_id, round(coalesce(last_value(x IGNORE NULLS) OVER {ALL}, first_value(x IGNORE NULLS) OVER (PARTITION BY series ORDER BY bar_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS x FROM g")
def _(s, d):
    return _pick(cleaning.fill_forward(_bars(s, d).withColumn("x", F.when(F.col("bar_id") % 3 == 1, F.col("close"))), ["x"]), ["x"])


# sources

@query("source_bounds", f"WITH {TICKS} SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM ticks")
def _(s, d):
    return tape.bounds(_ticks(s, d))


@query("source_time_ranges", f"""WITH {TICKS}, m AS (SELECT epoch_us(min(ts)) // 1000 AS a, epoch_us(max(ts)) // 1000 + 1 AS z FROM ticks), k AS (SELECT a, z, greatest(1, (z - a) // 6) AS step FROM m)
SELECT a + i * step AS start_ms, least(a + (i + 1) * step, z) AS end_ms, (SELECT count(*) FROM ticks WHERE epoch_us(ts) // 1000 >= a + i * step AND epoch_us(ts) // 1000 < least(a + (i + 1) * step, z)) AS n FROM k, range(0, 8) r(i) WHERE a + i * step < z""")
def _(s, d):
    return tape.ranges_of(_ticks(s, d), 6)


@query("source_tick_bars", f"WITH {BARS} SELECT series, bar_id, ts_open, ts_close, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, round(v_buy, 6) AS v_buy, round(v_sell, 6) AS v_sell, n_ticks, round(log_return, 6) AS log_return FROM bars")
def _(s, d):
    return _pick(_bars(s, d), ["ts_open", "ts_close", "open", "high", "low", "close", "volume", "v_buy", "v_sell", "n_ticks", "log_return"])


# bars

_DOLLAR = TICKS + """, o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, seq) AS i, price * amount AS v FROM ticks),
t AS (SELECT series, greatest(sum(v) / 20, 1e-10) AS th FROM o GROUP BY series)"""


@query("dollar_bars_fixed", f"""WITH RECURSIVE {_DOLLAR}, r AS (SELECT o.series, i, v AS acc, CAST(0 AS BIGINT) AS bar, v >= th AS closed FROM o JOIN t USING (series) WHERE i = 1
UNION ALL SELECT o.series, o.i, CASE WHEN r.closed THEN o.v ELSE r.acc + o.v END, CASE WHEN r.closed THEN r.bar + 1 ELSE r.bar END, CASE WHEN r.closed THEN o.v ELSE r.acc + o.v END >= th FROM r JOIN o ON o.series = r.series AND o.i = r.i + 1 JOIN t ON t.series = o.series),
done AS (SELECT series, bar FROM r WHERE closed)
SELECT r.series, r.bar AS bar_id, min(ts) AS ts_open, max(ts) AS ts_close, round(arg_min(price, o.i), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, o.i), 6) AS close, round(sum(amount), 6) AS volume, round(sum(v), 4) AS cum_dollar, round(sum(v) / sum(amount), 6) AS vwap, count(*) AS n_ticks
FROM r JOIN o ON o.series = r.series AND o.i = r.i JOIN done ON done.series = r.series AND done.bar = r.bar GROUP BY r.series, r.bar""")
def _(s, d):
    return B.dollar_bars(_ticks(s, d)).select(*KEY, "ts_open", "ts_close", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume")], F.round("cum_dollar", 4).alias("cum_dollar"), F.round("vwap", 6).alias("vwap"), "n_ticks")


@query("dollar_bars_adaptive", f"""WITH RECURSIVE {_DOLLAR}, r AS (SELECT o.series, i, v AS acc, CAST(0 AS BIGINT) AS bar, th AS thr, th AS ema, v >= th AS closed FROM o JOIN t USING (series) WHERE i = 1
UNION ALL SELECT series, i, acc, bar, thr, ema, acc >= thr FROM (SELECT o.series, o.i, CASE WHEN r.closed THEN o.v ELSE r.acc + o.v END AS acc, CASE WHEN r.closed THEN r.bar + 1 ELSE r.bar END AS bar,
 CASE WHEN r.closed THEN least(greatest(r.acc * (2.0 / 101) + r.ema * (1 - 2.0 / 101), 0.5 * th), 2 * th) ELSE r.thr END AS thr, CASE WHEN r.closed THEN r.acc * (2.0 / 101) + r.ema * (1 - 2.0 / 101) ELSE r.ema END AS ema FROM r JOIN o ON o.series = r.series AND o.i = r.i + 1 JOIN t ON t.series = o.series) x)
SELECT series, bar AS bar_id, round(acc, 4) AS cum_dollar, round(thr, 4) AS threshold_used FROM r WHERE closed""")
def _(s, d):
    return B.dollar_bars(_ticks(s, d), adaptive=True).select(*KEY, F.round("cum_dollar", 4).alias("cum_dollar"), F.round("threshold_used", 4).alias("threshold_used"))


# windowed features

_MOM = {f"cum_return_{k}": f"CASE WHEN rn > {k} OR (rn = {k} AND count(log_return) OVER {_w(k)} = {k}) THEN sum(log_return) OVER {_w(k)} END" for k in (1, 3, 5, 10, 20)}
_MOM |= {f"{m}_return_{k}": f"CASE WHEN rn >= {k} THEN {m}(log_return) OVER {_w(k)} END" for k in (5, 10, 20) for m in ("max", "min")}


@query("momentum", _bar_sql(_MOM))
def _(s, d):
    return _pick(features.momentum(_bars(s, d)), list(_MOM))


def _ma(k):
    return f"CASE WHEN rn >= {k} THEN avg(close) OVER {_w(k)} END"


_MA = {f"ma_{k}": _ma(k) for k in (5, 10, 20, 50)} | {f"cross_ma_{a}_{b}": f"CAST(sign({_ma(a)} - {_ma(b)}) AS DOUBLE)" for a, b in ((5, 20), (10, 50))}


@query("moving_averages", _bar_sql(_MA))
def _(s, d):
    return _pick(features.moving_averages(_bars(s, d)), list(_MA))


def _pz(k):
    w = f"(PARTITION BY series ORDER BY bar_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN rn > {k} AND stddev_samp(close) OVER {w} > 1e-10 THEN (close - avg(close) OVER {w}) / stddev_samp(close) OVER {w} ELSE 0.0 END"


_PZ = {f"price_zscore_{k}": _pz(k) for k in (10, 20, 50)}


@query("price_zscore", _bar_sql(_PZ))
def _(s, d):
    return _pick(features.price_zscore(_bars(s, d)), list(_PZ))


@query("return_streak", _bar_sql({"return_streak": "CAST(coalesce(s * row_number() OVER (PARTITION BY series, s, g ORDER BY bar_id), 0) AS DOUBLE)"}, f", sg AS (SELECT *, sign(log_return) AS s FROM bars), gr AS (SELECT *, rn - row_number() OVER (PARTITION BY series, s ORDER BY bar_id) AS g FROM sg)", "gr"))
def _(s, d):
    return _pick(features.return_streak(_bars(s, d)), ["return_streak"])


_LAG = {f"close_lag{k}": f"lag(close, {k}) OVER {O}" for k in (1, 5, 10)}


@query("lags", _bar_sql(_LAG))
def _(s, d):
    return _pick(features.lags(_bars(s, d), ["close"], (1, 5, 10)), list(_LAG))


@query("future_return", f"WITH {BARS}, n AS (SELECT series, bar_id, lead(log_return) OVER {O} AS log_return, lead(bar_id) OVER {O} AS nx FROM bars) SELECT series, bar_id, round(log_return, 6) AS log_return FROM n WHERE nx IS NOT NULL")
def _(s, d):
    return _pick(features.future_return(_bars(s, d)), ["log_return"])


def _full(agg, k, x="log_return"):
    return f"CASE WHEN count({x}) OVER {_w(k)} >= {k} THEN {agg} OVER {_w(k)} END"


_RV = {f"realized_vol_{k}": f"sqrt({_full('sum(log_return * log_return)', k)})" for k in (5, 10, 20)}
_RV |= {f"return_vol_ratio_{k}": f"coalesce(CASE WHEN sqrt({_full('sum(log_return * log_return)', k)}) > 1e-10 THEN {_full('sum(log_return)', k)} / sqrt({_full('sum(log_return * log_return)', k)}) END, 0.0)" for k in (5, 10, 20)}
_RV |= {f"realized_skew_{k}": _full("skewness(log_return)", k) for k in (10, 20, 50)} | {f"realized_kurt_{k}": _full("kurtosis(log_return)", k) for k in (10, 20, 50)}


@query("realized_moments", _bar_sql(_RV))
def _(s, d):
    return _pick(features.realized(_bars(s, d)), list(_RV))


_J = {}
for _k in (10, 20):
    _bv = f"CASE WHEN rn > {_k} AND count(p) OVER {_w(_k - 1)} >= {_k // 2} THEN pi() / 2 * sum(p) OVER {_w(_k - 1)} END"
    _rvv = _full("sum(log_return * log_return)", _k)
    _J |= {f"bipower_var_{_k}": _bv, f"jump_{_k}": f"CASE WHEN ({_bv}) IS NOT NULL AND ({_rvv}) IS NOT NULL THEN greatest(({_rvv}) - ({_bv}), 0) END"}


@query("jumps", _bar_sql(_J, f", pr AS (SELECT *, abs(log_return) * abs(lag(log_return) OVER {O}) AS p FROM bars)", "pr"))
def _(s, d):
    return _pick(features.jumps(_bars(s, d)), list(_J))


_RG = {}
for _k in (5, 10, 20):
    _mean = lambda x, k=_k: f"CASE WHEN rn >= {k} THEN avg({x}) OVER {_w(k)} END"
    _kap = 0.34 / (1.34 + (_k + 1) / (_k - 1))
    _RG |= {f"parkinson_vol_{_k}": f"sqrt({_mean('pk')})", f"garman_klass_vol_{_k}": f"sqrt(greatest({_mean('gk')}, 0))", f"rogers_satchell_vol_{_k}": f"sqrt(greatest({_mean('rs')}, 0))", f"yang_zhang_vol_{_k}": f"CASE WHEN rn > {_k} AND count(ovn) OVER {_w(_k)} >= 2 THEN sqrt(greatest(var_samp(ovn) OVER {_w(_k)} + {_kap!r} * var_samp(co) OVER {_w(_k)} + {1 - _kap!r} * avg(rs) OVER {_w(_k)}, 0)) END"}
_RG |= {"range_ratio": "CASE WHEN close > 0 THEN (high - low) / close END", "body_ratio": "CASE WHEN close > 0 THEN CASE WHEN high - low > 1e-10 THEN abs(close - open) / (high - low) ELSE 0.0 END END"}
# a maximum with a null is the other value in either engine, so the warm-up rows are cut by the row number
_RG = {k: (f"CASE WHEN rn >= {k.rsplit('_', 1)[1]} THEN {v} END" if k.startswith(("garman", "rogers")) else v) for k, v in _RG.items()}
_RGX = f", rg AS (SELECT *, ln(high / low) ** 2 / (4 * ln(2)) AS pk, 0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 AS gk, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, ln(open / lag(close) OVER {O}) AS ovn, ln(close / open) AS co FROM bars)"


@query("range_volatility", _bar_sql(_RG, _RGX, "rg"))
def _(s, d):
    df = features.range_volatility(_bars(s, d))
    return _pick(df, list(_RG))


_FL = {"vpin_50": f"CASE WHEN rn >= 50 AND sum(v_buy + v_sell) OVER {_w(50)} > 0 THEN sum(abs(v_buy - v_sell)) OVER {_w(50)} / sum(v_buy + v_sell) OVER {_w(50)} END", "kyle_lambda_50": f"CASE WHEN count(dp) OVER {_w(50)} >= 50 AND var_pop(sv) OVER {_w(50)} * 50 >= 1e-10 THEN covar_pop(sv, dp) OVER {_w(50)} / var_pop(sv) OVER {_w(50)} END"}


@query("order_flow", _bar_sql(_FL, f", fl AS (SELECT *, close - lag(close) OVER {O} AS dp, v_buy - v_sell AS sv FROM bars)", "fl"))
def _(s, d):
    return _pick(features.order_flow(_bars(s, d)), list(_FL))


_H, _DW, _MO = "(hour(ts_close) + minute(ts_close) / 60.0)", "(isodow(ts_close) - 1)", "month(ts_close)"


@query("calendar", f"WITH {BARS} SELECT series, bar_id, {_r({'hour': _H, **{f'{n}_{f}': f'{f}(2 * pi() * {x} / {m})' for n, x, m in (('hour', _H, 24), ('dow', _DW, 7), ('month', _MO, 12)) for f in ('sin', 'cos')}})}, CAST({_DW} AS INT) AS day_of_week, CAST(day(ts_close) AS INT) AS day_of_month, CAST(week(ts_close) AS INT) AS week, CAST(month(ts_close) AS INT) AS month, CAST(quarter(ts_close) AS INT) AS quarter FROM bars")
def _(s, d):
    return _pick(features.calendar(_bars(s, d)), ["hour", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "day_of_week", "day_of_month", "week", "month", "quarter"])


@query("drawdowns", f"""WITH {BARS}, m AS (SELECT *, max(close) OVER {ALL} AS top, min(close) OVER {ALL} AS bot FROM bars), f AS (SELECT m.*, (SELECT min(b.bar_id) FROM bars b WHERE b.series = m.series AND b.close = m.top) AS ti, (SELECT min(b.bar_id) FROM bars b WHERE b.series = m.series AND b.close = m.bot) AS bi FROM m)
SELECT series, bar_id, round(top, 6) AS rolling_max, round(bot, 6) AS rolling_min, round(close / top - 1, 6) AS drawdown, round(close / bot - 1, 6) AS drawup, bar_id - ti AS bars_since_high, bar_id - bi AS bars_since_low, CAST(close / top - 1 <= -0.1 AS INT) AS crash_10pct FROM f""")
def _(s, d):
    return _pick(features.drawdowns(_bars(s, d)), ["rolling_max", "rolling_min", "drawdown", "drawup", "bars_since_high", "bars_since_low", "crash_10pct"])


@query("since_shock", f"WITH {BARS}, h AS (SELECT *, max(CASE WHEN abs(log_return) > 0.5 THEN rn END) OVER {ALL} AS hit FROM bars) SELECT series, bar_id, CAST(coalesce(rn - hit, rn - 1) AS INT) AS bars_since_shock FROM h")
def _(s, d):
    return _pick(features.since_shock(_bars(s, d), 0.5), ["bars_since_shock"])


_V = f"CASE WHEN count(log_return) OVER {_w(20)} >= 2 THEN stddev_samp(log_return) OVER {_w(20)} END"


@query("volatility_regime", f"WITH {BARS}, v AS (SELECT *, {_V} AS vol FROM bars), e AS (SELECT *, count(vol) OVER {ALL} AS n, quantile_cont(vol, 0.75) OVER {ALL} AS q75, quantile_cont(vol, 0.95) OVER {ALL} AS q95, avg(vol) OVER {ALL} AS m, stddev_samp(vol) OVER {ALL} AS sd FROM v) SELECT series, bar_id, round(vol, 6) AS volatility, CASE WHEN vol IS NULL OR n < 40 THEN 0 ELSE CAST(vol > q75 AS INT) END AS vol_regime_75, CASE WHEN vol IS NULL OR n < 40 THEN 0 ELSE CAST(vol > q95 AS INT) END AS vol_regime_95, round(CASE WHEN n >= 40 AND sd > 1e-10 THEN (vol - m) / sd END, 6) AS vol_zscore FROM e")
def _(s, d):
    return _pick(features.volatility_regime(_bars(s, d)), ["volatility", "vol_regime_75", "vol_regime_95", "vol_zscore"])


@query("rolling_zscore", _bar_sql({"volume_zscore": f"CASE WHEN count(volume) OVER {_w(100)} < 10 THEN NULL WHEN coalesce(stddev_samp(volume) OVER {_w(100)}, 0) <= 1e-10 THEN 0.0 ELSE (volume - avg(volume) OVER {_w(100)}) / stddev_samp(volume) OVER {_w(100)} END"}))
def _(s, d):
    return _pick(features.rolling_zscore(_bars(s, d), ["volume"]), ["volume_zscore"])


def _weights(d, n):
    out = [1.0]
    for k in range(1, n):
        out.append(-out[-1] * (d - k + 1) / k)
    return out


@query("frac_diff", _bar_sql({"frac_diff_d05": " + ".join(f"({v!r}) * ln(lag(close, {k}) OVER {O})" for k, v in enumerate(_weights(0.5, 20)))}))
def _(s, d):
    return _pick(features.frac_diff(_bars(s, d)), ["frac_diff_d05"])


@query("shannon_entropy", f"""WITH {BARS}, p AS (SELECT a.series, a.bar_id, b.log_return AS x FROM bars a JOIN bars b ON a.series = b.series AND b.bar_id BETWEEN a.bar_id - 49 AND a.bar_id WHERE a.rn >= 50 AND b.log_return IS NOT NULL),
m AS (SELECT *, min(x) OVER (PARTITION BY series, bar_id) AS lo, max(x) OVER (PARTITION BY series, bar_id) AS hi, count(*) OVER (PARTITION BY series, bar_id) AS n FROM p),
c AS (SELECT series, bar_id, n, least(floor((x - lo) / (hi - lo) * 10), 9) AS b, count(*) AS k FROM m GROUP BY ALL)
SELECT bars.series, bars.bar_id, round(e, 6) AS shannon_entropy_50 FROM bars LEFT JOIN (SELECT series, bar_id, sum(-k / n * ln(k / n)) AS e FROM c GROUP BY ALL) USING (series, bar_id)""")
def _(s, d):
    return _pick(features.entropy(_bars(s, d)), ["shannon_entropy_50"])


# flow and joins

_SIGN = "CAST(coalesce(last_value(nullif(sign(price - lag_p), 0) IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 1) AS INT)"
_LAGP = "lagged AS (SELECT *, lag(price) OVER (PARTITION BY series ORDER BY ts, seq) AS lag_p FROM ticks)"


@query("tick_rule", f"WITH {TICKS}, {_LAGP} SELECT series, seq, {_SIGN} AS trade_sign FROM lagged")
def _(s, d):
    return flow.tick_rule(_ticks(s, d)).select("series", "seq", "trade_sign")


@query("volume_imbalance", f"WITH {TICKS}, b AS (SELECT series, sum(CASE WHEN side = 'buy' THEN amount ELSE 0 END) AS b, sum(CASE WHEN side = 'sell' THEN amount ELSE 0 END) AS s FROM ticks GROUP BY series) SELECT series, round(CASE WHEN b + s > 0 THEN (b - s) / (b + s) ELSE 0 END, 6) AS volume_imbalance FROM b")
def _(s, d):
    return _pick(flow.imbalance(flow.direct(_ticks(s, d)), ["series"]), ["volume_imbalance"], ["series"])


@query("asof_bar_imbalance", f"""WITH {BARS}, x AS (SELECT t.*, coalesce(b.bar_id, (SELECT max(bar_id) FROM bars z WHERE z.series = t.series)) AS bar FROM ticks t ASOF LEFT JOIN bars b ON t.series = b.series AND t.ts <= b.ts_close),
g AS (SELECT series, bar AS bar_id, sum(CASE WHEN side = 'buy' THEN amount ELSE 0 END) AS b, sum(CASE WHEN side = 'sell' THEN amount ELSE 0 END) AS s FROM x GROUP BY ALL) SELECT series, bar_id, round(CASE WHEN b + s > 0 THEN (b - s) / (b + s) ELSE 0 END, 6) AS volume_imbalance FROM g""")
def _(s, d):
    t = _ticks(s, d)
    return _pick(flow.imbalance(flow.direct(flow.bar_of_tick(t, tape.tick_bars(t))), KEY), ["volume_imbalance"])


@query("range_join_intrabar", f"""WITH {BARS}, j AS (SELECT b.series, b.bar_id, t.ts, t.seq, t.price FROM bars b JOIN ticks t ON t.series = b.series AND t.ts BETWEEN b.ts_open AND b.ts_close),
r AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY series, bar_id ORDER BY ts, seq)) AS r FROM j)
SELECT series, bar_id, count(*) AS tick_count, round(CASE WHEN count(r) >= 2 THEN sqrt(var_samp(r)) END, 6) AS intrabar_vol, round(CASE WHEN count(r) >= 2 THEN (max(price) - min(price)) / arg_max(price, ts) END, 6) AS tick_range, round(CASE WHEN count(r) >= 2 THEN sum(r * r) END, 6) AS tick_rv, round(CASE WHEN count(r) >= 2 THEN avg(r) END, 6) AS tick_mean FROM r GROUP BY ALL""")
def _(s, d):
    t = _ticks(s, d)
    return _pick(flow.intrabar(t, tape.tick_bars(t)), ["tick_count", "intrabar_vol", "tick_range", "tick_rv", "tick_mean"])


# labels

_TB = f"""WITH {BARS}, v AS (SELECT *, {_full('stddev_samp(log_return)', 20)} AS vol FROM bars), n AS (SELECT series, max(bar_id) AS last FROM bars GROUP BY series),
p AS (SELECT a.series, a.bar_id, a.vol, b.bar_id AS j, b.close / a.close - 1 AS r FROM v a JOIN v b ON a.series = b.series AND b.bar_id BETWEEN a.bar_id + 1 AND a.bar_id + 10 WHERE a.vol IS NOT NULL),
h AS (SELECT series, bar_id, coalesce(min(CASE WHEN r >= 1.5 * vol OR r <= -vol THEN j END), max(j)) AS t1 FROM p GROUP BY ALL),
lab AS (SELECT h.series, h.bar_id, h.t1, p.r AS ret, CASE WHEN abs(p.r) < 0.01 THEN 0 WHEN p.r > 0 THEN 1 ELSE -1 END AS label FROM h JOIN p ON p.series = h.series AND p.bar_id = h.bar_id AND p.j = h.t1)"""


def _labelled(s, d):
    bars = _bars(s, d)
    return labels.triple_barrier(bars.withColumn("vol", features.full(F.stddev_samp, F.col("log_return"), 20)), "vol", least=0.01)


@query("triple_barrier", _TB + " SELECT series, bar_id, t1, round(ret, 6) AS ret, label FROM lab")
def _(s, d):
    return _pick(_labelled(s, d), ["t1", "ret", "label"])


@query("label_shares", _TB + " SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lab GROUP BY label")
def _(s, d):
    return _pick(labels.class_shares(_labelled(s, d)), ["n", "share"], ["label"])


@query("label_economics", _TB + ", e AS (SELECT label * ret - 0.01 * abs(ret) AS net FROM lab WHERE label <> 0) SELECT count(*) AS n_trades, round(sum(net), 6) AS total_return, round(avg(CAST(net > 0 AS DOUBLE)), 6) AS win_rate, round(avg(net) / stddev_samp(net) * sqrt(count(*)), 6) AS sharpe FROM e")
def _(s, d):
    return _pick(labels.economics(_labelled(s, d)), ["n_trades", "total_return", "win_rate", "sharpe"], [])


# statistics

_COLS = ["open", "high", "low", "volume", "log_return"]


@query("correlations", f"WITH {BARS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM bars" for a, b in stats.pairs(_COLS)))
def _(s, d):
    return _pick(stats.correlations(_bars(s, d), _COLS), ["corr"], ["a", "b"])


@query("spearman", f"WITH {BARS}, r AS (SELECT rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2.0 AS a, rank() OVER (ORDER BY log_return) + (count(*) OVER (PARTITION BY log_return) - 1) / 2.0 AS b FROM bars WHERE log_return IS NOT NULL AND volume IS NOT NULL) SELECT round(corr(a, b), 6) AS spearman FROM r")
def _(s, d):
    return _pick(stats.spearman(_bars(s, d), "volume", "log_return"), ["spearman"], [])


@query("f_scores", f"WITH {BARS}, c AS (SELECT * FROM bars WHERE log_return IS NOT NULL), r AS (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, corr({x}, log_return) AS r, count(*) AS n FROM c" for x in ("volume", "v_buy", "v_sell")) + ") SELECT feature, round(r, 6) AS r, round(r * r / (1 - r * r) * (n - 2), 6) AS f_score FROM r")
def _(s, d):
    return _pick(stats.f_scores(_bars(s, d), ["volume", "v_buy", "v_sell"], "log_return"), ["r", "f_score"], ["feature"])


def determinant(m: list[list[str]]) -> str:
    """By the first row; of test sizes only."""
    if len(m) == 1:
        return m[0][0]
    parts = [f"{'-' if i % 2 else '+'} {x} * ({determinant([r[:i] + r[i + 1 :] for r in m[1:]])})" for i, x in enumerate(m[0])]
    return " ".join(parts).removeprefix("+ ")


_V4 = ["open", "volume", "v_buy", "v_sell"]
_M4 = [["(1 + 1e-8)" if a == b else f"r_{min(a, b)}_{max(a, b)}" for b in _V4] for a in _V4]
_VIF4 = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(({determinant([r[:i] + r[i + 1 :] for j, r in enumerate(_M4) if j != i])}) / ({determinant(_M4)}), 6) AS vif FROM c" for i, c in enumerate(_V4))


@query("vif", f"WITH {BARS}, c AS (SELECT {', '.join(f'corr({min(a, b)}, {max(a, b)}) AS r_{min(a, b)}_{max(a, b)}' for a, b in stats.pairs(_V4))} FROM bars) {_VIF4}")
def _(s, d):
    return _pick(stats.vif(_bars(s, d), ["open", "volume", "v_buy", "v_sell"]), ["vif"], ["feature"])


_ACF = f"WITH {BARS}, c AS (SELECT series, bar_id, log_return - avg(log_return) OVER (PARTITION BY series) AS x FROM bars WHERE log_return IS NOT NULL), l AS (SELECT *, row_number() OVER {O} AS i FROM c), a AS (SELECT u.series, u.i - v.i AS lag, sum(u.x * v.x) AS s FROM l u JOIN l v ON u.series = v.series AND u.i - v.i BETWEEN 1 AND 10 GROUP BY ALL), z AS (SELECT series, sum(x * x) AS s, count(*) AS n FROM c GROUP BY series)"


@query("autocorrelation", _ACF + " SELECT series, CAST(lag AS INT) AS lag, round(a.s / z.s, 6) AS acf FROM a JOIN z USING (series)")
def _(s, d):
    return _pick(stats.autocorrelation(_bars(s, d), "log_return"), ["acf"], ["series", "lag"])


@query("ljung_box", _ACF + " SELECT series, round(any_value(n) * (any_value(n) + 2) * sum((a.s / z.s) ** 2 / (n - lag)), 6) AS q FROM a JOIN z USING (series) GROUP BY series")
def _(s, d):
    return _pick(stats.ljung_box(_bars(s, d), "log_return"), ["q"], ["series"])


@query("jarque_bera", f"WITH {BARS}, m AS (SELECT series, log_return - avg(log_return) OVER (PARTITION BY series) AS x FROM bars WHERE log_return IS NOT NULL) SELECT series, round(count(*) / 6 * ((avg(x ** 3) / avg(x ** 2) ** 1.5) ** 2 + (avg(x ** 4) / avg(x ** 2) ** 2 - 3) ** 2 / 4), 6) AS jb FROM m GROUP BY series")
def _(s, d):
    return _pick(stats.jarque_bera(_bars(s, d), "log_return"), ["jb"], ["series"])


@query("mann_kendall", f"WITH {BARS} SELECT a.series, CAST(sum(sign(b.close - a.close)) AS BIGINT) AS s FROM bars a JOIN bars b ON a.series = b.series AND a.bar_id < b.bar_id GROUP BY a.series")
def _(s, d):
    return stats.mann_kendall(_bars(s, d), "close")


@query("stability", f"WITH {BARS}, n AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM bars) SELECT series, CAST(least((rn - 1) // greatest(n // 10, 1), 9) AS BIGINT) AS period, round(avg(volume), 6) AS mean, round(stddev_samp(volume), 6) AS std FROM n GROUP BY ALL")
def _(s, d):
    return _pick(stats.stability(_bars(s, d), "volume"), ["mean", "std"], ["series", "period"])


@query("rolling_correlation", _bar_sql({"corr_w50": f"CASE WHEN count(CASE WHEN volume IS NOT NULL AND log_return IS NOT NULL THEN 1 END) OVER {_w(50)} >= 50 THEN coalesce(corr(volume, log_return) OVER {_w(50)}, 0) END"}))
def _(s, d):
    return _pick(stats.rolling_correlation(_bars(s, d), "volume", "log_return"), ["corr_w50"])


# transforms

_SPLIT = f"{BARS}, sp AS (SELECT *, CASE WHEN rn <= floor(count(*) OVER (PARTITION BY series) * 0.8) THEN 'train' ELSE 'test' END AS split FROM bars)"


def _split(s, d):
    return transform.split_by_time(_bars(s, d))


@query("split_by_time", f"WITH {_SPLIT} SELECT series, bar_id, split FROM sp")
def _(s, d):
    return _split(s, d).select(*KEY, "split")


@query("standard_scaler", f"WITH {_SPLIT}, f AS (SELECT avg(volume) AS m, stddev_samp(volume) AS s FROM sp WHERE split = 'train') SELECT series, bar_id, round((volume - m) / s, 6) AS volume FROM sp, f")
def _(s, d):
    df = _split(s, d)
    return _pick(transform.standard_scaler(df.where("split = 'train'"), ["volume"]).transform(df), ["volume"])


@query("minmax_scaler", f"WITH {_SPLIT}, f AS (SELECT min(volume) AS a, max(volume) AS b FROM sp WHERE split = 'train') SELECT series, bar_id, round(greatest(-1, least(1, 2 * (volume - a) / (b - a) - 1)), 6) AS volume FROM sp, f")
def _(s, d):
    df = _split(s, d)
    return _pick(transform.minmax_scaler(df.where("split = 'train'"), ["volume"]).transform(df), ["volume"])


@query("signed_log", _bar_sql({"log_return": "sign(log_return) * ln(1 + abs(log_return))"}))
def _(s, d):
    return _pick(transform.signed_log(_bars(s, d), ["log_return"]), ["log_return"])


@query("group_components")
def _(s, d):
    df = _split(s, d)
    out = transform.group_components(df.where("split = 'train'"), df, ["open", "high", "low", "close"], "price")
    return _pick(out, [c for c in out.columns if c.startswith("pca_")])


# evaluation

@query("class_metrics", "WITH c AS (SELECT quality AS t, toxic AS g FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), l AS (SELECT t AS label FROM c UNION SELECT g FROM c) SELECT label, round(CASE WHEN count(*) FILTER (g = label) > 0 THEN count(*) FILTER (t = label AND g = label) / count(*) FILTER (g = label) ELSE 0 END, 6) AS precision, round(CASE WHEN count(*) FILTER (t = label) > 0 THEN count(*) FILTER (t = label AND g = label) / count(*) FILTER (t = label) ELSE 0 END, 6) AS recall, round(2 * count(*) FILTER (t = label AND g = label) / (count(*) FILTER (t = label) + count(*) FILTER (g = label)), 6) AS f1, count(*) FILTER (t = label) AS real FROM l, c GROUP BY label")
def _(s, d):
    return _pick(evaluation.class_metrics(s.read.parquet(f"{d}/labels.parquet"), "quality", "toxic"), ["precision", "recall", "f1", "real"], ["label"])


@query("accuracy_mcc", "SELECT round(avg(CAST(quality = toxic AS DOUBLE)), 6) AS accuracy, round(corr(quality, toxic), 6) AS mcc FROM labels")
def _(s, d):
    return _pick(evaluation.accuracy(s.read.parquet(f"{d}/labels.parquet"), "quality", "toxic"), ["accuracy", "mcc"], [])


@query("baseline_persistence", _TB + f" SELECT series, bar_id, lag(label) OVER {O} AS prediction FROM lab")
def _(s, d):
    return evaluation.persistence(_labelled(s, d)).select(*KEY, "prediction")


@query("baseline_transitions", _TB + f", b AS (SELECT lag(label) OVER {O} AS before, label AS after FROM lab) SELECT before, after, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY before), 6) AS p FROM b WHERE before IS NOT NULL GROUP BY before, after")
def _(s, d):
    return _pick(evaluation.transitions(_labelled(s, d)), ["n", "p"], ["before", "after"])


@query("backtest", f"WITH {BARS}, g AS (SELECT *, coalesce(log_return, 0) * sign(v_buy - v_sell) * 0.1 AS g FROM bars) SELECT series, bar_id, round(g - 0.01 * abs(g), 6) AS net, round(10000 * exp(sum(ln(1 + g - 0.01 * abs(g))) OVER {ALL}), 4) AS capital FROM g")
def _(s, d):
    return evaluation.backtest(_bars(s, d).withColumn("pos", F.signum(F.col("v_buy") - F.col("v_sell")) * 0.1), "pos").select(*KEY, F.round("net", 6).alias("net"), F.round("capital", 4).alias("capital"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from . import analysis_queries, fitted_queries, indicator_queries, model_queries, more_queries, report_queries, search_queries, slice_queries  # noqa: E402, F401  their queries add themselves
