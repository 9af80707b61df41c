"""Technical indicators over tick bars, with SQL that gets exponential averages from their closed form over pairs of rows."""

from __future__ import annotations

from ..operators import indicators
from .catalogue import ALL, BARS, KEY, O, _bars, _pick, _r, _w, query


def _ema(name: str, x: str, a: str, source: str = "b") -> str:
    keyed = f"(SELECT series, bar_id, {x} AS x, row_number() OVER {O} AS k FROM {source} WHERE {x} IS NOT NULL)"
    return f"{name} AS (SELECT b.series, b.bar_id, any_value(b.k) AS k, sum(CASE WHEN p.k = 1 THEN 1 ELSE {a} END * pow(1 - {a}, b.k - p.k) * p.x) AS y FROM {keyed} b JOIN {keyed} p ON p.series = b.series AND p.k <= b.k GROUP BY b.series, b.bar_id)"


def _f(agg: str, x: str, k: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(k)} >= {k} THEN {agg}({x}) OVER {_w(k)} END"


_B = f"""{BARS}, b0 AS (SELECT *, (high + low + close) / 3 AS tp, (high + low) / 2 AS mid, lag(close) OVER {O} AS pc, lag(high) OVER {O} AS ph, lag(low) OVER {O} AS pl, lag(volume) OVER {O} AS pv FROM bars),
b AS (SELECT *, tp - lag(tp) OVER {O} AS dtp, close - pc AS d, mid - lag(mid) OVER {O} AS dm, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
 CASE WHEN high = low THEN 0 ELSE (2 * close - high - low) / (high - low) * volume END AS mf, close - least(low, pc) AS bp, greatest(high, pc) - least(low, pc) AS utr FROM b0)"""
_MFI = f"CASE WHEN count(dtp) OVER {_w(14)} >= 14 THEN 100 * sum(CASE WHEN dtp > 0 THEN tp * volume ELSE 0 END) OVER {_w(14)} / nullif(sum(CASE WHEN dtp <> 0 THEN tp * volume ELSE 0 END) OVER {_w(14)}, 0) END"


def _sql(ctes: list[str], named: dict[str, str], source: str) -> str:
    return f"WITH {', '.join([_B, *ctes])} SELECT series, bar_id, {_r(named)} FROM {source}"


#: Columns that each family's query compares.
NAMED: dict[str, list[str]] = {}


def _ask(name: str, ctes: list[str], named: dict[str, str], source: str, family) -> None:
    NAMED[name] = list(named)

    @query(name, _sql(ctes, named, source))
    def _(s, d):
        return _pick(family(_bars(s, d)), list(named))


def _share(k: int) -> str:
    return f"CASE WHEN count(bp) OVER {_w(k)} >= {k} THEN sum(bp) OVER {_w(k)} / sum(utr) OVER {_w(k)} END"


_NAMED = {f"rsi_{n}": f"CASE WHEN g{n}.k >= {n} THEN CASE WHEN l{n}.y = 0 THEN 100 ELSE 100 - 100 / (1 + g{n}.y / l{n}.y) END END" for n in (14, 7)}
_NAMED |= {"macd": "CASE WHEN macd.k >= 26 THEN macd.x END", "macd_signal": "CASE WHEN ms.k >= 34 THEN ms.y END", "macd_diff": "CASE WHEN ms.k >= 34 THEN macd.x - ms.y END", "ppo": "CASE WHEN macd.k >= 26 THEN macd.p END", "ppo_signal": "CASE WHEN ps.k >= 34 THEN ps.y END", "ppo_diff": "CASE WHEN ps.k >= 34 THEN macd.p - ps.y END"}
_NAMED |= {"stoch_k": "sk", "stoch_d": _f("avg", "sk", 3), "williams_r": f"-100 * (({_f('max', 'high', 14)}) - close) / nullif(({_f('max', 'high', 14)}) - ({_f('min', 'low', 14)}), 0)"}
_NAMED |= {f"roc_{n}": f"100 * (close / lag(close, {n}) OVER {O} - 1)" for n in (10, 20)}
_NAMED |= {"awesome": f"({_f('avg', 'mid', 5)}) - ({_f('avg', 'mid', 34)})", "ultimate": f"100 * (4 * ({_share(7)}) + 2 * ({_share(14)}) + ({_share(28)})) / 7", "mfi_14": _MFI}
_ask(
    "ta_momentum",
    [*[_ema(f"{k}{n}", f"greatest({s}d, d * 0)", f"(1.0 / {n})") for n in (14, 7) for k, s in (("g", ""), ("l", "-"))], _ema("e12", "close", "(2.0 / 13)"), _ema("e26", "close", "(2.0 / 27)"), "macd AS (SELECT series, bar_id, e12.k, e12.y - e26.y AS x, 100 * (e12.y - e26.y) / e26.y AS p FROM e12 JOIN e26 USING (series, bar_id))", _ema("ms", "x", "0.2", "macd"), _ema("ps", "p", "0.2", "macd"), f"s AS (SELECT *, 100 * (close - ({_f('min', 'low', 14)})) / nullif(({_f('max', 'high', 14)}) - ({_f('min', 'low', 14)}), 0) AS sk FROM b)"],
    _NAMED,
    "s LEFT JOIN g14 USING (series, bar_id) LEFT JOIN l14 USING (series, bar_id) LEFT JOIN g7 USING (series, bar_id) LEFT JOIN l7 USING (series, bar_id) LEFT JOIN macd USING (series, bar_id) LEFT JOIN ms USING (series, bar_id) LEFT JOIN ps USING (series, bar_id)",
    indicators.momentum_indicators,
)

_BANDS = f"""v AS (SELECT *, 100 * (close / max(close) OVER {_w(14)} - 1) AS fall, {_f('avg', 'close', 20)} AS bb_mid, 2 * ({_f('stddev_pop', 'close', 20)}) AS sd, {_f('avg', '((4 * low - 2 * high + close) / 3)', 20)} AS kc_low, {_f('avg', 'tp', 20)} AS kc_mid,
 {_f('avg', '((4 * high - 2 * low + close) / 3)', 20)} AS kc_high, {_f('min', 'low', 20)} AS dc_low, {_f('max', 'high', 20)} AS dc_high FROM b),
v2 AS (SELECT *, bb_mid - sd AS bb_low, bb_mid + sd AS bb_high, (dc_low + dc_high) / 2 AS dc_mid FROM v)"""
_NAMED = {}
for _k in ("bb", "kc", "dc"):
    _NAMED |= {f"{_k}_{x}": f"{_k}_{x}" for x in ("low", "mid", "high")} | {f"{_k}_width": f"100 * ({_k}_high - {_k}_low) / {'bb' if _k == 'dc' else _k}_mid", f"{_k}_place": f"(close - {_k}_low) / nullif({_k}_high - {_k}_low, 0)"}
_NAMED |= {f"atr_{n}": f"CASE WHEN a{n}.k >= {n} THEN a{n}.y END" for n in (14, 7)} | {"ulcer": f"sqrt({_f('avg', '(fall * fall)', 14)})"}
_ask("ta_volatility", [*[_ema(f"a{n}", "tr", f"(1.0 / {n})") for n in (14, 7)], _BANDS], _NAMED, "v2 JOIN a14 USING (series, bar_id) JOIN a7 USING (series, bar_id)", indicators.volatility_indicators)

_NAMED = {f"sma_{n}": _f("avg", "close", n) for n in (7, 14, 20, 50)} | {f"ema_{n}": f"CASE WHEN ema{n}.k >= {n} THEN ema{n}.y END" for n in (7, 14, 20, 50)}
_NAMED |= {"adx": "CASE WHEN adx.k >= 27 THEN adx.y END", "di_plus": "CASE WHEN dx.k >= 14 THEN dx.di_plus END", "di_minus": "CASE WHEN dx.k >= 14 THEN dx.di_minus END"}
_NAMED |= {"aroon_up": f"CASE WHEN rn >= 26 THEN 100 * (25 - (rn - (max(struct_pack(h := high, i := rn)) OVER {_w(26)}).i)) / 25.0 END", "aroon_down": f"CASE WHEN rn >= 26 THEN 100 * (25 - (rn + (min(struct_pack(h := low, i := -rn)) OVER {_w(26)}).i)) / 25.0 END"}
_NAMED |= {f"cci_{n}": f"CASE WHEN rn >= {n} THEN (tp - m{n}) / nullif(0.015 * list_avg(list_transform(w{n}, lambda x: abs(x - m{n}))), 0) END" for n in (14, 20)}
_NAMED |= {"trix": f"CASE WHEN rn >= 43 THEN 100 * (t3.y / lag(t3.y) OVER {O} - 1) END", "mass_index": f"CASE WHEN rn >= 41 THEN sum(m1.y / nullif(m2.y, 0)) OVER {_w(25)} END"}
_NAMED |= {f"vortex_{k}": f"CASE WHEN count(pc) OVER {_w(14)} >= 14 THEN sum({x}) OVER {_w(14)} / sum(tr) OVER {_w(14)} END" for k, x in (("plus", "abs(high - pl)"), ("minus", "abs(low - ph)"))}
_NAMED |= {"dpo": f"lag(close, 11) OVER {O} - ({_f('avg', 'close', 20)})", "ichimoku_conversion": "i9", "ichimoku_base": "i26", "ichimoku_a": "(i9 + i26) / 2", "ichimoku_b": "i52"}
_DIRECT = "CASE WHEN pc IS NOT NULL THEN CASE WHEN {0} > {1} AND {0} > 0 THEN {0} ELSE 0 END END"
_JOINED = " ".join(f"LEFT JOIN {x} USING (series, bar_id)" for x in ("ema7", "ema14", "ema20", "ema50", "adx", "dx", "t3", "m1", "m2"))
_ask(
    "ta_trend",
    [*[_ema(f"ema{n}", "close", f"(2.0 / {n + 1})") for n in (7, 14, 20, 50)], _ema("st", "(CASE WHEN pc IS NOT NULL THEN tr END)", "(1.0 / 14)"), _ema("sp", "(" + _DIRECT.format("(high - ph)", "(pl - low)") + ")", "(1.0 / 14)"), _ema("sm", "(" + _DIRECT.format("(pl - low)", "(high - ph)") + ")", "(1.0 / 14)"),
     "dx AS (SELECT series, bar_id, st.k, 100 * sp.y / nullif(st.y, 0) AS di_plus, 100 * sm.y / nullif(st.y, 0) AS di_minus, CASE WHEN sp.y + sm.y = 0 THEN 0 ELSE 100 * abs(sp.y - sm.y) / (sp.y + sm.y) END AS x FROM st JOIN sp USING (series, bar_id) JOIN sm USING (series, bar_id))", _ema("adx", "x", "(1.0 / 14)", "dx"),
     _ema("t1", "close", "0.125"), _ema("t2", "y", "0.125", "t1"), _ema("t3", "y", "0.125", "t2"), _ema("m1", "(high - low)", "0.2"), _ema("m2", "y", "0.2", "m1"),
     "t AS (SELECT *, " + ", ".join(f"avg(tp) OVER {_w(n)} AS m{n}, list(tp) OVER {_w(n)} AS w{n}" for n in (14, 20)) + ", " + ", ".join(f"CASE WHEN rn >= {n} THEN (max(high) OVER {_w(n)} + min(low) OVER {_w(n)}) / 2 END AS i{n}" for n in (9, 26, 52)) + " FROM b)"],
    _NAMED,
    f"t {_JOINED}",
    indicators.trend_indicators,
)

_NAMED = {"obv": f"sum(coalesce(sign(d), 0) * volume) OVER {ALL}", "cmf_20": f"({_f('sum', 'mf', 20)}) / nullif(sum(volume) OVER {_w(20)}, 0)", "adi": f"sum(mf) OVER {ALL}", "emv": "emv", "emv_14": _f("avg", "emv", 14), "force_13": "CASE WHEN f.k >= 13 THEN f.y END", "mfi_14": _MFI}
_NAMED |= {"nvi": f"1000 * exp(sum(CASE WHEN volume < pv THEN ln(close / pc) ELSE 0 END) OVER {ALL})", "vwap_cumulative": f"sum(tp * volume) OVER {ALL} / nullif(sum(volume) OVER {ALL}, 0)"}
_ask("ta_volume", [_ema("f", "(d * volume)", "(1.0 / 7)"), "e AS (SELECT *, dm * (high - low) / nullif(volume, 0) AS emv FROM b)"], _NAMED, "e LEFT JOIN f USING (series, bar_id)", indicators.volume_indicators)
