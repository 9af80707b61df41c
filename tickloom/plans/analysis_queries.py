"""Queries of the analysis operators over tick bars; those that solve regressions or recursions are tested against numpy instead of SQL."""

from __future__ import annotations

from ..operators import analysis
from .catalogue import _ACF, ALL, BARS, KEY, O, _bar_sql, _bars, _pick, _w, query

_PAIRS = f"""{BARS}, c AS (SELECT series, bar_id, volume AS x, log_return AS y FROM bars WHERE volume IS NOT NULL AND log_return IS NOT NULL),
p AS (SELECT a.series, a.bar_id AS i, b.bar_id AS j, a.x - b.x AS dx, a.y - b.y AS dy FROM c a JOIN c b ON a.series = b.series)"""


@query("kendall", f"WITH {_PAIRS} SELECT series, round(sum(sign(dx) * sign(dy)) / sqrt(sum(abs(sign(dx))) * sum(abs(sign(dy)))), 6) AS tau FROM p WHERE i < j GROUP BY series")
def _(s, d):
    return _pick(analysis.kendall(_bars(s, d), "volume", "log_return"), ["tau"], ["series"])


@query("distance_correlation", f"""WITH {_PAIRS}, q AS (SELECT *, abs(dx) AS a, abs(dy) AS b FROM p), k AS (SELECT *, a - avg(a) OVER (PARTITION BY series, i) - avg(a) OVER (PARTITION BY series, j) + avg(a) OVER (PARTITION BY series) AS ca,
 b - avg(b) OVER (PARTITION BY series, i) - avg(b) OVER (PARTITION BY series, j) + avg(b) OVER (PARTITION BY series) AS cb FROM q) SELECT series, round(sqrt(avg(ca * cb) / sqrt(avg(ca * ca) * avg(cb * cb))), 6) AS dcor FROM k GROUP BY series""")
def _(s, d):
    return _pick(analysis.distance_correlation(_bars(s, d), "volume", "log_return"), ["dcor"], ["series"])


@query("expanding_zscore", _bar_sql({"volume_zscore": f"CASE WHEN rn >= 10 THEN (volume - avg(volume) OVER {ALL}) / stddev_samp(volume) OVER {ALL} END"}))
def _(s, d):
    return _pick(analysis.expanding_zscore(_bars(s, d), ["volume"]), ["volume_zscore"])


@query("volume_scaling", _bar_sql({"volume_scaled": f"CASE WHEN rn >= 7 THEN volume / avg(volume) OVER {_w(21)} ELSE 1 END"}))
def _(s, d):
    return _pick(analysis.volume_scaling(_bars(s, d)), ["volume_scaled"])


@query("kpss", f"""WITH {BARS}, c AS (SELECT series, bar_id, close - avg(close) OVER (PARTITION BY series) AS x FROM bars), n AS (SELECT *, sum(x) OVER {ALL} AS s, row_number() OVER {O} AS i FROM c),
g AS (SELECT a.series, a.i - b.i AS k, sum(a.x * b.x) AS v FROM n a JOIN n b ON a.series = b.series AND a.i - b.i BETWEEN 0 AND 10 GROUP BY ALL),
l AS (SELECT series, sum(CASE WHEN k = 0 THEN v ELSE 2 * (1 - k / 11.0) * v END) AS v FROM g GROUP BY series), t AS (SELECT series, sum(s * s) / count(*) AS s FROM n GROUP BY series) SELECT series, round(s / v, 6) AS kpss FROM t JOIN l USING (series)""")
def _(s, d):
    return _pick(analysis.kpss(_bars(s, d), "close"), ["kpss"], ["series"])


def _near(k: int, top: int) -> str:
    """Of each template the share of templates within reach, and of all pairs their number."""
    reach = " AND ".join(f"abs(x[i + {a}] - x[j + {a}]) <= 0.2" for a in range(k))
    return f"list_transform(range(1, {top} + 1), lambda i: list_sum(list_transform(range(1, {top} + 1), lambda j: CASE WHEN {reach} THEN 1.0 ELSE 0.0 END)))"


_CPLX = f"""WITH {BARS}, w AS (SELECT series, bar_id, CASE WHEN rn >= 50 AND count(log_return) OVER {_w(50)} >= 25 THEN list(log_return) FILTER (log_return IS NOT NULL) OVER {_w(50)} END AS v FROM bars),
z AS (SELECT series, bar_id, len(v) AS n, list_transform(v, lambda e: (e - list_avg(v)) / list_stddev_pop(v)) AS x FROM w),
m AS (SELECT series, bar_id, n, {_near(2, 'n - 1')} AS a2, {_near(3, 'n - 2')} AS a3, {_near(2, 'n - 2')} AS b2 FROM z)
SELECT series, bar_id, round(list_avg(list_transform(a2, lambda e: ln(e / (n - 1)))) - list_avg(list_transform(a3, lambda e: ln(e / (n - 2)))), 6) AS apen_50,
 round(CASE WHEN list_sum(a3) = n - 2 OR list_sum(b2) = n - 2 THEN ln(n) ELSE -ln((list_sum(a3) - (n - 2)) / (list_sum(b2) - (n - 2))) END, 6) AS sampen_50 FROM m"""


@query("complexity", _CPLX)
def _(s, d):
    return _pick(analysis.complexity(_bars(s, d)), ["apen_50", "sampen_50"])


@query("granger")
def _(s, d):
    return _pick(analysis.granger(_bars(s, d), "volume", "log_return"), ["f", "p"], ["series", "lag"])


@query("adf")
def _(s, d):
    return _pick(analysis.adf(_bars(s, d), "close", choose=True), ["n", "lags", "statistic", "critical", "stationary"], ["series"])


@query("partial_autocorrelation", _ACF.replace("WITH ", "WITH RECURSIVE ", 1) + """, v AS (SELECT a.series, list(a.s / z.s ORDER BY lag) AS r FROM a JOIN z USING (series) GROUP BY a.series),
d AS (SELECT series, r, 1 AS k, [r[1]] AS phi, 1 - r[1] * r[1] AS rest, r[1] AS pacf FROM v UNION ALL SELECT series, r, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - x * phi[k + 1 - i]), x), rest * (1 - x * x), x
 FROM (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 1 - i]))) / rest AS x FROM d WHERE k < 10) t) SELECT series, k AS lag, round(pacf, 6) AS pacf FROM d""")
def _(s, d):
    return _pick(analysis.partial_autocorrelation(_bars(s, d), "log_return"), ["pacf"], ["series", "lag"])


# the tail of chi-square with ten degrees of freedom is a finite sum
@query("ljung_box_p", _ACF + """, b AS (SELECT series, any_value(n) * (any_value(n) + 2) * sum((a.s / z.s) ** 2 / (n - lag)) AS q FROM a JOIN z USING (series) GROUP BY series)
SELECT series, round(q, 6) AS q, round(exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24), 6) AS p FROM b""")
def _(s, d):
    return _pick(analysis.ljung_box(_bars(s, d), "log_return"), ["q", "p"], ["series"])


@query("eigenvalues")
def _(s, d):
    return _pick(analysis.eigenvalues(_bars(s, d), ["open", "high", "low", "close", "volume"]), ["eigenvalue", "share", "cumulative", "condition_index"], ["component"])


@query("feature_groups")
def _(s, d):
    return _pick(analysis.feature_groups(_bars(s, d), ["open", "high", "low", "close", "volume", "v_buy", "v_sell"]), ["cluster", "size", "mean_corr"], ["feature"])
