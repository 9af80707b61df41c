"""Queries of searches over barrier settings, labels brought to rows, and information by neighbours, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import barrier_search, features, neighbours
from .catalogue import _TB, BARS, KEY, _bars, _full, _labelled, _pick, query

_GRID = barrier_search.settings((0.5, 1.0, 1.5), (0.0, 0.05), (5, 10))
_TRIED = ", ".join(f"({i}, {s.up!r}, {s.down!r}, {s.hold}, {s.least!r})" for i, s in enumerate(_GRID))
_GRID_SQL = f"""WITH {BARS}, s(setting, up, down, hold, least) AS (VALUES {_TRIED}), v AS (SELECT *, {_full('stddev_samp(log_return)', 20)} AS vol FROM bars),
p AS (SELECT a.series, a.bar_id, a.vol, b.bar_id AS j, b.close / a.close - 1 AS r FROM v a JOIN v b ON a.series = b.series AND b.bar_id BETWEEN a.bar_id + 1 AND a.bar_id + 10 WHERE a.vol IS NOT NULL),
h AS (SELECT s.setting, p.series, p.bar_id, coalesce(min(CASE WHEN r >= s.up * vol OR r <= -s.down * vol THEN j END), max(j)) AS t1 FROM p JOIN s ON p.j <= p.bar_id + s.hold GROUP BY ALL),
lab AS (SELECT h.setting, h.series, h.bar_id, h.t1, p.r AS ret, CASE WHEN abs(p.r) < s.least THEN 0 WHEN p.r > 0 THEN 1 ELSE -1 END AS label FROM h JOIN s ON s.setting = h.setting JOIN p ON p.series = h.series AND p.bar_id = h.bar_id AND p.j = h.t1),
e AS (SELECT *, CASE WHEN label <> 0 THEN label * ret - 0.01 * abs(ret) END AS net FROM lab),
g AS (SELECT setting, count(*) AS n, sum(CAST(label = -1 AS BIGINT)) AS n_down, sum(CAST(label = 0 AS BIGINT)) AS n_flat, sum(CAST(label = 1 AS BIGINT)) AS n_up, count(net) AS n_trades, sum(net) AS total_return, avg(CAST(net > 0 AS DOUBLE)) AS win_rate, avg(net) / nullif(stddev_samp(net), 0) * sqrt(count(net)) AS sharpe FROM e GROUP BY setting),
f AS (SELECT *, least(n_down, n_flat, n_up) >= 0.01 * n AND greatest(n_down, n_flat, n_up) <= 0.9 * n AS balanced FROM g), z AS (SELECT *, CASE WHEN balanced THEN CASE WHEN n_trades < 10 THEN 0 ELSE coalesce(sharpe, 0) END END AS score FROM f)"""


def _events(s, d):
    bars = _bars(s, d)
    return bars.withColumn("vol", features.full(F.stddev_samp, F.col("log_return"), 20))


@query("barrier_grid", _GRID_SQL + """ SELECT s.setting, s.up, s.down, s.hold, s.least, n, CAST(n_down AS BIGINT) AS n_down, CAST(n_flat AS BIGINT) AS n_flat, CAST(n_up AS BIGINT) AS n_up, n_trades, round(total_return, 6) AS total_return, round(win_rate, 6) AS win_rate, round(sharpe, 6) AS sharpe, balanced, round(score, 6) AS score,
 score IS NOT NULL AND row_number() OVER (ORDER BY score DESC NULLS LAST, z.setting) = 1 AS best FROM z JOIN s ON s.setting = z.setting""")
def _(s, d):
    return _pick(barrier_search.barrier_grid(_events(s, d), "vol", _GRID, shares=(0.01, 0.9)), ["up", "down", "hold", "least", "n", "n_down", "n_flat", "n_up", "n_trades", "total_return", "win_rate", "sharpe", "balanced", "score", "best"], ["setting"])


@query("barrier_touches", _GRID_SQL + " SELECT series, bar_id, setting, t1, round(ret, 6) AS ret, label FROM lab")
def _(s, d):
    return _pick(barrier_search.first_touches(_events(s, d), "vol", _GRID), ["setting", "t1", "ret", "label"])


@query("labels_applied", _TB + " SELECT bars.series, bars.bar_id, lab.label, lab.t1 FROM bars LEFT JOIN lab USING (series, bar_id)")
def _(s, d):
    return barrier_search.apply_labels(_bars(s, d).withColumn("label", F.lit(9)), _labelled(s, d)).select(*KEY, "label", "t1")


@query("label_alignment", _TB + ", a AS (SELECT * FROM bars WHERE bar_id % 3 <> 0) SELECT (SELECT count(*) FROM a) AS n_rows, (SELECT count(*) FROM lab) AS n_labels, (SELECT count(*) FROM a JOIN lab USING (series, bar_id)) AS n_matched, (SELECT count(*) FROM a LEFT JOIN lab USING (series, bar_id) WHERE lab.label IS NULL) AS rows_without_label, (SELECT count(*) FROM lab LEFT JOIN a USING (series, bar_id) WHERE a.close IS NULL) AS labels_without_row")
def _(s, d):
    return barrier_search.alignment(_bars(s, d).where("bar_id % 3 <> 0"), _labelled(s, d))


def _psi(x: str) -> str:
    return f"(ln({x} + 8) - 0.5 / ({x} + 8) - 1.0 / (12 * pow({x} + 8, 2)) + 1.0 / (120 * pow({x} + 8, 4)) - 1.0 / (252 * pow({x} + 8, 6)) - " + " - ".join(f"1.0 / ({x} + {i})" for i in range(8)) + ")"


#: All pairs of rows: for test sizes.
_KNN = f"""WITH {BARS}, c AS (SELECT volume, v_buy, log_return AS y, stddev_pop(volume) OVER () AS s1, stddev_pop(v_buy) OVER () AS s2, stddev_pop(log_return) OVER () AS sy FROM bars WHERE volume IS NOT NULL AND v_buy IS NOT NULL AND log_return IS NOT NULL),
u AS (SELECT 'volume' AS feature, volume / s1 AS x, y / sy AS y FROM c UNION ALL SELECT 'v_buy', v_buy / s2, y / sy FROM c), q AS (SELECT *, row_number() OVER () AS i FROM u),
p AS (SELECT a.feature, a.i, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, row_number() OVER (PARTITION BY a.i ORDER BY greatest(abs(a.x - b.x), abs(a.y - b.y))) AS k FROM q a JOIN q b ON a.feature = b.feature AND a.i <> b.i),
r AS (SELECT i, greatest(dx, dy) AS r FROM p WHERE k = 3), m AS (SELECT p.feature, p.i, sum(CAST(dx < r * (1 - 1e-10) OR (r = 0 AND dx = 0) AS BIGINT)) AS nx, sum(CAST(dy < r * (1 - 1e-10) OR (r = 0 AND dy = 0) AS BIGINT)) AS ny FROM p JOIN r ON r.i = p.i GROUP BY p.feature, p.i)
SELECT feature, round(greatest({_psi('count(*)')} + {_psi('3')} - avg({_psi('(nx + 1)')} + {_psi('(ny + 1)')}), 0), 6) AS mi FROM m GROUP BY feature"""


@query("mutual_information_knn", _KNN)
def _(s, d):
    return _pick(neighbours.mutual_information(_bars(s, d), ["volume", "v_buy"], "log_return"), ["mi"], ["feature"])
