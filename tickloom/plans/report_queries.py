"""Queries of whole reports on features, with SQL put together from each measure's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from . import report as R
from . import analysis_queries  # noqa: F401  its SQL is used
from .catalogue import _SQL, _V4, _bars, query
from .fitted_queries import _mi, _ranked

_T = "log_return"
_ALL = [*_V4, _T]


def _cell(name: str, measure: str, a: str, b: str, series: str, value: str, source: str) -> str:
    return f"SELECT '{name}' AS analysis, '{measure}' AS measure, {a} AS a, {b} AS b, {series} AS series, round({value}, 6) AS value FROM {source}"


def _parts() -> list[str]:
    null, out = "CAST(NULL AS VARCHAR)", []
    for a, b in stats.pairs(_ALL):
        out.append(_cell("relations", "corr", f"'{a}'", f"'{b}'", null, "v", f"(SELECT corr({a}, {b}) AS v FROM bars)"))
        out.append(_cell("relations", "mi", f"'{a}'", f"'{b}'", null, f"greatest({_mi(a, b)}, 0)", "one"))
    told = " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, {_T}) AS p, corr({c}_rank, {_T}_rank) AS s, {_mi(c, _T)} AS mi, count(*) AS n FROM bin" for c in _V4)
    scored = f"(SELECT *, abs(abs(s) - abs(p)) + greatest(mi / max(mi) OVER () - abs(p), 0) AS score, p * p / (1 - p * p) * (n - 2) AS f FROM ({told}))"
    out += [_cell("target", m, "feature", f"'{_T}'", null, v, scored) for m, v in (("pearson", "p"), ("spearman", "s"), ("mi", "mi"), ("score", "score"), ("f_score", "f"))]
    out.append(_cell("collinearity", "vif", "feature", null, null, "vif", f"({_SQL['vif']})"))
    for c in _V4:
        acf = _SQL["autocorrelation"].replace(f"{_T} - avg({_T})", f"{c} - avg({c})").replace(f"WHERE {_T} IS NOT NULL", f"WHERE {c} IS NOT NULL")
        out.append(_cell("time", "acf", f"'{c}'", "CAST(lag AS VARCHAR)", "CAST(series AS VARCHAR)", "acf", f"({acf})"))
        out.append(_cell("time", "kpss", f"'{c}'", null, "CAST(series AS VARCHAR)", "kpss", f"({_SQL['kpss'].replace('close - avg(close)', f'{c} - avg({c})')})"))
    return out


def _rounded(df):
    return df.withColumn("value", F.round("value", 6))


@query("feature_report", f"WITH {_ranked(_ALL)}, one AS (SELECT 1) " + " UNION ALL ".join(f"({p})" for p in _parts()))
def _(s, d):
    return _rounded(R.report(_bars(s, d), _V4, _T, (R.relations, R.of_target, R.collinearity, R.in_time)))


@query("feature_report_structure")
def _(s, d):
    return _rounded(R.report(_bars(s, d), _V4, _T, (R.components, R.stationarity, R.groups)))


@query("feature_ranking", f"""WITH {_ranked(_ALL)}, t AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, {_T}) AS p, corr({c}_rank, {_T}_rank) AS s, {_mi(c, _T)} AS mi, count(*) AS n FROM bin" for c in _V4)}),
u AS (SELECT feature, greatest(abs(p), abs(s)) + abs(abs(s) - abs(p)) + greatest(mi / max(mi) OVER () - abs(p), 0) AS score, p * p / (1 - p * p) * (n - 2) AS f FROM t)
SELECT feature, round(score, 6) AS score, round(f, 6) AS f_score, round(vif, 6) AS vif, CAST(row_number() OVER (ORDER BY score DESC, feature) AS INT) AS place FROM u JOIN ({_SQL['vif']}) v USING (feature)""")
def _(s, d):
    found = R.ranking(R.report(_bars(s, d), _V4, _T, (R.of_target, R.collinearity)))
    return found.select("feature", *[F.round(c, 6).alias(c) for c in ("score", "f_score", "vif")], "place")
