"""Queries of merged statistics, dependence, paths of a baseline and the table of all features, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dependence, evaluation, features, incremental, transform
from .catalogue import _TB, BARS, KEY, O, _bars, _labelled, _pick, _w, query
from .feature_table import all_features, prepare


def _batches(rows: DataFrame, make) -> DataFrame:
    """Tables of three batches, one under the other."""
    return reduce(DataFrame.unionByName, [make(rows.where(F.col("bar_id") % 3 == i)) for i in range(3)])


_MOMENTS = "SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(var_pop({c}) * count({c}), 4) AS m2, round(min({c}), 6) AS low, round(max({c}), 6) AS high FROM bars"


@query("merged_moments", f"WITH {BARS} " + " UNION ALL ".join(_MOMENTS.format(c=c) for c in ("volume", "log_return")))
def _(s, d):
    met = incremental.merge(_batches(_bars(s, d), lambda b: incremental.moments(b, ["volume", "log_return"])))
    return met.select("feature", "n", *[F.round(c, 4 if c == "m2" else 6).alias(c) for c in ("mean", "m2", "low", "high")])


@query("merged_scaler", f"WITH {BARS}, m AS (SELECT avg(volume) AS m, stddev_samp(volume) AS s FROM bars) SELECT series, bar_id, round((volume - m) / s, 6) AS volume FROM bars, m")
def _(s, d):
    rows = _bars(s, d)
    return _pick(incremental.standard_of(incremental.merge(_batches(rows, lambda b: incremental.moments(b, ["volume"])))).transform(rows), ["volume"])


@query("merged_range_scaler", f"WITH {BARS}, m AS (SELECT min(volume) AS a, max(volume) AS z FROM bars) SELECT series, bar_id, round(2 * (volume - a) / (z - a) - 1, 6) AS volume FROM bars, m")
def _(s, d):
    rows = _bars(s, d)
    return _pick(incremental.minmax_of(incremental.merge(_batches(rows, lambda b: incremental.moments(b, ["volume"])))).transform(rows), ["volume"])


@query("merged_components", f"""WITH {BARS}, m AS (SELECT avg(close) AS ma, stddev_samp(close) AS sa, avg(volume) AS mb, stddev_samp(volume) AS sb, sign(corr(close, volume)) AS r FROM bars)
SELECT series, bar_id, round(((close - ma) / sa + r * (volume - mb) / sb) / sqrt(2), 6) AS pca_pair_c0 FROM bars, m""")
def _(s, d):
    rows = _bars(s, d)
    return _pick(incremental.components_of(_batches(rows, lambda b: incremental.co_moments(b, ["close", "volume"])), 0.5).transform(rows, "pair"), ["pca_pair_c0"])


def _ranked(columns: list[str]) -> str:
    """Rows whole in all columns with average ranks and bins."""
    rank = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}_rank" for c in columns)
    bin_ = ", ".join(f"CAST(floor(({c}_rank - 1) * 16 / n) AS INT) AS {c}_bin" for c in columns)
    return f"{BARS}, w AS (SELECT {', '.join(columns)}, count(*) OVER () AS n, {rank} FROM bars WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)}), bin AS (SELECT *, {bin_} FROM w)"


def _mi(a: str, b: str) -> str:
    return f"(SELECT sum(k / n * ln(k * n / (r * c))) FROM (SELECT k, sum(k) OVER () AS n, sum(k) OVER (PARTITION BY i) AS r, sum(k) OVER (PARTITION BY j) AS c FROM (SELECT {a}_bin AS i, {b}_bin AS j, CAST(count(*) AS DOUBLE) AS k FROM bin GROUP BY ALL)))"


_XS = ["volume", "v_buy"]


@query("mutual_information", f"WITH {_ranked([*_XS, 'log_return'])} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round({_mi(c, 'log_return')}, 6) AS mi" for c in _XS))
def _(s, d):
    return _pick(dependence.mutual_information(_bars(s, d), _XS, "log_return"), ["mi"], ["feature"])


@query("mutual_information_pairs", f"WITH {_ranked(['volume', 'v_buy', 'close'])} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_mi(a, b)}, 6) AS mi" for a, b in (("volume", "v_buy"), ("volume", "close"), ("v_buy", "close"))))
def _(s, d):
    return _pick(dependence.mutual_information_pairs(_bars(s, d), ["volume", "v_buy", "close"]), ["mi"], ["a", "b"])


@query("nonlinearity", f"WITH {_ranked([*_XS, 'log_return'])}, m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, log_return) AS p, corr({c}_rank, log_return_rank) AS s, {_mi(c, 'log_return')} AS mi FROM bin" for c in _XS) + """)
SELECT feature, round(p, 6) AS pearson, round(s, 6) AS spearman, round(mi, 6) AS mi, round(abs(abs(s) - abs(p)) + greatest(mi / max(mi) OVER () - abs(p), 0), 6) AS score FROM m""")
def _(s, d):
    return _pick(dependence.nonlinearity(_bars(s, d), _XS, "log_return"), ["pearson", "spearman", "mi", "score"], ["feature"])


@query("least_fractional_order")
def _(s, d):
    return dependence.least_order(_bars(s, d))


@query("baseline_markov_path", _TB.replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT *, row_number() OVER {O} AS i, count(*) OVER (PARTITION BY series) AS n FROM lab), tr AS (SELECT * FROM o WHERE i <= floor(n * 0.8)), te AS (SELECT *, row_number() OVER {O} AS k FROM o WHERE i > floor(n * 0.8)),
b AS (SELECT label, lag(label) OVER {O} AS before FROM tr), t AS (SELECT before, label, row_number() OVER (PARTITION BY before ORDER BY count(*) DESC, label) AS r FROM b WHERE before IS NOT NULL GROUP BY before, label), c AS (SELECT DISTINCT label FROM tr),
nx AS (SELECT c.label AS before, coalesce(t.label, (SELECT min(label) FROM tr)) AS label FROM c LEFT JOIN t ON t.before = c.label AND t.r = 1), st AS (SELECT series, arg_max(label, bar_id) AS label FROM tr GROUP BY series),
walk AS (SELECT series, 0 AS k, label FROM st UNION ALL SELECT w.series, w.k + 1, nx.label FROM walk w JOIN nx ON nx.before = w.label WHERE w.k < 3000) SELECT te.series, te.bar_id, walk.label AS prediction FROM te LEFT JOIN walk ON walk.series = te.series AND walk.k = te.k""")
def _(s, d):
    rows = transform.split_by_time(_labelled(s, d))
    return evaluation.markov_path(rows.where("split = 'train'"), rows.where("split = 'test'")).select(*KEY, "prediction")


@query("feature_pipeline", f"""WITH {BARS}, f AS (SELECT *, lead(log_return) OVER {O} AS y, lead(bar_id) OVER {O} AS nxt, CASE WHEN rn >= 20 THEN avg(close) OVER {_w(20)} END AS ma FROM bars), k AS (SELECT * FROM f WHERE nxt IS NOT NULL AND ma IS NOT NULL),
t AS (SELECT *, CASE WHEN row_number() OVER {O} <= floor(count(*) OVER (PARTITION BY series) * 0.8) THEN 'train' ELSE 'test' END AS split FROM k), g AS (SELECT avg(ma) AS m, stddev_samp(ma) AS s, avg(volume) AS vm, stddev_samp(volume) AS vs FROM t WHERE split = 'train')
SELECT series, bar_id, split, round(y, 6) AS log_return, round((ma - m) / s, 6) AS ma_20, round((volume - vm) / vs, 6) AS volume FROM t, g""")
def _(s, d):
    table, _, _ = prepare(_bars(s, d), (features.durations, features.moving_averages), (), ["ma_20"])
    return _pick(table, ["split", "log_return", "ma_20", "volume"])


@query("feature_table", f"WITH {BARS}, v AS (SELECT *, sum(log_return) OVER {_w(5)} AS c5 FROM bars) SELECT series, bar_id, round(CASE WHEN rn > 5 THEN c5 END, 6) AS cum_return_5, round(lag(CASE WHEN rn > 5 THEN c5 END, 5) OVER {O}, 6) AS cum_return_5_lag5, round(lag(volume, 10) OVER {O}, 6) AS volume_lag10 FROM v")
def _(s, d):
    return _pick(all_features(_bars(s, d)), ["cum_return_5", "cum_return_5_lag5", "volume_lag10"])
