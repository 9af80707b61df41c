"""Queries of models, baselines and their scores over labelled bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, models, transform
from .catalogue import _TB, ALL, BARS, KEY, O, _bars, _labelled, _pick, query

_HELD = f", c AS (SELECT series, bar_id, label, lag(label) OVER {O} AS g FROM lab), d AS (SELECT * FROM c WHERE g IS NOT NULL), k AS (SELECT label FROM d UNION SELECT g FROM d)"
_CLASSES = _TB + _HELD + """, tally AS (SELECT k.label, count(*) FILTER (d.label = k.label) AS a, count(*) FILTER (d.g = k.label) AS s, count(*) FILTER (d.g = k.label AND d.label = k.label) AS h FROM k, d GROUP BY k.label),
q AS (SELECT *, coalesce(h / nullif(s, 0), 0) AS p, coalesce(h / nullif(a, 0), 0) AS r, coalesce(2 * h / nullif(a + s, 0), 0) AS f FROM tally)"""


@query("classification_summary", _CLASSES + """ SELECT round(sum(h) / sum(a), 6) AS accuracy, round(avg(r) FILTER (a > 0), 6) AS balanced_accuracy, round(avg(p), 6) AS precision_macro, round(sum(p * a) / sum(a), 6) AS precision_weighted, round(avg(r), 6) AS recall_macro, round(sum(r * a) / sum(a), 6) AS recall_weighted,
 round(avg(f), 6) AS f1_macro, round(sum(f * a) / sum(a), 6) AS f1_weighted, round((sum(h) / sum(a) - sum(a * s) / sum(a) ** 2) / (1 - sum(a * s) / sum(a) ** 2), 6) AS kappa, round((sum(h) * sum(a) - sum(a * s)) / sqrt((sum(a) ** 2 - sum(s * s)) * (sum(a) ** 2 - sum(a * a))), 6) AS mcc FROM q""")
def _(s, d):
    out = evaluation.summary(evaluation.persistence(_labelled(s, d)), "label", "prediction")
    return _pick(out, out.columns, [])


@query("composite_score", _CLASSES + """, f AS (SELECT coalesce(max(f) FILTER (label = -1), 0) AS f1_down, coalesce(max(f) FILTER (label = 0), 0) AS f1_flat, coalesce(max(f) FILTER (label = 1), 0) AS f1_up FROM q), e AS (SELECT avg(CAST(label * g < 0 AS DOUBLE)) AS sign_error_rate FROM d)
SELECT round(f1_down, 6) AS f1_down, round(f1_flat, 6) AS f1_flat, round(f1_up, 6) AS f1_up, round(sign_error_rate, 6) AS sign_error_rate, round(0.45 * (f1_down + f1_up) / 2 + 0.2 * f1_flat + 0.25 * least(f1_down, f1_flat, f1_up) - 0.2 * sign_error_rate, 6) AS composite_score FROM f, e""")
def _(s, d):
    out = evaluation.composite_score(evaluation.persistence(_labelled(s, d)), "label", "prediction")
    return _pick(out, out.columns, [])


@query("class_weights", _TB + " SELECT label, count(*) AS n, round((SELECT count(*) FROM lab) / ((SELECT count(DISTINCT label) FROM lab) * count(*)), 6) AS weight FROM lab GROUP BY label")
def _(s, d):
    return _pick(evaluation.class_weights(_labelled(s, d)), ["n", "weight"], ["label"])


@query("baseline_markov", _TB + f""", b AS (SELECT series, bar_id, label, lag(label) OVER {O} AS before FROM lab), t AS (SELECT before, label, row_number() OVER (PARTITION BY before ORDER BY count(*) DESC, label) AS k FROM b WHERE before IS NOT NULL GROUP BY before, label)
SELECT b.series, b.bar_id, coalesce(t.label, (SELECT min(label) FROM lab)) AS prediction FROM b LEFT JOIN t ON t.before = b.before AND t.k = 1""")
def _(s, d):
    rows = _labelled(s, d)
    return evaluation.markov(rows, rows).select(*KEY, "prediction")


_GAIN = f"""WITH {BARS}, g AS (SELECT series, bar_id, sign(v_buy - v_sell) * 0.1 AS pos, coalesce(log_return, 0) * sign(v_buy - v_sell) * 0.1 AS g FROM bars), n AS (SELECT *, g - 0.01 * abs(g) AS net FROM g),
c AS (SELECT *, 10000 * exp(sum(ln(1 + net)) OVER {ALL}) AS cap, 10000 * exp(sum(ln(1 + net)) OVER {ALL}) / (1 + net) AS was FROM n),
d AS (SELECT *, greatest(max(cap) OVER {ALL}, 10000) AS peak, was * net AS trade FROM c)"""


@query("trading_summary", _GAIN + """ SELECT series, count(*) FILTER (pos <> 0) AS n_trades, count(*) FILTER (pos <> 0 AND trade > 0) AS n_profitable, round(avg(CAST(trade > 0 AS DOUBLE)) FILTER (pos <> 0), 6) AS win_rate, round(sum(was * g), 4) AS gross_pnl, round(sum(trade), 4) AS net_pnl, round(sum(0.01 * abs(was * g)), 4) AS total_costs,
 round(avg(net) FILTER (pos <> 0) / stddev_samp(net) FILTER (pos <> 0) * sqrt(12500), 6) AS sharpe, round(max(peak - cap), 4) AS max_drawdown, round(100 * max(peak - cap) / arg_max(peak, peak - cap), 6) AS max_drawdown_pct, round(sum(trade) FILTER (trade > 0) / -sum(trade) FILTER (trade < 0), 6) AS profit_factor FROM d GROUP BY series""")
def _(s, d):
    out = evaluation.trading_summary(_bars(s, d).withColumn("pos", F.signum(F.col("v_buy") - F.col("v_sell")) * 0.1), "pos")
    whole, money = ["n_trades", "n_profitable"], ["gross_pnl", "net_pnl", "total_costs", "max_drawdown"]
    return out.select("series", *whole, *[F.round(c, 4 if c in money else 6).alias(c) for c in out.columns[1:] if c not in whole])


@query("sequences", f"WITH {BARS}, q AS (SELECT series, bar_id, rn, list([close, volume]) OVER (PARTITION BY series ORDER BY bar_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x FROM bars) SELECT series, bar_id, len(x) AS n, round(x[1][1], 6) AS oldest, round(x[5][2], 6) AS newest FROM q WHERE rn > 5")
def _(s, d):
    rows = transform.sequences(_bars(s, d), ["close", "volume"], 5)
    return rows.select(*KEY, F.size("sequence").alias("n"), F.round(F.col("sequence")[0][0], 6).alias("oldest"), F.round(F.col("sequence")[4][1], 6).alias("newest"))


@query("log_transform", f"WITH {BARS}, m AS (SELECT min(volume) AS a FROM bars) SELECT series, bar_id, round(sign(log_return) * ln(1 + abs(log_return)), 6) AS log_return, round(ln(1 + volume + CASE WHEN a < 1e-10 THEN 1e-10 ELSE 0 END), 6) AS volume FROM bars, m")
def _(s, d):
    rows = _bars(s, d)
    return _pick(transform.log_transform(rows, ["log_return", "volume"]).transform(rows), ["log_return", "volume"])


_X = ["vol", "volume", "v_buy", "v_sell"]


@query("ridge_out_of_fold")
def _(s, d):
    told = models.out_of_fold(_labelled(s, d), lambda rows: models.ridge(rows, _X), end="t1")
    return told.select(*KEY, "fold", "prediction", "coverage")


@query("forest_predictions")
def _(s, d):
    rows = transform.split_by_time(_labelled(s, d))
    return models.trees(rows.where("split = 'train'"), _X, numTrees=10, maxDepth=4).transform(rows.where("split = 'test'")).select(*KEY, "label", "prediction")
