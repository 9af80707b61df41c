"""Queries of cleaning chains, durations, meta barriers, trends, clusters and folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, evaluation, features, labels, normality, stats
from ..sources import tape
from .catalogue import _TB, BARS, KEY, TICKS, O, _bar_sql, _bars, _labelled, _pick, _ticks, query

_DUR = {"bar_duration_ts": "(epoch_us(ts_close) - epoch_us(ts_open)) / 1e6", "time_gap_bars": f"coalesce((epoch_us(ts_open) - epoch_us(lag(ts_close) OVER {O})) / 1e6, 0)"}


@query("bar_durations", _bar_sql(_DUR))
def _(s, d):
    return _pick(features.durations(_bars(s, d)), list(_DUR))


@query("temporal_acceleration", f"""WITH RECURSIVE {BARS}, t AS (SELECT *, (epoch_us(ts_close) - epoch_us(ts_open)) / 1e6 AS tau FROM bars), e AS (SELECT series, rn, tau AS m FROM t WHERE rn = 1
 UNION ALL SELECT t.series, t.rn, t.tau / 3 + e.m * 2 / 3 FROM e JOIN t ON t.series = e.series AND t.rn = e.rn + 1), a AS (SELECT t.series, t.bar_id, lag(tau) OVER w - tau AS acc, lag(m) OVER w - m AS sm FROM t JOIN e ON e.series = t.series AND e.rn = t.rn WINDOW w AS (PARTITION BY t.series ORDER BY t.bar_id))
SELECT series, bar_id, round(acc, 6) AS temporal_acceleration, round(acc - lag(acc) OVER {O}, 6) AS temporal_jerk, round(sm, 6) AS temporal_acceleration_smooth FROM a""")
def _(s, d):
    return _pick(features.acceleration(features.durations(_bars(s, d)), span=5), ["temporal_acceleration", "temporal_jerk", "temporal_acceleration_smooth"])


@query("rolling_spearman", f"""WITH {BARS}, p AS (SELECT a.series, a.bar_id, b.bar_id AS j, b.volume AS x, b.close AS y FROM bars a JOIN bars b ON a.series = b.series AND b.bar_id BETWEEN a.bar_id - 19 AND a.bar_id WHERE a.rn >= 20),
r AS (SELECT series, bar_id, row_number() OVER (PARTITION BY series, bar_id ORDER BY x, j) AS rx, row_number() OVER (PARTITION BY series, bar_id ORDER BY y, j) AS ry FROM p), c AS (SELECT series, bar_id, corr(rx, ry) AS v FROM r GROUP BY ALL)
SELECT bars.series, bars.bar_id, round(v, 6) AS spearman_w20 FROM bars LEFT JOIN c USING (series, bar_id)""")
def _(s, d):
    return _pick(features.rolling_spearman(_bars(s, d), "volume", "close", 20), ["spearman_w20"])


@query("planned_lags", _bar_sql({f"volume_lag{k}": f"lag(volume, {k}) OVER {O}" for k in (1, 5)}))
def _(s, d):
    return _pick(features.planned_lags(_bars(s, d).withColumn("hour_sin", F.lit(0.0)), ["volume", "hour_sin"], (1, 5)), ["volume_lag1", "volume_lag5"])


@query("frac_diff_expanding", f"""WITH RECURSIVE {BARS}, g AS (SELECT 0 AS k, CAST(1 AS DOUBLE) AS w UNION ALL SELECT k + 1, -w * (0.4 - k) / (k + 1) FROM g WHERE k < 3000),
t AS (SELECT a.series, a.bar_id, sum(g.w * ln(b.close)) AS v FROM bars a JOIN bars b ON a.series = b.series AND b.rn <= a.rn JOIN g ON g.k = a.rn - b.rn WHERE a.rn >= 20 GROUP BY ALL)
SELECT bars.series, bars.bar_id, round(v, 5) AS frac_diff_expanding FROM bars LEFT JOIN t USING (series, bar_id)""")
def _(s, d):
    return features.frac_diff_expanding(_bars(s, d), 0.4).select(*KEY, F.round("frac_diff_expanding", 5).alias("frac_diff_expanding"))


_SIDED = f"""{_TB}, ev AS (SELECT lab.series, lab.bar_id, v.vol, CASE WHEN lab.bar_id % 3 = 0 THEN -1 ELSE 1 END AS side FROM lab JOIN v ON v.series = lab.series AND v.bar_id = lab.bar_id)"""


def _events(s, d):
    rows = _labelled(s, d)
    return rows.select("series", "bar_id", "vol", F.when(F.col("bar_id") % 3 == 0, -1).otherwise(1).alias("side"))


@query("vertical_barriers", _SIDED + " SELECT ev.series, ev.bar_id, least(ev.bar_id + 7, n.last) AS t1 FROM ev JOIN n USING (series)")
def _(s, d):
    return labels.vertical_barriers(_bars(s, d), _events(s, d), 7).select(*KEY, "t1")


@query("side_barriers", _SIDED + " SELECT series, bar_id, round(2 * vol * side, 6) AS pt, round(-1 * vol * side, 6) AS sl FROM ev")
def _(s, d):
    return _pick(labels.side_barriers(_events(s, d), 2.0, 1.0), ["pt", "sl"])


@query("meta_first_touch", _SIDED + """, q AS (SELECT ev.*, b.bar_id AS j, b.close / a.close - 1 AS r FROM ev JOIN bars a ON a.series = ev.series AND a.bar_id = ev.bar_id JOIN bars b ON b.series = ev.series AND b.bar_id BETWEEN ev.bar_id + 1 AND ev.bar_id + 10),
f AS (SELECT series, bar_id, min(CASE WHEN r * side >= 2 * vol OR r * side <= -vol THEN j END) AS touch, max(j) AS last FROM q WHERE vol > 0 GROUP BY ALL)
SELECT f.series, f.bar_id, f.touch, coalesce(f.touch, f.last) AS t1, round(q.r, 6) AS ret, CAST(q.r * q.side > 0 AS INT) AS meta_label FROM f JOIN q ON q.series = f.series AND q.bar_id = f.bar_id AND q.j = coalesce(f.touch, f.last)""")
def _(s, d):
    events = labels.side_barriers(_events(s, d), 2.0, 1.0)
    return _pick(labels.first_touch(_bars(s, d), events, 10), ["touch", "t1", "ret", "meta_label"])


_FIT = "slope, intercept, r_squared, std_error, mean_first_half, mean_second_half, std_first_half, std_second_half, mean_change, std_change".split(", ")


@query("linear_trend", f"""WITH {BARS}, x AS (SELECT series, close AS y, rn - 1 AS x, count(*) OVER (PARTITION BY series) AS n FROM bars),
f AS (SELECT series, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r_squared, sqrt((1 - regr_r2(y, x)) * var_pop(y) / var_pop(x) / (count(*) - 2)) AS std_error, avg(y) FILTER (x < n // 2) AS mean_first_half, avg(y) FILTER (x >= n // 2) AS mean_second_half,
 stddev_pop(y) FILTER (x < n // 2) AS std_first_half, stddev_pop(y) FILTER (x >= n // 2) AS std_second_half FROM x GROUP BY series)
SELECT series, {", ".join(f"round({c}, 6) AS {c}" for c in _FIT[:8])}, round(mean_second_half - mean_first_half, 6) AS mean_change, round(std_second_half - std_first_half, 6) AS std_change FROM f""")
def _(s, d):
    return _pick(stats.linear_trend(_bars(s, d), "close"), _FIT, ["series"])


@query("embedding_outliers", """WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), r AS (SELECT vec_id, sqrt((x - avg(x) OVER ()) ** 2 + (y - avg(y) OVER ()) ** 2) AS d FROM p), z AS (SELECT *, (d - avg(d) OVER ()) / stddev_pop(d) OVER () AS z FROM r)
SELECT vec_id, round(d, 6) AS distance_from_center, round(z, 6) AS z_score, abs(z) > 2 AS is_outlier FROM z""")
def _(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xy")])
    return _pick(stats.embedding_outliers(e, "x", "y", 2.0), ["distance_from_center", "z_score", "is_outlier"], ["vec_id"])


@query("cluster_scores", """WITH p AS (SELECT vec_id AS i, label AS c, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE label IS NOT NULL),
m AS (SELECT c, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM p GROUP BY c), g AS (SELECT avg(x) AS gx, avg(y) AS gy, count(*) AS n FROM p),
d AS (SELECT p.c, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS s, sum((x - mx) ** 2 + (y - my) ** 2) AS w FROM p JOIN m USING (c) GROUP BY p.c),
b AS (SELECT a.c, max((da.s + db.s) / sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2)) AS worst FROM m a JOIN m b ON a.c <> b.c JOIN d da ON da.c = a.c JOIN d db ON db.c = b.c GROUP BY a.c),
f AS (SELECT u.i, u.c, v.c AS o, avg((u.x - v.x) ** 2 + (u.y - v.y) ** 2) AS far FROM p u JOIN p v ON u.i <> v.i GROUP BY ALL),
q AS (SELECT i, max(far) FILTER (c = o) AS a, min(far) FILTER (c <> o) AS b FROM f GROUP BY i)
SELECT (SELECT count(*) FROM m) AS n_clusters, round((SELECT sum(m.n * ((mx - gx) ** 2 + (my - gy) ** 2)) FROM m, g) / ((SELECT count(*) FROM m) - 1) / ((SELECT sum(w) FROM d) / ((SELECT n FROM g) - (SELECT count(*) FROM m))), 6) AS calinski_harabasz,
 round((SELECT avg(worst) FROM b), 6) AS davies_bouldin, round((SELECT avg(coalesce((b - a) / greatest(a, b), 0)) FROM q), 6) AS silhouette""")
def _(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xy")])
    return _pick(stats.cluster_scores(e, ["x", "y"], "label"), ["n_clusters", "calinski_harabasz", "davies_bouldin", "silhouette"], [])


_GAPS = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) ** 2))"


@query("cluster_scores_all_components", f"""WITH p AS (SELECT vec_id AS i, label AS c, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
l AS (SELECT i, c, unnest(v) AS x, unnest(range(64)) AS j FROM p), mj AS (SELECT c, j, avg(x) AS x FROM l GROUP BY c, j), m AS (SELECT c, list(x ORDER BY j) AS m FROM mj GROUP BY c), size AS (SELECT c, count(*) AS n FROM p GROUP BY c),
gj AS (SELECT j, avg(x) AS x FROM l GROUP BY j), g AS (SELECT list(x ORDER BY j) AS m FROM gj), d AS (SELECT p.c, avg(sqrt({_GAPS.format("p.v", "m.m")})) AS s, sum({_GAPS.format("p.v", "m.m")}) AS w FROM p JOIN m USING (c) GROUP BY p.c),
b AS (SELECT a.c, max((da.s + db.s) / sqrt({_GAPS.format("a.m", "b.m")})) AS worst FROM m a JOIN m b ON a.c <> b.c JOIN d da ON da.c = a.c JOIN d db ON db.c = b.c GROUP BY a.c),
f AS (SELECT u.i, u.c, w.c AS o, avg({_GAPS.format("u.v", "w.v")}) AS far FROM p u JOIN p w ON u.i <> w.i GROUP BY ALL), q AS (SELECT i, max(far) FILTER (c = o) AS a, min(far) FILTER (c <> o) AS b FROM f GROUP BY i)
SELECT (SELECT count(*) FROM m) AS n_clusters, round((SELECT sum(size.n * {_GAPS.format("m.m", "g.m")}) FROM m JOIN size USING (c), g) / ((SELECT count(*) FROM m) - 1) / ((SELECT sum(w) FROM d) / ((SELECT count(*) FROM p) - (SELECT count(*) FROM m))), 6) AS calinski_harabasz,
 round((SELECT avg(worst) FROM b), 6) AS davies_bouldin, round((SELECT avg(coalesce((b - a) / greatest(a, b), 0)) FROM q), 6) AS silhouette""")
def _(s, d):
    names = [f"x{i}" for i in range(64)]
    e = s.read.parquet(f"{d}/embeddings.parquet").where("size(embedding) = 64").select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)])
    return _pick(stats.cluster_scores(e, names, "label"), ["n_clusters", "calinski_harabasz", "davies_bouldin", "silhouette"], [])


@query("walk_forward_folds", _TB + """, o AS (SELECT series, bar_id, t1, row_number() OVER (PARTITION BY series ORDER BY bar_id) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM lab), k AS (SELECT *, greatest(n // 5, 1) AS size FROM o), c AS (SELECT *, fold * size AS a, CASE WHEN fold = 4 THEN n ELSE (fold + 1) * size END AS z FROM k, (SELECT unnest(range(5)) AS fold) f),
r AS (SELECT *, CASE WHEN i >= a AND i < z THEN 'validation' WHEN i < a - floor((z - a) * 0.1) THEN 'train' END AS role FROM c), u AS (SELECT *, min(CASE WHEN role = 'validation' THEN bar_id END) OVER (PARTITION BY series, fold) AS b FROM r WHERE role IS NOT NULL),
g AS (SELECT *, count(*) FILTER (role = 'train') OVER (PARTITION BY series, fold) AS t FROM u WHERE role = 'validation' OR t1 < b) SELECT CAST(fold AS INT) AS fold, role, series, bar_id FROM g WHERE t >= 20""")
def _(s, d):
    return evaluation.folds(_labelled(s, d), 5, 0.1, 20)


_CHAIN = f"""{TICKS}, a AS (SELECT *, price * amount AS v FROM ticks WHERE amount >= 1e-10), m AS (SELECT *, CASE WHEN count(v) OVER w >= 100 THEN quantile_cont(v, 0.5) OVER w END AS m FROM a WINDOW w AS (PARTITION BY series ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, abs(v - m) AS dev FROM m), c AS (SELECT *, CASE WHEN count(dev) OVER w >= 100 THEN quantile_cont(dev, 0.5) OVER w END AS mad FROM b WINDOW w AS (PARTITION BY series ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT * FROM c WHERE mad IS NULL OR mad = 0 OR dev <= 3 * 1.4826 * mad)"""


@query("clean_chain", f"WITH {_CHAIN} SELECT series, seq FROM kept")
def _(s, d):
    return cleaning.clean(_ticks(s, d), value_threshold=3.0)[-1][1].select("series", "seq")


@query("outlier_report", f"WITH {_CHAIN}, n AS (SELECT (SELECT count(*) FROM ticks) AS t, (SELECT count(*) FROM a) AS u, (SELECT count(*) FROM kept) AS k) SELECT 0 AS step, 'all' AS stage, t AS n, 0 AS removed FROM n UNION ALL SELECT 1, 'numbers', t, 0 FROM n UNION ALL SELECT 2, 'repeats', t, 0 FROM n UNION ALL SELECT 3, 'dust', u, t - u FROM n UNION ALL SELECT 4, 'dollar_value', k, u - k FROM n")
def _(s, d):
    return cleaning.outlier_report(cleaning.clean(_ticks(s, d), value_threshold=3.0))


@query("drop_first_incomplete", f"WITH {BARS} SELECT series, bar_id FROM bars WHERE rn >= 20")
def _(s, d):
    df = features.moving_averages(_bars(s, d), (20,), ())
    return cleaning.drop_first_incomplete(df, ["ma_20", "log_return"]).select(*KEY)


@query("bar_thresholds", f"WITH {TICKS}, t AS (SELECT series, sum(price * amount) / 20 AS v FROM ticks GROUP BY series) SELECT series, round(v, 4) AS threshold, round(v * 0.5, 4) AS least, round(v * 2, 4) AS most FROM t")
def _(s, d):
    from ..operators import bars as B

    return B.bounds_for(_ticks(s, d), 20).select("series", *[F.round(c, 4).alias(c) for c in ("threshold", "least", "most")])


@query("instrument_ids", "SELECT DISTINCT c_mktsegment AS symbol, CAST(CAST(concat('0x', substr(md5(c_mktsegment || 'x'), 1, 16)) AS UBIGINT) AS VARCHAR) AS id FROM customer")
def _(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("symbol")).distinct()
    return c.withColumn("id", tape.instrument_id(F.col("symbol"), "x").cast("string"))


_SQL_EWM = f"""WITH {BARS}, p AS (SELECT a.series, a.bar_id, b.log_return AS r, pow(99.0 / 101, a.rn - b.rn) AS w FROM bars a JOIN bars b ON a.series = b.series AND b.rn <= a.rn WHERE b.log_return IS NOT NULL), m AS (SELECT series, bar_id, sum(w * r) / sum(w) AS mu, sum(w) AS w1, sum(w * w) AS w2, count(*) AS n FROM p GROUP BY ALL),
v AS (SELECT p.series, p.bar_id, sum(p.w * (p.r - m.mu) ** 2) AS s, any_value(w1) AS w1, any_value(w2) AS w2, any_value(n) AS n FROM p JOIN m USING (series, bar_id) GROUP BY ALL)
SELECT bars.series, bars.bar_id, round(CASE WHEN n >= 10 THEN sqrt(s / w1 * w1 * w1 / (w1 * w1 - w2)) END, 6) AS vol FROM bars LEFT JOIN v USING (series, bar_id)"""


@query("ewm_volatility", _SQL_EWM)
def _(s, d):
    return _pick(labels.ewm_volatility(_bars(s, d)), ["vol"])


@query("vif_pair", f"WITH {BARS}, c AS (SELECT corr(v_buy, v_sell) AS r FROM bars) SELECT f AS feature, round(1 / (1 - r * r), 4) AS vif FROM c, (VALUES ('v_buy'), ('v_sell')) t(f)")
def _(s, d):
    return stats.vif(_bars(s, d), ["v_buy", "v_sell"]).select("feature", F.round("vif", 4).alias("vif"))


@query("collinear_to_drop", f"""WITH {BARS}, c AS (SELECT corr(open, high) AS r FROM bars), v AS (SELECT 1 / (1 - r * r) AS v, r FROM c) SELECT 'high' AS feature FROM v WHERE abs(r) > 0.5 OR v > 10 UNION SELECT 'open' FROM v WHERE v > 10""")
def _(s, d):
    b, c = _bars(s, d), ["open", "high"]
    vif = stats.vif(b, c).withColumn("vif", F.round("vif", 4))
    return stats.collinear_to_drop(stats.correlations(b, c), vif, 0.5)


@query("shapiro_wilk")
def _(s, d):
    return _pick(normality.shapiro_wilk(_bars(s, d), "log_return"), ["n", "tested", "w", "p"], ["series"])
