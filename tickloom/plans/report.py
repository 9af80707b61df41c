"""One table of all analyses of features against a target, for feature selection.

Every row is (analysis, measure, a, b, series, value): ``a`` is a feature, ``b`` the other one, the target, a lag, or null; ``series`` is null for what all series share.
The columns needed are written once and every analysis reads them. What goes by series is done for all features in one pass, a feature of a series being a series of its own.
Jobs run while the plan is built. Rows not whole in a measure's columns take no part in it, as the operators say; a value that is not defined is null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import analysis, dependence, linkage, stats
from ..sources.tape import require


def _rows(found: DataFrame, name: str, measures: Sequence[str], a: Column, b: Column | None = None, series: Column | None = None) -> DataFrame:
    """Each measure of a row as a row."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("m")
    null = F.lit(None).cast("string")
    cells = found.select(a.cast("string").alias("a"), (null if b is None else b.cast("string")).alias("b"), (null if series is None else series.cast("string")).alias("series"), each)
    return cells.select(F.lit(name).alias("analysis"), "m.measure", "a", "b", "series", "m.value")


def _melted(df: DataFrame, features: list[str]) -> DataFrame:
    """(series, bar_id, x) with (series, feature) as the series."""
    each = F.explode(F.array(*[F.struct(F.struct("series", F.lit(c).alias("feature")).alias("series"), F.col(c).cast("double").alias("x")) for c in features])).alias("m")
    return df.select("bar_id", each).select("m.series", "bar_id", "m.x")


def relations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Pearson's correlation and mutual information of every pair, the target's too."""
    columns = [*features, target]
    a, b = F.col("a"), F.col("b")
    return _rows(stats.correlations(df, columns), "relations", ["corr"], a, b).unionByName(_rows(dependence.mutual_information_pairs(df, columns), "relations", ["mi"], a, b))


def of_target(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """How a feature tells of the target: linear, by ranks, by information, the score of what isn't linear, and F."""
    a, b = F.col("feature"), F.lit(target)
    found = _rows(dependence.nonlinearity(df, features, target), "target", ["pearson", "spearman", "mi", "score"], a, b)
    return found.unionByName(_rows(stats.f_scores(df, features, target), "target", ["f_score"], a, b))


def collinearity(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Variance inflation of each feature among the others."""
    return _rows(stats.vif(df, features), "collinearity", ["vif"], F.col("feature"))


def components(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Eigenvalues of the features' correlations, their shares and condition indices; ``a`` is the component's number."""
    return _rows(analysis.eigenvalues(df, features), "components", ["eigenvalue", "share", "cumulative", "condition_index"], F.col("component"))


def in_time(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Autocorrelations, ``b`` the lag, and the KPSS statistic."""
    long = _melted(df, features)
    a, series = F.col("series.feature"), F.col("series.series")
    return _rows(stats.autocorrelation(long, "x"), "time", ["acf"], a, F.col("lag"), series).unionByName(_rows(analysis.kpss(long, "x"), "time", ["kpss"], a, None, series))


def stationarity(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """The Dickey-Fuller statistic, the number of lags chosen, its critical value, and 1 where it calls the series stationary."""
    found = analysis.adf(_melted(df, features), "x", choose=True).withColumn("stationary", F.col("stationary").cast("double"))
    return _rows(found, "stationarity", ["statistic", "lags", "critical", "stationary"], F.col("series.feature"), None, F.col("series.series"))


def groups(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """The group of each feature in the cut of the tree with the best silhouette, and the feature's own silhouette; one group for fewer than three features."""
    best = linkage.numbers_of_groups(df, features).where("best").first() if len(features) > 2 else None
    return _rows(linkage.cut_tree(df, features, k=best["k"] if best else 1), "groups", ["cluster", "silhouette"], F.col("feature"))


Section = Callable[[DataFrame, list[str], str], DataFrame]
SECTIONS: tuple[Section, ...] = (relations, of_target, collinearity, components, in_time, stationarity, groups)


def report(bars: DataFrame, features: list[str], target: str, sections: Sequence[Section] = SECTIONS) -> DataFrame:
    """All sections' rows. Features are named once each and the target is none of them."""
    if not features or len(set(features)) < len(features) or target in features:
        raise ValueError("name each feature once, at least one, and the target apart")
    rows = cut(require(bars, ["series", "bar_id", *features, target]).select("series", "bar_id", *features, target))
    return reduce(DataFrame.unionByName, [s(rows, features, target) for s in sections])


def ranking(found: DataFrame) -> DataFrame:
    """(feature, score, f_score, vif, place): features of a report by what they tell of the target, the larger of the sizes of both correlations, plus what the score adds; equals by name."""
    wide = found.where("analysis in ('target', 'collinearity')").groupBy(F.col("a").alias("feature")).agg(*[F.max(F.when(F.col("measure") == m, F.col("value"))).alias(m) for m in ("pearson", "spearman", "score", "f_score", "vif")])
    score = F.greatest(F.abs("pearson"), F.abs("spearman")) + F.coalesce("score", F.lit(0.0))
    ranked = wide.select("feature", score.alias("score"), "f_score", "vif")
    higher = ranked.select(F.collect_list(F.struct("feature", "score")).alias("all"))  # one entry a feature
    before = F.size(F.filter("all", lambda o: F.coalesce(o["score"], F.lit(-1.0)) > F.coalesce(F.col("score"), F.lit(-1.0)))) + F.size(F.filter("all", lambda o: F.coalesce(o["score"], F.lit(-1.0)).eqNullSafe(F.coalesce(F.col("score"), F.lit(-1.0))) & (o["feature"] < F.col("feature"))))
    return ranked.crossJoin(F.broadcast(higher)).select("feature", "score", "f_score", "vif", (before + 1).alias("place"))
