"""Statistics of features: correlation, collinearity, autocorrelation, normality, trend, stability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import correlation, over
from ..functions.lineage import cut


def pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of every pair of columns, from one aggregate."""
    flat = df.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs(columns)])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs(columns)])).alias("x")).select("x.*")


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Average ranks of each column; nulls have none.

    Counts by value come first, so a run of equal values is one row. Values are dealt to ranges; a range's rows count from the sum of
    the ranges before it, so no task sees all values.
    """
    for c in columns:
        n = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__n"))
        dealt = cut(n.repartitionByRange("__v").withColumn("__p", F.spark_partition_id()))
        sums = dealt.groupBy("__p").agg(F.sum("__n").alias("__s"))
        before = sums.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__before"))  # one row a range
        own = F.sum("__n").over(Window.partitionBy("__p").orderBy("__v"))
        ranks = dealt.join(F.broadcast(before), "__p").select("__v", (F.col("__before") + own - (F.col("__n") - 1) / 2).alias(f"{c}_rank"))
        df = df.join(ranks, df[c] == ranks["__v"], "left").drop("__v")
    return df


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    rows = average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b), [a, b])
    return rows.agg(correlation(f"{a}_rank", f"{b}_rank").alias("spearman"))


def f_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """r squared over (1 - r squared), times n - 2; null for a constant column or r of 1 or -1."""
    n = F.count("*")
    flat = df.dropna(subset=[*columns, target]).agg(n.alias("n"), *[correlation(c, target).alias(c) for c in columns])
    rows = flat.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in columns])).alias("x")).select("x.feature", "x.r", "n")
    return rows.select("feature", "r", (over(F.col("r") ** 2, 1 - F.col("r") ** 2) * (F.col("n") - 2)).alias("f_score"))


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix, which has the columns' number squared entries, whatever the rows.

    A constant column, or any without rows, has none (null) and is left out for the others. Runs jobs while the plan is built.
    """
    whole = df.dropna(subset=columns)
    spread = whole.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    some = [c for c in columns if spread[c]]
    got = {(r["a"], r["b"]): r["corr"] for r in correlations(whole, some).collect()} if len(some) > 1 else {}
    m = np.array([[1.0 if a == b else got.get((a, b), got.get((b, a))) for b in some] for a in some], float)
    values = dict(zip(some, np.diag(np.linalg.pinv(m + 1e-8 * np.eye(len(some)))).tolist())) if some else {}
    return df.sparkSession.createDataFrame([(c, values.get(c)) for c in columns], "feature string, vif double")


def autocorrelation(df: DataFrame, column: str, most: int = 10, by: str = "bar_id") -> DataFrame:
    """(series, lag, acf): biased, around the whole mean; null for a constant series."""
    whole = df.where(F.col(column).isNotNull()).withColumn("__d", F.col(column) - F.avg(column).over(Window.partitionBy("series")))
    w = Window.partitionBy("series").orderBy(by)
    rows = whole.withColumns({f"__{k}": F.col("__d") * F.lag("__d", k).over(w) for k in range(1, most + 1)})
    sums = rows.groupBy("series").agg(F.sum(F.col("__d") ** 2).alias("s"), *[F.sum(f"__{k}").alias(str(k)) for k in range(1, most + 1)])
    return sums.select("series", F.posexplode(F.array(*[over(F.col(f"`{k}`"), F.col("s")) for k in range(1, most + 1)])).alias("i", "acf")).select("series", (F.col("i") + 1).alias("lag"), "acf")


def ljung_box(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    n = df.where(F.col(column).isNotNull()).groupBy("series").agg(F.count("*").alias("n"))
    return autocorrelation(df, column, most).join(n, "series").groupBy("series").agg((F.first("n") * (F.first("n") + 2) * F.sum(over(F.col("acf") ** 2, F.col("n") - F.col("lag")))).alias("q"))


def jarque_bera(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("series").agg((F.count(column) / 6 * (F.skewness(column) ** 2 + F.kurtosis(column) ** 2 / 4)).alias("jb"))


def rises_and_falls(rows: DataFrame, sums: dict[str, str] | None = None) -> DataFrame:
    """Of ``rows(series, i, r, ...)``, r a rank from 0: for each row and bit of r the rows of the series before it (less i) that part from r at that bit.

    Two ranks differ first at one bit: under equal higher bits, the larger has a 1 there and the smaller a 0. So each pair with different i and r is counted
    once, from running sums over groups of equal higher bits; there are n log n rows and no pairs. Adds ``up`` (1 if the rows before
    are the smaller ones), ``met``, their number, and for each (name, column) of ``sums`` the column's sum over them.
    """
    top = rows.agg(F.max("r")).first()[0]
    bits = max(int(top or 0).bit_length(), 1)
    each = rows.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).withColumn("__bit", F.expr("shiftright(r, __b) & 1"))
    each = each.withColumn("__g", F.expr("shiftright(r, __b + 1)")).repartition("series", "__b", "__g")  # else a series' rows of all bits stay in its task
    w = Window.partitionBy("series", "__b", "__g").orderBy("i").rangeBetween(Window.unboundedPreceding, -1)
    other = lambda c: F.coalesce(F.when(F.col("__bit") == 1, F.sum(F.when(F.col("__bit") == 0, c)).over(w)).otherwise(F.sum(F.when(F.col("__bit") == 1, c)).over(w)), F.lit(0))
    return each.withColumns({"up": F.col("__bit"), "met": other(F.lit(1))} | {k: other(F.col(c)) for k, c in (sums or {}).items()}).drop("__b", "__bit", "__g")


def dense_rank(by: str):
    return F.dense_rank().over(Window.partitionBy("series").orderBy(by)) - 1


def mann_kendall(df: DataFrame, column: str, by: str = "bar_id") -> DataFrame:
    """S: concordant less discordant pairs in time, counted without making pairs; nulls take no part."""
    rows = df.where(F.col(column).isNotNull()).select("series", F.col(by).cast("long").alias("i"), F.col(column).alias("x"))
    met = rises_and_falls(rows.select("series", "i", dense_rank("x").alias("r")))
    return met.groupBy("series").agg(F.sum(F.when(F.col("up") == 1, F.col("met")).otherwise(-F.col("met"))).cast("long").alias("s"))


def rolling_correlation(df: DataFrame, a: str, b: str, k: int = 50, by: str = "bar_id") -> DataFrame:
    w = Window.partitionBy("series").orderBy(by).rowsBetween(-(k - 1), 0)
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)
    return df.withColumn(f"corr_w{k}", F.when(F.count(both).over(w) >= k, F.coalesce(F.nanvl(correlation(a, b, w), F.lit(0.0)), F.lit(0.0))))


def stability(df: DataFrame, column: str, periods: int = 10, by: str = "bar_id") -> DataFrame:
    """Means and deviations over equal slices of each series; the last takes the remainder."""
    w = Window.partitionBy("series")
    rows = df.withColumns({"__n": F.count("*").over(w), "__i": F.row_number().over(w.orderBy(by)) - 1})
    period = F.least(F.floor(F.col("__i") / F.greatest(F.floor(F.col("__n") / periods), F.lit(1))), F.lit(periods - 1))
    return rows.groupBy("series", period.alias("period")).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))


def quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: share of nulls, constant or not, largest absolute z."""
    flat = df.agg(*[F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).isNull().cast("double")).alias("null_share"), (F.coalesce(F.var_samp(c), F.lit(0.0)) == 0).alias("constant"), over(F.greatest(F.max(c) - F.avg(c), F.avg(c) - F.min(c)), F.stddev_samp(c)).alias("max_z")).alias(c) for c in columns])
    return flat.select(F.explode(F.array(*columns)).alias("x")).select("x.*")


def linear_trend(df: DataFrame, column: str, by: str = "bar_id") -> DataFrame:
    """Per series the regression on row numbers from 0 (slope, intercept, r_squared, std_error), and means and deviations of its two halves."""
    w = Window.partitionBy("series")
    rows = df.where(F.col(column).isNotNull()).select("series", F.col(column).cast("double").alias("y"), (F.row_number().over(w.orderBy(by)) - 1).cast("double").alias("x"), F.count("*").over(w).alias("n"))
    half = lambda first: F.when((F.col("x") < F.floor(F.col("n") / 2)) == F.lit(first), F.col("y"))
    n, sx, sy, sxy = F.count("*"), F.var_pop("x"), F.var_pop("y"), F.covar_pop("x", "y")
    slope, r2 = over(sxy, sx), over(sxy * sxy, sx * sy)
    change = {"mean_first_half": F.avg(half(True)), "mean_second_half": F.avg(half(False)), "std_first_half": F.stddev_pop(half(True)), "std_second_half": F.stddev_pop(half(False))}
    fit = {"slope": slope, "intercept": F.avg("y") - slope * F.avg("x"), "r_squared": r2, "std_error": F.sqrt(over(over((1 - r2) * sy, sx), n - 2))}
    found = rows.groupBy("series").agg(*[v.alias(k) for k, v in (fit | change).items()])
    return found.withColumns({"mean_change": F.col("mean_second_half") - F.col("mean_first_half"), "std_change": F.col("std_second_half") - F.col("std_first_half")})


def vif_level(vif, high: float = 10.0, critical: float = 100.0):
    """How bad an inflation factor is."""
    return F.when(F.isnan(vif) | (F.abs(vif) == float("inf")), "infinite").when(vif > critical, "critical").when(vif > high, "high").when(vif > 5.0, "moderate").otherwise("low")


def collinear_to_drop(corr: DataFrame, vif: DataFrame, threshold: float = 0.8, most: float = 10.0) -> DataFrame:
    """(feature): of each pair of columns correlated over ``threshold`` the one with the larger inflation (of equals the second), and all over ``most``."""
    v = lambda side: vif.select(F.col("feature").alias(side), F.col("vif").alias(f"v{side}"))
    pairs = corr.where(F.abs("corr") > threshold).join(v("a"), "a", "left").join(v("b"), "b", "left")
    of_pair = pairs.select(F.when(F.coalesce("va", F.lit(0.0)) > F.coalesce("vb", F.lit(0.0)), F.col("a")).otherwise(F.col("b")).alias("feature"))
    return of_pair.union(vif.where(F.col("vif") > most).select("feature")).distinct()


def embedding_outliers(df: DataFrame, x: str, y: str, threshold: float = 3.0) -> DataFrame:
    """distance_from_center, its z_score over all rows, and is_outlier; z is null where all distances are equal."""
    c = df.agg(F.avg(x).alias("__cx"), F.avg(y).alias("__cy"))
    rows = df.join(F.broadcast(c)).withColumn("distance_from_center", F.sqrt(F.pow(F.col(x) - F.col("__cx"), 2) + F.pow(F.col(y) - F.col("__cy"), 2))).drop("__cx", "__cy")
    d = F.col("distance_from_center")
    s = rows.agg(F.avg(d).alias("__m"), F.stddev_pop(d).alias("__s"))
    return rows.join(F.broadcast(s)).withColumn("z_score", over(d - F.col("__m"), F.col("__s"))).withColumn("is_outlier", F.coalesce(F.abs("z_score") > threshold, F.lit(False))).drop("__m", "__s")


#: Clusters, by numbers of their centres, that one row of a block may hold.
BLOCK = 1 << 15


def _dot(u, v) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _against(rows: DataFrame, cells: DataFrame, width: int, best, value, name: str) -> DataFrame:
    """Rows, which have an ``__id`` and a cluster ``__c``, with ``best`` (least or greatest) of ``value(cell)`` over all other clusters' cells.

    Cells lie in arrays of a bounded size, and a row goes through an array in one expression. A single array is a table of one row; of several
    each row gets a copy an array, by an equi-join on the array's number, and its best are merged by ``__id``.
    """
    per = max(1, BLOCK // max(width, 1))
    blocks = -(-cells.count() // per)
    named = cells.withColumn("__b", F.floor((F.row_number().over(Window.orderBy("__c")) - 1) / per).cast("int"))  # one row a cluster
    packed = named.groupBy("__b").agg(F.collect_list(F.struct(*cells.columns)).alias("__cells"))
    found = best("__cells", value).alias(name)
    if blocks <= 1:
        return rows.crossJoin(F.broadcast(packed.select("__cells"))).select("*", found).drop("__cells")  # one row of at most BLOCK numbers
    copies = rows.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    merge = F.min if best is _least else F.max
    met = copies.join(packed, "__b").select("__id", found).groupBy("__id").agg(merge(name).alias(name))
    return rows.join(met, "__id", "left")


def _least(cells: str, value) -> Column:
    return F.aggregate(cells, F.lit(None).cast("double"), lambda s, c: F.least(s, value(c)))


def _greatest(cells: str, value) -> Column:
    return F.aggregate(cells, F.lit(None).cast("double"), lambda s, c: F.greatest(s, value(c)))


def cluster_scores(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(n_clusters, calinski_harabasz, davies_bouldin, silhouette) of rows with a label; null under two clusters.

    Two aggregates by cluster. The silhouette is that of squared distances, which follow from a cluster's sums, so rows never meet rows, and a row meets
    clusters in arrays of a bounded size. Rows are written once, numbered. Runs jobs while the plan is built.
    """
    rows = df.dropna(subset=[*columns, label]).select(F.col(label).alias("__c"), F.array(*[F.col(c).cast("double") for c in columns]).alias("__v"))
    rows = cut(rows.withColumn("__q", F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x)).withColumn("__id", F.monotonically_increasing_id()))
    dims = range(len(columns))
    own = cut(rows.groupBy("__c").agg(F.count("*").alias("n"), F.sum("__q").alias("q"), F.array(*[F.sum(F.get("__v", F.lit(i))) for i in dims]).alias("s")))
    cells = own.select("__c", "n", "q", "s", F.transform("s", lambda x: x / F.col("n")).alias("m"))
    near = rows.join(cells, "__c").withColumn("d", F.sqrt(F.greatest(F.col("__q") - 2 * _dot("__v", "m") + _dot("m", "m"), F.lit(0.0))))
    spread = near.groupBy("__c").agg(F.avg("d").alias("spread"), F.sum(F.col("d") ** 2).alias("within"))
    each = cut(cells.join(spread, "__c"))
    whole = each.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("within").alias("within"), F.sum("q").alias("q"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in dims]).alias("s"))

    other = lambda c, x: F.when(c["__c"] != F.col("__c"), x)
    apart = lambda c: F.sqrt(F.greatest(_dot("m", "m") - 2 * _dot("m", c["m"]) + _dot(c["m"], c["m"]), F.lit(0.0)))
    worst = _against(each.select("__c", "m", "spread", F.col("__c").alias("__id")), each.select("__c", "m", "spread"), len(columns) + 2, _greatest, lambda c: other(c, over(F.col("spread") + c["spread"], apart(c))), "w")
    db = worst.agg(F.avg("w").alias("davies_bouldin"))

    far = lambda q, n, m: F.col("__q") + q / n - 2 * _dot("__v", m)
    joined = _against(rows.join(own.select("__c", "n", "q", F.transform("s", lambda x: x / F.col("n")).alias("m")), "__c"), cells.drop("s"), len(columns) + 3, _least, lambda c: other(c, far(c["q"], c["n"], c["m"])), "b")
    a = F.when(F.col("n") > 1, far(F.col("q"), F.col("n"), F.col("m")) * F.col("n") / (F.col("n") - 1))
    mean = joined.select(a.alias("a"), "b").agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(over(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))).alias("silhouette"))

    between = F.col("q") - _dot("s", "s") / F.col("n") - F.col("within")
    ch = over(between * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))
    two = lambda x: F.when(F.col("k") >= 2, x)
    return whole.join(F.broadcast(db)).join(F.broadcast(mean)).select(F.col("k").alias("n_clusters"), two(ch).alias("calinski_harabasz"), two(F.col("davies_bouldin")).alias("davies_bouldin"), two(F.col("silhouette")).alias("silhouette"))
