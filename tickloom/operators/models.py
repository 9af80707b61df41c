"""Classifiers fitted on training rows, and predictions out of fold. Ridge solves sums of products; trees are Spark ML's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import finite
from ..functions.lineage import cut


@dataclass(frozen=True)
class Ridge:
    """One score a class, linear in the features; the class with the largest is the prediction, the first on ties."""

    features: list[str]
    classes: list
    weights: list[list[float]]
    bias: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction, and proba, the softmax of scores in the order of ``classes``. Null and infinite features count as their training mean."""
        score = F.array(*[sum((F.coalesce(finite(F.col(f).cast("double")), F.lit(0.0)) * w for f, w in zip(self.features, row)), F.lit(b)) for row, b in zip(self.weights, self.bias)])
        rows = df.withColumn("__s", score)
        best = F.array_position("__s", F.array_max("__s")).cast("int")
        raised = F.transform("__s", lambda s: F.exp(s - F.array_max("__s")))
        total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
        return rows.withColumns({"prediction": F.element_at(F.array(*map(F.lit, self.classes)), best), "proba": F.transform(raised, lambda x: x / total)}).drop("__s")


def ridge(train: DataFrame, features: list[str], label: str = "label", alpha: float = 1.0) -> Ridge:
    """Least squares with penalty ``alpha`` on standardised features against +1 and -1 for each class.

    One aggregate gives all sums; the driver solves a system of as many unknowns as features. Rows with a null or an infinity are left out.
    """
    rows = train.withColumns({f: finite(F.col(f).cast("double")) for f in features}).dropna(subset=[*features, label])
    classes = sorted(r[0] for r in rows.select(label).distinct().collect())
    if not classes:
        raise ValueError("no complete training rows")
    x = [F.col(f).cast("double") for f in features]
    y = [F.when(F.col(label) == c, 1.0).otherwise(-1.0) for c in classes]
    n = len(features)
    got = rows.agg(F.array(*[F.avg(a) for a in x]).alias("m"), F.array(*[F.stddev_pop(a) for a in x]).alias("s"), F.array(*[F.covar_pop(a, b) for a in x for b in x]).alias("xx"), F.array(*[F.avg(t) for t in y]).alias("my"), F.array(*[F.covar_pop(a, t) for t in y for a in x]).alias("xy"), F.count("*").alias("n")).first()
    std = np.array([s if s and s > 0 else 1.0 for s in got["s"]])
    xx = np.array(got["xx"]).reshape(n, n) / np.outer(std, std) * got["n"]
    xy = np.array(got["xy"]).reshape(len(classes), n) / std * got["n"]
    w = np.linalg.solve(xx + alpha * np.eye(n), xy.T).T / std
    return Ridge(list(features), classes, w.tolist(), (np.array(got["my"]) - w @ np.array(got["m"])).tolist())


def trees(train: DataFrame, features: list[str], label: str = "label", boosted: bool = False, **params):
    """A Spark ML pipeline model whose ``transform`` adds prediction: a random forest, or boosted trees, one against the rest. Null and infinite features count as 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler

    filled = SQLTransformer(statement="SELECT *, " + ", ".join(f"CASE WHEN abs(CAST(`{f}` AS DOUBLE)) < CAST('inf' AS DOUBLE) THEN CAST(`{f}` AS DOUBLE) ELSE 0D END AS `__{f}`" for f in features) + " FROM __THIS__")
    index = StringIndexer(inputCol=label, outputCol="__label", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    known = index.labels
    where = {"featuresCol": "__features", "labelCol": "__label", "predictionCol": "__p"}
    kind = OneVsRest(classifier=GBTClassifier(seed=42, **params), **where) if boosted else RandomForestClassifier(seed=42, **where, **params)
    parts = [filled, index, VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol="__features"), kind, IndexToString(inputCol="__p", outputCol="prediction", labels=[*known, "unknown"])]
    return Pipeline(stages=parts).fit(train.where(F.col(label).isNotNull()))


def out_of_fold(df: DataFrame, fit: Callable[[DataFrame], object], folds: int = 5, embargo: int = 0, end: str | None = None, label: str = "label", by: str = "bar_id") -> DataFrame:
    """Predictions of walk-forward folds: each of ``folds`` slices of every series is told by a model of the rows before it.

    ``fit`` takes training rows and gives something with ``transform``. ``embargo`` rows before a slice, and rows whose ``end``
    reaches it, are left out. Adds fold, prediction and coverage; rows before the first slice (fold 0), and slices with no rows to
    learn from, get a null prediction and coverage 0. The rows are written once, and all folds read them. Runs jobs while the plan is built.
    """
    w = Window.partitionBy("series")
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(by)) - 1, "__n": F.count("*").over(w)})
    size = F.greatest(F.floor(F.col("__n") / (folds + 1)), F.lit(1))
    rows = cut(rows.withColumn("fold", F.least(F.floor(F.col("__i") / size), F.lit(folds)).cast("int")))
    starts = cut(rows.where("fold > 0").groupBy("series", "fold").agg(F.min("__i").alias("__start"), F.min(by).alias("__first")))  # a row a series and fold
    parts, bare = [], [0]
    for k in range(1, folds + 1):
        fold = starts.where(F.col("fold") == k).select(F.col("series").alias("__series"), "__start", "__first")
        marked = rows.where(F.col("fold") < k).join(fold, F.col("series").eqNullSafe(F.col("__series"))).drop("__series")
        train = marked.where(F.col("__i") < F.col("__start") - embargo)
        if end is not None:
            train = train.where(F.col(end) < F.col("__first"))
        if train.isEmpty():
            bare.append(k)
        else:
            parts.append(fit(train).transform(rows.where(F.col("fold") == k)).select(*df.columns, "fold", "prediction").withColumn("coverage", F.lit(1)))
    kind = dict((parts[0] if parts else df).dtypes)["prediction" if parts else label]
    out = rows.where(F.col("fold").isin(bare)).select(*df.columns, "fold").withColumns({"prediction": F.lit(None).cast(kind), "coverage": F.lit(0)})
    for p in parts:
        out = out.unionByName(p)
    return out


def meta_rows(told: DataFrame, label: str = "label") -> DataFrame:
    """Covered rows with a direction predicted; meta_label: 1 if it came true."""
    return told.where("coverage = 1 and prediction <> 0").withColumn("meta_label", (F.col("prediction") == F.col(label)).cast("int"))


def meta_features(told: DataFrame, features: list[str], label: str = "label", directional: bool = True) -> DataFrame:
    """Covered rows (with a direction predicted, unless ``directional`` is off) with meta_label, 1 if the prediction came true; nulls and NaN of the features take the median of these rows, 0 without one."""
    rows = told.where("coverage = 1" + (" and prediction <> 0" if directional else "")).withColumn("meta_label", (F.col("prediction") == F.col(label)).cast("int"))
    clean = rows.withColumns({f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features})
    middle = clean.agg(*[F.percentile(f, 0.5).alias(f) for f in features]).first()
    return clean.fillna({f: float(middle[f]) if middle[f] is not None else 0.0 for f in features})


def train_meta(rows: DataFrame, features: list[str], fit: Callable[[DataFrame], object]) -> tuple[object, DataFrame]:
    """A model of meta_label from the rows of ``meta_features``, and its metrics on them. ``fit`` gives something with ``transform``; where that adds proba in the order of the classes, its last is the score."""
    from .evaluation import binary_metrics

    model = fit(rows)
    told = model.transform(rows)
    score = None
    if "proba" in told.columns:
        told, score = told.withColumn("__score", F.element_at("proba", -1)), "__score"
    return model, binary_metrics(told, "meta_label", "prediction", score)
