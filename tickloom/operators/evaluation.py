"""Walk-forward folds, classification metrics, baselines and a back-test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import correlation, logarithm, over
from .stats import average_ranks


def walk_forward(n: int, folds: int = 5, embargo: int = 0, least: int = 1) -> list[tuple[range, range]]:
    """Expanding train and the slice after it; ``embargo`` rows before a validation slice are left out."""
    size = n // (folds + 1)
    out = []
    for k in range(1, folds + 1):
        train, stop = range(0, max(0, k * size - embargo)), n if k == folds else (k + 1) * size
        if len(train) >= least and size:
            out.append((train, range(k * size, stop)))
    return out


def folds(df: DataFrame, n_splits: int = 5, embargo: float = 0.01, least: int = 50, end: str | None = "t1", by: str = "bar_id") -> DataFrame:
    """(fold, role, series, ``by``): walk-forward folds of each series; validation slice k after all rows before it as training, less the last ``embargo`` of a slice's
    length and less events that end in it or later (unless none would be left). Folds with under ``least`` training rows go."""
    w = Window.partitionBy("series")
    keep = ["series", by, *([end] if end else [])]
    rows = df.select(*keep, (F.row_number().over(w.orderBy(by)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    size = F.greatest(F.floor(F.col("n") / n_splits), F.lit(1))
    rows = rows.withColumn("size", size).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("fold") * F.col("size")
    stop = F.when(F.col("fold") == n_splits - 1, F.col("n")).otherwise(start + F.col("size"))
    gap = F.floor((stop - start) * embargo)
    role = F.when((F.col("i") >= start) & (F.col("i") < stop), "validation").when(F.col("i") < start - gap, "train")
    rows = rows.withColumn("role", role).where("role is not null")
    group = Window.partitionBy("series", "fold")
    if end:
        begins = F.min(F.when(F.col("role") == "validation", F.col(by))).over(group)
        rows = rows.withColumn("late", (F.col("role") == "train") & F.coalesce(F.col(end) >= begins, F.lit(False)))
        left = F.count(F.when((F.col("role") == "train") & ~F.col("late"), 1)).over(group)
        rows = rows.withColumn("late", F.col("late") & (left > 0)).where("not late")
    train = F.count(F.when(F.col("role") == "train", 1)).over(group)
    held = F.count(F.when(F.col("role") == "validation", 1)).over(group)
    return rows.withColumns({"__t": train, "__h": held}).where((F.col("__t") >= least) & (F.col("__h") > 0)).select("fold", "role", "series", by)


def residuals(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.withColumn("residual", F.col(truth) - F.col(guess))


def purge(train: DataFrame, validation_start, end: str = "t1") -> DataFrame:
    """Training events that end before the validation begins."""
    return train.where(F.col(end) < F.lit(validation_start))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def _by_class(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, real, said, hits) over rows with both."""
    cells = confusion(df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()), truth, guess)
    sides = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said")))).alias("x"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hits"))
    return sides.groupBy("x.label").agg(F.sum("x.real").alias("real"), F.sum("x.said").alias("said"), F.sum(F.when(F.col("x.real") > 0, F.col("hits")).otherwise(0)).alias("hits"))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def class_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 of each class; 0 where undefined."""
    return _by_class(df, truth, guess).select("label", _ratio(F.col("hits"), F.col("said")).alias("precision"), _ratio(F.col("hits"), F.col("real")).alias("recall"), _ratio(2 * F.col("hits"), F.col("real") + F.col("said")).alias("f1"), "real")


def summary(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted precision, recall and F1, Cohen's kappa and Matthews correlation for any number of classes."""
    rows = _by_class(df, truth, guess).select("*", _ratio(F.col("hits"), F.col("said")).alias("p"), _ratio(F.col("hits"), F.col("real")).alias("r"), _ratio(2 * F.col("hits"), F.col("real") + F.col("said")).alias("f"))
    n, c, both = F.sum("real"), F.sum("hits"), F.sum(F.col("real") * F.col("said"))
    spread = F.sqrt((n * n - F.sum(F.col("said") ** 2)) * (n * n - F.sum(F.col("real") ** 2)))
    named = {"accuracy": c / n, "balanced_accuracy": F.avg(F.when(F.col("real") > 0, F.col("r")))}
    for k, x in (("precision", "p"), ("recall", "r"), ("f1", "f")):
        named |= {f"{k}_macro": F.avg(x), f"{k}_weighted": F.sum(F.col(x) * F.col("real")) / n}
    named |= {"kappa": F.when(both < n * n, (c / n - both / (n * n)) / (1 - both / (n * n))), "mcc": F.when(spread > 0, (c * n - both) / spread).otherwise(0.0)}
    return rows.agg(*[v.alias(k) for k, v in named.items()])


def composite_score(df: DataFrame, truth: str, guess: str, direction: float = 0.45, neutral: float = 0.20, worst: float = 0.25, sign: float = 0.20) -> DataFrame:
    """Of labels -1, 0 and 1: weighted F1 of the directions, of 0 and of the worst class, less the share of rows with opposite signs."""
    f = class_metrics(df, truth, guess)
    one = lambda k: F.coalesce(F.max(F.when(F.col("label") == k, F.col("f1"))), F.lit(0.0))
    scores = f.agg(one(-1).alias("f1_down"), one(0).alias("f1_flat"), one(1).alias("f1_up"))
    wrong = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).agg(F.coalesce(F.avg((F.col(truth) * F.col(guess) < 0).cast("double")), F.lit(0.0)).alias("sign_error_rate"))
    down, flat, up = (F.col(f"f1_{k}") for k in ("down", "flat", "up"))
    return scores.join(wrong).withColumn("composite_score", direction * (down + up) / 2 + neutral * flat + worst * F.least(down, flat, up) - sign * F.col("sign_error_rate"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows over the number of classes times a class's rows."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # one row a class
    return n.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))


def accuracy(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy and Matthews correlation of 0/1 columns."""
    return df.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"), correlation(truth, guess).alias("mcc"))


def sign_errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.where((F.col(truth) != 0) & (F.col(guess) != 0)).agg(F.avg((F.col(truth) * F.col(guess) < 0).cast("double")).alias("sign_error"))


def persistence(df: DataFrame, label: str = "label", by: str = "bar_id") -> DataFrame:
    return df.withColumn("prediction", F.lag(label).over(Window.partitionBy("series").orderBy(by)))


def transitions(df: DataFrame, label: str = "label", by: str = "bar_id") -> DataFrame:
    """First-order transition frequencies."""
    rows = df.withColumn("before", F.lag(label).over(Window.partitionBy("series").orderBy(by))).where("before is not null")
    n = rows.groupBy("before", F.col(label).alias("after")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def backtest(df: DataFrame, position: str, capital: float = 10_000.0, cost: float = 0.01, by: str = "bar_id") -> DataFrame:
    """Capital after each row: a running product of 1 + return * position - cost * |return * position|, by sums of logarithms."""
    gain = F.coalesce(F.col("log_return"), F.lit(0.0)) * F.col(position)
    step = logarithm(1 + gain - cost * F.abs(gain))
    w = Window.partitionBy("series").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"net": gain - cost * F.abs(gain), "capital": capital * F.exp(F.sum(step).over(w))})


def trading_summary(df: DataFrame, position: str, capital: float = 10_000.0, cost: float = 0.01, per_year: float = 12_500.0, by: str = "bar_id") -> DataFrame:
    """Per series the compounded trades (rows with a position): counts, win rate, profits, costs, Sharpe, deepest drawdown and its share of the peak, profit factor."""
    w = Window.partitionBy("series").orderBy(by)
    rows = backtest(df, position, capital, cost, by).withColumn("before", F.coalesce(F.lag("capital").over(w), F.lit(capital)))
    gain = F.coalesce(F.col("log_return"), F.lit(0.0)) * F.col(position)
    peak = F.greatest(F.max("capital").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(capital))
    rows = rows.withColumns({"peak": peak, "gross": F.col("before") * gain, "trade": F.col("before") * F.col("net"), "own": F.col("net"), "held": F.col(position) != 0}).withColumn("dd", F.col("peak") - F.col("capital"))
    held = lambda x: F.when(F.col("held"), x)
    win, loss = F.sum(held(F.greatest("trade", F.lit(0.0)))), -F.sum(held(F.least("trade", F.lit(0.0))))
    deepest = F.max(F.struct("dd", (-F.col(by)).alias("i"), "peak"))
    n, sd = F.count(held(F.lit(1))), F.stddev_samp(held(F.col("own")))
    return rows.groupBy("series").agg(n.alias("n_trades"), F.count(F.when(F.col("held") & (F.col("trade") > 0), 1)).alias("n_profitable"), F.coalesce(F.avg(held((F.col("trade") > 0).cast("double"))), F.lit(0.0)).alias("win_rate"), F.sum(held(F.col("gross"))).alias("gross_pnl"), F.sum(held(F.col("trade"))).alias("net_pnl"), F.sum(held(F.abs("gross") * cost)).alias("total_costs"), F.when(sd > 0, F.avg(held(F.col("own"))) / sd * per_year**0.5).alias("sharpe"), deepest["dd"].alias("max_drawdown"), (100 * over(deepest["dd"], deepest["peak"])).alias("max_drawdown_pct"), F.when(loss > 0, win / loss).alias("profit_factor"))


def markov(train: DataFrame, df: DataFrame, label: str = "label", by: str = "bar_id") -> DataFrame:
    """prediction: the likeliest class after the label before, as seen in ``train``; ties and unseen labels give the least class."""
    n = transitions(train, label, by)
    best = n.groupBy("before").agg(F.min_by("after", F.struct(-F.col("n"), F.col("after"))).alias("__best"))
    least = train.agg(F.min(label).alias("__least"))
    rows = df.withColumn("__before", F.lag(label).over(Window.partitionBy("series").orderBy(by)))
    return rows.join(best, rows["__before"] == best["before"], "left").join(least).withColumn("prediction", F.coalesce("__best", "__least")).drop("before", "__before", "__best", "__least")


def markov_path(train: DataFrame, df: DataFrame, label: str = "label", by: str = "bar_id") -> DataFrame:
    """prediction: the likeliest class after the last training label of the series, then the likeliest after that prediction, and so on, no label of ``df`` being used.

    The likeliest classes run into a cycle, so the path is looked up by the row's number, not walked. Ties, unseen labels and series without training rows start from
    the least class. As many rows reach the driver as there are classes.
    """
    counts = transitions(train, label, by).collect()  # classes squared
    classes = sorted(r[label] for r in train.where(F.col(label).isNotNull()).select(label).distinct().collect())
    if not classes:
        return df.withColumn("prediction", F.lit(None).cast(dict(df.dtypes).get(label, "int")))
    after = {c: min(((-r["n"], r["after"]) for r in counts if r["before"] == c and r["after"] is not None), default=(0, classes[0]))[1] for c in classes}
    paths = []
    for c in [*classes, None]:
        walk, here = [], after[c] if c is not None else classes[0]
        while here not in walk:
            walk.append(here)
            here = after[here]
        paths.append(F.struct(F.lit(c).alias("c"), F.array(*[F.lit(x) for x in walk]).alias("walk"), F.lit(walk.index(here)).alias("loop")))
    start = train.groupBy("series").agg(F.max_by(label, by).alias("__start"))
    rows = df.join(start, "series", "left").withColumn("__i", F.row_number().over(Window.partitionBy("series").orderBy(by)) - 1)
    rows = rows.withColumn("__p", F.filter(F.array(*paths), lambda p: p["c"].eqNullSafe(F.col("__start")))[0])
    loop, size = F.col("__p.loop"), F.size("__p.walk")
    place = F.when(F.col("__i") < size, F.col("__i")).otherwise(loop + F.pmod(F.col("__i") - loop, size - loop))
    return rows.withColumn("prediction", F.get("__p.walk", place)).drop("__start", "__i", "__p")


def random_guess(train: DataFrame, df: DataFrame, label: str = "label", seed: int = 42) -> DataFrame:
    """prediction: classes drawn with the shares they have in ``train``; as many numbers reach the driver as there are classes."""
    shares = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(label).collect()
    total, up, guess = sum(r["n"] for r in shares), 0, F.lit(None)
    draw, cuts = F.col("__draw"), []
    for r in shares:
        up += r["n"]
        cuts.append((up / total, r[label]))
    for top, value in reversed(cuts):
        guess = F.when(draw < top, F.lit(value)).otherwise(guess if top < 1 else F.lit(value))
    return df.withColumn("__draw", F.rand(seed)).withColumn("prediction", guess).drop("__draw")


def temporal_order(df: DataFrame, by: str = "bar_id", ts: str = "ts") -> DataFrame:
    """(series, n, n_back, in_order): rows, those whose time lies before the row's before them in the order of ``by``, and whether there is none. A null time is not compared."""
    before = F.lag(ts).over(Window.partitionBy("series").orderBy(by))
    marked = df.select("series", F.coalesce(F.col(ts) < before, F.lit(False)).alias("__back"))
    return marked.groupBy("series").agg(F.count("*").alias("n"), F.sum(F.col("__back").cast("long")).alias("n_back")).withColumn("in_order", F.col("n_back") == 0)


def temporal_split(df: DataFrame, ts: str = "ts", split: str = "split") -> DataFrame:
    """(series, train_end, test_start, apart): the last time of train, the first of test, and whether the one lies before the other; null where either part is empty."""
    end, start = F.max(F.when(F.col(split) == "train", F.col(ts))), F.min(F.when(F.col(split) == "test", F.col(ts)))
    return df.groupBy("series").agg(end.alias("train_end"), start.alias("test_start")).withColumn("apart", F.col("train_end") < F.col("test_start"))


def binary_metrics(df: DataFrame, truth: str, guess: str, score: str | None = None) -> DataFrame:
    """One row: n, accuracy, precision, recall, f1 for truth and guess of 0 and 1, and auc of the score (null without one, or where all rows are of one class).

    The area under the curve comes from the sum of average ranks of the ones; ranks are taken by ranges of scores.
    """
    t, g = F.col(truth) == 1, F.col(guess) == 1
    n = lambda c: F.sum(c.cast("long"))
    known = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    sums = known.agg(F.count("*").alias("n"), F.avg((t == g).cast("double")).alias("accuracy"), over(n(t & g), n(g)).alias("precision"), over(n(t & g), n(t)).alias("recall"), over(2 * n(t & g), n(t) + n(g)).alias("f1"))
    if score is None:
        return sums.withColumn("auc", F.lit(None).cast("double"))
    ranked = average_ranks(known.where(F.col(score).isNotNull()).select(F.col(truth).cast("long").alias("__t"), F.col(score).alias("__s")), ["__s"])
    ones, rows = F.sum("__t"), F.count("*")
    area = ranked.agg(over(F.sum(F.when(F.col("__t") == 1, F.col("__s_rank"))) - ones * (ones + 1) / 2, ones * (rows - ones)).alias("auc"))
    return sums.crossJoin(area)  # one row each
