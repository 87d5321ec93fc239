"""Labels, splits and the metrics of classifiers and regressors, each metric set in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.panel import correlation, nonzero
from panelforge.operators.ranks import quantiles


def three_classes(r: Column, low: float = -0.01, high: float = 0.01) -> Column:
    """0 below ``low``, 2 above ``high``, else 1; a missing return is class 0."""
    return F.when(r.isNull() | (r < low), 0).when(r > high, 2).otherwise(1)


def class_centres(df: DataFrame, r: str, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.avg(r).alias("centre"), F.count(F.lit(1)).alias("n"))


def expected_value(probabilities: Column, centres: Column, softmax: bool = False) -> Column:
    """The mean of class centres under (soft-maxed) probabilities."""
    p = F.transform(probabilities, F.exp) if softmax else probabilities
    dot = F.aggregate(F.zip_with(p, centres, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, nonzero(F.aggregate(p, F.lit(0.0), lambda s, x: s + x))) if softmax else dot


def ordinal_probabilities(s: Column) -> Column:
    """Class probabilities from K - 1 threshold probabilities: 1 - s0, s0 - s1, ..., s(K-2)."""
    padded = F.concat(F.array(F.lit(1.0)), s, F.array(F.lit(0.0)))
    return F.zip_with(F.slice(padded, 1, F.size(padded) - 1), F.slice(padded, 2, F.size(padded) - 1), lambda a, b: a - b)


def chronological(time: Column, train_end: str, valid: tuple[str, str], test_start: str) -> Column:
    """train, valid, test or null (the embargo between them)."""
    return F.when(time <= F.lit(train_end).cast("timestamp"), "train").when(time.between(F.lit(valid[0]).cast("timestamp"), F.lit(valid[1]).cast("timestamp")), "valid").when(time >= F.lit(test_start).cast("timestamp"), "test")


def embargo_split(df: DataFrame, time: str, label_end: str, cutoff: str, embargo_hours: int, valid_share: float = 0.2) -> DataFrame:
    """Adds split: test from the cutoff on; before it, rows whose label ends before the cutoff less the embargo, the last
    ``valid_share`` of them valid and, an embargo earlier, train. The border is a quantile, not a global sort."""
    cut = F.lit(cutoff).cast("timestamp")
    usable = F.col(label_end).cast("timestamp") < cut - F.expr(f"INTERVAL {embargo_hours} HOURS")
    seconds = F.col(time).cast("timestamp").cast("double")
    border = df.filter(usable & (F.col(time).cast("timestamp") < cut))
    border = quantiles(border.select(seconds.alias("s")), "s", [1 - valid_share]).select(F.col("edges")[0].alias("__border"))
    out = df.crossJoin(F.broadcast(border))  # one row
    split = F.when(F.col(time).cast("timestamp") >= cut, "test").when(usable & (seconds >= F.col("__border")), "valid").when(usable & (F.col(label_end).cast("timestamp").cast("double") < F.col("__border")), "train")
    return out.withColumn("split", split).drop("__border")


def rolling_folds(df: DataFrame, time: str, first_years: int = 4, months: int = 3) -> DataFrame:
    """(fold, test_start, test_end, train_rows, test_rows): test windows that follow one another from ``first_years`` after
    the first row's day; a fold trains on all rows before its window. Rows are counted by day, folds by their days."""
    days = df.select(F.to_date(time).alias("__day")).filter("__day is not null").groupBy("__day").agg(F.count(F.lit(1)).alias("__n"))
    ends = days.agg(F.min("__day").alias("a"), F.max("__day").alias("b"))
    steps = F.sequence(F.lit(0), F.floor(F.greatest(F.months_between("b", "a") - 12 * first_years, F.lit(0)) / months).cast("int"))
    folds = ends.select("a", "b", F.explode(steps).alias("fold")).withColumns({k: F.add_months("a", 12 * first_years + months * (F.col("fold") + i)) for i, k in enumerate(("test_start", "test_end"))})
    folds = folds.filter(F.col("test_start") <= F.col("b")).select("fold", "test_start", "test_end")
    seen = days.join(F.broadcast(folds), F.col("__day") < F.col("test_end"))  # as many folds as quarters
    test = F.col("__day") >= F.col("test_start")
    return seen.groupBy("fold", "test_start", "test_end").agg(F.sum(F.when(~test, F.col("__n")).otherwise(0)).alias("train_rows"), F.sum(F.when(test, F.col("__n")).otherwise(0)).alias("test_rows"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """Adds fold 0..k-1: rows of each label dealt in turn, in order of a hash of the key. The rows are numbered in ranges
    of the hash, and the ranges' sizes added up."""
    hashed = F.xxhash64(key)
    at = Window.partitionBy(label, "__range").orderBy("__hash", key)
    df = df.withColumn("__hash", hashed).withColumn("__range", F.shiftright("__hash", 56))
    sizes = df.groupBy(label, "__range").agg(F.count(F.lit(1)).alias("__n"))
    lower = Window.partitionBy(label).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(label).alias("__label"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__lower"))
    df = df.join(sizes, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__range") == F.col("__r")))
    return df.withColumn("fold", F.pmod(F.col("__lower") + F.row_number().over(at) - 1, F.lit(k))).drop("__hash", "__range", "__label", "__r", "__lower")


def scaled(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns over the training rows' standard deviation, the mean left in."""
    stats = df.agg(*[F.stddev_pop(F.when(train, F.col(c))).alias(f"__{c}") for c in columns])
    return df.crossJoin(F.broadcast(stats)).withColumns({c: F.try_divide(F.col(c), nonzero(F.col(f"__{c}"))) for c in columns}).drop(*[f"__{c}" for c in columns])


def winsorised(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    edges = quantiles(df, column, [low, high]).withColumnRenamed("edges", "__e")
    x = F.col(column)
    return df.crossJoin(F.broadcast(edges)).withColumn(column, F.when(x.isNotNull(), F.least(F.greatest(x, F.col("__e")[0]), F.col("__e")[1]))).drop("__e")


def confusion(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row: confusion counts, accuracy, balanced accuracy, precision, recall, F1 and Matthews correlation."""
    t, p = F.col(truth) == 1, F.col(prediction) == 1
    n = lambda c: F.sum(F.coalesce(c.cast("double"), F.lit(0.0)))
    g = df.agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, nonzero(b)), F.lit(0.0))
    return g.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2,
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    })


def multiclass_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row: accuracy, macro and weighted F1, Matthews correlation, from the confusion matrix."""
    m = confusion(df, truth, prediction)
    rows = m.groupBy(F.col("truth").alias("k")).agg(F.sum("n").alias("t"))
    cols = m.groupBy(F.col("prediction").alias("k")).agg(F.sum("n").alias("p"))
    hits = m.filter("truth = prediction").select(F.col("truth").alias("k"), F.col("n").alias("c"))
    k = rows.join(cols, "k", "full").join(hits, "k", "left").na.fill(0)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("c"), nonzero(F.col("t") + F.col("p"))), F.lit(0.0))
    g = k.agg(F.sum("c").alias("c"), F.sum("t").alias("s"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("t")) / nonzero(F.sum("t"))).alias("weighted_f1"))
    s = F.col("s").cast("double")
    mcc = F.coalesce(F.try_divide(F.col("c") * s - F.col("tp"), nonzero(F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt"))))), F.lit(0.0))
    return g.select((F.col("c") / nonzero(s)).alias("accuracy"), "macro_f1", "weighted_f1", mcc.alias("mcc"))


def regression_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """One row: n, mse, rmse, mae, r2, correlation, share of equal signs."""
    y, e = F.col(truth), F.col(prediction) - F.col(truth)
    g = df.filter(y.isNotNull() & F.col(prediction).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(truth).alias("__v"),
        correlation(truth, prediction).alias("correlation"), F.avg((F.signum(y) == F.signum(F.col(prediction))).cast("double")).alias("sign_accuracy"),
    )
    return g.withColumn("rmse", F.sqrt("mse")).withColumn("r2", 1 - F.try_divide(F.col("mse"), nonzero(F.col("__v")))).drop("__v")


def log_loss(truth: Column, probabilities: Column, eps: float = 1e-15) -> Column:
    """The mean of -ln of the true class's probability, as an aggregate."""
    return F.avg(-F.ln(F.least(F.greatest(F.try_element_at(probabilities, truth.cast("int") + 1), F.lit(eps)), F.lit(1 - eps))))


def matrix_profile(df: DataFrame, vector: str) -> DataFrame:
    """By dimension of an array column: mean, std, missing values, least and greatest."""
    cells = df.select(F.posexplode(vector).alias("dim", "x"))
    return cells.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.sum(F.col("x").isNull().cast("long")).alias("missing"), F.min("x").alias("least"), F.max("x").alias("greatest"))
