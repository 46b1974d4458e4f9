"""Evaluation of scores: threshold table, its summary, confusion matrix, best cut, calibration and density."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def thresholds(df: DataFrame, score: str, target: str, weight: str | None = None, low_is_bad: bool = False) -> DataFrame:
    """One row per distinct score, highest risk first: tp, fp, tpr, fpr, precision, cumpop, ks, lift, f1. Rows with a null take no part.

    Rows are summed by score before the running sums, so the ordered part is as large as the distinct scores.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(target).cast("double")
    kept = df.select((F.negate(F.col(score)) if low_is_bad else F.col(score)).cast("double").alias("pred"), (w * y).alias("p"), (w * (1 - y)).alias("n")).dropna()
    sums = kept.groupBy("pred").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    totals = F.broadcast(sums.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")))  # one row
    upto = Window.orderBy(F.desc("pred")).rowsBetween(Window.unboundedPreceding, 0)
    t = sums.select("pred", F.sum("p").over(upto).alias("tp"), F.sum("n").over(upto).alias("fp")).crossJoin(totals)
    t = t.withColumn("tpr", F.try_divide("tp", "all_p")).withColumn("fpr", F.try_divide("fp", "all_n")).withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    return t.select("pred", "tp", "fp", "tpr", "fpr", "precision", ((F.col("tp") + F.col("fp")) / (F.col("all_p") + F.col("all_n"))).alias("cumpop"), F.abs(F.col("tpr") - F.col("fpr")).alias("ks"),
        F.try_divide(F.col("precision"), F.col("all_p") / (F.col("all_p") + F.col("all_n"))).alias("lift"), F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_p")).alias("f1"))


def summary(table: DataFrame) -> DataFrame:
    """ks, auc, gini and best f1 of a threshold table."""
    order = Window.orderBy("fpr", "tpr")
    area = (F.col("fpr") - F.lag("fpr", 1, 0.0).over(order)) * (F.col("tpr") + F.lag("tpr", 1, 0.0).over(order)) / 2
    return table.select("ks", "f1", area.alias("area")).agg(F.max("ks").alias("ks"), F.sum("area").alias("auc"), (2 * F.sum("area") - 1).alias("gini"), F.max("f1").alias("best_f1"))


def confusion(df: DataFrame, score: str, target: str, cutoff: float = 0.5, weight: str | None = None) -> DataFrame:
    """actual, predicted, n and its share of all, of the actual and of the predicted class."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    kept = df.select(F.col(target).cast("int").alias("actual"), (F.col(score) > cutoff).cast("int").alias("predicted"), w.alias("w")).dropna()
    sums = kept.groupBy("actual", "predicted").agg(F.sum("w").alias("n"))
    of = lambda *keys: F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return sums.select("actual", "predicted", "n", of(F.lit(1)).alias("of_all"), of("actual").alias("of_actual"), of("predicted").alias("of_predicted"))


def bucketed_thresholds(df: DataFrame, score: str, target: str, buckets: int = 1000, weight: str | None = None, low_is_bad: bool = False) -> DataFrame:
    """thresholds() over at most so many buckets of equal width: the ordered part has that many rows, whatever the score's values. pred is a bucket's lower edge."""
    x = F.col(score).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    width = (high - low) / buckets if low is not None and high > low else 1.0
    edge = F.lit(low or 0.0) + F.least(F.floor((x - F.lit(low or 0.0)) / width), F.lit(buckets - 1)) * width
    return thresholds(df.withColumn("__edge", edge), "__edge", target, weight, low_is_bad)


def low_is_bad(df: DataFrame, score: str, target: str) -> bool:
    """Whether low scores go with the target: the sign of the correlation."""
    return (df.agg(F.corr(F.col(score).cast("double"), F.col(target).cast("double"))).first()[0] or 0.0) < 0


def best_cut(table: DataFrame, beta: float = 1.0) -> DataFrame:
    """pred, fbeta: the threshold of greatest F-beta of a threshold table; ties to the higher threshold."""
    b = beta * beta
    return table.select("pred", F.try_divide((1 + b) * F.col("precision") * F.col("tpr"), b * F.col("precision") + F.col("tpr")).alias("fbeta")).orderBy(F.desc_nulls_last("fbeta"), F.desc("pred")).limit(1)


def calibration(df: DataFrame, score: str, target: str, bins: int = 10, weight: str | None = None) -> DataFrame:
    """bin, n, mean_score, event_rate: scores from 0 to 1 in bins of equal width. Rows with a null take no part."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x, y = F.col(score).cast("double"), F.col(target).cast("double")
    kept = df.select(F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int").alias("bin"), w.alias("w"), (w * x).alias("wx"), (w * y).alias("wy")).dropna()
    return kept.groupBy("bin").agg(F.sum("w").alias("n"), (F.sum("wx") / F.sum("w")).alias("mean_score"), (F.sum("wy") / F.sum("w")).alias("event_rate"))


def density(df: DataFrame, score: str, target: str, bins: int = 50) -> DataFrame:
    """label, bin, low, density: a histogram of each class over the common range, of area 1 each."""
    x = F.col(score).cast("double")
    kept = df.select(F.col(target).cast("int").alias("label"), x.alias("x")).dropna()
    low, high = kept.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "label int, bin int, low double, density double")
    width = (high - low) / bins if high > low else 1.0
    at = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("int")
    sums = kept.groupBy("label", at.alias("bin")).agg(F.count("*").alias("n"))
    return sums.select("label", "bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.col("n") / F.sum("n").over(Window.partitionBy("label")) / width).alias("density"))


def mean_log_loss(df: DataFrame, score: str, target: str) -> DataFrame:
    """log_loss over the rows without nulls."""
    from ..functions import log_loss

    kept = df.select(F.col(target).cast("double").alias("y"), F.col(score).cast("double").alias("p")).dropna()
    return kept.agg(F.avg(log_loss(F.col("y"), F.col("p"))).alias("log_loss"))
