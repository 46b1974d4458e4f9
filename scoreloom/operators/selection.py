"""Feature filters and the scorecard."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import CardScorer, WoeEncoder
from .regression import StepLogit
from .report import absent, stacked, variable_report


def filter_statistics(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """variable, missing_rate, modal_share (null counts as a value), levels: what the missing and unique filters look at."""
    counts = stacked(df, names, "string").groupBy("variable", "value").agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n")
    return counts.groupBy("variable").agg((F.sum(F.when(absent(df, names), F.col("n")).otherwise(0.0)) / total).alias("missing_rate"), (F.max("n") / total).alias("modal_share"), F.count("value").alias("levels"))


def by_information_value(df: DataFrame, target: str, breaks: Mapping[str, Sequence], least: float = 0.02, places: int | None = None) -> DataFrame:
    """variable, total_iv of the variables above the limit; with places, values are rounded before they are compared."""
    worth = F.col("total_iv") if places is None else F.round("total_iv", places)
    return variable_report(df, target, breaks).groupBy("variable").agg(F.max(worth).alias("total_iv")).where(F.col("total_iv") > least)


def points(pdo: float = 75.0, base: float = 660.0, ratio: float = 1 / 15) -> tuple[float, float]:
    """A and B of score = A - B * log-odds."""
    b = pdo / math.log(2)
    return base + b * math.log(ratio), b


def scorecard(df: DataFrame, target: str, breaks: Mapping[str, Sequence], odds0: float = 1 / 100, pdo: float = 50, points0: float = 600, check_na: bool = True) -> tuple[DataFrame, DataFrame]:
    """(points of each bin and of the intercept, df with points and score): a binomial regression on weights of evidence.

    The fit runs on the cells of equal weights, a row for each combination of bins. Rows with a null target don't count in it but are scored;
    a level of no bin is an error, or with check_na=False gives a null score.
    """
    encoder = WoeEncoder(breaks, check_na=check_na).fit(variable_report(df, target, breaks))
    names = {n: f"{n}__woe" for n in breaks}
    fit = StepLogit().fit(encoder.transform(df, "__woe").select(target, *names.values()), list(names.values()), target)
    scorer = CardScorer({n: fit.coefficients[c] for n, c in names.items()}, fit.intercept, odds0, pdo, points0).fit(encoder)
    return scorer.card(df), scorer.transform(df)


def missing_correlation(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """one, other, corr: Pearson correlation of the null indicators of columns that have nulls."""
    flags = df.select(*(F.col(n).isNull().cast("double").alias(n) for n in names))
    held = flags.agg(*(F.sum(n).alias(n) for n in names)).first()
    some = [n for n in names if held[n]]
    if not some:
        return df.sparkSession.createDataFrame([], "one string, other string, corr double")
    pairs = [(a, b) for k, a in enumerate(some) for b in some[k + 1 :]] or [(some[0], some[0])]
    row = flags.agg(F.array(*(F.struct(F.lit(a).alias("one"), F.lit(b).alias("other"), F.corr(a, b).alias("corr")) for a, b in pairs)).alias("all"))
    return row.select(F.inline("all"))


def best_per_group(df: DataFrame, group: str, weight: str) -> DataFrame:
    """The row of highest weight of each group; of equal weights the least row by its other columns."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(weight), *(c for c in df.columns if c not in (group, weight))))).where("__place = 1").drop("__place")
