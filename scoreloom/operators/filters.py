"""Feature filters on one pass of sums: variance, chi-square and F statistics, and the chain of all filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .autobin import BinSelector
from .binning import number
from .boosting import tree_filter
from .quantiles import percentiles
from .report import is_numeric, stacked
from .selection import filter_statistics


def variances(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """variable, variance (of the population; nulls and not-a-numbers are left out)."""
    long = stacked(df, names, "double").where("value IS NOT NULL AND NOT isnan(value)")
    return long.groupBy("variable").agg(F.var_pop("value").alias("variance"))


def f_statistics(df: DataFrame, target: str, names: Sequence[str], fill: str | None = None) -> DataFrame:
    """variable, f, df1, df2: one-way analysis of variance of each column over the classes of the target.

    Missing values are left out, or filled by max (one above the greatest), min (one below the least) or median.
    """
    data = df.where(F.col(target).isNotNull())
    if fill:
        if fill == "median":
            row = {n: p[0] if p else None for n, p in percentiles(data, {n: number(n) for n in names}, dict.fromkeys(names, [0.5])).items()}
        else:
            how = {"max": lambda c: F.max(c) + 1, "min": lambda c: F.min(c) - 1}[fill]
            row = data.agg(*(how(number(n)).alias(n) for n in names)).first()
        data = data.withColumns({n: F.coalesce(number(n), F.lit(row[n]).cast("double")) for n in names})
    long = stacked(data, names, "double", target).where("value IS NOT NULL AND NOT isnan(value)")
    parts = long.groupBy("variable", target).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    sums = parts.groupBy("variable").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("inside"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return sums.select("variable", F.try_divide(between / (F.col("k") - 1), F.col("inside") / (F.col("n") - F.col("k"))).alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))


def chi2_statistics(df: DataFrame, target: str, names: Sequence[str]) -> DataFrame:
    """variable, chi2, dof: levels as codes 0, 1, ... by name, taken as frequencies; their sums by class against the classes' shares. Null is a level, the last."""
    data = df.where(F.col(target).isNotNull())
    counts = stacked(data, names, "string", target).groupBy("variable", "value", target).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    codes = counts.select("variable", "value", target, "n", (F.dense_rank().over(Window.partitionBy("variable").orderBy(F.asc_nulls_last("value"))) - 1).alias("code"))
    by = codes.groupBy("variable", target).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("code")).alias("seen"))
    whole = Window.partitionBy("variable")
    due = by.select("variable", "seen", (F.col("n") / F.sum("n").over(whole) * F.sum("seen").over(whole)).alias("due"))
    return due.groupBy("variable").agg(F.sum(F.try_divide((F.col("seen") - F.col("due")) * (F.col("seen") - F.col("due")), F.col("due"))).alias("chi2"), (F.count("*") - 1).alias("dof"))


def _tail(df: DataFrame, kind: str, x: float | None, *shape: float) -> float:
    """The upper tail of a chi-square or F distribution, by the mathematics library that comes with Spark."""
    if x is None or min(shape) <= 0:
        return 1.0
    law = getattr(df.sparkSession._jvm.org.apache.commons.math3.distribution, kind)(*map(float, shape))
    return 1.0 - law.cumulativeProbability(float(x))


def corrected(p: Mapping[str, float], alpha: float, how: str = "fpr") -> list[str]:
    """The names that pass: fpr each by itself, fdr by Benjamini and Hochberg, fwe by Bonferroni."""
    names = sorted(p, key=lambda n: (p[n], n))
    if how == "fdr":
        last = max((k for k, n in enumerate(names, 1) if p[n] <= alpha * k / len(names)), default=0)
        return names[:last]
    return [n for n in names if p[n] < (alpha / len(p) if how == "fwe" else alpha)]


class PreSelector:
    """Filters in a row: missing rate, modal share, variance, chi-square (text) or F under any of three fills (numbers), importance in boosted trees (off unless asked for), information value of frequency bins.

    A step whose limit is None is left out; what is in keep comes back. fit() sets kept and, by step, dropped.
    """

    def __init__(self, na_pct: float | None = 0.99, unique_pct: float | None = 0.99, variance: float | None = 0.0, chif_pvalue: float | None = 0.05, iv_limit: float | None = 0.02, keep: Sequence[str] = (), correction: str = "fpr", tree_importance: float | None = None, trees: Mapping | None = None):
        self.na_pct, self.unique_pct, self.variance, self.chif, self.iv_limit, self.keep, self.correction = na_pct, unique_pct, variance, chif_pvalue, iv_limit, list(keep), correction
        self.tree_importance, self.trees = tree_importance, dict(trees or {"maxIter": 100})
        self.kept: list[str] | None = None

    def fit(self, df: DataFrame, target: str, names: Sequence[str] | None = None) -> PreSelector:
        every = list(names or [c for c in df.columns if c != target])
        left, self.dropped = list(every), {}

        def stay(step: str, good: set[str]) -> None:
            self.dropped[step] = [n for n in left if n not in good]
            left[:] = [n for n in left if n in good]

        if self.na_pct is not None or self.unique_pct is not None:
            rates = {r.variable: r for r in filter_statistics(df, left).collect()}
            if self.na_pct is not None:
                stay("missing", {n for n in left if n in rates and rates[n].missing_rate < self.na_pct})
            if self.unique_pct is not None:
                stay("unique", {n for n in left if rates[n].modal_share < self.unique_pct})
        numbers = lambda: [n for n in left if is_numeric(df, n)]
        if self.variance is not None and numbers():
            spread = {r.variable: r.variance for r in variances(df, numbers()).collect()}
            stay("variance", {n for n in left if not is_numeric(df, n) or spread.get(n, 0.0) > self.variance})
        if self.chif is not None and left:
            good: set[str] = set()
            if numbers():
                for fill in ("max", "median", "min"):
                    good |= set(corrected({r.variable: _tail(df, "FDistribution", r.f, r.df1, r.df2) for r in f_statistics(df, target, numbers(), fill).collect()}, self.chif, self.correction))
            if text := [n for n in left if not is_numeric(df, n)]:
                good |= set(corrected({r.variable: _tail(df, "ChiSquaredDistribution", r.chi2, r.dof) for r in chi2_statistics(df, target, text).collect()}, self.chif, self.correction))
            stay("chi2 or F", good)
        if self.tree_importance is not None and left:
            stay("trees", set(tree_filter(df, target, left, self.tree_importance, params=self.trees)))
        if self.iv_limit is not None and left:
            stay("iv", set(BinSelector("freq", bin_num_limit=30, iv_limit=self.iv_limit, levels=1000).fit(df, target, left).kept))
        self.kept = [n for n in every if n in left or n in self.keep]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.kept is None:
            raise RuntimeError("fit() comes first")
        return df.select(*self.kept)
