"""Encoders from a fitted weight-of-evidence table: bin labels, weights of evidence, points. Each value is looked up in an array by its bin number."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binning import bin_labels, bin_number
from .report import is_numeric


def looked_up(df: DataFrame, name: str, breaks: Sequence, values: Sequence, special: Sequence, check: bool) -> Column:
    """values by bin number. Levels of no bin: an error when the row is computed, or null."""
    at = bin_number(name, breaks, is_numeric(df, name), special)
    found = F.get(F.array(*map(F.lit, values)), at)
    return F.when(at.isNull(), F.raise_error(F.concat(F.lit(f"{name}: a level of no bin: "), F.col(name).cast("string")))).otherwise(found) if check else found


class BinEncoder:
    """Values by the labels of their bins; null becomes 'missing', special values 'special'."""

    def __init__(self, breaks: Mapping[str, Sequence], special: Mapping[str, Sequence] | None = None, check_na: bool = True):
        self.breaks, self.special, self.check = dict(breaks), dict(special or {}), check_na

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: looked_up(df, n, b, bin_labels(b, is_numeric(df, n)), self.special.get(n, ()), self.check) for n, b in self.breaks.items()})


class WoeEncoder:
    """Values by weights of evidence. woe_missing and woe_special take the place of those of bins with less than distr_limit of the rows."""

    def __init__(self, breaks: Mapping[str, Sequence], special: Mapping[str, Sequence] | None = None, woe_missing: float | None = None, woe_special: float | None = None, distr_limit: float = 0.01, check_na: bool = True):
        self.breaks, self.special, self.check = dict(breaks), dict(special or {}), check_na
        self.instead, self.limit = {"missing": woe_missing, "special": woe_special}, distr_limit
        self.woe: dict[str, list[float]] | None = None

    def fit(self, table: DataFrame) -> WoeEncoder:
        """table: of variable_report(); as small as the breaks."""
        rows = sorted(table.select("variable", "bin_no", "breaks", "woe", "count_distr").collect(), key=lambda r: (r.variable, r.bin_no))
        own = lambda r: self.instead[r.breaks] if self.instead.get(r.breaks) is not None and (r.count_distr or 0.0) < self.limit else r.woe
        self.woe = {n: [float(own(r)) for r in rows if r.variable == n] for n in self.breaks}
        return self

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        if self.woe is None:
            raise RuntimeError("fit() comes first")
        return df.withColumns({f"{n}{suffix}": looked_up(df, n, b, self.woe[n], self.special.get(n, ()), self.check) for n, b in self.breaks.items()})


class CardScorer:
    """Points of a scorecard: round(-B * coefficient * woe) for each bin and round(A - B * intercept) as the row 'intercept'; halves go to even."""

    def __init__(self, coefficients: Mapping[str, float], intercept: float, odds0: float = 1 / 100, pdo: float = 50, points0: float = 600, digit: int = 0):
        self.coefficients, self.intercept, self.digit = dict(coefficients), intercept, digit
        self.b = pdo / math.log(2)
        self.a = points0 + self.b * math.log(odds0)

    def fit(self, encoder: WoeEncoder) -> CardScorer:
        self.encoder = encoder
        self.base = round(self.a - self.b * self.intercept, self.digit)
        self.points = {n: [round(-self.b * c * w, self.digit) + 0.0 for w in encoder.woe[n]] for n, c in self.coefficients.items()}
        return self

    def card(self, df: DataFrame) -> DataFrame:
        """variable, breaks, points."""
        rows = [("intercept", "", float(self.base))]
        rows += [(n, x, p) for n in self.points for x, p in zip(bin_labels(self.encoder.breaks[n], is_numeric(df, n)), self.points[n])]
        return df.sparkSession.createDataFrame(rows, "variable string, breaks string, points double")

    def transform(self, df: DataFrame) -> DataFrame:
        """df with <variable>_points and score; no row is left out."""
        e = self.encoder
        each = {f"{n}_points": looked_up(df, n, e.breaks[n], p, e.special.get(n, ()), e.check) for n, p in self.points.items()}
        out = df.withColumns(each)
        return out.withColumn("score", sum((F.col(c) for c in each), F.lit(float(self.base))))
