"""Cleaning: statistics are fitted in aggregates and applied as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binning import number
from .quantiles import percentiles
from .validate import fitted


def first_by_id(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """One row per id: the first in the given order."""
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def standardised(df: DataFrame, id_col: str, order: Sequence[str], without: Sequence[str] = ()) -> DataFrame:
    """The first row of each id in the given order, without the columns that are not wanted."""
    return first_by_id(df, id_col, order).drop(*without)


def allocated(df: DataFrame, kinds: dict[str, Sequence[str]] | None = None, keep: Sequence[str] = (), drop_date: bool = False, places: int = 10) -> DataFrame:
    """Columns cast to numbers (double), text or dates.

    kinds: column names under num, str and date; a date loses all but its digits first, yyyyMMdd. A column under two kinds is refused. Without
    kinds all numbers and booleans become doubles rounded to so many places, and dates become days since 1970, or go. Columns in keep stay as they are.
    """
    if kinds:
        named = [c for cols in kinds.values() for c in cols]
        if len(named) > len(set(named)) or set(named) & set(keep) or set(kinds) - {"num", "str", "date"}:
            raise ValueError("a column belongs to one kind: num, str or date")
        how = {"num": lambda c: F.col(c).try_cast("double"), "str": lambda c: F.col(c).cast("string"), "date": lambda c: F.try_to_timestamp(F.regexp_replace(F.col(c).cast("string"), "[^0-9]", ""), F.lit("yyyyMMdd"))}
        return df.withColumns({c: how[k](c) for k, cols in kinds.items() for c in cols})
    out = []
    for c, t in df.dtypes:
        base = t.split("(")[0]
        if c in keep or base == "string":
            out.append(F.col(c))
        elif base in ("date", "timestamp", "timestamp_ntz"):
            out += [] if drop_date else [F.unix_date(F.col(c).cast("date")).cast("double").alias(c)]
        elif base in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean"):
            out.append(F.bround(F.col(c).cast("double"), places).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def replaced(df: DataFrame, special: dict[str, Sequence] | Sequence, by=None) -> DataFrame:
    """Special values by another value: of each named column, or a list that holds for all columns of its values' kind."""
    if not isinstance(special, dict):
        text, numbers = [v for v in special if isinstance(v, str)], [v for v in special if not isinstance(v, str)]
        special = {c: text if t == "string" else numbers for c, t in df.dtypes if (text if t == "string" else numbers) and (t == "string" or t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))}
    return df.withColumns({c: F.when(F.col(c).isin(list(v)), F.lit(by).cast(dict(df.dtypes)[c])).otherwise(F.col(c)) for c, v in special.items()})


class Outliers:
    """Values at or beyond three interquartile ranges from the quartiles (at or beyond the 1st and 99th percentile if that range is 0)."""

    def __init__(self, columns: Sequence[str], method: str = "fill"):
        if method not in ("fill", "nan"):
            raise ValueError("method is fill or nan")
        self.columns, self.method, self.bounds = list(columns), method, None

    def fit(self, df: DataFrame) -> Outliers:
        row = percentiles(df, {c: number(c) for c in self.columns}, dict.fromkeys(self.columns, (0.01, 0.25, 0.75, 0.99)))
        self.bounds = {}
        for c in self.columns:
            if row[c]:
                p1, q1, q3, p99 = row[c]
                self.bounds[c] = (q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)) if q3 > q1 else (p1, p99)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        fitted(self, "bounds")

        def one(c: str) -> Column:
            low, high = self.bounds[c]
            x = F.col(c).cast("double")
            fill = lambda v: F.lit(v if self.method == "fill" else None).cast("double")
            return F.when(F.isnan(x), x).when(x <= low, fill(low)).when(x >= high, fill(high)).otherwise(x)

        return df.withColumns({c: one(c) for c in self.bounds})


class Missing:
    """Fills nulls and not-a-numbers: numeric by constant, mean, median or mode, strings by constant or mode (ties to the smallest). Adds <column>_isnan where asked."""

    def __init__(self, numeric: Sequence[str] = (), strings: Sequence[str] = (), method: tuple[str, str] = ("mean", "constant"), constant: tuple = (0.0, "missing"), indicator: bool = False):
        self.numeric, self.strings, self.method, self.constant, self.indicator, self.fill = list(numeric), list(strings), method, constant, indicator, {}

    def fit(self, df: DataFrame) -> Missing:
        def one(c: str, text: bool) -> Column:
            x = F.col(c) if text else number(c)
            return {"constant": F.lit(self.constant[text]), "mean": F.avg(x) if not text else None, "median": F.lit(medians[c][0] if medians.get(c) else None).cast("double") if not text else None, "most_frequent": F.mode(x, True)}[self.method[text]]

        medians = percentiles(df, {c: number(c) for c in self.numeric}, dict.fromkeys(self.numeric, [0.5])) if self.method[0] == "median" else {}
        columns = [(c, False) for c in self.numeric] + [(c, True) for c in self.strings]
        row = df.agg(*(one(c, t).alias(f"v{k}") for k, (c, t) in enumerate(columns)), *(F.count_if(self._gone(c, t)).alias(f"n{k}") for k, (c, t) in enumerate(columns))).first()
        self.fill = {c: row[f"v{k}"] for k, (c, _) in enumerate(columns)}
        self.flagged = [c for k, (c, _) in enumerate(columns) if row[f"n{k}"]]
        return self

    @staticmethod
    def _gone(c: str, text: bool) -> Column:
        return F.col(c).isNull() if text else F.col(c).isNull() | F.isnan(F.col(c).cast("double"))

    def transform(self, df: DataFrame) -> DataFrame:
        text = set(self.strings)
        flags = {f"{c}_isnan": self._gone(c, c in text).cast("int") for c in self.flagged} if self.indicator else {}
        return df.withColumns(flags | {c: F.when(self._gone(c, c in text), F.lit(v)).otherwise(F.col(c)) for c, v in self.fill.items()})
