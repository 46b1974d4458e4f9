"""Checks of what is handed in. Each raises ValueError or TypeError with the reason, on the schema alone unless it says otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fitted(operator: object, attribute: str) -> None:
    if getattr(operator, attribute, None) is None:
        raise RuntimeError("fit() comes first")


def frame(df: object, columns: Sequence[str] = ()) -> None:
    if not isinstance(df, DataFrame):
        raise TypeError("a Spark DataFrame is needed")
    if len(set(df.columns)) < len(df.columns):
        raise ValueError("column names repeat")
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(gone)}")


def binary_target(df: DataFrame, target: str) -> None:
    """One pass: the target holds 0 and 1, both, and no nulls."""
    frame(df, [target])
    row = df.agg(F.count_if(F.col(target).isNull() | ~F.col(target).isin(0, 1)).alias("odd"), F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    if row.odd or row.lo == row.hi:
        raise ValueError(f"{target} must hold 0 and 1, both, and no nulls")


def weights(df: DataFrame, weight: str) -> None:
    """One pass: no nulls, and nothing below 0."""
    frame(df, [weight])
    if df.where(F.col(weight).isNull() | (F.col(weight) < 0)).limit(1).count():
        raise ValueError(f"{weight} holds nulls or negative weights")


def values(df: DataFrame, names: Sequence[str]) -> None:
    """One pass: no infinite numbers, and numbers or text only."""
    frame(df, names)
    if odd := [f"{n} ({t})" for n, t in df.dtypes if n in names and t.split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "string", "boolean")]:
        raise TypeError(f"numbers or text are needed: {', '.join(odd)}")
    numbers = [n for n, t in df.dtypes if n in names and t in ("float", "double")]
    if numbers:
        row = df.agg(*(F.count_if(F.abs(n) == float("inf")).alias(n) for n in numbers)).first()
        if endless := [n for n in numbers if row[n]]:
            raise ValueError(f"infinite values in {', '.join(endless)}")


def breaks(table: Mapping[str, Sequence], columns: Sequence[str]) -> dict[str, list]:
    """The breaks in order, numbers rounded to three places and made distinct; unknown columns are refused."""
    if gone := [n for n in table if n not in columns]:
        raise ValueError(f"no such columns: {', '.join(gone)}")
    return {n: sorted({round(float(x), 3) for x in b}) if all(isinstance(x, (int, float)) for x in b) else list(b) for n, b in table.items()}
